import zlib

import numpy as np
import pytest

from fieldglass.llm import quality
from fieldglass.llm.common import table
from fieldglass.llm.convnet import Net, sigmoid

DATA = "/root/testdata/sf0.01"


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(range(1, 251)) * 20
        c = quality.chunks(data[:n])
        seen = np.zeros(n, bool)
        for k, row in enumerate(c):
            part = data[:n][k * quality.STEP : k * quality.STEP + quality.CHUNK]
            assert row[: len(part)].tobytes() == part and not row[len(part) :].any()
            seen[k * quality.STEP : k * quality.STEP + quality.CHUNK] = True
        assert seen.all() and (len(c) == 1 or n > (len(c) - 1) * quality.STEP)


def test_gradients_equal_differences():
    net = Net(3, filters=4, hidden=5)
    x = np.random.default_rng(0).integers(0, 256, (6, 40)).astype(np.uint8)
    y = np.array([0, 1, 0, 1, 1, 0.0])

    def loss():
        pooled = net.pool(x, [None, np.arange(9) < 4 + np.zeros((6, 1))])
        _, z = net.head(np.hstack([p for p, _ in pooled]))
        p = sigmoid(z)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    pooled = net.pool(x, [None, np.arange(9) < 4 + np.zeros((6, 1))])
    f = np.hstack([p for p, _ in pooled])
    h, z = net.head(f)
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    d = net.head_gradient(f, h, sigmoid(z) - y, g)
    for j, (p, at) in enumerate(pooled):
        net.pool_gradient(x, p, at, d[:, 4 * j : 4 * j + 4], g)
    rng = np.random.default_rng(1)
    for k, v in net.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in v.shape)
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=2e-3)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = quality.fit(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    right = np.mean([r.predicted == r.quality for r in out])
    assert right >= 0.93 and right > np.mean([r.quality for r in out]) + 0.04
    clean = [r for r in out if r.quality == 1]
    assert np.mean([r.predicted for r in clean]) >= 0.97
    pairs = [(a.score > b.score) for a in out if a.quality == 1 for b in out if b.quality == 0]
    assert np.mean(pairs) >= 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x) for x in (labels, other))
    assert all((a.net.p[k] == b.net.p[k]).all() for k in a.net.p)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 7.0), (2, "", 7.0), (None, "x", 7.0), (4, "long " * 50_000, 7.0), (4, "long " * 50_000, 7.0)], "doc_id long, text string, score double")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.net is None and none.prior == 0.5
    alone = quality.fit(docs, spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 1), (4, 1)], "doc_id long, quality int"))
    assert alone.net is None and alone.prior > 0.5
    model = quality.train([b"good words here"] * 20 + [b"### *** %%%"] * 20, np.array([1.0] * 20 + [0.0] * 20))
    rows = quality.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].score == by[2].score and by[None].held_out is False
    assert quality.score(docs.limit(0), model).count() == 0
    assert model.scores([b"good words here"])[0] > 0.5 > model.scores([b"*** ### %%%"])[0]


def test_scores_do_not_depend_on_company():
    model = quality.train([b"good words here"] * 20 + [b"### *** %%%"] * 20, np.array([1.0] * 20 + [0.0] * 20))
    texts = [b"a" * n for n in (0, 10, 600, 300_000)]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-6)
