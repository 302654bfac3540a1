"""Quality classifier: a byte-level convolutional network in numpy over whole documents.

A text's bytes are cut into overlapping chunks that cover all of it; learned filters run over each
chunk and are max-pooled; a document's largest and mean pooled values over its chunks give one
probability. Only bytes are inputs. The network is trained on the driver from a bounded sample of
labelled rows: in the order of a hash of their id, up to ``sample`` rows whose texts come to no more than
``TRAIN_BYTES`` together (a row that would go beyond is left out, the next may still fit). Training reads their
texts whole, as scoring does. The few thousand weights go out with the scoring tasks.

Nulls count as empty texts, which have one chunk of padding and get a score like others. Labels that
are null are left out; of several labels for one id the largest counts. With no labels, or one class
alone, the score is the smoothed share of label 1 for all. Repeated rows are scored each; a null id is
carried and is not held out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require
from .convnet import Net, sigmoid

CHUNK, STEP = 512, 448
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH, RATE, SEED = 3000, 32 << 20, 14, 32, 4e-3, 7
KERNEL = 16
#: A row of the rarer label counts as often as the other label is more frequent, but so many times at most.
WEIGHT = 4.0
#: Share of readings in training that take a short piece of a text in place of all of it, so that short texts are known too.
PIECES = 0.2
AT_ONCE = 128  # chunks that go through the network at a time


def chunks(data: bytes) -> np.ndarray:
    """Overlapping rows of CHUNK bytes over all of ``data``, the last one padded with zeros."""
    n = 1 + max(0, -(-(len(data) - CHUNK) // STEP))
    full = np.frombuffer(data + bytes((n - 1) * STEP + CHUNK - len(data)), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK)[::STEP]


class Classifier:
    def __init__(self, net: Net | None, prior: float):
        self.net, self.prior = net, prior

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return self.net.pool(x, [None])[0][0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.prior)
        features, held, owners = np.zeros((len(texts), 2 * self.net.filters), np.float32), [], []
        counts = np.zeros(len(texts))

        def flush() -> None:
            if held:
                p, who = self.pooled(np.concatenate(held)), np.concatenate(owners)
                np.maximum.at(features[:, : self.net.filters], who, p)
                np.add.at(features[:, self.net.filters :], who, p)
                held.clear()
                owners.clear()

        for i, t in enumerate(texts):
            c = chunks(t)
            counts[i] = len(c)
            for at in range(0, len(c), AT_ONCE):
                held.append(c[at : at + AT_ONCE])
                owners.append(np.full(len(held[-1]), i))
                if sum(map(len, held)) >= AT_ONCE:
                    flush()
        flush()
        features[:, self.net.filters :] /= counts[:, None]
        return sigmoid(self.net.head(features)[1])


def blocks(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The chunks of several texts one after another, at most AT_ONCE at a time."""
    held, size = [], 0
    for c in rows:
        for at in range(0, len(c), AT_ONCE):
            part = c[at : at + AT_ONCE]
            if size + len(part) > AT_ONCE:
                yield np.concatenate(held)
                held, size = [], 0
            held.append(part)
            size += len(part)
    if held:
        yield np.concatenate(held)


def piece(text: bytes, rng: np.random.Generator) -> bytes:
    """A random stretch of at most a chunk's length."""
    size = int(rng.integers(24, CHUNK + 1))
    at = int(rng.integers(0, max(1, len(text) - size + 1)))
    return text[at : at + size]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Classifier:
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if len(np.unique(labels)) < 2:
        return Classifier(None, float(prior))
    net, rng = Net(seed, kernel=KERNEL), np.random.default_rng(seed)
    f, share = net.filters, labels.mean()
    rarer = 1.0 if share < 0.5 else 0.0
    weight = np.where(labels == rarer, min(WEIGHT, max(share, 1 - share) / min(share, 1 - share)), 1.0)
    net.p["b2"][:] = np.log(prior / (1 - prior))
    rows = [chunks(t) for t in texts]  # views of the texts
    batches = -(-len(texts) // BATCH)
    mean, seen = net.zero(), 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(batches):
            own = order[k::batches]
            read = [chunks(piece(texts[i], rng)) if rng.random() < PIECES else rows[i] for i in own]
            counts = np.array([len(c) for c in read])
            who, starts = np.repeat(np.arange(len(own)), counts), np.cumsum(counts) - counts
            parts = list(blocks(read))
            pools = [net.pool(x, [None])[0] for x in parts]
            pooled, n = np.concatenate([p for p, _ in pools]), counts[:, None]
            largest = np.maximum.reduceat(pooled, starts)
            features = np.hstack([largest, np.add.reduceat(pooled, starts) / n]).astype(np.float32)
            h, z = net.head(features)
            g = net.zero()
            df = net.head_gradient(features, h, ((sigmoid(z) - labels[own]) * weight[own] / len(own)).astype(np.float32), g)
            first = (pooled == largest[who]) & (pooled > 0)
            ties = np.maximum(np.add.reduceat(first.astype(np.float32), starts), 1)
            back = first * (df[:, :f] / ties)[who] + (df[:, f:] / n)[who]
            at = 0
            for x, (p, places) in zip(parts, pools):
                net.pool_gradient(x, p, places, back[at : at + len(x)], g)
                at += len(x)
            net.step(g, RATE * (1 - epoch / epochs) + 1e-4)
            if epoch >= epochs // 2:  # the mean of the later weights is steadier than the last
                seen += 1
                for key, value in net.p.items():
                    mean[key] += (value - mean[key]) / seen
    net.p = mean
    return Classifier(net, float(prior))


def held_out(id_: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = TRAIN_BYTES) -> Classifier:
    """Train on at most ``sample`` labelled rows that are not held out, of at most ``most_bytes`` together."""
    usable = require(labels, id_col, label).filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(id_col).agg(F.max(label).alias("label")).select(F.col(id_col).alias("id"), "label", F.xxhash64(id_col).alias("place")).orderBy("place", "id").limit(sample)
    texts = require(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(chosen), "id").groupBy("id", "place").agg(F.max(F.octet_length("text")).alias("size")).orderBy("place", "id").collect()  # `sample` numbers at most
    room, taken = most_bytes, []
    for r in sizes:
        if r["size"] <= room:
            room -= r["size"]
            taken.append(r["id"])
    if not taken:
        return train([], np.zeros(0))
    ids = docs.sparkSession.createDataFrame([(i,) for i in taken], require(docs, id_col).withColumnRenamed(id_col, "id").schema)
    rows = texts.join(F.broadcast(ids.join(chosen, "id")), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = sorted(rows.collect(), key=lambda r: r["id"])  # bounded by `most_bytes`
    return train([r["text"].encode("utf-8") for r in found], np.array([float(r["label"]) for r in found]))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """Every row of ``docs`` with whether it is held out, the score of its whole text, and 1 or 0, under ``names``; columns that ``docs`` has under these are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # some thousand weights
    new = f"`{names[0]}` boolean, `{names[1]}` double, `{names[2]}` int"
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    body = docs.select(*[docs[c] for c in kept]).withColumn(names[0], held_out(docs[id_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            scores = np.zeros(len(texts))
            start, held = 0, []
            for i in range(len(texts)):
                held.append((texts[i].as_py() or "").encode("utf-8"))
                if len(held) == 64 or i == len(texts) - 1:
                    scores[start : i + 1] = model.scores(held)
                    start, held = i + 1, []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*batch.schema.names, *names[1:]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return body.mapInArrow(run, f"{schema}{', ' * bool(schema)}{new}")
