import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import DATA, check

from fieldglass.llm import lexical, neighbours, vector_codes
from fieldglass.llm.queries import ORACLE, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, code string, node long, half string, id long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, "h", 7) for i, v, label in rows], VECTORS)


def random_rows(n, width, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    if copies:
        x[rng.choice(n, copies, replace=False)] = x[0]
    return [(i, x[i].tolist(), int(i % 3) if i % 7 else None) for i in range(n)]


# codes


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_lexical_search"])
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name])


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(0, 6), st.integers(0, 2**32), st.sampled_from([2, 50, 1 << 25]))
def test_ball_tree_equals_a_scan_of_all_entries(n, width, seed, most):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-most, most, (n, width))
    parts = np.concatenate([rng.integers(-most, most, (50, width)), entries[: min(20, n)]])
    index, d = vector_codes.BallTree(entries).nearest(parts)
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == every.argmin(axis=1).tolist() and d.tolist() == every.min(axis=1).tolist()


def plain_codes(rows):
    """Scan of all entries, integers of any size."""
    kept = sorted([(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)], key=lambda r: (r[0], r[1]))
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    w = len(ints[0]) // 4
    parts = [[v[k * w : (k + 1) * w] for v in ints] for k in range(4)]
    books = [p[:256] for p in parts]

    def assign(k):
        out = []
        for p in parts[k]:
            out.append(min((sum((a - b) ** 2 for a, b in zip(p, e)), j) for j, e in enumerate(books[k])))
        return out

    for _ in range(4):
        for k in range(4):
            groups = {}
            for p, (_, j) in zip(parts[k], assign(k)):
                groups.setdefault(j, []).append(p)
            books[k] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[k])]
    final = [assign(k) for k in range(4)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(final[k][r][0] for k in range(4)) for r in range(len(kept))]
    by = Counter()
    for (_, _, label), e in zip(kept, errors):
        by[label] += e
    return sorted((i, "".join(f"{final[k][r][1]:02x}" for k in range(4)), errors[r], by[label], digest) for r, (i, _, label) in enumerate(kept))


@pytest.mark.parametrize("n,width,copies", [(400, 8, 0), (600, 12, 250), (40, 4, 0), (1, 4, 0)])
def test_codes_equal_brute_force(spark, rows, n, width, copies):
    data = random_rows(n, width, n, copies)
    data += [(10_000, None, 1), (10_001, [None] + [0.0] * (width - 1), 1), (10_002, [float("nan")] * width, None), (10_003, [float("-inf")] * width, 0), (5, data[0][1], 2)]
    got = sorted(map(tuple, vector_codes.compress(vectors(spark, data).repartition(5)).collect()))
    assert got == plain_codes(data)


def test_odd_vectors_have_defined_codes(spark):
    data = [(1, [0.5] * 6, 1), (2, [0.25] * 6, 1), (3, [0.5] * 5, 1), (4, [1e30] * 6, None), (5, [-0.5] * 6, None)]
    got = {r.vec_id: r for r in vector_codes.compress(vectors(spark, data)).collect()}
    assert got[1].code == "00000000" and got[2].code == "01010101" and got[5].error == 0
    assert got[3].code is None and got[3].error is None and got[4].code is None and got[3].label_error == 0
    assert vector_codes.compress(vectors(spark, [])).collect() == [] == vector_codes.compress(vectors(spark, [(1, None, 1)])).collect()
    assert [r.code for r in vector_codes.compress(vectors(spark, [(1, [], 1), (2, [], 1)])).collect()] == ["00000000"] * 2
    assert {r.code for r in vector_codes.compress(vectors(spark, [(1, [1e30] * 4, 1), (2, [1.0], 1)])).collect()} == {None}


# lexical search


def plain_search(docs, items, top=20):
    term = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    texts = [(i, term(t)) for i, t in docs]
    n, length = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for place, (i, t) in enumerate(texts):
            tf = Counter(t)
            m = 75 + 25 * len(t) * n // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in term(text) if tf[w])
            if s > 0:
                scored.append((-s, i, place))
        out += [(item, k + 1, i, -s) for k, (s, i, _) in enumerate(sorted(scored)[:top])]
    return sorted(out)


WORDS = ["the", "The", "ÉTÉ", "été", "x1", "x-1", "日本", "a_b", "naïve", "", "\x7f", "\x80", "zebra", "q" * 300]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=30), max_size=30), st.lists(st.lists(st.sampled_from(WORDS), max_size=8), max_size=5))
def test_search_equals_brute_force(spark, texts, items):
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(3, None)]
    asked = [(i, ".".join(t)) for i, t in enumerate(items)] + [(99, None)]
    d = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in docs], "doc_id long, text string, row long, bucket string, n long").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id long, text string, term int")
    assert sorted(map(tuple, lexical.ranked(d, q).collect())) == plain_search(docs, asked)


def test_long_text_repeated_rows_and_empty_tables(spark):
    docs = [(1, "w " * 300_000 + "rare"), (1, "rare w"), (2, "rare w"), (2, "rare w"), (None, "rare"), (7, "é" * 200_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "rare"), (1, "rare é")], "item_id long, text string")
    got = lexical.ranked(d, q).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5] and [r.doc_id for r in got].count(2) == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.ranked(none, q).collect() == [] == lexical.ranked(d, spark.createDataFrame([], "item_id long, text string")).collect()


def test_search_that_shuffles_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    small = sorted(map(tuple, lexical.ranked(docs, items).collect()))
    for module in (lexical, __import__("fieldglass.llm.common", fromlist=["x"])):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, lexical.ranked(docs, items).collect())) == small


def test_no_document_crosses_tasks_to_be_summed(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    index = lexical.build(docs)
    plan = lexical.search(spark, index, lexical.count_terms(items, "item_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" in plan and "hashpartitioning(row" not in plan and "WindowGroupLimit" in plan and "Bucketed: true" in plan
    index.drop(spark)


# neighbours


def recall(spark, rows, every, n=5):
    got = {}
    for r in neighbours.nearest_rows(vectors(spark, rows).repartition(3), every).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {}
    for i, v, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or [])):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            whole.setdefault(i, v)
    ids = np.array(sorted(whole))
    x = np.array([whole[i] for i in ids], np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    hits = total = 0
    assert set(got) == {i for i in ids.tolist() if i % every == 0 and len(ids) > 1}
    for q, found in got.items():
        at = ids.tolist().index(q)
        cos = x @ x[at] / (norm * norm[at])
        others = [j for j in range(len(ids)) if j != at]
        best = sorted(others, key=lambda j: (-cos[j], ids[j]))[:n]
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(best) + 1)) and q not in [f[1] for f in found]
        assert all(abs(cos[ids.tolist().index(i)] - s) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += sum(s >= cos[best[-1]] - 1e-12 for _, _, s in found)
        total += len(best)
    return hits / max(total, 1)


def test_neighbours_found(spark):
    assert recall(spark, random_rows(1500, 32, 1), 50) >= 0.95


def test_copies_are_one_node_and_ties_go_by_id(spark):
    data = random_rows(300, 16, 2, copies=120)
    assert recall(spark, data, 10) >= 0.95
    got = [(r["rank"], r.vec_id) for r in neighbours.nearest_rows(vectors(spark, [(i, [1.0, 2.0], 0) for i in range(0, 20)]), 10).collect() if r.query_id == 10]
    assert sorted(got) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_odd_vectors_take_no_part(spark):
    data = [(0, [1.0, 0.0], 0), (50, [0.0, 0.0], 0), (51, None, 0), (52, [None, 1.0], 0), (53, [float("inf"), 1.0], 0), (54, [], 0), (55, [1.0, 1.0, 1.0], 0), (56, [1.0, 1.0], 0), (56, [3.0, 1.0], 0), (100, [3e38, 3e38], 0), (None, [1.0, 1.0], 0)]
    assert recall(spark, [r for r in data if r[0] != 55], 50) == 1.0
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest_rows(vectors(spark, data), 50).collect()}
    assert got == {(0, 56), (0, 100), (100, 0), (100, 56)}
    assert neighbours.nearest_rows(vectors(spark, []), 50).collect() == [] == neighbours.nearest_rows(vectors(spark, [(0, [1.0], 0)]), 50).collect()


def test_queries_from_outside_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 8 * 16 * 7)
    data = random_rows(400, 16, 3)
    graph = neighbours.build(vectors(spark, data))
    asked = [(1000 + i, [float(x) + 0.01 for x in data[i][1]]) for i in range(20)]
    got = neighbours.search(graph, spark.createDataFrame(asked, "id long, v array<float>"), 1).collect()
    assert {(r.query_id - 1000, r.vec_id) for r in got} == {(i, i) for i in range(20)}
    graph.drop()
