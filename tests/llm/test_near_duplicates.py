import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldglass.llm import simhash, similar
from fieldglass.llm.common import table

COLS = "doc_id long, text string, bits string, component_id string, label string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "b", "c", "l") for i, t in rows], COLS)


def plain_fingerprint(text, size=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


TEXTS = [None, "", " \t\n", "One two", "one TWO", "one\x0btwo", "a b c d", "A b c d", "É b c", "é b c", "x " * 5000, "one two three four five six seven", "one two three four five six eight"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.majority(simhash.shingle_hashes(text, 3)) == plain_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.integers(0, 2**32), st.integers(0, 5))
def test_forest_equals_brute_force(seeds, seed, radius):
    rng = random.Random(seed)
    values = set(seeds)
    for v in list(values) * 12:
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randint(0, 63)
        values.add(v)
    values = np.array(sorted(values), np.uint64)
    a, b = simhash.forest(values, radius)
    got = groups(values.tolist(), zip(a.tolist(), b.tolist()))
    near = [(x, y) for x, y in itertools.combinations(values.tolist(), 2) if (x ^ y).bit_count() <= radius]
    assert got == groups(values.tolist(), near) and len(a) < len(values)


def test_index_prunes_but_misses_nothing():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    index = simhash.GrayIndex(values)
    found = Counter()
    for q, m in index.near(index.values, 18):
        found.update(zip(q.tolist(), m.tolist()))
    want = sum(int((np.bitwise_count(index.values ^ v) <= 18).sum()) for v in index.values)
    assert len(found) == want and max(found.values()) == 1


@pytest.mark.parametrize("cell", [3, 8192])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(200)) for _ in range(4)]
    data = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(40):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(200)] = "new"
        data.append((100 + i, " ".join(words)))
    data += [(3, "One two"), (None, "one two")]
    prints = [(i, plain_fingerprint(t)) for i, t in data]
    near = [(x, y) for x, y in itertools.combinations({p for _, p in prints}, 2) if (x ^ y).bit_count() <= 3]
    top = groups({p for _, p in prints}, near)
    least = {}
    for i, p in prints:
        if i is not None:
            least[top[p]] = min(least.get(top[p], i), i)
    want = Counter((i, f"{p:016x}", least.get(top[p])) for i, p in prints)
    got = simhash.near_duplicates(docs(spark, *data))
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(docs(spark)).count() == 0


def test_components_of_a_long_path(spark):
    order = random.Random(1).sample(range(300), 300)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299) if i % 100 != 99], "a long, b long")
    got = {r.vertex: r.label for r in simhash.components(edges).collect()}
    want = {v: min(order[k : k + 100]) for k in (0, 100, 200) for v in order[k : k + 100]}
    assert {v: got.get(v, v) for v in order} == want


def kept_by_brute_force(data, threshold=0.8):
    sets = {k: frozenset(simhash.shingle_hashes(t, 5).tolist()) for k, (_, t) in enumerate(data)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) and sets[a]]
    return groups(sets, linked)


@pytest.mark.parametrize("cell", [4, 1024])
def test_keep_one_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(similar, "CELL", cell)
    rng = random.Random(9)
    data = [(i, t) for i, t in enumerate(TEXTS)]
    for g in range(6):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(150)]
        for i in range(8):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(150)] = f"n{rng.randint(0, 99)}"
            data.append((100 + 10 * g + i, " ".join(own)))
    top = kept_by_brute_force(data)
    want = {}
    for k, (i, _) in enumerate(data):
        want[top[k]] = min(want.get(top[k], i), i)
    again = [*data, (105, dict(data)[105]), (11, TEXTS[11])]
    got = similar.keep_one(docs(spark, *again))
    assert got.columns == [c.split()[0] for c in COLS.split(", ")]
    assert sorted(r.doc_id for r in got.collect()) == sorted(want.values())
    assert similar.keep_one(docs(spark)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    got = similar.keep_one(docs(spark, (None, "a b c"), (None, "a b c"), (2, "a b c"), (3, "z")))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 3), (True, 0)]


def test_whole_table_equals_brute_force(spark):
    data = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    top = kept_by_brute_force(data)
    want = {}
    for k, (i, _) in enumerate(data):
        want[top[k]] = min(want.get(top[k], i), i)
    got = similar.keep_one(table(spark, "/root/testdata/sf0.001", "documents"))
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(want.values())


def test_repeated_phrases_do_not_part_near_copies(spark):
    rng = random.Random(2)
    data = []
    for g in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(210)]
        data += [(2 * g, " ".join(words[:200])), (2 * g + 1, " ".join(words[:200] + words[200:] * 20))]
    top = kept_by_brute_force(data)
    assert len(set(top.values())) == 12
    assert sorted(r.doc_id for r in similar.keep_one(docs(spark, *data)).collect()) == [2 * g for g in range(12)]


def test_links_beyond_the_radius_are_verified():
    sets = [np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    bits = np.array([0, 2**40 - 1, 0], np.uint64)
    assert similar.verified_forest(bits, sets, 0.8, 20) == [(0, 1)]


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_fingerprints_within_the_radius_share_a_cell(spark, radius):
    from pyspark.sql import functions as F

    rng, pairs = np.random.default_rng(radius), []
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(0, radius + 1), replace=False):
            b ^= 1 << int(bit)
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long").select(simhash.cell_keys("a", radius).alias("x"), simhash.cell_keys("b", radius).alias("y"))
    assert df.filter(~F.arrays_overlap("x", "y")).count() == 0 and len(df.first().x) == (radius + 2) * (radius + 1) // 2


@pytest.mark.parametrize("seed", range(6))
def test_forest_between_two_chunks(seed):
    rng, values = random.Random(seed), set()
    for v in [rng.getrandbits(64) for _ in range(6)] * 15:
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randint(0, 63)
        values.add(v)
    left = set(rng.sample(sorted(values), len(values) // 2))
    a, b = simhash.forest(np.array(sorted(left), np.uint64), 3, np.array(sorted(values - left), np.uint64))
    near = [(x, y) for x in left for y in values - left if (x ^ y).bit_count() <= 3]
    assert groups(values, zip(a.tolist(), b.tolist())) == groups(values, near) and near


def test_fingerprints_of_many_rows_are_joined_by_broadcast(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(i, ("", "a b c d e", f"own text of number {i} and more")[i % 3]) for i in range(60)], "doc_id long, text string")
    want = rows(simhash.near_duplicates(docs))
    monkeypatch.setattr(simhash, "HOT", 5)
    assert rows(simhash.near_duplicates(docs)) == want
