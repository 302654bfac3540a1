import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldglass.llm import decontaminate, line_dedup
from fieldglass.llm.common import table

LINE_COLS = "doc_id long, text string, n_lines string, at string, place string, row string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], LINE_COLS)


def near(a, b):
    a, b = a.split(" "), b.split(" ")
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(data, least=5):
    """(id, text) after dedup, for distinct (id, text) rows."""
    order = sorted({(i, t) for i, t in data if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, kept = [], {}
    for i, t in order:
        out = []
        for line in t.split("\n"):
            if not line.strip(" "):
                out.append(line)
                continue
            gone = any(line == s or max(len(line.split(" ")), len(s.split(" "))) >= least and near(line, s) for s in seen)
            seen.append(line)
            if not gone:
                out.append(line)
        kept[i, t] = "\n".join(out)
    return [(i, None if t is None else kept[i, t]) for i, t in data]


def result(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_edges(spark):
    line = "one two three four five six seven eight nine"
    data = [
        (1, f"{line}\n\nshort\nshort"), (2, line.replace("five", "5")), (3, line.replace(" nine", "")), (4, line + " ten"), (5, line.replace("one", "1").replace("two", "2")),
        (6, None), (7, ""), (8, "\n\n"), (None, "from nobody\nshort"), (9, "w " * 3000 + "end"), (10, "w " * 3000 + "fin"), (11, line.replace(" ", "  ")),
        (12, "a b c d e\na b c d f\na b c d\nb c d e\na c d\na b c e"), (13, "p q r s\np q r s t\np q r x"),
    ]
    out = line_dedup.dedup_lines(docs(spark, *data))
    assert result(out) == sorted(brute(data), key=repr)
    assert out.columns == ["doc_id", "text", "at", "place", "row", "n_lines", "n_removed"] and out.filter("at = 'x' AND place = 'x' AND row = 'x'").count() == len(data)
    counts = {r.doc_id: (r.n_lines, r.n_removed) for r in out.collect()}
    assert counts[1] == (4, 2) and counts[6] == (0, 0) and counts[2] == (1, 1) and counts[8] == (3, 0)
    assert line_dedup.dedup_lines(docs(spark)).count() == 0


def test_equal_rows_are_one_document(spark):
    out = line_dedup.dedup_lines(docs(spark, (1, "a b c"), (1, "a b c"), (2, "a b c")))
    assert result(out) == [(1, "a b c"), (1, "a b c"), (2, "")]


def test_random_lines_equal_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdef") for _ in range(rng.choice([3, 4, 5, 6, 8, 12]))] for _ in range(12)]
    data = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice("abcxyz")] * rng.randint(0, 1)
            lines.append(" ".join(w))
        data.append((i, "\n".join(lines)))
    assert result(line_dedup.dedup_lines(docs(spark, *data))) == sorted(brute(data), key=repr)


def test_columns_of_any_name_are_kept(spark):
    names = ["id", "row", "stays", "__row_", "__id2__", "__at_", "h1", "v"]
    frame = spark.createDataFrame([(1, "a b\na b", *names), (2, "a b", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = line_dedup.dedup_lines(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, *(r[n] for n in names)) for r in out.collect()) == [(1, "a b", *names), (2, "", *names)]


def test_shuffled_sides_give_the_same(spark, monkeypatch):
    from fieldglass.llm import common

    data = [(i, "one two three four five six seven " + w) for i, w in enumerate(["a", "b", "c", "a"])] + [(9, "else")]
    want = result(line_dedup.dedup_lines(docs(spark, *data)))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert result(line_dedup.dedup_lines(docs(spark, *data))) == want == sorted(brute(data), key=repr)


def test_no_python_on_the_path(spark):
    plan = line_dedup.dedup_lines(docs(spark, (1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ITEM = "Which of these seven quick rivers runs through the old town of Alder, and where does it end at last?"
LEAK_COLS = "doc_id long, text string, item_id string, id string, words string"


def leak_docs(spark, *rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], LEAK_COLS)


def bench(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def plain_leaks(data, items, threshold=0.8):
    """Best similarity over all windows of all documents."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out, held = {}, {}
    for i, t in data:
        w = words(t)
        held[i, t] = w, {k: {tuple(w[x : x + k]) for x in range(len(w) - k + 1)} for k in range(1, 6)}
    for j, item in items:
        iw = words(item)
        if not iw:
            continue
        k = min(5, len(iw))
        bag = Counter(tuple(iw[i : i + k]) for i in range(len(iw) - k + 1))
        for i, t in data:
            w, own = held[i, t]
            if own[k].isdisjoint(bag):
                continue  # no window shares anything
            for s in range(max(1, len(w) - k + 1)):
                own = Counter(tuple(w[s : s + len(iw)][x : x + k]) for x in range(len(w[s : s + len(iw)]) - k + 1))
                if own:
                    sim = sum((own & bag).values()) / sum((own | bag).values())
                    if sim >= threshold:
                        out[i, j] = max(out.get((i, j), 0), sim)
    return out


FILL = "something else entirely was written here about the weather and about boats " * 3


def test_leaks_equal_all_windows(spark):
    changed = ITEM.replace("last?", "first!")
    two = ITEM + " " + "and then some more words follow to make the item long enough for an edit " + ITEM
    data = [(1, FILL + ITEM + FILL), (2, ITEM.upper()), (3, FILL), (4, None), (5, ""), (None, "x " + ITEM), (6, changed), (7, FILL + two.replace("follow", "come") + FILL), (8, ITEM[:60]), (9, "no way"), (10, "not a no way " * 2000 + ITEM), (11, "mini item"), (12, ITEM + "\n" + ITEM)]
    items = [(100, ITEM), (101, two), (102, ""), (103, None), (104, "mini item"), (105, ITEM)]
    got = decontaminate.report(leak_docs(spark, *data), bench(spark, *items)).collect()
    want = plain_leaks(data, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) and (1, 100) in want and (7, 101) in want and (11, 104) in want and (8, 100) not in want
    left = decontaminate.clean(leak_docs(spark, *data), bench(spark, *items))
    assert sorted(r.doc_id for r in left.collect()) == sorted({i for i, _ in data} - {i for i, _ in want}) and left.columns == [c.split()[0] for c in LEAK_COLS.split(", ")]


@pytest.mark.parametrize("seed", range(4))
def test_rearranged_items_equal_all_windows(spark, seed):
    """Halves swapped, blocks moved, doubled and dropped: what no alignment of shared shingles shows as one copy."""
    rng = random.Random(seed)
    items, data = [], []
    for j in range(3):
        words = [f"i{j}_{rng.randint(0, 60)}" for _ in range(rng.choice([40, 58, 80]))]
        items.append((j, " ".join(words)))
        half = len(words) // 2
        data.append((10 * j, " ".join(["x"] * rng.randint(0, 90) + words[half:] + words[:half] + ["y"] * rng.randint(0, 90))))
        for n in range(1, 6):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                a, size, to = rng.randrange(len(own)), rng.randint(1, 25), rng.randrange(len(own))
                block = own[a : a + size]
                if rng.random() < 0.7:
                    del own[a : a + size]
                own[to:to] = block
            data.append((10 * j + n, " ".join(["x"] * rng.randint(0, 30) + own + ["y"] * rng.randint(0, 30))))
    got = decontaminate.report(leak_docs(spark, *data), bench(spark, *items)).collect()
    want = plain_leaks(data, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert any(i == 10 * j for i, j in want)


@pytest.mark.parametrize("size, end, inserted", [(58, 0, 2), (64, 0, 2), (120, 2, 6), (30, 0, 1), (58, 0, 0)])
def test_windows_between_alignments(spark, size, end, inserted):
    item = [f"i{j}" for j in range(size)]
    own = list(item)
    own[end], own[-1 - end] = "x", "y"
    own[size // 2 : size // 2] = ["new"] * inserted
    fill = " ".join(f"f{j}" for j in range(80))
    data = [(1, f"{fill} {' '.join(own)} {fill}"), (2, " ".join(own)), (3, " ".join(own[:-4]))]
    items = [(7, " ".join(item)), (8, " ".join(item[::-1]))]
    got = decontaminate.report(leak_docs(spark, *data), bench(spark, *items)).collect()
    want = plain_leaks(data, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert (1, 7) in want or size == 30


def test_empty_tables_and_repeated_rows(spark):
    d, b = leak_docs(spark, (1, ITEM), (1, ITEM)), bench(spark, (1, ITEM))
    assert decontaminate.report(d, b).count() == 2 and decontaminate.clean(d, b).count() == 0
    assert decontaminate.report(d, b.limit(0)).count() == 0 and decontaminate.clean(d, b.limit(0)).count() == 2
    assert decontaminate.report(d.limit(0), b).count() == 0


@pytest.mark.parametrize("radius", [3, 20])
def test_blocks_meet_within_the_radius(spark, radius):
    rng = random.Random(radius)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, radius)):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long").select(decontaminate.blocks(F.col("a"), radius).alias("x"), decontaminate.blocks(F.col("b"), radius).alias("y"))
    assert df.filter(~F.arrays_overlap("x", "y")).count() == 0 and len(df.first().x) == radius + 1


def test_sql_simhash_equals_plain(spark):
    bags = [[1, -1, 5], [], [7], [-(1 << 63), 3], [12345678901234567, -98765432109876543, 5, 5]]
    df = spark.createDataFrame([(b,) for b in bags], "bag array<bigint>")
    got = [r[0] for r in df.select(decontaminate.simhash(F.col("bag"))).collect()]
    for b, x in zip(bags, got):
        want = sum(1 << k for k in range(64) if 2 * sum((h >> k) & 1 for h in b) > len(b))
        assert x & ((1 << 64) - 1) == want


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    data = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, folder, "benchmark").select("item_id", "text").collect()]
    got = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(plain_leaks(data, items))
