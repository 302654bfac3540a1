import inspect

import corpus_pipeline as pipeline
from fieldglass.llm.common import materialise, table
from fieldglass.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.01"


def test_stages_hand_on_whole_documents(spark):
    docs = table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    counts = []
    for name, stage in pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        had = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = materialise(stage(spark, docs, DATA), "stage")
        counts.append(docs.count())
        if name == pipeline.STAGES[-1][0]:
            break
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert set(now) <= set(had) and len(now) == counts[-1]
        if name == "line dedup":
            assert all(set(now[i].split("\n")) <= set(had[i].split("\n")) for i in now)
            lines = [line for t in now.values() for line in t.split("\n") if line.strip()]
            assert len(lines) == len(set(lines))
            assert docs.filter("n_chars != length(text)").count() == 0
        else:
            assert all(had[i] == t for i, t in now.items())
    assert before > counts[0] > counts[1] >= counts[2] > counts[3]
    assert docs.select("doc_id").distinct().count() == counts[3]


def test_clean_documents_stay(spark):
    labels = table(spark, DATA, "labels").filter("quality = 1")
    docs = table(spark, DATA, "documents")
    kept = pipeline.good_quality(spark, docs, DATA)
    clean = docs.join(labels, "doc_id", "left_semi").count()
    assert kept.join(labels, "doc_id", "left_semi").count() >= 0.97 * clean


def test_run_equals_the_stages(spark):
    small = "/root/testdata/sf0.001"
    docs = table(spark, small, "documents")
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, small), "stage")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, pipeline.run(spark, small).select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_near_duplicates_of_the_stage_input_equal_brute_force(spark):
    """Of the documents as line dedup leaves them, exactly one of each group at 0.8 stays, and of the raw table too."""
    import itertools

    from fieldglass.llm.simhash import shingle_hashes

    raw = table(spark, DATA, "documents")
    for docs in (pipeline.without_repeated_lines(spark, pipeline.good_quality(spark, raw, DATA), DATA), raw):
        docs = materialise(docs, "input")
        rows = docs.select("doc_id", "text").collect()
        sets = {r.doc_id: frozenset(shingle_hashes(r.text, 5).tolist()) for r in rows}
        holders = {}
        for i, own in sets.items():
            for h in own or {None}:
                holders.setdefault(h, set()).add(i)
        together = {p for ids in holders.values() for p in itertools.combinations(sorted(ids), 2)}
        parent = {i: i for i in sets}

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in together:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
        want = {i for i in sets if top(i) == i}
        got = {r.doc_id for r in pipeline.one_of_each_group(spark, docs, DATA).select("doc_id").collect()}
        assert got == want
    assert len(want) < len(sets)


ODD = "doc_id long, text string, id string, row int, score double, predicted int, n_lines int, stays string, __id_ string, held_out boolean"


def odd(spark, *rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.25, 7, 9, "y", "z", None) for i, t in rows], ODD)


def test_stages_on_odd_documents(spark):
    """No n_chars; columns with the operators' own names; nulls, empty and repeated rows; each stage hands on the caller's values."""
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = odd(spark, (1, None), (2, ""), (None, "line one is here and it is long\nand another line"), (4, long), (5, "same text as the other one here"), (5, "same text as the other one here"), (6, "\n\n"))
    for name, stage in pipeline.STAGES[1:4]:
        out = materialise(stage(spark, docs, "/root/testdata/sf0.001"), "odd")
        assert out.columns == docs.columns and out.schema == docs.schema, name
        kept = out.collect()
        assert all((r.id, r.row, r.score, r.predicted, r.n_lines, r.stays, r["__id_"], r.held_out) == ("x", 1, 0.25, 7, 9, "y", "z", None) for r in kept)
        ids = sorted((r.doc_id for r in kept), key=repr)
        want = {"SimHash near-dedup": [1, 4, 5, None]}.get(name, [1, 2, 4, 5, 5, 6, None])
        assert ids == sorted(want, key=repr), name
    kept = pipeline.good_quality(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and all((r.score, r.predicted) == (0.25, 7) for r in kept.collect())
    pieces = pipeline.packed(spark, docs, "").collect()
    assert len(pieces) >= 7 and {r.doc_id for r in pieces} == {1, 2, None, 4, 5, 6}


def test_stages_on_no_documents(spark):
    for name, stage in pipeline.STAGES:
        assert stage(spark, odd(spark), "/root/testdata/sf0.001").count() == 0, name


def test_a_stage_leaves_no_intermediate_tables(spark, tmp_path, monkeypatch):
    import os

    from fieldglass.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert sorted(n.rsplit("-", 1)[0] for n in os.listdir(tmp_path)) == ["benchmark-decontamination", "pieces"]


def test_registry():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert set(ORACLE) <= set(QUERIES) and pipeline.ORACLE_SQL is None


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(pipeline.__file__).parent
    for path in (root / "fieldglass").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
