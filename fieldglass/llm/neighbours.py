"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries walk it greedily.

``build`` gives each distinct vector one node; rows with equal vectors are its members. The first graph comes from
random projections: in each of ``TABLES`` orders, nodes sorted by the signs of some projections meet the others of
their block of ``BLOCK`` nodes. Then rounds of NN-descent: each node's neighbours and those it is a neighbour of (at
most ``SAMPLE`` new and ``SAMPLE`` old ones, drawn by hash) meet at that node, and a pair goes out only if it beats the
worst neighbour of one of its ends; a join keeps the best ``DEGREE`` of each node. Pairs that met before are marked
old and don't meet again. Rounds end when few edges are new, or after ``ROUNDS``.

``search`` starts each query at the best of ``ENTRIES`` entry nodes and, where it is a row of the table, at its own
node. A round expands the ``EXPAND`` nearest nodes of its beam that are not expanded yet: join with the graph, group the
queries by the node they reach, score there, and keep the best ``BEAM`` of a query. It ends when a whole beam is
expanded. Queries are taken in blocks whose vectors are at most ``QUERY_BYTES``, so what tasks are sent has a bound.
The graph is built on unit vectors in half precision; search scores are cosines of the original vectors in doubles.

Defined results: vectors null, empty, zero, or holding null or non-finite components, and rows with a null id, take no
part, nor do vectors of another length than that of the smallest id. Of rows that repeat an id, the one with the least
vector counts. Equal scores go by id. A query finds all candidates if they are fewer than asked for. An empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, discard, materialise, require

TABLES, BLOCK = 4, 512
DEGREE, SAMPLE, ROUNDS, LEAST_NEW = 30, 24, 6, 0.02
ENTRIES, BEAM, EXPAND, QUERY_BYTES = 1024, 256, 64, 32 << 20
#: Nearest rows of a query.
NEAREST = 5
#: Rows of an Arrow batch that holds vectors.
EDGE = "a long, b long, s float"


def sound(vector: str | Column) -> Column:
    """Whether all components are finite numbers and one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors of equal length as rows of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by a power of two, which is exact, so that squares stay in range."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x and the row of y beside it, in doubles."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    y = np.ldexp(y, -np.frexp(np.abs(y).max(axis=1, keepdims=True))[1])
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def half_vectors(column: pa.Array, width: int) -> np.ndarray:
    raw = b"".join(v.as_py() for v in column)
    return np.frombuffer(raw, np.float16).reshape(-1, width).astype(np.float32)


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(node, vector, half, members): a node for each distinct vector; its least id, and its ``NEAREST`` + 1 least ids."""
    rows = require(vectors, id_col, vector_col).toDF("id", "vector").filter(F.col("id").isNotNull() & sound("vector"))
    rows = rows.withColumn("id", F.col("id").cast("long"))
    first = rows.orderBy("id", "vector").select(F.size("vector")).first()
    rows = rows.filter(F.size("vector") == (first[0] if first else 0)).groupBy("id").agg(F.min("vector").alias("vector"))
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= NEAREST + 1)
    classes = few.groupBy("vector").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("members"))
    kind = dict(vectors.select(F.col(vector_col)).dtypes)[vector_col]

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                halves = units(matrix(batch.column(1))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in halves], pa.binary())], names=["node", "vector", "members", "half"])

    return classes.select("node", "vector", "members").mapInArrow(halved, f"node long, vector {kind}, members array<long>, half binary")


def best(edges: DataFrame, degree: int) -> DataFrame:
    """Each node's nearest ``degree`` of its edges (a, b, s, fresh, met), and the worst of a full list. One shuffle, by node.

    Rows without a similarity only tell that the pair has met; an edge that was there and has met, or was old, is old.
    """
    one = edges.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.max("met").alias("met")).filter("s IS NOT NULL")
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    kept = one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= degree)
    worst = F.max(F.when(F.col("place") == degree, F.col("s"))).over(Window.partitionBy("a"))
    return kept.select("a", "b", "s", (F.col("fresh") & ~F.col("met")).alias("fresh"), F.coalesce(worst, F.lit(-2.0)).cast("float").alias("worst"))


def candidates(edges: DataFrame, turn: int) -> DataFrame:
    """(u, v, fresh): neighbours either way of each node at which a new one is; at most ``SAMPLE`` new and ``SAMPLE`` old ones, drawn by hash."""
    both = edges.select("a", "b", "fresh").union(edges.select("b", "a", "fresh")).toDF("u", "v", "fresh")
    one = both.repartition("u").groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    drawn = Window.partitionBy("u", "fresh").orderBy(F.xxhash64(F.lit(turn), "u", "v"))
    few = one.withColumn("place", F.row_number().over(drawn)).filter(F.col("place") <= SAMPLE)
    return few.withColumn("moved", F.max("fresh").over(Window.partitionBy("u"))).filter("moved").select("u", "v", "fresh")


def first_graph(nodes: DataFrame, count: int, width: int, degree: int) -> DataFrame:
    bits = max(1, int(np.ceil(np.log2(max(2, count / BLOCK * 2)))))
    planes = [np.random.default_rng(7 + t).normal(size=(width, bits + 1)).astype(np.float32) for t in range(TABLES)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = half_vectors(batch.column(1), width)
            for t, plane in enumerate(planes):
                y = x @ plane
                cell = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(cell), pa.array(y[:, bits]), batch.column(0), batch.column(1)], names=["t", "cell", "at", "node", "half"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: pa.Table) -> pa.RecordBatch:
            ids, x = part["node"].to_numpy(), half_vectors(part["half"], width)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            k = min(degree, len(ids) - 1)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(s, near, 1).ravel())], names=["a", "b", "s"])

        left = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            while held.num_rows >= 2 * BLOCK:
                yield block(held.slice(0, BLOCK))
                held = held.slice(BLOCK)
            left = held
        if left is not None and left.num_rows > 1:
            yield block(left)

    keys = nodes.select("node", "half").mapInArrow(dealt, "t int, cell long, at float, node long, half binary")
    parts = max(TABLES, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), TABLES * count // (8 * BLOCK)))
    return keys.repartitionByRange(parts, "t", "cell", "at").sortWithinPartitions("t", "cell", "at").mapInArrow(met, EDGE).withColumns({"fresh": F.lit(True), "met": F.lit(False)})


def descend(nodes: DataFrame, edges: DataFrame, width: int, degree: int, turn: int) -> DataFrame:
    """One round: candidates that met at a common neighbour, merged into each node's list."""
    lists = materialise(candidates(edges, turn), "candidates")
    worst = edges.groupBy(F.col("a").alias("v")).agg(F.first("worst").alias("worst"))
    meet = lists.join(nodes.select(F.col("node").alias("v"), "half"), "v").join(worst, "v", "left").select("u", "v", "fresh", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"), "half")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def local(part: pa.Table) -> pa.RecordBatch | None:
        """Pairs of one node's candidates that improve one of the two lists."""
        fresh = part["fresh"].to_numpy(zero_copy_only=False)
        order = np.argsort(~fresh, kind="stable")
        ids, worst, new = part["v"].to_numpy()[order], part["worst"].to_numpy()[order], int(fresh.sum())
        x = half_vectors(part["half"], width)[order]
        s = x[:new] @ x.T
        i, j = np.nonzero((s > np.minimum(worst[:new, None], worst[None])) & (np.arange(len(ids))[None] > np.arange(new)[:, None]))
        w = s[i, j]
        to_i, to_j = w > worst[i], w > worst[j]
        a = np.concatenate([ids[i[to_i]], ids[j[to_j]]])
        if not len(a):
            return None
        b, w = np.concatenate([ids[j[to_i]], ids[i[to_j]]]), np.concatenate([w[to_i], w[to_j]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(w)], names=["a", "b", "s"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, left = [], 0, None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = held if left is None else pa.concat_tables([left, held])
            u = held["u"].to_numpy()
            ends = np.flatnonzero(u[1:] != u[:-1]) + 1
            start = 0
            for end in ends.tolist():  # the last node may go on in the next batch
                if (found := local(held.slice(start, end - start))) is not None:
                    out.append(found)
                    size += found.num_rows
                start = end
                if size > 50_000:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, size = [], 0
            left = held.slice(start)
        if left is not None and left.num_rows and (found := local(left)) is not None:
            out.append(found)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    found = meet.repartition(parts, "u").sortWithinPartitions("u").mapInArrow(joined, EDGE)
    met = lists.filter("fresh").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")
    every = edges.select("a", "b", "s", "fresh", F.lit(False).alias("met"))
    every = every.union(found.select("a", "b", "s", F.lit(True), F.lit(False))).union(met.select("a", "b", F.lit(None).cast("float"), F.lit(None).cast("boolean"), F.lit(True)))
    kept = materialise(best(every, degree), "neighbours")
    discard(lists)
    discard(edges)
    return kept


class Graph:
    """Nodes with their vectors, members and neighbours (``to``): a written table."""

    def __init__(self, nodes: DataFrame, count: int):
        self.nodes, self.count = nodes, count

    def drop(self) -> None:
        discard(self.nodes)


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = DEGREE) -> Graph:
    nodes = materialise(nodes_of(vectors, id_col, vector_col), "nodes")
    count, width = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if count < 2:
        return Graph(nodes.withColumn("to", F.array().cast("array<long>")), count)
    edges = materialise(best(first_graph(nodes, count, width, degree), degree), "neighbours")
    for turn in range(ROUNDS):
        edges = descend(nodes, edges, width, degree, turn)
        total, new = edges.agg(F.count("*"), F.count_if("fresh")).first()
        if new <= LEAST_NEW * total:
            break
    links = edges.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("to"))
    graph = materialise(nodes.drop("half").join(links, "node", "left"), "graph")
    discard(edges)
    discard(nodes)
    return Graph(graph, count)


def ranked_beam(beam: DataFrame) -> DataFrame:
    """The best of each query's beam, and which of them to expand next. One shuffle, by query."""
    one = beam.repartition("q").groupBy("q", "node").agg(F.max("s").alias("s"), F.max("done").alias("done"), F.first("to", ignorenulls=True).alias("to"))
    order = Window.partitionBy("q").orderBy(F.desc("s"), "node")
    kept = one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BEAM).drop("place")
    turn = Window.partitionBy("q", "done").orderBy(F.desc("s"), "node")
    return kept.withColumn("next", ~F.col("done") & (F.row_number().over(turn) <= EXPAND))


def walk(graph: Graph, block: list, entries: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The beams of a block of (node or None, vector) queries: (q, node, s), q being the place in the block."""
    spark, nodes = graph.nodes.sparkSession, graph.nodes
    vectors = spark.sparkContext.broadcast(np.array([r[1] for r in block], np.float64))
    entry_ids, entry_units = entries

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = entry_units @ units(vectors.value[q : q + 1])[0]
                top = np.argsort(-s, kind="stable")[:BEAM]
                ids, s = entry_ids[top], s[top]
                if own is not None and own not in ids:
                    ids = np.append(ids, own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids)], names=["q", "node"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            each = np.diff(lists.offsets.to_numpy())
            at, q = np.repeat(np.arange(batch.num_rows), each), np.asarray(lists.flatten())
            ids, x, to = batch.column(0).to_numpy(), matrix(batch.column(2)), batch.column(3)
            for start in range(0, len(q), 1 << 14):
                i, j = at[start : start + (1 << 14)], q[start : start + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(ids[i]), pa.array(cosines(vectors.value[j], x[i])), to.take(pa.array(i))], names=["q", "node", "s", "to"])

    places = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], "q int, own long").repartition(min(len(block), spark.sparkContext.defaultParallelism))

    def reached(pairs: DataFrame) -> DataFrame:
        """Scores of (q, node) pairs: queries gather at the node they reach."""
        asked = pairs.groupBy("node").agg(F.collect_set("q").alias("qs"))
        return asked.join(nodes, "node").select("node", "qs", "vector", "to").mapInArrow(score, "q int, node long, s double, to array<long>").select("q", "node", "s", F.lit(False).alias("done"), "to")

    beam = materialise(ranked_beam(reached(places.mapInArrow(begin, "q int, node long"))), "beam")
    while not beam.filter("next").isEmpty():
        found = reached(beam.filter("next").select("q", F.explode("to").alias("node")))
        held = beam.select("q", "node", "s", (F.col("done") | F.col("next")).alias("done"), F.when(~F.col("done") & ~F.col("next"), F.col("to")).alias("to"))
        after = materialise(ranked_beam(held.union(found)), "beam")
        discard(beam)
        beam = after
    out = materialise(beam.select("q", "node", "s").join(nodes.select("node", "members"), "node"), "reached")
    discard(beam)
    return out


def search(graph: Graph, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of each query, itself left out. ``queries``: (id, vector)."""
    if nearest > NEAREST:
        raise ValueError(f"a node keeps the ids of {NEAREST} nearest at most")
    spark, nodes = graph.nodes.sparkSession, graph.nodes
    out_type = "query_id long, rank int, vec_id long, score double"
    if not graph.count:
        return spark.createDataFrame([], out_type)
    asked = queries.toDF("id", "vector").filter(F.col("id").isNotNull() & sound("vector"))
    asked = asked.withColumn("id", F.col("id").cast("long")).groupBy("id").agg(F.min("vector").alias("vector"))
    width = nodes.agg(F.max(F.size("vector"))).first()[0]
    asked = materialise(asked.filter(F.size("vector") == width), "queries")
    ones = materialise(asked.groupBy("vector").agg(F.min("id").alias("first")).join(nodes.select("vector", "node"), "vector", "left"), "distinct-queries")
    few = nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node", "vector").collect()
    entries = np.array([r.node for r in few]), units(np.array([r.vector for r in few], np.float64))
    size = max(1, QUERY_BYTES // (8 * width))
    parts, block = [], []
    best_rows = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("vec_id"))

    def finish(block: list) -> None:
        beams = walk(graph, [(r.node, r.vector) for r in block], entries)
        rows = beams.select("q", F.explode("members").alias("vec_id"), F.col("s").alias("score"))
        top = rows.withColumn("place", F.row_number().over(best_rows)).filter(F.col("place") <= nearest + 1)
        firsts = spark.createDataFrame([(i, r.first) for i, r in enumerate(block)], "q int, first long")
        found = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
        parts.append(materialise(firsts.join(found, "q").select("first", "found"), "found"))
        discard(beams)

    for row in ones.orderBy("first").toLocalIterator():
        block.append(row)
        if len(block) == size:
            finish(block)
            block = []
    if block:
        finish(block)
    if not parts:
        return spark.createDataFrame([], out_type)
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    named = asked.select("id", "vector").join(ones.select("vector", "first"), "vector").select("id", "first")
    rows = named.join(bounded(found, "found"), "first")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, nearest)
    return rows.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def nearest_rows(vectors: DataFrame, every: int, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """Index all rows; take those whose id is divisible by ``every`` as queries. The result is written, the graph goes."""
    graph = build(vectors, id_col, vector_col)
    queries = require(vectors, id_col, vector_col).filter(F.col(id_col) % every == 0)
    found = materialise(search(graph, queries, nearest), "nearest")
    graph.drop()
    return found
