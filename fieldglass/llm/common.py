"""What the training-data operators share: table access, the shared folder, cut lineage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.cluster import ship_package

#: ASCII letters only: other scripts keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Where none is set, a temporary one serves on a single machine; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="fieldglass-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of the open ``scratch`` blocks, the innermost last.
_scratch: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch[-1] if _scratch else shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside goes when the block ends: for work whose result is by then written elsewhere."""
    _scratch.append(fresh_path(spark, "scratch"))
    try:
        yield
    finally:
        remove(spark, _scratch.pop())


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cut lineage that outlives executors."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, which nothing reads any more."""
    if path := getattr(df, "_stored_at", None):
        remove(df.sparkSession, path)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names like ``stems`` that ``df`` does not have, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    tail = "_"
    while any(f"__{s}{tail}".lower() in taken for s in stems):
        tail += "_"
    return [f"__{s}{tail}" for s in stems]


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that other columns can't clash with its own."""
    return df.select(*[df[n] for n in names])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: an expression named inside a lambda is otherwise computed for each element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


#: A side of at most so many rows and bytes is broadcast; a larger one is joined by shuffling, with the same result.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20


def width(name: str, kind: T.DataType) -> Column:
    """About how many bytes a column takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return 8 * F.greatest(F.size(name), F.lit(0)) + 16
    return F.lit(8 * max(1, len(kind.fields))) if isinstance(kind, T.StructType) else F.lit(8)


def bounded(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and measured; marked for broadcast only when its rows and bytes are within bounds."""
    kept = materialise(df, name)
    each = functools.reduce(Column.__add__, [width(f.name, f.dataType).cast("long") for f in kept.schema], F.lit(16).cast("long"))
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(kept) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else kept


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of that column, one row at least."""
    start = held = 0
    for i, v in enumerate(batch.column(column)):
        held += v.as_buffer().size if v.is_valid else 0
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows or batch.num_rows == 0:
        yield batch.slice(start)
