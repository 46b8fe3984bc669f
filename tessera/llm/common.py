"""Helpers shared by the corpus operators: Arrow text maps, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key and text are carried under these names inside an operator, so that other columns cannot clash.
KEY, TEXT = "__key", "__text"


#: Where the tables written in this context are, if somebody wants to know (see ``scratch``).
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a new local one where that is unset and executors are local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back, with its path: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return write(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the tables that are written inside, as they come."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def keyed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Only the key and the named columns; the first of these is the text."""
    rest = [F.col(f"`{c}`") for c in columns[1:]]
    return df.select(F.col(f"`{key}`").alias(KEY), F.col(f"`{columns[0]}`").cast("string").alias(TEXT), *rest)


def map_texts(df: DataFrame, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list], list]], key: str) -> DataFrame:
    """One row per row of df (columns KEY and TEXT): the key and what ``make()(texts)`` returns as columns.

    ``make`` runs once per task on the executor; the function it returns gets the texts of an
    Arrow batch (bounded in rows and bytes by Spark) and gives one list per field.
    """
    schema = T.StructType([T.StructField(key, df.schema[KEY].dataType), *(T.StructField(n, t) for n, t in fields)])
    types = [_arrow(t) for _, t in fields]
    names = [key, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                got = each(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(got, types, strict=True))], names=names)

    return df.select(KEY, TEXT).mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch, *columns: int | str) -> Iterator[tuple]:
    """Rows of a batch one at a time: its texts are not all Python strings at once."""
    held = [batch.column(c) for c in columns]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in held)


def _arrow(t: T.DataType) -> pa.DataType:
    plain = {T.LongType: pa.int64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary(), T.IntegerType: pa.int32()}
    return pa.list_(_arrow(t.elementType)) if isinstance(t, T.ArrayType) else plain[type(t)]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows ``(node, root)``, root the least node.

    Alternating large-star and small-star steps. Each is a map-side combined minimum and an
    equi-join, which adaptive execution can split at a hub; every round is written to the shared
    folder and the one before deleted, so no lineage builds up and nothing is gathered by the driver but a count and a hash.
    """
    spark = edges.sparkSession
    now, path = write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b")))
        old = path
        now, path = write(small.distinct(), name)
        remove(spark, old)
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
