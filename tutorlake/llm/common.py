"""Helpers shared by the training-data operators.

Every operator takes a DataFrame with a key column and a content column (their names are
parameters), selects just those two, and returns its own columns; extra input columns,
whatever their names, are never looked at. Python work always runs inside ``mapInArrow``
over the partitions Spark made, in slices of bounded size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters handled at once inside a Python task; larger Arrow batches are cut to this.
SLICE_CHARS = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where the session
    names none, a temporary folder stands in for it on one machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-tutorlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files that
    outlive any executor, and the lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tutorlake-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # this write's shuffle files are of no use after it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, written to the shared folder, for the small side of a join: as a broadcast where its
    rows, counted, are at most ``most`` (8 MB of keys), else as it is, for a shuffled join."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= most else df


def slices(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds SLICE_CHARS characters of ``column``, or ``most`` if fewer, or one row."""
    start, size, most = 0, 0, min(SLICE_CHARS, most or SLICE_CHARS)
    for i, length in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if size and size + (length or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_columns(df: DataFrame, schema: str, content: str, make: Callable[[], Callable]) -> DataFrame:
    """Run ``make()(columns) -> columns`` (dicts of lists or arrays) over slices of ``df``.

    ``make`` runs once a task, so that a model or a cache is set up there.
    """
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, content):
                got = f({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def keyed(df: DataFrame, key: str, content: str, as_key: str = "doc_id", as_content: str = "text") -> DataFrame:
    """Key and content alone, null content as the empty string."""
    return df.select(F.col(key).alias(as_key), F.coalesce(F.col(content), F.lit("")).alias(as_content))


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key: str = "doc_id"):
    """True for the rows that no training may look at: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_order(key: str):
    """A number from 0 to 1 by the hash of a key: the rows of a sample are those with the smallest."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31)) / float(1 << 31)
