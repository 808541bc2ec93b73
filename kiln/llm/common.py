"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many characters, so that memory does not follow the batch size; rows of a batch.
SLICE_CHARS = 2_000_000
BATCH_ROWS = 2000

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one is set in local mode. On a cluster no
    folder of this machine will do, so there it has to be set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="kiln-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kiln/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, limit: int) -> DataFrame:
    """df, marked for broadcast if it has at most limit rows; limit times the size of a row is what a broadcast can hold."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def numbered(docs: DataFrame, col: str) -> DataFrame:
    """(col, number): the distinct values that aren't null, numbered from 0 as they sort; by a range shuffle and counts per range."""
    ids = materialize(docs.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col).sortWithinPartitions(col).withColumn("number", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("number", 33).alias("part")
    parts = ids.groupBy(part).agg(F.min("number").alias("first"), F.count("*").alias("n")).withColumn("all", F.lit(0))
    before = F.sum("n").over(Window.partitionBy("all").orderBy("part")) - F.col("n") - F.col("first")  # a row for each range
    return ids.withColumn("part", part).join(F.broadcast(parts.select("part", before.alias("shift"))), "part").select(col, (F.col("number") + F.col("shift")).alias("number"))


def drop_materialized(keep: int = 0) -> None:
    """Delete what materialize() wrote; results that were not read yet need it, so only at the end of a session."""
    while len(_made) > keep:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit
            return


atexit.register(drop_materialized)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1. A null id counts as the empty text (crc32 0)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def slices(texts: list[str | None], limit: int = SLICE_CHARS, rows: int = 512) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of up to rows texts and about limit characters; a longer text is a run of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (held + n > limit or i - start >= rows):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def _give_back() -> None:
    """Freed memory goes back to the system: a worker stays for later tasks, of this operator or another."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def tidy(run):
    """run, for mapInArrow; every few seconds and at its end the worker gives freed memory back."""

    def wrapped(batches):
        last = time.monotonic()
        try:
            for out in run(batches):
                yield out
                if time.monotonic() - last > 2:
                    _give_back()
                    last = time.monotonic()
        finally:
            gc.collect()
            _give_back()

    return wrapped


_held: dict = {}


def held(key: tuple, make):
    """What a worker keeps between tasks, by key; only one thing at a time, so that operators' tables don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def small_batches(df: DataFrame) -> DataFrame:
    """df; where the session has Spark's own setting of Arrow batches (10,000 rows), sets BATCH_ROWS, as whole texts are in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def mapped(df: DataFrame, function, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow over RecordBatches of at most `rows` rows, so that little of a batch is held as Python objects;
    function(batch) yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for made in function(batch.slice(at, rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if not isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else made[f.name].cast(f.type) for f in out], schema=out)

    return small_batches(df).mapInArrow(tidy(run), schema)
