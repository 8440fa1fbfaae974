"""Helpers that keep plans safe at any size: checked broadcasts, lineage cuts, ranks without a hot task."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Rows of a bucket in which ``running`` ranks.
BUCKET_ROWS = 100_000

_written: set[str] = set()


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.aggregate(F.coalesce(F.transform(c, lambda x: _bytes(x, kind.elementType)), F.array().cast("array<int>")), F.lit(16), lambda n, x: n + x)
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        total = F.lit(16)
        for f in kind.fields:
            total = total + _bytes(c[f.name], f.dataType)
        return total
    return F.lit(8)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes. Known without a job of a table made by ``written``; else at most ``max_rows + 1`` rows are counted."""
    known = getattr(df, "_vinolake_size", None)
    if known is not None:
        return known[0] <= max_rows and known[1] <= max_bytes
    width = F.lit(0)
    for f in df.schema.fields:
        width = width + _bytes(F.col(f"`{f.name}`"), f.dataType)
    rows, size = df.select(width.cast("long").alias("w")).limit(max_rows + 1).agg(F.count("*"), F.sum("w")).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, of: DataFrame | None = None) -> DataFrame:
    """``df`` marked for broadcast if it ``fits``, else as it is, for a shuffled join. ``of`` is a table whose size is known and no smaller than that of ``df``."""
    return F.broadcast(df) if fits(df if of is None else of, max_rows, max_bytes) else df


def rows_of(df: DataFrame) -> int:
    """The number of rows; known without a job of a table made by ``written``."""
    known = getattr(df, "_vinolake_size", None)
    return df.count() if known is None else known[0]


def _shared(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, and a temporary one only where everything runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return "file://" + tempfile.gettempdir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{_shared(df.sparkSession)}/vinolake-checkpoints")
    return df.checkpoint()


def spread(df: DataFrame, per_core: int = 3, piece: int = 256 * 1024) -> DataFrame:
    """``df`` in enough partitions to keep every core busy in a Python stage; as it is if it has them already.

    A scan of few large files leaves cores idle where each row costs much CPU.
    Small inputs get one partition per ``piece`` bytes of the optimizer's estimate.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    want = min(per_core * df.sparkSession.sparkContext.defaultParallelism, 1 + size // piece)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(int(want))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that is written once and read several times; see ``forget``."""
    path = f"{_shared(spark)}/vinolake/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(forget)
    _written.add(path)
    return path


def forget() -> None:
    """Delete every table written to ``scratch`` paths so far; results that still read them become unreadable. Also done when the program ends."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, survives lost executors. Its rows and bytes are known from the writing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    # Parquet is several times smaller than the rows in memory.
    out._vinolake_size = (seen.get["rows"], 6 * at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength())
    return out


def map_columns(df: DataFrame, schema: str | T.StructType, f) -> DataFrame:
    """``f(*columns)`` over the Arrow batches of ``df``: lists of values in, an iterable of lists of values out, one per column of ``schema``.

    Plain lists go to and from Arrow directly, which costs less than half of what frames cost.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = f(*[c.to_pylist() for c in b.columns])
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(out, target)], schema=target)

    return df.mapInArrow(run, schema)


def running(df: DataFrame, group: list[str], order: list[Column], amount: Column | None = None, name: str = "rank", buckets: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Running total of ``amount`` before each row (or the 0-based rank) within ``group``, without one task per group.

    The order is (bucket, ``order``), the bucket being that of the hash of
    ``order`` unless given: deterministic and arbitrary, which suits shuffling
    and packing. Each group is cut into
    ``buckets`` buckets (else as many as hold BUCKET_ROWS rows each if all are of one group), ranked separately, and shifted by the buckets' totals,
    a table of at most groups x buckets rows that is aggregated before it moves.
    """
    amount = F.lit(1) if amount is None else amount
    if buckets is None and bucket is None:
        buckets = 1 + rows_of(df) // BUCKET_ROWS
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if bucket is None else bucket).withColumn("_a", amount.cast("long"))
    totals = keyed.groupBy(*group, "_b").agg(F.sum("_a").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_sb"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    within = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("_r", F.coalesce(F.sum("_a").over(within), F.lit(0)))
    on = F.col("_b") == F.col("_sb")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return ranked.join(small_side(shifts), on).withColumn(name, F.col("_r") + F.col("_s")).drop("_b", "_a", "_r", "_s", "_sb", *[f"_g{i}" for i in range(len(group))])
