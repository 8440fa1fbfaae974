"""What changed between full snapshots: a bucketed key-to-hash index of the last snapshot, probed with the new one.

``SnapshotStore`` keeps the index in a folder, one generation per delivery. A
generation is a table bucketed by key: (key columns, hash of the compared values,
change_kind). A delivery is shuffled once, by key, into the same buckets and probes
the last generation in place; what the probe finds is the next generation, whose
change_kind column tells the changes and whose other rows are the index. Values of the
old snapshot never travel: where they are wanted, ``old_values`` fetches them for the
changed keys only. Generations are swapped by renaming a pointer file, so a job
that dies leaves the old one in force; older generations are removed.

``changes_in_history`` delivers a whole history to such a store, snapshot by snapshot.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinolake.operators.scale import scratch, small_side

#: Bytes of a delivery that one bucket holds at most, when the number of buckets is not given.
BUCKET_BYTES = 64 << 20


def page_path(url: Column) -> Column:
    """The path of a url, percent-decoded, lower case, without trailing slashes, query and fragment; null stays null.

    Malformed percent sequences leave the path undecoded; '+' is not a space in a path.
    """
    raw = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    return F.regexp_replace(F.lower(decoded), "/+$", "")


def value_hash(*values: Column) -> Column:
    """64-bit hash of the compared values in which null differs from every value (xxhash64 alone skips nulls)."""
    return F.xxhash64(*[x for v in values for x in (v.isNull(), v)])


def cents(price: Column) -> Column:
    """Whole cents, so that float noise is no change."""
    return F.round(price.cast("double") * 100, 0).cast("long")


class SnapshotStore:
    """The index of the last snapshot in ``folder``, bucketed by ``keys``, replaced as a whole by each delivery.

    ``source`` names the key column of parties that deliver on their own: a source without a
    row in a snapshot did not deliver, and its part of the index stays as it is; a
    source's first delivery gives no changes. Without it the first snapshot gives none.
    ``keep`` generations stay readable, None for all; the changes returned by the last
    ``keep - 1`` deliveries are reads of them. Null keys are left out, repeated rows are merged.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], values: list[str], buckets: int | None = None, source: str | None = None, keep: int | None = 2):
        self.spark, self.folder, self.keys, self.values, self.buckets, self.source, self.keep = spark, folder.rstrip("/"), keys, values, buckets, source, keep
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: dict[str, str] = {}  # generation -> name in this session's catalog

    def _pointers(self) -> list[str]:
        """Names of the pointer files, oldest first."""
        at = self._fs_path(self.folder)
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if n.startswith("CURRENT-"))

    def _read(self, pointer: str) -> dict:
        stream = self._fs.open(self._fs_path(f"{self.folder}/{pointer}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _table(self, state: dict) -> DataFrame:
        """A generation as a bucketed table, entered into the session's catalog at first sight."""
        generation = state["generation"]
        if generation not in self._known:
            name = f"vinolake_{generation.replace('-', '_')}"
            cluster = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"create table {name} ({state['schema']}) using parquet clustered by ({cluster}) into {state['buckets']} buckets location '{self.folder}/{generation}'")
            self._known[generation] = name
        return self.spark.table(self._known[generation])

    def index(self) -> DataFrame | None:
        """The index in force (keys, hash), or None before the first delivery."""
        pointers = self._pointers()
        return self._table(self._read(pointers[-1])).where("hash is not null").select(*self.keys, "hash") if pointers else None

    def apply(self, snapshot: DataFrame, version: str | None = None) -> DataFrame | None:
        """The changes (keys, change_kind) against the last delivery, None for the first; afterwards ``snapshot`` is the last delivery.

        Of several rows of a key the one with the greatest ``version`` counts, else the greatest values.
        """
        pointers = self._pointers()
        state = self._read(pointers[-1]) if pointers else None
        buckets = state["buckets"] if state else self.buckets or self._wanted(snapshot)
        rows = snapshot.where(" and ".join(f"`{k}` is not null" for k in self.keys)).select(*self.keys, *([version] if version else []), *self.values).repartition(buckets, *self.keys)
        order = [F.col(version).alias("_v")] if version else []
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*order, *self.values)).alias("_b"))
        new = best.select(*self.keys, value_hash(*[F.col(f"_b.{v}") for v in self.values]).alias("_new"))
        if state is None:
            found = new.select(*self.keys, F.col("_new").alias("hash"), F.lit(None).cast("string").alias("change_kind"))
        else:
            old = self.index().withColumnRenamed("hash", "_old")
            if self.source:  # which sources delivered now, and which had delivered before
                now = small_side(snapshot.select(F.col(self.source).alias("_n")).where("_n is not null").distinct())
                before = small_side(old.select(F.col(self.source).alias("_s")).distinct())
                old = old.join(now, F.col(self.source) == F.col("_n"), "left").withColumn("_due", F.col("_n").isNotNull()).drop("_n")
                new = new.join(before, F.col(self.source) == F.col("_s"), "left").withColumn("_had", F.col("_s").isNotNull()).drop("_s")
            else:
                old, new = old.withColumn("_due", F.lit(True)), new.withColumn("_had", F.lit(True))
            kind = F.when(F.col("_old").isNull(), F.when(F.col("_had"), "added")).when(F.col("_new").isNull(), F.when(F.col("_due"), "removed")).when(F.col("_old") != F.col("_new"), "changed")
            kept = F.coalesce("_new", F.when(~F.col("_due"), F.col("_old")))
            found = old.join(new, self.keys, "full_outer").select(*self.keys, kept.alias("hash"), kind.alias("change_kind"))
        generation = f"gen-{uuid.uuid4().hex}"
        name = f"vinolake_{generation.replace('-', '_')}"
        found.write.bucketBy(buckets, *self.keys).option("path", f"{self.folder}/{generation}").format("parquet").saveAsTable(name)
        self._known[generation] = name
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
        self._swap(pointers, {"generation": generation, "buckets": buckets, "schema": schema})
        return None if state is None else self.spark.table(name).where("change_kind is not null").select(*self.keys, "change_kind")

    def _wanted(self, snapshot: DataFrame) -> int:
        """Buckets for deliveries of the size of the first."""
        size = int(snapshot._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return max(self.spark.sparkContext.defaultParallelism, 1 + size // BUCKET_BYTES)

    def _swap(self, pointers: list[str], state: dict) -> None:
        """Put a generation in force by one rename, then forget the pointers and generations before the last ``keep``."""
        draft = self._fs_path(f"{self.folder}/draft-{state['generation']}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        number = int(pointers[-1].split("-")[1]) + 1 if pointers else 0
        if not self._fs.rename(draft, self._fs_path(f"{self.folder}/CURRENT-{number:012d}")):
            raise OSError(f"another delivery took place in {self.folder}")
        for old in pointers[: len(pointers) + 1 - self.keep] if self.keep and len(pointers) >= self.keep else []:
            generation = self._read(old)["generation"]
            if generation in self._known:
                self.spark.sql(f"drop table if exists {self._known.pop(generation)}")
            self._fs.delete(self._fs_path(f"{self.folder}/{generation}"), True)
            self._fs.delete(self._fs_path(f"{self.folder}/{old}"), False)

    @staticmethod
    def old_values(changes: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
        """The previous snapshot's rows of the keys that changed or vanished, and of no others."""
        return previous.join(changes.where("change_kind <> 'added'").select(*keys), keys, "left_semi")


def changes_in_history(df: DataFrame, *, source: str, seq: str, key: Column, version: str, values: list[Column]) -> DataFrame:
    """(seq, source, key, change_kind) of every delivery of every source against that source's previous delivery.

    A source's first delivery gives no rows; a number at which a source has no
    row was not delivered for it. Rows without source, number or key are left out.
    The rows are laid out by number in one pass, then delivered to a ``SnapshotStore``
    in order: work is in proportion to the rows of each delivery and of the index.
    """
    spark = df.sparkSession
    rows = df.select(F.col(seq), F.col(source), key.alias("_key"), F.col(version), *values).where(F.col(seq).isNotNull() & F.col(source).isNotNull() & F.col("_key").isNotNull())
    names = rows.columns[4:]
    staged = scratch(spark, "deliveries")
    rows.write.partitionBy(seq).parquet(staged)
    laid = spark.read.schema(rows.schema).parquet(staged)
    store = SnapshotStore(spark, scratch(spark, "index"), [source, "_key"], names, source=source, keep=None)
    out = spark.createDataFrame([], f"`{seq}` {dict(rows.dtypes)[seq]}, `{source}` string, _key string, change_kind string")
    for (number,) in sorted(laid.select(seq).distinct().collect()):  # the numbers of the deliveries
        changes = store.apply(laid.where(F.col(seq) == number).drop(seq), version)
        if changes is not None:
            out = out.unionByName(changes.select(F.lit(number).cast(dict(rows.dtypes)[seq]).alias(seq), source, "_key", "change_kind"))
    return out


def found_changes(snapshot: DataFrame) -> DataFrame:
    """Distinct (snap_no, shop, page_path, change_kind) of the catalogue snapshots."""
    return changes_in_history(
        snapshot.select("snap_no", "shop", "url", "loaded_at", "price", "in_stock"),
        source="shop", seq="snap_no", key=page_path(F.col("url")), version="loaded_at",
        values=[cents(F.col("price")).alias("cents"), F.col("in_stock")],
    ).withColumnRenamed("_key", "page_path")
