"""Stored tables: results, history, density, token map, index, reports
(S6-S11, S13, S14, O10).

Plain Parquet has no MERGE.  A table that is rewritten is kept as numbered
versions: a new version is written completely, and readers take the newest version
that finished.  A writer that dies leaves an unfinished version nobody reads.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from riskframe import schemas
from riskframe.operators.lookup import last_per_key
from riskframe.operators.sync import upsert_results
from riskframe.scale import with_rank

#: Tasks a core that write files of their own for every row.
WRITES_PER_CORE = 4


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished_versions(spark: SparkSession, path: str) -> list[int]:
    location, files = _folder(spark, path)
    if not files.exists(location):
        return []
    found = []
    for status in files.listStatus(location):
        name = status.getPath().getName()
        done, _ = _folder(spark, f"{path}/{name}/_SUCCESS")
        if name.startswith("version=") and files.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


class VersionedTable:
    """A table whose content is replaced as a whole.

    ``origin`` keeps data of different origins (demo, live) in separate folders
    (S11), so a reader or writer of one never touches the other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, origin: str = "live"):
        self.spark = spark
        self.schema = schema
        self.path = f"{path.rstrip('/')}/origin={origin}"

    def version(self) -> int:
        """Number of the newest finished version, 0 when there is none."""
        return max(_finished_versions(self.spark, self.path), default=0)

    def read(self) -> DataFrame:
        """Current content; a table never written is empty."""
        version = self.version()
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={version:06d}")

    def replace(self, df: DataFrame) -> int:
        """Write ``df`` as the next version, which readers see once it is complete."""
        version = self.version() + 1
        columns = [F.col(field.name).cast(field.dataType) for field in self.schema]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/version={version:06d}")
        return version

    def drop_old(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions."""
        _, files = _folder(self.spark, self.path)
        for version in _finished_versions(self.spark, self.path)[:-keep]:
            location, _ = _folder(self.spark, f"{self.path}/version={version:06d}")
            files.delete(location, True)


class ResultStore:
    """Results as a compacted base and small batches on top.

    A batch is written beside the base and costs what it holds, however large the
    table is; reading keeps the newest row per ``bug_key``.  Every row carries the
    number of its batch in ``seq``, numbers only grow, and a repeated batch replaces
    itself.
    """

    schema = T.StructType([*schemas.RESULT.fields, T.StructField("seq", T.LongType())])

    def __init__(self, spark: SparkSession, path: str, origin: str = "live"):
        self.spark = spark
        self._base = VersionedTable(spark, f"{path.rstrip('/')}/base", self.schema, origin)
        self._batches = f"{path.rstrip('/')}/batches/origin={origin}"

    def add(self, rows: DataFrame, batch: int) -> None:
        """Write one batch; ``rows`` has the result columns."""
        columns = [F.col(field.name).cast(field.dataType) for field in schemas.RESULT]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self._batches}/seq={batch}")

    def read(self) -> DataFrame:
        """Newest row per key, and every row without a key."""
        base = self._base.read()
        location, files = _folder(self.spark, self._batches)
        if not files.exists(location):
            return base
        merged = self._merged_up_to(base)
        batches = self.spark.read.schema(self.schema).parquet(self._batches)
        return upsert_results(base, batches.where(F.col("seq") > merged).select(*base.columns))

    def compact(self) -> None:
        """Fold the batches into the base; readers see the same rows before and after."""
        last = self._last_batch()
        self._base.replace(self.read())
        # Batches up to the highest number in the base are no longer read.
        for number in range(last + 1):
            location, files = _folder(self.spark, f"{self._batches}/seq={number}")
            files.delete(location, True)

    def _last_batch(self) -> int:
        location, files = _folder(self.spark, self._batches)
        if not files.exists(location):
            return -1
        names = [status.getPath().getName() for status in files.listStatus(location)]
        return max((int(n.split("=")[1]) for n in names if n.startswith("seq=")), default=-1)

    @staticmethod
    def _merged_up_to(base: DataFrame) -> int:
        highest = base.agg(F.max("seq")).first()[0]
        return -1 if highest is None else highest


class IndexStore:
    """P5: the similarity index as a compacted base and deltas on top.

    A delta holds the written rows of one load and, as rows with ``gone``, marks for
    deleted keys, so a load writes what it changes.  Readers take the newest row of
    every key and drop marks (merge on read).  Deltas are numbered; a load repeated
    under its number replaces itself.  A delta that was not finished is not read.
    """

    schema = T.StructType([*schemas.INDEX.fields, T.StructField("gone", T.BooleanType()), T.StructField("seq", T.LongType())])

    def __init__(self, spark: SparkSession, path: str, origin: str = "live"):
        self.spark = spark
        self._base = VersionedTable(spark, f"{path.rstrip('/')}/base", self.schema, origin)
        self._deltas = f"{path.rstrip('/')}/deltas/origin={origin}"

    def _numbers(self) -> list[int]:
        """Numbers of the finished deltas."""
        location, files = _folder(self.spark, self._deltas)
        if not files.exists(location):
            return []
        names = [status.getPath().getName() for status in files.listStatus(location)]
        found = [int(name.split("=")[1]) for name in names if name.startswith("seq=")]
        return sorted(n for n in found if files.exists(_folder(self.spark, f"{self._deltas}/seq={n}/_SUCCESS")[0]))

    def _newest(self, before: int | None = None) -> DataFrame:
        """Newest row of every key, marks included, of deltas numbered below ``before``."""
        base = self._base.read()
        merged = base.agg(F.max("seq")).first()[0]
        merged = -1 if merged is None else merged
        parts = [n for n in self._numbers() if n > merged and (before is None or n < before)]
        if not parts:
            return base
        plain = T.StructType([f for f in self.schema.fields if f.name != "seq"])
        rows = base
        for n in parts:
            delta = self.spark.read.schema(plain).parquet(f"{self._deltas}/seq={n}")
            rows = rows.unionByName(delta.withColumn("seq", F.lit(n).cast("bigint")))
        # Vectors stay where they are until the newest row of a key is known.
        return last_per_key(rows, ["key"], ["seq"])

    def read(self, before: int | None = None) -> DataFrame:
        """The index, optionally as it was before the load numbered ``before``."""
        columns = [field.name for field in schemas.INDEX]
        return self._newest(before).where("NOT gone").select(*columns)

    def next_number(self) -> int:
        merged = self._base.read().agg(F.max("seq")).first()[0]
        return max([-1 if merged is None else merged, *self._numbers()]) + 1

    def apply(self, written: DataFrame, deleted: DataFrame, number: int) -> None:
        """Write one delta: rows of the index and keys that are gone."""
        columns = [F.col(field.name).cast(field.dataType) for field in schemas.INDEX]
        empty = [F.lit(None).cast(field.dataType).alias(field.name) for field in schemas.INDEX if field.name != "key"]
        rows = written.select(*columns, F.lit(False).alias("gone")).unionByName(
            deleted.select(F.col("key").cast("string"), *empty, F.lit(True).alias("gone"))
        )
        rows.write.mode("overwrite").parquet(f"{self._deltas}/seq={number}")

    def compact(self) -> None:
        """Fold the finished deltas into the base; only those are deleted.

        The newest mark stays in the base, so the number of the last load is not lost.
        """
        numbers = self._numbers()
        if not numbers:
            return
        last = numbers[-1]
        rows = self._newest(last + 1).where("NOT gone").withColumn("seq", F.lit(last).cast("bigint"))
        mark = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.INDEX]
        rows = rows.unionByName(self.spark.range(1).select(*mark, F.lit(True).alias("gone"), F.lit(last).cast("bigint").alias("seq")))
        self._base.replace(rows.select(*[f.name for f in self.schema]))
        for number in numbers:
            location, files = _folder(self.spark, f"{self._deltas}/seq={number}")
            files.delete(location, True)


def count_table(spark: SparkSession, path: str, origin: str = "live") -> VersionedTable:
    """K5: counts of the newest versions of all bugs."""
    return VersionedTable(spark, path, schemas.COUNTS, origin)


def day_table(spark: SparkSession, path: str, origin: str = "live") -> VersionedTable:
    """K4: accepted successes per day."""
    return VersionedTable(spark, path, schemas.DAYS, origin)


def density_table(spark: SparkSession, path: str, origin: str = "live") -> VersionedTable:
    """The density map, overwritten as a whole."""
    return VersionedTable(spark, path, schemas.DENSITY, origin)


def index_table(spark: SparkSession, path: str, origin: str = "live") -> IndexStore:
    """The similarity index."""
    return IndexStore(spark, path, origin)


#: Errors of Spark that mean a file itself is damaged, not that storage fails for now.
DAMAGED_FILE = ("CANNOT_READ_FILE_FOOTER", "PARQUET_COLUMN_DATA_TYPE_MISMATCH", "is not a Parquet file")


class TokenMap:
    """The token map, added to by batch and reset by an empty version.

    Every ``add`` writes a folder of its own; ``compact`` folds those it read into one
    version and deletes no others.  A damaged folder is set aside by itself.
    """

    def __init__(self, spark: SparkSession, path: str, origin: str = "live"):
        self._table = VersionedTable(spark, path, schemas.PII_MAP, origin)
        self._batches = f"{path.rstrip('/')}/batches/origin={origin}"

    def _parts(self) -> list[str]:
        """Folders of the current version and of the finished batches."""
        version = self._table.version()
        found = [f"{self._table.path}/version={version:06d}"] if version else []
        location, files = _folder(self._table.spark, self._batches)
        if not files.exists(location):
            return found
        names = sorted(status.getPath().getName() for status in files.listStatus(location))
        batches = [f"{self._batches}/{name}" for name in names if name.startswith("batch=")]
        return found + [path for path in batches if files.exists(_folder(self._table.spark, f"{path}/_SUCCESS")[0])]

    def _rows(self, parts: list[str]) -> DataFrame:
        spark = self._table.spark
        if not parts:
            return spark.createDataFrame([], schemas.PII_MAP)
        return spark.read.schema(schemas.PII_MAP).parquet(*parts)

    def _damaged(self, parts: list[str]) -> bool:
        """Whether a file of ``parts`` cannot be read; errors that pass are raised."""
        try:
            self._rows(parts).write.format("noop").mode("overwrite").save()
        except Exception as error:  # noqa: BLE001 - Spark wraps the reader's error in its own
            if not any(sign in str(error) for sign in DAMAGED_FILE):
                raise
            return True
        return False

    def _sound_parts(self) -> list[str]:
        """The readable folders; others are set aside, each by itself."""
        parts = self._parts()
        if not parts or not self._damaged(parts):
            return parts
        sound = []
        for path in parts:
            if not self._damaged([path]):
                sound.append(path)
                continue
            location, files = _folder(self._table.spark, path)
            parent, name = path.rsplit("/", 1)
            stamp = f"{datetime.now(timezone.utc):%Y%m%d-%H%M%S-%f}"
            files.rename(location, _folder(self._table.spark, f"{parent}/damaged-{stamp}-{name}")[0])
        return sound

    def read(self) -> DataFrame:
        """Known tokens; damaged parts of the map are set aside, other errors are raised."""
        return self._rows(self._sound_parts()).distinct()

    def add(self, entries: DataFrame) -> None:
        """Write one batch; readers see it once it is complete."""
        columns = [F.col(field.name).cast(field.dataType) for field in schemas.PII_MAP]
        entries.select(*columns).write.parquet(f"{self._batches}/batch={uuid.uuid4().hex}")

    def compact(self) -> None:
        """Fold the batches that are there now into one version."""
        parts = self._sound_parts()
        self._table.replace(self._rows(parts).distinct())
        self._drop(parts)

    def clear(self) -> None:
        """Start anew: an empty version, and none of the batches there are now."""
        parts = self._parts()
        self._table.replace(self._table.spark.createDataFrame([], schemas.PII_MAP))
        self._drop(parts)

    def _drop(self, parts: list[str]) -> None:
        for path in parts:
            if path.startswith(self._batches):
                location, files = _folder(self._table.spark, path)
                files.delete(location, True)


def append_history(results: DataFrame, path: str) -> None:
    """Add webhook results; the history is never rewritten."""
    results.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The whole history, empty when nothing was written."""
    location, files = _folder(spark, path)
    if not files.exists(location):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def newest_first(history: DataFrame, *order: str) -> DataFrame:
    """History in reverse order of arrival, numbered by ``rank``."""
    return with_rank(history, [F.desc(name) for name in order])


def read_json_or_quarantine(
    spark: SparkSession, path: str, schema: T.StructType, quarantine: str, now: datetime
) -> DataFrame:
    """Readable rows of line-delimited JSON; damaged lines are set aside.

    Damaged lines go to ``<quarantine>/ts=<time>`` as text, and reading goes on.
    """
    location, files = _folder(spark, path)
    if not files.exists(location):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    damaged = ~F.coalesce(
        F.ltrim("value").startswith("{") & F.expr("try_parse_json(value) IS NOT NULL"), F.lit(False)
    )
    bad = lines.where(damaged)
    if not bad.isEmpty():
        bad.write.mode("append").text(f"{quarantine}/ts={now.strftime('%Y%m%d-%H%M%S')}")
    good = lines.where(~damaged)
    return good.select(F.from_json("value", schema).alias("row")).select("row.*")


def write_reports(reports: DataFrame, path: str) -> None:
    """One markdown text per change, in a folder per change.

    The cost is that of the files, not of their few bytes, so they are dealt to all cores by
    a fixed number, which AQE does not merge.
    """
    tasks = WRITES_PER_CORE * reports.sparkSession.sparkContext.defaultParallelism
    texts = reports.select("change_id", F.col("report").alias("value")).repartition(tasks, "change_id")
    texts.write.mode("overwrite").option("lineSep", "\n").partitionBy("change_id").text(path)
