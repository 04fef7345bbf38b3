"""Helpers that keep plans safe when the data grows.

* :func:`settle_small` replaces a frame by a local relation only after checking
  that it is small; callers that want a broadcast join get it from the optimiser
  because the size of a local relation is known.
* :func:`with_rank` numbers rows of any size without a one-task window.
* :func:`checkpointed` cuts lineage on reliable storage.
* :func:`single_row_batches` bounds what a Python function holds of rows that are large.
* :class:`LoopTables` does so for the tables of a loop and deletes what is read no more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SMALL_ROWS = 50_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local master may fall back to a temp folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="riskframe-checkpoint-")
    context.setCheckpointDir(configured)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class LoopTables:
    """Parquet tables of one loop in a folder of its own below the checkpoint folder.

    Unlike a checkpoint, a table read back has the size of its files: estimates do not
    grow from round to round, and its columns are read one by one.  A lost executor
    costs the running job's tasks, never an earlier round.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/loop-{uuid.uuid4().hex}"
        self._written = 0

    def store(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.folder}/table-{self._written}"
        self._written += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a stored table that no later plan reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def single_row_batches(spark: SparkSession) -> Iterator[None]:
    """Python functions of the plans that run inside get one row at a time: for rows of some megabytes.

    By default a batch may be hundreds of megabytes, held by the JVM and by Python, for each core.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Evaluate ``df`` once when it has at most ``max_rows`` rows.

    At most ``max_rows + 1`` rows ever reach the driver.  The result is a local
    relation, whose size the optimiser knows, so joins against it broadcast exactly
    when it is below the session's threshold.  A larger frame is checkpointed
    instead: its consumers do not recompute it, and joins stay shuffle joins.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return checkpointed(df)
    return df.sparkSession.createDataFrame(rows, df.schema)


def spread_small(df: DataFrame, max_bytes: int = 1 << 30) -> DataFrame:
    """Spread a scan of a few small files over all cores.

    A small file is often one row group and thus one task.  Scans with enough files,
    or too large to move cheaply, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > max_bytes or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def with_rank(
    df: DataFrame, order: Sequence[Column | str], name: str = "rank", start: int = 1
) -> DataFrame:
    """Number the rows of ``df`` in ``order``.

    Rows are range-partitioned on the whole sort key, sorted in parallel, and
    numbered from per-partition counts, so neither the row count nor one hot
    sort value limits it.  ``order`` has to be total (end with a unique column).
    The sorted rows are checkpointed: counts and numbers then see the same partitions.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    before, offsets = 0, []
    for row in sorted(counts):  # one row per partition
        offsets.append((row.part, before))
        before += row.n
    starts = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
    within = F.col("__place") - F.shiftleft("__part", 33)
    return placed.join(F.broadcast(starts), part == F.col("__part")).select(
        *df.columns, (within + F.col("__before") + F.lit(start)).cast("bigint").alias(name)
    )
