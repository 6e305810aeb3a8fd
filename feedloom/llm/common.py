"""Staging, lineage cuts and distributed neighbours, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, ExitStack, contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where the setting is missing."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        found = context.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and cut from their lineage."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class Stage:
    """Parquet tables in the shared folder that live as long as the `with` block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.kept = spark, 0
        self.root = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"

    def __enter__(self) -> Stage:
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of df as a table that needs no name."""
        self.kept += 1
        return self.table(df, f"kept-{self.kept}")

    def counted(self, df: DataFrame, name: str | None = None) -> tuple[DataFrame, int]:
        """The rows of df as a table, and how many were written; no job of its own counts them."""
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"))
        kept = self.table(watched, name) if name else self.keep(watched)
        return kept, seen.get["n"]

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Jobs of the block hand `rows` rows at a time to Python; for rows of several megabytes."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def large_rows(spark: SparkSession) -> Iterator[None]:
    """Parquet tables of the block are written and read a few rows at a time; for rows of a megabyte.

    Writers look at the size of what they hold after 100 rows only, and readers take 4,096 rows at once.
    """
    with ExitStack() as held:
        for name, value in (
            ("parquet.page.size.row.check.min", "1"), ("parquet.block.size.row.check.min", "1"), ("parquet.block.size", str(16 << 20)),
            ("spark.sql.parquet.columnarReaderBatchSize", "4"),
        ):
            held.enter_context(_setting(spark, name, value))
        yield


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Each action of the block deletes its shuffle files when it ends; for many actions that write what they find."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Queries of the block are planned once and run as one job; for many queries on few rows.

    Adaptive execution plans a query anew after each of its stages and broadcasts, and the driver
    keeps a thread for each of them for a minute. No code is generated for whole stages: the driver would
    compile it again for each query, as it remembers 100 classes, and few rows don't repay that.
    """
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, spark.sparkContext.defaultParallelism))
    with ExitStack() as held:
        for name, value in (
            ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", str(parts)),
            ("spark.sql.codegen.wholeStage", "false"),
        ):
            held.enter_context(_setting(spark, name, value))
        yield


def successors(keys: DataFrame, column: str, out: str, descending: bool = False) -> DataFrame:
    """(column, out): each distinct non-null key with the next one in order, the last with the first.

    The keys are dealt out by range, so that only the ends of the ranges, one row for each
    partition, are looked at together.
    """
    spark = keys.sparkSession
    order = F.col(column).desc() if descending else F.col(column).asc()
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(
        keys.select(column).where(F.col(column).isNotNull()).distinct()
        .repartitionByRange(parts, order).withColumn("part", F.spark_partition_id())
    )
    edge = F.max if descending else F.min
    firsts = dealt.groupBy("part").agg(edge(column).alias("first"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(whole)).alias("beyond"),
    )
    inside = dealt.withColumn(out, F.lead(column).over(Window.partitionBy("part").orderBy(order)))
    return (
        inside.join(F.broadcast(turns), "part")  # a row for each shuffle partition
        .select(column, F.coalesce(F.col(out), F.col("beyond")).alias(out))
    )
