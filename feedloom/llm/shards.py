"""Two-pass external shuffle into training shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import Stage, cut, shuffles_dropped

SEED = 7_919
BUCKET_BYTES = 64 << 20  # what one bucket may hold in memory
OVERHEAD = 16  # bytes a record takes besides its text


def scattered_records(
    docs: DataFrame, shards: int, stage: Stage, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(record, copy, shard, slot) of every row of docs, in one random order cut into equal shards; record holds all its columns.

    Pass one scatters the records, texts included, by seeded hash over buckets of about bucket_bytes. Pass two
    applies a Fisher-Yates shuffle (Spark's `shuffle`, seeded) to the records of each bucket, and writes them. The
    buckets follow each other, and shard s takes the s-th part of that order, so shards differ by one row
    at most. Slots count from 0 in each shard.

    Rows that agree in key, size and checksum are numbered as copies, before they are moved, and scatter like any
    others. The buckets lie in a fixed number of partitions and in order of number there, and are sorted before
    they are shuffled, so a lost task gives the same order again. Columns have to be of types that Spark can order.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")
    crc = F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    alike = docs.select(F.col(key).alias("key"), size.alias("size"), crc.alias("crc")).groupBy("key", "size", "crc").agg(F.count("*").alias("n"))
    count, volume, most = alike.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)), F.max("n")).first()
    if (most or 0) > 1:
        numbered = _numbered(stage.keep(docs.withColumns({"__s": size, "__c": crc, "__p": F.spark_partition_id()})), key)
        copy = F.col("__n").cast("long")
    else:
        numbered, copy = docs, F.lit(0).cast("long")
    rows = numbered.select(F.col(key).alias("key"), size.alias("size"), crc.alias("crc"), copy.alias("copy"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"))
    buckets = max(shards, -(-volume // bucket_bytes))
    held = (
        rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key", "size", "crc", "copy"), F.lit(buckets)).cast("long"))
        .repartition(min(buckets, 1 << 14), "bucket")
        .groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "size", "crc", "copy", "record"))).alias("rows"))
        .sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    )
    shuffled = stage.table(
        held.select("bucket", F.posexplode("rows").alias("pos", "r")).select("bucket", "pos", F.col("r.copy").alias("copy"), F.col("r.record").alias("record")), "buckets"
    )
    sizes = shuffled.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = max(count, 1)
    rank = F.col("base") + F.col("pos")
    shard = F.expr(f"CAST((base + pos) * {shards} DIV {total} AS INT)")
    start = F.expr(f"(CAST((base + pos) * {shards} DIV {total} AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return shuffled.join(F.broadcast(offsets), "bucket").select("record", "copy", shard.alias("shard"), (rank - start).alias("slot"))  # a row for each bucket


def placed(docs: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, copy, shard, slot) of every row, taken from its record where it lies after both passes.

    Null texts have size 16 and checksum 0, null keys are kept; an empty table gives no rows.
    """
    held = F.col(f"record.`{text}`")
    with Stage(docs.sparkSession) as stage, shuffles_dropped(docs.sparkSession):
        records = scattered_records(docs.select(key, text), shards, stage, seed, bucket_bytes, key, text)
        return cut(records.select(
            F.col(f"record.`{key}`").alias(key), (F.coalesce(F.octet_length(held), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(held, F.lit("")), "UTF-8")).alias("text_crc32"), "copy", "shard", "slot",
        ))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """Writes the rows of docs to path/shard=N, each file in order of slot.

    A shard is spread over range partitions of (shard, slot), so none has to fit into one task.
    """
    with Stage(docs.sparkSession) as stage, shuffles_dropped(docs.sparkSession):
        records = scattered_records(docs, shards, stage, seed, bucket_bytes, key, text).select("record.*", "shard", "slot")
        records.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with __n, a number for each among those of its key, size and checksum.

    They are counted within each input partition, and the partitions after each other, so that
    very many copies of a row are not brought together.
    """
    same = [key, "__s", "__c"]
    within = F.row_number().over(Window.partitionBy(*same, "__p").orderBy(F.lit(0))) - 1
    before = Window.partitionBy(*same).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*same, "__p").agg(F.count("*").alias("__k")).select(
        F.col(key).alias("__k0"), F.col("__s").alias("__k1"), F.col("__c").alias("__k2"), F.col("__p").alias("__k3"),
        F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__start"),
    )
    matches = F.col(key).eqNullSafe(F.col("__k0")) & (F.col("__s") == F.col("__k1")) & (F.col("__c") == F.col("__k2")) & (F.col("__p") == F.col("__k3"))
    return (
        rows.withColumn("__w", within).join(starts, matches)
        .withColumn("__n", F.col("__w") + F.col("__start")).drop("__w", "__start", "__k0", "__k1", "__k2", "__k3")
    )
