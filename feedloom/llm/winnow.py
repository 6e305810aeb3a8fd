"""Winnowing fingerprints in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import cut

GRAM = 16  # bytes of a k-gram
WINDOW = 32  # k-grams of a window, a power of two; texts that share WINDOW + GRAM - 1 bytes share a fingerprint
_HASH = 0x7FFFFFFF00000000
_LOW = 0xFFFFFFFF


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def winnowed(data: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The picked k-grams of a UTF-8 text given as binary, in order, each packed as hash << 32 less (position + 1).

    Every window of k-grams picks its least hash, the rightmost of equals: as a later position
    takes off more, that is the least packed number. Window minima come from doubling: the minimum over
    2^j + 2^j grams is the lesser of two neighbours. A text shorter than a k-gram is one gram, one
    with fewer grams than a window is one window, an empty one has none. The work is on bytes, where
    a position is an offset, so long texts cost no more for each gram.
    """
    def hashed(b: Column) -> Column:
        last = F.greatest(F.octet_length(b) - gram + 1, F.lit(1))
        return F.when(F.octet_length(b) > 0, F.transform(
            F.sequence(F.lit(1), last),
            lambda i: F.xxhash64(F.substring(b, i, F.lit(gram))).bitwiseAND(F.lit(_HASH)) - i.cast("long"),
        )).otherwise(F.array().cast("array<bigint>"))

    def minima(h: Column, span: int) -> Column:
        if span == window:
            return h
        return _let(F.zip_with(h, F.slice(h, F.lit(span + 1), F.size(h)), lambda x, y: F.least(x, y)), lambda m: minima(m, span * 2))

    return _let(data, lambda b: _let(hashed(b), lambda h: F.when(
        F.size(h) > window, F.array_distinct(F.slice(minima(h, 1), F.lit(1), F.size(h) - window + 1)),
    ).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)))


def position(pick: Column) -> Column:
    """Bytes before the k-gram."""
    return (-1 - pick).bitwiseAND(F.lit(_LOW))


def rewinnowed(picks: Column, data: Column, same: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """winnowed(data), given the picks of a text whose first `same` bytes are the same.

    The windows inside those bytes pick what they picked before: the picks whose first window
    starts early enough. Only the rest of the text is hashed.
    """
    def first_window(pick: Column, i: Column) -> Column:
        before = F.get(picks, i - 1)
        enters = F.greatest(position(pick) - (window - 1), F.lit(0))
        return F.when(i == 0, F.lit(0)).when(pick < before, enters).otherwise(position(before) + 1)

    def joined(whole: Column) -> Column:
        kept = F.filter(picks, lambda p, i: first_window(p, i) < whole)
        rest = winnowed(F.substring(data, whole + 1, F.octet_length(data)), gram, window)
        both = F.array_distinct(F.concat(kept, F.transform(rest, lambda p: p - whole.cast("long"))))
        return F.when((whole > 0) & (F.octet_length(data) <= same), kept).otherwise(both)  # no window is left

    return _let(F.greatest(same - (gram + window - 2), F.lit(0)), joined)  # windows that lie inside


def _bytes(text: Column) -> Column:
    return text.cast("binary")


def rendered(picks: Column) -> Column:
    """hash:position of each pick, comma-joined."""
    return F.array_join(F.transform(
        picks, lambda p: F.concat(F.lower(F.hex(F.shiftright(p, 32))), F.lit(":"), position(p).cast("string")),
    ), ",")


def hashes(picks: Column) -> Column:
    return F.array_distinct(F.transform(picks, lambda p: F.shiftright(p, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    return _let(F.size(F.array_intersect(a, b)), lambda both: F.when(
        F.size(a) + F.size(b) == 0, F.lit(1.0),
    ).otherwise(both / (F.size(a) + F.size(b) - both)))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by binary search."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << j for j in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda low, step: F.when(F.coalesce(F.get(held, low + step - 1) <= key, F.lit(False)), low + step).otherwise(low),
    )
    return F.coalesce(found, F.lit(0))


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness to each other and to the next text.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the
    next text in descending order of doc_id (equal ids: of text hash; null ids last; after the last
    comes the first). Rows are dealt into ranges of doc_id found by approximate quantiles, four for each
    shuffle partition, so texts are moved once; only the first row of each range is looked up
    for the one before. Null texts count as empty. Repeated rows follow each other.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = min(16_384, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", quantiles, 20 * parts)).first()[0] or []
    dealt = rows.withColumns({"bucket": _bucket(F.col("doc_id"), sorted(set(bounds))), "h": F.xxhash64("text")})
    # heads: doc_id and hash of the first row of each range, a row for each range
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("first")
    heads = dealt.groupBy("bucket").agg(first)
    order = Window.orderBy(F.col("bucket").desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = cut(heads.select("bucket", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("n")))
    texts = (
        dealt.join(F.broadcast(beyond.select(F.col("n.doc_id").alias("i"), F.col("n.h").alias("nh"), F.col("bucket").alias("of"))),
                   F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("nh")))
        .groupBy("of").agg(F.min("text").alias("beyond"))
    )
    texts = texts.withColumn("beyond_picks", winnowed(_bytes(F.col("beyond"))))
    ranges = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    led = (
        dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").withColumn("picks", winnowed(_bytes(F.col("text"))))
        .withColumns({"next": F.lead("text").over(ranges), "next_picks": F.lead("picks").over(ranges)})
        .join(texts, (F.col("bucket") == F.col("of")) & F.col("next").isNull(), "left")
        .select(
            "doc_id", "text", "picks", F.coalesce("next", "beyond").alias("next"), F.coalesce("next_picks", "beyond_picks").alias("next_picks"),
        )
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    head = F.substring(F.col("text"), F.lit(1), n - half)
    edited = F.struct(
        F.octet_length(head).alias("same"), _bytes(F.concat(head, F.substring(F.col("next"), F.lit(1), half))).alias("data"),
    )
    picks = F.col("picks")
    out = _let(hashes(picks), lambda own: _let(edited, lambda e: _let(rewinnowed(picks, e["data"], e["same"]), lambda p: F.struct(
        F.sha2(e["data"], 256).alias("sha"), rendered(p).alias("print"), likeness(own, hashes(p)).alias("near_edited"),
        likeness(own, hashes(F.col("next_picks"))).alias("near_next"),
    ))))
    return led.select("doc_id", n.cast("long").alias("n_chars"), rendered(picks).alias("fingerprint"), out.alias("o")).select(
        "doc_id", "n_chars", F.col("o.sha").alias("edited_sha256"), "fingerprint", F.col("o.print").alias("edited_fingerprint"),
        F.col("o.near_edited").alias("near_edited"), F.col("o.near_next").alias("near_next"),
    )
