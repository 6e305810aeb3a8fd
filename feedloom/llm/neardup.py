"""MinHash near-duplicates: banding, signature and exact verification, components by star contraction."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Stage, batches_of, cut, planned_once, shuffles_dropped
from feedloom.llm.components import connected_components

# Workers get this module's code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS, ROWS = 45, 6  # a pair at similarity 0.8 is missed by all bands with probability 1.2e-6
DEVIATIONS = 6.0  # the signature may lie so many standard deviations below the threshold
PIVOTS = 3  # members of a bucket that all others are compared with before what is still apart is paired
BROADCAST = 1 << 18  # ids up to which a list of them goes to all tasks (a few MB)
FEW = 1 << 14  # rows up to which queries are planned once, not anew after each stage
LANES = 8  # longs of a set's bitmap, which tells most pairs apart
SEED = 20_011
PIECE = 1 << 20  # bytes of a text split into words at a time
CHUNK = 1 << 16  # shingles hashed at a time
WORDS_KEPT = 400_000  # words whose hashes a task remembers
TEXTS = 500  # rows handed to Python at a time; a pair has two texts
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str, known: dict) -> np.ndarray:
    """64-bit hashes of the words of the text, A-Z lower-cased, split at ASCII white space."""
    data, start, parts = text.encode("utf-8").lower(), 0, []
    while start < len(data):
        end = len(data)
        if end - start > PIECE and (space := _SPACE.search(data, start + PIECE)):
            end = space.start()
        words = (data if not start and end == len(data) else data[start:end]).split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        start = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: str | None, words: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than one shingle has make one of them all."""
    w = word_hashes(text, known) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    count = len(w) - n + 1
    h = np.full(count, n, np.uint64)
    for j in range(n):
        h = _mixed(h + w[j : j + count])
    return np.unique(h)


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    a = random.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, count, dtype=np.uint64)


def _minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(sets, hashes): the least value of each multiply-add hash over each non-empty set."""
    out = np.full((len(a), len(sets)), np.uint64(0xFFFFFFFFFFFFFFFF))
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= CHUNK):
            total += len(sets[last])
            last += 1
        joined = np.concatenate(sets[first:last])
        starts = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        for at in range(0, len(joined), CHUNK):  # more than one turn only for one long set
            x = joined[at : at + CHUNK]
            v = np.empty_like(x)
            for j in range(len(a)):
                np.multiply(x, a[j], out=v)
                np.add(v, b[j], out=v)
                low = np.minimum.reduceat(v, starts) if last - first > 1 else v.min()
                np.minimum(out[j, first:last], low, out=out[j, first:last])
        first = last
    return out.T


_SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
    ("keys", pa.list_(pa.int64())), ("signature", pa.binary()), ("mark", pa.int64()),
])


def _signer(words: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = _WordHashes(), _coefficients(bands * rows)
        weights = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = [shingle_set(t, words, known) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                low = iter(_minima(full, a, b)) if full else iter(())
                k1, k2, keys, marks = [], [], [], []
                for s in sets:
                    if not len(s):
                        k1.append(None), k2.append(None), keys.append(None), marks.append(None)
                        continue
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    k1.append(int(digest[0])), k2.append(int(digest[1]))
                    high = next(low) >> np.uint64(24)
                    keys.append(_mixed((high.reshape(bands, rows) * weights).sum(1) + salt).view(np.int64))
                    marks.append((high & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()), part.column(2),
                ], schema=_SIGNED)
    return sign


def _alike(share: float, hashes: int):
    """Keeps pairs whose signatures (a byte of each minimum) do not rule out the threshold."""
    p = share + (1 - share) / 256
    least = hashes * p - DEVIATIONS * (hashes * p * (1 - p)) ** 0.5

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, hashes) for i in (2, 3))
            mask = (x == y).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(mask))
    return keep


def _confirmed(words: int, num: int, den: int):
    """Keeps pairs whose full sets have den * intersection >= num * union."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, hub = _WordHashes(), None, None
        for batch in batches:
            kept_a, kept_b = [], []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if a != at:
                    at, hub = a, shingle_set(x, words, known)
                other = shingle_set(y, words, known)
                both = len(np.intersect1d(hub, other, assume_unique=True))
                if den * both >= num * (len(hub) + len(other) - both):
                    kept_a.append(a), kept_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], ["a", "b"])
    return keep


def _against_hub(words: int, num: int, den: int):
    """The shingles of each member that a link of it may have to hit: those that its hub lacks, then the hub's.

    Two linked sets share num * n / den shingles of each. So in any one order of all shingles, each
    has one they share among its first n - num * n / den + 1 (`need`). The hub's come last in that
    order, and where those outside the hub are as many as needed, they are left out.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, hub_set = _WordHashes(), None, None
        for batch in batches:
            sizes, needs, outsides, insides, maps = [], [], [], [], []
            for hub, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if hub != at:
                    at, hub_set = hub, shingle_set(x, words, known)
                own = shingle_set(y, words, known)
                outside = np.setdiff1d(own, hub_set, assume_unique=True)
                need = len(own) - -(-num * len(own) // den) + 1
                sizes.append(len(own)), needs.append(need), outsides.append(outside.view(np.int64))
                insides.append(np.setdiff1d(own, outside, assume_unique=True).view(np.int64) if need > len(outside) else None)
                bits = np.zeros(64 * LANES, np.uint8)
                bits[own % np.uint64(64 * LANES)] = 1
                maps.append(np.packbits(bits).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(needs, pa.int64()),
                 pa.array(outsides, pa.list_(pa.int64())), pa.array(insides, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))],
                ["hub", "id", "component", "n", "need", "outside", "inside", "bits"],
            )
    return split


def _fits(n: Column, m: Column, num: int, den: int) -> Column:
    """Sizes that let a pair reach the threshold."""
    return den * F.least(n, m) >= num * F.greatest(n, m)


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, threshold: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text).

    Links hold where den * intersection >= num * union of the shingle sets. Equal sets are one
    class, represented by a text of its least doc_id. Classes that share a band key are candidates. Each is first
    compared with the hub of its bucket, the member with the largest buckets in all bands. Members
    of one hub that are then still in several components meet on the rarest of the shingles that
    several components have (see _against_hub and open_buckets), where no two that can be linked miss each other.
    In each such bucket all are compared with one member, PIVOTS times over, which joins what is
    alike at a cost in proportion to the bucket; those still apart are paired where sizes and bitmaps
    let them be linked. So no candidate link between components is left out, and groups of alike
    rows do not become all their pairs. Candidates are checked on signatures and confirmed on full sets.

    Null or empty texts have no shingles and no links. A null doc_id is never linked: its
    component_id is null and it is kept. Rows that repeat a doc_id are each returned; if their texts
    differ, each is searched, and what is linked to one of them is linked to the document. Other
    columns are not looked at; an empty table gives an empty result.
    """
    num, den = threshold
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.withColumn("mark", F.xxhash64("text"))
    with Stage(spark) as stage, shuffles_dropped(spark), batches_of(spark, TEXTS), ExitStack() as plans:
        signed, count = stage.counted(
            hashed.mapInArrow(
                _signer(shingle_words, bands, rows),
                "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>, signature binary, mark long",
            ), "signed",
        )
        if count <= FEW:
            plans.enter_context(planned_once(spark))
        found = signed.where("k1 is not null and doc_id is not null")
        # equal sets have equal keys and signatures, so those of any row are the class's
        known = stage.table(
            found.groupBy("k1", "k2").agg(
                F.min(F.struct("doc_id", "mark")).alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "keys", "signature"))
            ).select(
                "k1", "k2", F.col("rep.doc_id").alias("rep"), F.col("rep.mark").alias("rep_mark"),
                "n_shingles", "keys", "signature", F.monotonically_increasing_id().alias("id"),
            ), "known",
        )
        classes = known.select("k1", "k2", "rep", "id")
        rows_of = known.select("id", F.explode("keys").alias("key"))
        shared = stage.table(rows_of.join(rows_of.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "shared")
        score = shared.groupBy("id").agg(F.sum("n").alias("score"))
        hubs = shared.join(score, "id").groupBy("key").agg(
            F.max(F.struct("score", (-F.col("id")).alias("least"))).alias("best")
        ).select("key", (-F.col("best.least")).alias("hub"))
        members = stage.table(
            shared.join(hubs, "key").where("id <> hub").groupBy("hub", "id").agg(F.max("n").alias("n")), "members"
        )

        # rows of an id may have several texts; the rows of one text are read once
        repeated = signed.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0
        one = hashed.where("doc_id is not null").toDF("rep", "text", "rep_mark")
        if repeated:
            one = one.dropDuplicates(["rep", "rep_mark"])

        involved = members.select("id").union(members.select("hub")).distinct()
        named, count = stage.counted(known.select("id", "rep", "rep_mark").join(involved, "id", "left_semi"))
        compared = stage.table(one.join(F.broadcast(named) if count <= BROADCAST else named, ["rep", "rep_mark"]).select("id", "text"), "texts")

        def with_texts(rows: DataFrame, count: int, **named: str) -> DataFrame:
            """`count` rows, staged before, with the text of the class that each column names; of the texts, only those asked for are regrouped."""
            out = rows
            for column, text in named.items():
                asked, size = rows.select(F.col(column).alias("id")), count
                if size > BROADCAST:  # few rows go to all tasks as they are
                    asked, size = stage.counted(asked.distinct())
                found = compared.join(F.broadcast(asked) if size <= BROADCAST else asked, "id", "left_semi")
                out = out.join(found.select(F.col("id").alias(column), F.col("text").alias(text)), column)
            return out

        def links(pairs: DataFrame) -> tuple[DataFrame, int]:
            x = known.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
            y = known.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
            alike = (
                pairs.join(x, "a").join(y, "b").where(_fits(F.col("na"), F.col("nb"), num, den))
                .select("a", "b", "sa", "sb").mapInArrow(_alike(num / den, bands * rows), "a long, b long")
            )
            alike, count = stage.counted(alike)
            if not count:
                return alike, 0
            return stage.counted(
                with_texts(alike, count, b="y", a="x").select("a", "b", "x", "y").mapInArrow(_confirmed(shingle_words, num, den), "a long, b long")
            )

        def still_open(rows: DataFrame) -> DataFrame:
            """Rows of the buckets that hold several components."""
            several = rows.groupBy("hub", "shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
            return rows.join(several.select("hub", "shingle"), ["hub", "shingle"]).select("hub", "shingle", "id", "component", "n", "bits")

        def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame | None:
            """(hub, shingle, id, component, n): where members of a hub, of several components as yet, may meet.

            Shingles that only one component has come first in the order, as nobody meets there, then
            the others by how many members have them. So members that share a common
            passage alone don't meet on it. None where no hub's members are apart.
            """
            placed = members.where("n > 2").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            several = placed.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
            apart, count = stage.counted(placed.join(several.select("hub"), "hub"))
            if not count:
                return None
            parts = stage.table(
                with_texts(apart, count, id="y", hub="x").select("hub", "id", "component", "x", "y")
                .mapInArrow(_against_hub(shingle_words, num, den), "hub long, id long, component long, n long, need long, outside array<long>, inside array<long>, bits array<long>"),
                "parts",
            )
            # two members meet on a shingle of the hub only if neither has as many outside it as needed
            within = parts.where(F.col("need") > F.size("outside"))
            wide = within.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("hub")
            found = parts.select("hub", "id", "component", F.lit(0).alias("kind"), F.explode("outside").alias("shingle")).union(
                within.join(wide, "hub").select("hub", "id", "component", F.lit(1).alias("kind"), F.explode("inside").alias("shingle"))
            )
            live = found.groupBy("hub", "shingle").agg(
                F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("often")
            ).where("low < high").select("hub", "shingle", "often")
            ordered = found.join(live, ["hub", "shingle"]).groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("kind", "often", "shingle"))).alias("live"))
            sides = parts.select("hub", "id", "component", "n", "bits", "need", F.size("outside").alias("o"), F.coalesce(F.size("inside"), F.lit(0)).alias("i")).join(ordered, ["hub", "id"])
            first, last = (F.filter("live", lambda x, k=k: x["kind"] == k) for k in (0, 1))
            kept = F.concat(
                F.slice(first, 1, F.greatest(F.lit(0), F.least("need", "o") - (F.col("o") - F.size(first))).cast("int")),
                F.slice(last, 1, F.greatest(F.lit(0), F.col("need") - F.col("o") - (F.col("i") - F.size(last))).cast("int")),
            )
            return still_open(sides.select("hub", "id", "component", "n", "bits", F.explode(kept).alias("k")).select("hub", F.col("k.shingle").alias("shingle"), "id", "component", "n", "bits"))

        def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
            """The labels once the links found (a, b) are known too."""
            return connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found), "a", "b", stage.keep)

        def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
            """The labels once the links among these pairs are known too."""
            found, count = links(pairs.select("id1", "id2").distinct().toDF("a", "b"))
            return joined(labels, found) if count else labels

        found, _ = links(members.select(F.col("hub").alias("a"), F.col("id").alias("b")))
        labels = connected_components(found, "a", "b", stage.keep)

        opened = open_buckets(members, labels)
        buckets, count = stage.counted(opened, "buckets") if opened is not None else (None, 0)
        for turn in range(PIVOTS):
            if not count:
                break
            pivots = buckets.groupBy("hub", "shingle").agg(F.min(F.struct("id", "component", "n")).alias("p"))
            pivots = pivots.select("hub", "shingle", F.col("p.id").alias("id1"), F.col("p.component").alias("component1"), F.col("p.n").alias("n1"))
            others = buckets.join(pivots, ["hub", "shingle"]).where("id <> id1")
            labels = merged(labels, others.withColumnRenamed("id", "id2").where((F.col("component1") != F.col("component")) & _fits(F.col("n1"), F.col("n"), num, den)))
            again = others.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            buckets, count = stage.counted(still_open(again), f"buckets-{turn}")
        if count:
            one_side, other = (buckets.withColumnsRenamed({c: f"{c}{k}" for c in ("id", "component", "n", "bits")}) for k in (1, 2))
            # a bit that one set alone has is a shingle that the other lacks, and linked sets lack few of each other's
            unlike = sum((F.bit_count(F.col("bits1")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(LANES)), F.lit(0))
            alike = (num + den) * unlike <= (den - num) * (F.col("n1") + F.col("n2"))
            labels = merged(labels, one_side.join(other, ["hub", "shingle"]).where("id1 < id2 AND component1 <> component2").where(_fits(F.col("n1"), F.col("n2"), num, den) & alike))
        narrow = signed.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
        if repeated:  # the texts of an id are one document, so their classes are linked
            of = narrow.where("doc_id is not null and id is not null").select("doc_id", "id").distinct()
            shared_ids = of.join(of.groupBy("doc_id").agg(F.min("id").alias("first")), "doc_id").where("id <> first")
            labels = joined(labels, shared_ids.select("id", "first"))
        grouped = classes.select("id", "rep").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = grouped.groupBy("component").agg(F.min("rep").alias("least"))
        named = grouped.join(least, "component").select("id", "least")
        result = narrow.join(named, "id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
        if repeated:  # also for rows of it without words
            least = result.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
            result = result.drop("component_id").join(least, result.doc_id.eqNullSafe(least.doc_id)).drop(least.doc_id)
        return cut(result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
