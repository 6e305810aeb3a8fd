"""Merkle manifest of a dataset: nested-interval labels, ancestors by containment joins, proofs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import cut

BAND = 8  # levels of a band; a group has 2 ** BAND nodes at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7  # rows whose key's checksum it divides are tampered with


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value; no two values agree."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def ranked(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """rows with `rank`, the place within its tree from 0, and `n`, the rows of the tree.

    The rows are dealt by range, numbered within each range, and the ranges of a tree are added up,
    a row for each range and tree. So a tree may have any share of the rows. What is alike in order
    is told apart by place, so repeated rows spread as well.
    """
    turn = [F.col(tree), *order, F.col("__place")]
    dealt = cut(
        cut(rows.withColumn("__place", F.monotonically_increasing_id()))
        .repartitionByRange(max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *turn)
        .withColumn("__part", F.spark_partition_id())
    )
    sizes = dealt.groupBy("__part", tree).agg(F.count("*").alias("__size"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__part", tree, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(whole).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy("__part", tree).orderBy(*turn[1:])) - 1
    return (
        dealt.withColumn("__inside", inside).join(starts, ["__part", tree])
        .withColumn("rank", F.col("__start") + F.col("__inside")).drop("__part", "__place", "__start", "__inside")
    )


def _grouped(nodes: DataFrame, band: int) -> DataFrame:
    """(tree, n, bucket, nodes, height, levels): up to 2 ** BAND neighbours of a band and all that they are merged to.

    nodes(tree, n, idx, digest, payload) lie at level band * BAND; node idx covers the leaf ranks
    from idx << level on. levels[k] has the digests k levels above them, up to the one at the
    top, or to the root of the tree where that comes first.
    """
    below = F.ceil(F.col("n") / F.lit(1 << band * BAND)).cast("long")  # nodes of the tree at this band
    height = F.when(below > 1, F.least(F.lit(BAND), F.length(F.bin(below - 1)))).otherwise(0)
    merged = F.expr("""
        aggregate(
            CASE WHEN height > 0 THEN sequence(1, height) ELSE CAST(array() AS ARRAY<INT>) END,
            array(transform(nodes, x -> x.digest)),
            (levels, k) -> concat(levels, array(transform(
                sequence(0, CAST((size(element_at(levels, -1)) - 1) DIV 2 AS INT)),
                i -> sha2(concat(get(element_at(levels, -1), 2 * i), coalesce(get(element_at(levels, -1), 2 * i + 1), '')), 256)
            )))
        )""")
    return (
        nodes.groupBy("tree", "n", F.shiftright("idx", BAND).alias("bucket"))
        .agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "payload"))).alias("nodes"))
        .withColumn("height", height.cast("int")).withColumn("levels", merged)
    )


def _proved(groups: DataFrame) -> DataFrame:
    """Each node of each group with its path: what stands left and right of it at every level of its band.

    A node covers an interval of the group's nodes, and so do its ancestors. At each level the
    parent's interval less the own one is the sibling's: what lies left, or right, or nothing.
    """
    return groups.withColumn("path", F.expr("""
        transform(sequence(0, size(nodes) - 1), p -> transform(
            CASE WHEN height > 0 THEN sequence(0, height - 1) ELSE CAST(array() AS ARRAY<INT>) END,
            k -> transform(array(struct(
                p - p % shiftleft(1, k) AS lo, least(p - p % shiftleft(1, k) + shiftleft(1, k), size(nodes)) AS hi,
                p - p % shiftleft(1, k + 1) AS outer_lo, least(p - p % shiftleft(1, k + 1) + shiftleft(1, k + 1), size(nodes)) AS outer_hi
            )), own -> struct(
                CASE WHEN own.outer_lo < own.lo THEN get(get(levels, k), shiftright(own.outer_lo, k)) ELSE '' END AS before,
                CASE WHEN own.hi < own.outer_hi THEN get(get(levels, k), shiftright(own.hi, k)) ELSE '' END AS after
            ))[0]
        ))"""))


class Tree:
    """The Merkle trees of leaves(tree, n, rank, digest, payload), ranks from 0 to n - 1 in each tree.

    Neighbouring nodes are merged in pairs, a last single one by itself, until one is left. Levels
    are built in bands of BAND, each a grouping by (tree, bucket) of at most 2 ** BAND nodes, so
    no group grows with the table. Each band has 1 / 2 ** BAND of the rows of the one below.
    """

    def __init__(self, leaves: DataFrame) -> None:
        most = leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        nodes, self.bands = leaves.withColumnRenamed("rank", "idx"), []
        while not self.bands or most > 1:
            groups = cut(_grouped(nodes, len(self.bands)))
            self.bands.append(groups)
            most = -(-most // (1 << BAND))
            nodes = groups.select(
                "tree", "n", F.col("bucket").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("digest"), F.lit(None).cast("int").alias("payload"),
            )
        self.roots = nodes.select("tree", "n", F.col("digest").alias("root"))

    def nodes(self) -> DataFrame:
        """(tree, level, lo, hi, digest) of every node: its level and the leaf ranks [lo, hi) that it covers."""
        out = None
        for band, groups in enumerate(self.bands):
            levels = groups.select("tree", "n", "bucket", F.posexplode("levels").alias("k", "digests"))
            if band:  # the lowest level of a band is the highest of the band below
                levels = levels.where("k > 0")
            level = F.col("k") + band * BAND
            nodes = levels.select("tree", "n", "bucket", "k", level.alias("level"), F.posexplode("digests").alias("i", "digest"))
            first = F.expr(f"shiftleft(shiftleft(bucket, {BAND} - k) + i, level)")
            found = nodes.select("tree", "level", first.alias("lo"), F.least(first + F.expr("shiftleft(1L, level)"), F.col("n")).alias("hi"), "digest")
            out = found if out is None else out.unionByName(found)
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """(tree, rank, digest, payload, path, above) of every leaf.

        above(tree, path, above) is what follows on the root of each tree. From the top band down, a group
        meets the node of the band above whose interval holds its own: same tree, same bucket of
        their level. Both sides are unique by that key, so no key of this join is hot.
        """
        holders = above.select("tree", F.lit(0).cast("long").alias("lo"), F.lit((1 << 62)).cast("long").alias("hi"), F.lit(0).cast("long").alias("bucket"), F.col("path").alias("tail"), "above")
        for band in range(len(self.bands) - 1, -1, -1):
            span = (band + 1) * BAND  # level of the node that a group is merged to
            lo = F.shiftleft("bucket", span)
            inner = _proved(self.bands[band]).withColumns({"__lo": lo, "__hi": F.least(lo + F.lit(1 << span).cast("long"), F.col("n"))})
            held = inner.join(holders, ["tree", "bucket"]).where("lo <= __lo AND __hi <= hi")
            rows = held.select("tree", "n", "above", "tail", F.explode(F.arrays_zip("nodes", "path")).alias("own"))
            path = F.concat("own.path", "tail")
            if not band:
                return rows.select("tree", F.col("own.nodes.idx").alias("rank"), F.col("own.nodes.digest").alias("digest"), F.col("own.nodes.payload").alias("payload"), path.alias("path"), "above")
            start = F.shiftleft(F.col("own.nodes.idx"), band * BAND)
            holders = rows.select(
                "tree", start.alias("lo"), F.least(start + F.lit(1 << band * BAND).cast("long"), F.col("n")).alias("hi"),
                F.col("own.nodes.idx").alias("bucket"), path.alias("tail"), "above",
            )


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id") -> DataFrame:
    """(tree, __tree, order, digest, tampered) of every row.

    digest covers all fields in turn; tampered is that of the row with 1 added to n_chars where
    TAMPER divides the CRC-32 of the decimal doc_id, else the same.
    """
    plain = digest(*(encoded(F.col(c)) for c in fields))
    changed = digest(*(encoded(F.col(c).cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c)) for c in fields))
    hit = F.crc32(F.encode(F.col(order).cast("string"), "UTF-8")) % TAMPER == 0
    return docs.select(
        encoded(F.col(tree)).alias("tree"), F.col(tree).cast("string").alias("__tree"), F.col(order).alias("__order"), plain.alias("digest"),
        F.when(hit & F.col("n_chars").isNotNull(), changed).alias("tampered"),
    )


def trees(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id") -> tuple[Tree, Tree]:
    """The trees of all values of `tree`, and the tree of their roots, of which the last root is the dataset's."""
    named = ranked(leaves(docs, fields, tree, order), "tree", [F.col("__order").asc_nulls_first(), F.col("digest")])
    payload = F.struct("__order", "__tree", "tampered")
    inner = Tree(cut(named.select("tree", "n", "rank", "digest", payload.alias("payload"))))
    names = inner.bands[0].where("bucket = 0").select("tree", F.element_at("nodes", 1)["payload"]["__tree"].alias("__tree"))
    tops = inner.roots.join(names, "tree").select(F.lit("").alias("whole"), F.col("tree").alias("inner"), "__tree", "root")
    placed = ranked(tops, "whole", [F.col("__tree").asc_nulls_first()])
    outer = Tree(cut(placed.select(F.col("whole").alias("tree"), "n", "rank", F.col("root").alias("digest"), F.col("inner").alias("payload"))))
    return inner, outer


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda seen, step: digest(step["before"], seen, step["after"]))


def row_proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, path, tampered) of every row of docs(doc_id, source, lang, n_chars, text).

    A row's leaf covers all its fields, nulls as `-`. The leaves of each lang, by ascending doc_id
    (null first), are merged in pairs to a subroot, the subroots by lang (null first, by bytes)
    to the root. path has what stands before and after the row's node at each level up to the
    root; an empty path means that the leaf is the root. tampered is the leaf of the tampered row,
    null where tampering changes nothing.

    Rows that agree in lang and doc_id come in order of their leaf; equal rows have equal leaves, and
    each has a place and a proof of its own. A null doc_id is never tampered with. Other columns
    are not looked at. A table without rows has no root and gives no rows.
    """
    inner, outer = trees(docs, fields, tree, order)
    root = outer.roots.select(F.col("tree").alias("whole"), "root")
    start = root.select(F.col("whole").alias("tree"), F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.struct("root").alias("above"))
    tops = outer.proofs(start).select(
        F.col("payload").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), F.col("above.root").alias("root")).alias("above"),
    )
    return inner.proofs(cut(tops)).select(
        F.col("payload.__order").alias(order), F.col("digest").alias("leaf"), "above.subroot", "above.root", "path", "payload.tampered",
    )


def verified_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row checked against the root after tampering."""
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    proved = row_proofs(docs).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
