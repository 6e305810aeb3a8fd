"""Benchmark decontamination: pigeonhole pieces found exactly, candidates verified by Myers' bit-parallel distance."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get this module's code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ERROR_RATE = 0.08  # edits an item may differ by, as a share of its length
MIN_CHARS = 40  # shorter items have no error budget: they match as they are, between word boundaries
BLOCK_CHARS = 4_000_000  # characters of items that are searched for in one pass


def normalized(text: str | None) -> str:
    """Lower case, runs of white space as one blank, ends trimmed; null as empty."""
    return " ".join(text.lower().split()) if text else ""


def myers_search(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the first best place in the text that holds the pattern within `most` edits."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        masks[ch] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    get = masks.get
    for at, ch in enumerate(text):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return (best, end) if best <= most else None


def _word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _apart(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] cuts through no word."""
    return not (start and _word(text[start - 1]) and _word(text[start])) and not (end < len(text) and _word(text[end - 1]) and _word(text[end]))


class Matcher:
    """Finds all items of one block in normalized texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int) -> None:
        self.items: list[tuple[int | None, str, int, bool]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            text = normalized(text)
            if not text:
                continue
            short, index = len(text) < min_chars, len(self.items)
            errors = 0 if short else int(len(text) * rate)
            self.items.append((item_id, text, errors, short))
            cuts = [len(text) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[text[a:b]].append((index, a))
        self.pieces = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.pieces.add_word(piece, (len(piece), places))
        if pieces:
            self.pieces.make_automaton()

    def find(self, raw: str | None) -> dict[int | None, tuple[int, int]]:
        """item_id -> (distance, end in the normalized text), the best place of each item found."""
        text = normalized(raw)
        found: dict[int | None, tuple[int, int]] = {}
        if not self.items or not text:
            return found
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (length, places) in self.pieces.iter(text):
            for index, offset in places:
                item_id, _, _, short = self.items[index]
                if not short:
                    starts[index].add(last + 1 - length - offset)
                elif _apart(text, last + 1 - length, last + 1) and found.get(item_id, (1, 0)) > (0, last + 1):
                    found[item_id] = (0, last + 1)
        for index, all_starts in starts.items():
            item_id, item, errors, _ = self.items[index]
            ordered = sorted(all_starts)
            low = high = ordered[0]
            for start in [*ordered[1:], None]:
                if start is not None and start - high <= errors:
                    high = start
                    continue
                begin = max(0, low - errors)
                if hit := myers_search(item, text[begin : high + len(item) + errors], errors):
                    best = found.get(item_id)
                    if best is None or hit[0] < best[0]:
                        found[item_id] = (hit[0], begin + hit[1])
                low = high = start
        return found


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items, some at a time: the query set may be of any size, what is held at once is bounded."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    volume = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-volume // block_chars))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield sorted({(r.item_id, r.text) for r in part.toLocalIterator()}, key=lambda item: (item[0] is None, item))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): benchmark items held by texts within rate * length edits.

    Texts and items are compared in lower case with single blanks. An item of m characters with a
    budget of e edits is cut into e + 1 pieces; a text that holds it within e edits holds one piece
    unchanged, so no such place is missed. `end` counts normalized characters. Each row of docs is
    searched whole, repeated rows each; of several places the best and first is given. Null or
    empty texts and items match nothing. Items under min_chars are found where they stand unchanged between
    word boundaries. Items without an id are one item, given with a null item_id, at its best place in each block.
    """
    spark, out = docs.sparkSession, None
    for items in _blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, min_chars)
            for batch in batches:
                rows = [
                    (doc, item, distance, end)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for item, (distance, end) in sorted(matcher.find(text).items(), key=lambda hit: (hit[0] is None, hit))
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "end"])

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, "doc_id long, item_id long, distance long, end long")
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs whose text holds no benchmark item; all columns stay."""
    spark = docs.sparkSession
    for items in _blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, min_chars)
            for batch in batches:
                at = batch.schema.names.index("text")
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
