"""Alignment of two tokenizers' tokens by galloping intersection of their end offsets."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Stage, batches_of, cut, large_rows

# Workers get this module's code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOGETHER = 1 << 19  # characters of the texts that are aligned together; a longer text is aligned by itself
BLOCK = 1 << 20  # characters of the texts whose links are counted together, which are a row
ROWS = 250  # rows read from a batch at a time
GAP = 4  # drivers between two places found before
CHUNK = 1 << 20  # tokens written out at a time
# fixed value: the word pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_NONE = np.empty(0, np.int64)


class ByteTokens:
    """Tokenizer A: a byte-level BPE file; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._path, self._library = path, None
        self._fast = tiktoken.Encoding("byte_tokens", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, text: str) -> list[int]:
        try:
            return self._fast.encode(text, disallowed_special=())  # encode_ordinary panics where this raises
        except ValueError:  # its pattern gives up on about a million white-space characters in a row
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self._path)
                self._library.encode_special_tokens = True
            return self._library.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Tokenizer B: a sentencepiece model with byte fallback, which sets a space before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        self.bytes = [
            bytes([int(self._model.id_to_piece(i)[3:-1], 16)]) if self._model.is_byte(i)
            else self._model.id_to_piece(i).replace("▁", " ").encode("utf-8")
            for i in range(self.size)
        ]

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text)


def _advance(x: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each x the first place from its start on where ends >= x: steps of 1, 2, 4 and so on, then halving.

    All searches take their steps together; `ends` closes with a sentinel above every x.
    """
    low, high, step, last = start.copy(), start.copy(), 1, len(ends) - 1
    live = np.flatnonzero(ends[high] < x)
    while len(live):
        low[live] = high[live] + 1
        high[live] = np.minimum(high[live] + step, last)
        step *= 2
        live = live[ends[high[live]] < x[live]]
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        below = ends[middle] < x[live]
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
        live = live[low[live] < high[live]]
    return low


def galloping_intersection(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in a and in b of the values they share; both rise strictly.

    The shorter list drives. First widely spaced drivers are searched for, then those between
    them, each from the place of the one before it, so a search goes as far as the gap is wide.
    """
    if len(a) > len(b):
        places = galloping_intersection(b, a)
        return places[1], places[0]
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.append(b, np.iinfo(np.int64).max)
    found = np.zeros(len(a), np.int64)
    stride = 1
    while stride * GAP < len(a):
        stride *= GAP
    known = None
    while stride:
        drivers = np.arange(0, len(a), stride)
        start = np.zeros(len(drivers), np.int64) if known is None else found[drivers // known * known]
        found[drivers] = _advance(a[drivers], start, ends)
        known, stride = stride, stride // GAP
    common = np.flatnonzero(ends[found] == a)
    return common, found[common]


@dataclass
class Aligned:
    """Tokens of several texts, one after the other; tokens of text i are those from a_from[i] to a_from[i + 1], groups likewise.

    Group g takes the tokens after those of group g - 1 up to a_last[g] and b_last[g], which end together.
    """

    doc_ids: list
    a: np.ndarray
    b: np.ndarray
    a_from: np.ndarray
    b_from: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    group_from: np.ndarray


class Aligner:
    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.first, self.second = ByteTokens(byte_path), PieceTokens(piece_path)
        self._a_len = np.array([len(t) for t in self.first.bytes], np.int64)
        self._b_len = np.array([len(t) for t in self.second.bytes], np.int64)
        # what a token is written as, followed by what ends it: , in a group, | after its last A, ; after its last B
        self._written = [
            f"{i}{mark}" for size, close in ((self.first.size, "|"), (self.second.size, ";")) for i in range(size) for mark in (",", close)
        ]

    def _tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a text, or none where it is empty or a tokenizer does not give its bytes back."""
        if not text:
            return _NONE, _NONE
        spaced = " " + text
        whole = spaced.encode("utf-8")
        a, b = self.first.encode(spaced), self.second.encode(text)
        if b"".join(map(self.first.bytes.__getitem__, a)) != whole or b"".join(map(self.second.bytes.__getitem__, b)) != whole:
            return _NONE, _NONE
        return np.fromiter(a, np.int64, len(a)), np.fromiter(b, np.int64, len(b))

    def align(self, rows: list[tuple]) -> Aligned:
        """The rows (doc_id, text), aligned as one list of tokens: the texts lie one after the other."""
        parts = [self._tokens(text) for _, text in rows]
        a, b = (np.concatenate([_NONE, *(p[k] for p in parts)]) for k in (0, 1))
        a_from, b_from = (np.cumsum([0, *(len(p[k]) for p in parts)]) for k in (0, 1))
        a_last, b_last = galloping_intersection(np.cumsum(self._a_len[a]), np.cumsum(self._b_len[b]))
        # both sides end where a text ends, so no group reaches into the next text
        return Aligned([r[0] for r in rows], a, b, a_from, b_from, a_last, b_last, np.searchsorted(a_last, a_from))

    def written(self, found: Aligned) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of each text: ids of A and B by group; '' without tokens."""
        nth = np.arange(1, len(found.a_last) + 1)
        a_group = np.searchsorted(found.a_last, np.arange(len(found.a)))
        b_group = np.searchsorted(found.b_last, np.arange(len(found.b)))
        a_code, b_code = found.a * 2, found.b * 2 + 2 * self.first.size
        a_code[found.a_last] += 1
        b_code[found.b_last] += 1
        order = np.empty(len(found.a) + len(found.b), np.int64)
        if len(nth):  # ranks: a token stands behind all of its own side and the other side's earlier groups
            b_before = np.append(0, found.b_last[:-1] + 1)
            order[np.arange(len(found.a)) + b_before[a_group]] = a_code
            order[np.arange(len(found.b)) + found.a_last[b_group] + 1] = b_code
        out = []
        starts = found.a_from + found.b_from
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            hashed = hashlib.sha256()
            for at in range(start, end, CHUNK):
                text = "".join(map(self._written.__getitem__, order[at : min(end, at + CHUNK)].tolist()))
                hashed.update((text if at + CHUNK < end else text[:-1]).encode())
            out.append(hashed.hexdigest() if end > start else "")
        return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows of the batches, gathered until their texts reach `size` characters."""
    held, chars = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.append(row)
                chars += len(row[1] or "")
                if chars >= size:
                    yield held
                    held, chars = [], 0
    if held:
        yield held


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_groups(docs: DataFrame, byte_path: str, piece_path: str, together: int = TOGETHER) -> DataFrame:
    """(doc_id, a, b, a_end, b_end, links) of every row: both token lists and how they fit together.

    a and b are the ids of space + text in each vocabulary. Group g holds the tokens from rank a_end[g - 1]
    to a_end[g] of a and from b_end[g - 1] to b_end[g] of b (0 before the first): the least ranges
    that cover the same bytes. links has the pair of ids that end each group. Null and empty
    texts, and texts that a tokenizer does not give back byte by byte, have empty lists. Repeated rows
    and null doc_ids have a row each; other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        for rows in _blocks(batches, together):
            found = aligner.align(rows)
            out = []
            for i, doc_id in enumerate(found.doc_ids):
                groups = slice(found.group_from[i], found.group_from[i + 1])
                a_last, b_last = found.a_last[groups], found.b_last[groups]
                out.append({
                    "doc_id": doc_id, "a": found.a[found.a_from[i] : found.a_from[i + 1]], "b": found.b[found.b_from[i] : found.b_from[i + 1]],
                    "a_end": a_last + 1 - found.a_from[i], "b_end": b_last + 1 - found.b_from[i],
                    "links": [{"a": x, "b": y} for x, y in zip(found.a[a_last].tolist(), found.b[b_last].tolist(), strict=True)],
                })
            link = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            lists = [(n, pa.list_(pa.int64())) for n in ("a", "b", "a_end", "b_end")]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), *lists, ("links", link)]))
    ids = "array<long>"
    return _plain(docs).mapInArrow(run, f"doc_id long, a {ids}, b {ids}, a_end {ids}, b_end {ids}, links array<struct<a:long,b:long>>")


def _place(pairs: int) -> type:
    """The smallest type that holds a place among so many pairs."""
    return np.uint16 if pairs <= 1 << 16 else np.uint32


_DOC = pa.struct([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
])


def link_scores(docs: DataFrame, byte_path: str, piece_path: str, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A link joins the A and the B token that end together at the end of a group. Its count is the number
    of links of the whole table with its pair of ids; n_best counts links whose count is the
    highest of their B id (ties included), count_sum adds the counts up.

    Each text is tokenized once. The links of a block of texts are counted in the block, and only its distinct
    pairs are shuffled: once to be added up by pair, once to bring the sums back to the block, where
    each text's own links are looked up; they are kept as places among the block's pairs, of 2 bytes where that does. The highest counts, one number for each B id, are broadcast:
    they are as many as the vocabulary at most. Odd rows are as in token_groups, with zeros.
    """
    second = PieceTokens(piece_path).size
    blocks_schema = pa.schema([
        ("block", pa.int64()), ("docs", pa.list_(_DOC)), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("links", pa.binary()),
    ])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(byte_path, piece_path), TaskContext.get().partitionId() << 33
        names = [f.name for f in _DOC]
        docs_of: list[dict] = []
        found_by: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of texts aligned together: pairs, each link's place among them, counts
        chars = 0

        def counted() -> pa.RecordBatch:
            pairs, places = np.unique(np.concatenate([p for p, _, _ in found_by]), return_inverse=True)
            counts, links, at = np.zeros(len(pairs), np.int64), [], 0
            for own, each, n in found_by:
                place = places[at : at + len(own)]
                counts[place] += n
                links.append(place.astype(_place(len(pairs)))[each].tobytes())
                at += len(own)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([docs_of], pa.list_(_DOC)), pa.array([pairs], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([b"".join(links)], pa.binary()),
            ], schema=blocks_schema)

        for rows in _blocks(batches, together):
            found = aligner.align(rows)
            per = [np.diff(x).tolist() for x in (found.a_from, found.b_from, found.group_from)]
            docs_of += [dict(zip(names, values, strict=True)) for values in zip(found.doc_ids, *per, aligner.written(found), strict=True)]
            pairs, each, n = np.unique(found.a[found.a_last] * second + found.b[found.b_last], return_inverse=True, return_counts=True)
            found_by.append((pairs, each.astype(_place(len(pairs))), n))
            chars += sum(len(r[1] or "") for r in rows)
            if chars >= block:
                yield counted()
                docs_of, found_by, chars = [], [], 0
                number += 1
                pa.default_memory_pool().release_unused()
        if docs_of:
            yield counted()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs_of = batch.column(0)[i].as_py()
                totals, best = (batch.column(2)[i].values.field(k).to_numpy(zero_copy_only=False) for k in (1, 2)) if batch.column(2)[i].is_valid else (np.zeros(0, np.int64), np.zeros(0, bool))
                links = np.frombuffer(batch.column(1)[i].as_buffer(), _place(len(totals)))
                starts = np.cumsum([0, *(d["n_groups"] for d in docs_of)])
                # running sums: whole numbers, so a difference is the sum of a text's links
                sums = np.append(0, np.cumsum(totals[links]))
                bests = np.append(0, np.cumsum(best[links].astype(np.int64)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([d["doc_id"] for d in docs_of], pa.int64()),
                    **{n: pa.array([d[n] for d in docs_of], pa.int64()) for n in ("n_a", "n_b", "n_groups")},
                    "n_links": pa.array([d["n_groups"] for d in docs_of], pa.int64()),
                    "n_best": pa.array(np.diff(bests[starts]), pa.int64()), "count_sum": pa.array(np.diff(sums[starts]), pa.int64()),
                    "groups_sha256": pa.array([d["groups_sha256"] for d in docs_of], pa.string()),
                })

    with Stage(docs.sparkSession) as stage, large_rows(docs.sparkSession):
        with batches_of(docs.sparkSession, ROWS):  # neither side of the pipe has to hold more texts than are read at a time
            blocks = stage.table(_plain(docs).mapInArrow(
                align, "block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,groups_sha256:string>>,"
                " pairs array<long>, counts array<long>, links binary",
            ), "blocks")
        pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "p")).select("block", "pos", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
        totals = stage.table(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "totals")
        piece = F.col("pair") % second
        highest = totals.groupBy(piece.alias("piece")).agg(F.max("total").alias("highest"))
        marked = totals.join(F.broadcast(highest), piece == F.col("piece")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
        back = pairs.join(marked, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "total", "best"))).alias("scores"))
        # blocks stream past the sums of their pairs: sorted, as a merge would have them, they would all be held
        scored = blocks.join(back.hint("shuffle_hash"), "block", "left").select("docs", "links", "scores").mapInArrow(
            score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
        )
        with batches_of(docs.sparkSession, 1):
            return cut(scored)
