"""Packing of tokenized texts into fixed sequences by vector bin packing."""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut

# Workers get this module's code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENS = 1024
SEGMENTS = 128
BLOCK = 8192  # pieces that are packed together
SEPARATOR = 0


def load_encoder(path: str):
    """Text -> token ids, the same as those of the tokenizers library for a byte-level BPE file.

    The vocabulary's ids are in order of merges, so a rank encoder gives the same ids several times
    faster; strings of added tokens in a text become those tokens, as there. Its pattern gives up
    on about a million white-space characters in a row; such texts go to the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    # fixed value: the word pattern of byte-level BPE
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    library: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if not library:
                library.append(Tokenizer.from_file(path))
            return np.array(library[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def token_pieces(docs: DataFrame, tokenizer_path: str, tokens: int = TOKENS) -> DataFrame:
    """(row, doc_id, start, length, ids_crc32, doc_tokens): each text and its separator, cut every `tokens` ids.

    Null texts count as empty: one separator. Texts are tokenized whole. `row` numbers the pieces
    by partition and place. Repeated rows give their pieces again.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer_path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder(text or "").astype("<u4"), np.uint32(SEPARATOR)).astype("<u4")
                for start in range(0, len(ids), tokens):
                    part = ids[start : start + tokens]
                    out.append((row, doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
                    row += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def dot_product_bins(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in the bin) of each item: one bin after the other takes the fitting item with the
    largest dot product of demand and what is left, both relative to the limits."""
    kinds, of = np.unique(demand, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(kinds)))
    left = np.bincount(of, minlength=len(kinds))
    share = kinds / limits
    if (share > 1).any():
        raise ValueError("an example exceeds the limits of a sequence")
    weight = share.mean(0)
    bins, places = np.empty(len(demand), np.int64), np.empty(len(demand), np.int64)
    current = 0
    live = np.arange(len(kinds))
    while len(live):
        free, place = np.ones(kinds.shape[1]), 0
        while True:
            own = share[live]
            fits = (own <= free + 1e-9).all(1)
            if not fits.any():
                break
            k = live[np.argmax(np.where(fits, own @ (weight * free), -1.0))]
            item = order[ends[k] - left[k]]
            bins[item], places[item] = current, place
            free, place = free - share[k], place + 1
            left[k] -= 1
            if not left[k]:
                live = live[live != k]
        current += 1
    return bins, places


def pack(examples: DataFrame, limits: dict[str, int], key: str = "row", block: int = BLOCK) -> DataFrame:
    """examples with `sequence_id` and `place`: sequences whose sums keep to all limits at once.

    limits has the most of each demand column (tokens, segments, loss-bearing tokens). The examples
    are dealt by hash of their unique key into blocks of about `block`, and each block is packed by
    itself, so a task holds one block whatever the size of the table. An example that exceeds a
    limit is an error. An empty table gives no rows; other columns stay.
    """
    held = cut(examples)
    count = max(1, -(-held.count() // block))
    columns, most = list(limits), np.array(list(limits.values()), float)

    def one(block_id: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable")
        bins, places = dot_product_bins(rows[columns].to_numpy(float), most)
        return rows.drop(columns="__block").assign(sequence_id=bins + (int(block_id[0]) << 24), place=places)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", sequence_id long, place long"
    return held.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(count))).groupBy("__block").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, tokens: int = TOKENS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every text.

    Full pieces are sequences of their own; the rests are packed under the limits of tokens,
    segments and loss-bearing tokens (all but the last of each piece). In documents every token
    bears loss, so that last limit, which equals that of the tokens, never binds here.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, tokens))
    full = pieces.where(F.col("length") == tokens).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rests = pieces.where(F.col("length") < tokens).select("*", F.lit(1).cast("long").alias("segments"), (F.col("length") - 1).alias("loss"))
    limits = {"length": tokens, "segments": segments, "loss": tokens}
    packed = pack(rests, limits)
    return full.union(offsets(packed).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence_id") * 2).alias("sequence_id"), "offset"
    ))


def offsets(packed: DataFrame) -> DataFrame:
    """packed with `offset`, the tokens of a sequence before each example."""
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
