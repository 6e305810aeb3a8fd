"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut

# Workers get this module's code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNITS = 1 << 15  # hash slots of words and word forms; fits into 16 bits with a sign
WIDTH = 32  # numbers of a word vector
NONZERO = 6  # of which so many are set in an index vector
HIDDEN = 32
SAMPLE = 20_000  # labelled rows that are fitted on, the first in order of hash
SEED = 4_241
THRESHOLD = 0.7
PIECE = 1 << 18  # words handled at a time
WORDS_KEPT = 300_000
SALTS = 16  # first groups that partial vectors are summed in
SLOTS = 512  # slots of a row of partial vectors
_FORM = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


class _Units(dict):
    """word -> slot of the word * UNITS + slot of its form: case and the marks around it."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        before, core, after = _FORM.match(word).groups()
        case = "u" if core.isupper() and len(core) > 1 else "t" if core.istitle() else "l" if core.islower() else "d" if core.isdigit() else "m"
        form = f"{before[:4]} {case} {after[:4]}"
        value = self[word] = (
            xxhash.xxh3_64_intdigest("w" + (core.lower() or word)) % UNITS * UNITS + xxhash.xxh3_64_intdigest("f" + form) % UNITS
        )
        return value


def _index_vectors() -> np.ndarray:
    random = np.random.default_rng(SEED)
    out = np.zeros((UNITS, WIDTH), np.int32)
    at = np.argsort(random.random((UNITS, WIDTH)), axis=1)[:, :NONZERO]
    out[np.arange(UNITS)[:, None], at] = random.integers(0, 2, (UNITS, NONZERO)) * 2 - 1
    return out


def _slots(text: str, known: _Units) -> Iterator[np.ndarray]:
    """The slots of a text, word and form in turn, some words at a time."""
    words = text.split()
    for at in range(0, len(words), PIECE):
        part = words[at : at + PIECE]
        both = np.fromiter(map(known.__getitem__, part), np.int32, len(part))
        slots = np.empty(2 * len(part), np.int32)
        slots[0::2], slots[1::2] = both // UNITS, both % UNITS
        yield slots


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the sum of the index vectors of the two slots before and after each slot."""
    known = _Units()
    index = np.concatenate([_index_vectors(), np.zeros((1, WIDTH), np.int32)]).astype(np.int8)  # -1 has no vector
    total, pending, size = np.zeros((UNITS, WIDTH), np.int64), [], 0

    def add() -> None:
        ids = np.concatenate(pending)  # texts are kept apart by two slots -1
        v = index[ids]
        around = np.zeros_like(v)
        for d in (1, 2):
            around[d:] += v[:-d]
            around[:-d] += v[d:]
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ordered = ids[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        slot, sums = ordered[starts], np.add.reduceat(around[order], starts, axis=0, dtype=np.int32)
        total[slot[slot >= 0]] += sums[slot >= 0]

    gap = np.full(2, -1, np.int32)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for ids in _slots(text or "", known):
                pending += (ids, gap)
                size += len(ids) + 2
                if size > 50_000:
                    add()
                    pending, size = [], 0
    if pending:
        add()
    salt = TaskContext.get().partitionId() % SALTS
    for block in range(UNITS // SLOTS):
        part = total[block * SLOTS : (block + 1) * SLOTS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([part.tobytes()])], ["block", "salt", "sums"])


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, names = np.zeros((SLOTS, WIDTH), np.int64), None
    for batch in batches:
        for sums in batch.column(batch.schema.names.index("sums")).to_pylist():
            total += np.frombuffer(sums, np.int64).reshape(SLOTS, WIDTH)
    values = [k.as_py() for k in key]
    names = ["block", "salt"][: len(values)]
    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in values), pa.array([total.tobytes()])], [*names, "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(slots, width) unit vectors from the contexts of all words of docs.text.

    Counts are whole numbers, so the sum does not depend on the order. Each task holds one table of
    fixed size; the tables are summed by block and salt, then by block. What comes to the driver
    is one table (UNITS * WIDTH * 8 bytes = 8 MB), whatever the input.
    """
    partial = docs.select(F.col("text").cast("string")).mapInArrow(_contexts, "block int, salt int, sums binary")
    summed = partial.groupBy("block", "salt").applyInArrow(_added, "block int, salt int, sums binary")
    total = np.zeros((UNITS, WIDTH), np.float64)
    for row in summed.groupBy("block").applyInArrow(_added, "block int, sums binary").collect():
        total[row.block * SLOTS : (row.block + 1) * SLOTS] = np.frombuffer(row.sums, np.int64).reshape(SLOTS, WIDTH)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, known: _Units) -> np.ndarray:
    """Mean word vector and mean form vector of a text; zeros for an empty one."""
    sums, n = np.zeros(2 * WIDTH), 0
    for ids in _slots(text or "", known):
        for at in range(0, len(ids), 1 << 15):
            part = vectors[ids[at : at + (1 << 15)]]
            sums += np.concatenate([part[0::2].sum(0), part[1::2].sum(0)])
        n += len(ids) // 2
    return sums / max(n, 1)


@dataclass
class Model:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def parts(self) -> tuple:
        return self.vectors, self.center, self.scale, self.layers, self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_logits(self.layers, (x - self.center) / self.scale) / self.temperature, -40, 40)))


def _logits(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2[:, 0] + b2[0]


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 150) -> list[np.ndarray]:
    """Two layers by Adam on the mean log loss, with weight decay."""
    random = np.random.default_rng(SEED)
    layers = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(rounds):
        for part in np.array_split(random.permutation(len(x)), max(1, len(x) // 256)):
            w1, b1, w2, b2 = layers
            h = np.tanh(x[part] @ w1 + b1)
            d = ((1 / (1 + np.exp(-np.clip(h @ w2[:, 0] + b2[0], -40, 40)))) - y[part])[:, None] / len(part)
            dh = (d @ w2.T) * (1 - h * h)
            step += 1
            for i, g in enumerate((x[part].T @ dh + 1e-4 * w1, dh.sum(0), h.T @ d + 1e-4 * w2, d.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits, from a fixed grid, with the least log loss on held rows."""
    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, np.where(y > 0.5, -logits, logits) / t)))
    return min((float(t) for t in np.geomspace(0.25, 8, 61)), key=loss)


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: crc32 of the id as text, modulo 4, is not 2.

    Null ids and labels are left out; an id with several labels takes their majority, 1 in a tie.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 != 2)
    return usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors from all texts; the network from at most `sample` labelled rows, a fifth of them for calibration.

    Without labelled rows, or with one class only, every score is the share of label 1 (0.5 without rows).
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Units()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([pooled(t, shared.value, known).tobytes() for t in batch.column(2).to_pylist()], pa.binary())],
                ["doc_id", "label", "x"],
            )

    picked = cut(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(picked), "doc_id")  # at most `sample` rows
        .select("doc_id", "label", "text").mapInArrow(embed, "doc_id long, label int, x binary")
        .dropDuplicates(["doc_id"]).collect()
    )
    rows.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r.doc_id)))
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(-1, 2 * WIDTH)
    y = np.array([r.label for r in rows], float)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        odds = np.log((share + 1e-3) / (1 - share + 1e-3))
        layers = [np.zeros((2 * WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.array([odds])]
        return Model(vectors, np.zeros(2 * WIDTH), np.ones(2 * WIDTH), layers, 1.0)
    center, scale = x.mean(0), x.std(0) + 1e-6
    x, held = (x - center) / scale, len(x) // 5
    layers = _train(x[held:], y[held:])
    temperature = _temperature(_logits(layers, x[:held]), y[:held]) if held >= 20 else 1.0
    return Model(vectors, center, scale, layers, temperature)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; the text alone decides, null texts count as empty, repeated rows each get theirs."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = _Units(), Model(*shared.value)
        for batch in batches:
            x = np.array([pooled(t, m.vectors, known) for t in batch.column(1).to_pylist()]).reshape(-1, 2 * WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = _Units(), Model(*shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            x = np.array([pooled(t, m.vectors, known) for t in texts]).reshape(-1, 2 * WIDTH)
            yield batch.filter(pa.array(m.scores(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
