"""Secret spans: fixed patterns, and a linear-chain conditional random field decoded by Viterbi."""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get this module's code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: the kinds of base secrets with their patterns and least lengths
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

SAMPLE = 3_000  # windows that the field is fitted on, half of them around base secrets
AROUND = 12  # tokens on either side of a window's middle
FEATURES = 1 << 12
ROUNDS = 25
SEED = 977
TOKENS_KEPT = 300_000
_TOKEN = re.compile(r"[\w+/.-]+|[^\w\s]")
_HEX_LETTERS = re.compile(r"[a-fA-F]+")
O, B, I = 0, 1, 2  # noqa: E741
_BARRED = -1e4


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of the fixed patterns' matches, leftmost first in each kind."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _shape(token: str) -> str:
    """Kinds of characters with a class of length and of mixture; marks stand for themselves."""
    if len(token) == 1 and not token.isalnum():
        return token
    if token.isascii() and token.isalpha():  # most tokens: letters of one or two cases, no change of kind
        kind = "l" if token.islower() else "u" if token.isupper() else "lu"
        return f"{kind}|{min(10, int(math.log2(len(token)) * 2))}|0|{_HEX_LETTERS.fullmatch(token) is not None}"
    kinds = Counter("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "p" for c in token)
    turns = sum(a.isalpha() != b.isalpha() for a, b in zip(token, token[1:], strict=False))
    mixed = min(9, turns * 10 // len(token))
    hexed = all(c in "0123456789abcdefABCDEF" for c in token)
    return f"{''.join(sorted(kinds))}|{min(10, int(math.log2(len(token)) * 2))}|{mixed}|{hexed}"


def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % FEATURES


def _file_features(text: str) -> list[int]:
    """Features of the whole text: digits, marks of code, blanks."""
    n = max(len(text), 1)
    code = sum(text.count(c) for c in "={};\"'")
    blank = text.count(" ") + text.count("\n")
    return [_slot(f"file code {min(5, int(code * 100 / n))}"), _slot(f"file blank {min(5, int(blank * 20 / n))}"), _slot(f"file size {min(6, int(math.log10(n)))}")]


@dataclass
class Field:
    """A fitted field: weights of hashed features (slot, label), transitions and the words it knows."""

    weights: np.ndarray
    moves: np.ndarray
    words: frozenset[str]

    def parts(self) -> tuple:
        return self.weights, self.moves, self.words

    def rows(self) -> _Rows:
        return _Rows(self)


class _Rows(dict):
    """token -> row of self.table: scores as the token itself, as the one before, two before and after."""

    def __init__(self, field: Field) -> None:
        super().__init__()
        self.field, self.places = field, {}
        self.table = np.zeros((1024, 4, 3))
        self.used = 0

    def __missing__(self, token: str) -> int:
        if len(self) > TOKENS_KEPT:
            self.clear()
        key = (_shape(token), token.lower() if token.lower() in self.field.words else "")
        place = self.places.get(key)
        if place is None:
            if self.used == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            place = self.places[key] = self.used
            for role, slots in enumerate(_token_features(*key)):
                self.table[place, role] = self.field.weights[slots].sum(0)
            self.used += 1
        self[token] = place
        return place


def _token_features(shape: str, word: str) -> list[list[int]]:
    """Feature slots of a token as itself, as the one before, as two before and as the next."""
    own = [_slot(f"0 s {shape}"), _slot(f"0 w {word}"), _slot(f"0 k {shape.split('|')[0]}")]
    return [own, *([_slot(f"{at} s {shape}"), _slot(f"{at} w {word}")] for at in ("-1", "-2", "+1"))]


def _viterbi(emission: np.ndarray, moves: np.ndarray) -> list[int]:
    (oo, ob, _), (bo, bb, bi), (io, ib, ii) = moves.tolist()
    o, b, i = 0.0, _BARRED, _BARRED
    rows, back = emission.tolist(), []
    o, b, i = rows[0][O] + oo, rows[0][B] + ob, _BARRED
    for eo, eb, ei in rows[1:]:
        x, y, z = o + oo, b + bo, i + io
        no, fo = (x, 0) if x >= y and x >= z else (y, 1) if y >= z else (z, 2)
        x, y, z = o + ob, b + bb, i + ib
        nb, fb = (x, 0) if x >= y and x >= z else (y, 1) if y >= z else (z, 2)
        y, z = b + bi, i + ii
        ni, fi = (y, 1) if y >= z else (z, 2)
        o, b, i = no + eo, nb + eb, ni + ei
        back.append((fo, fb, fi))
    last = max(((o, 0), (b, 1), (i, 2)), key=lambda p: (p[0], -p[1]))[1]
    labels = [last]
    for step in reversed(back):
        last = step[last]
        labels.append(last)
    return labels[::-1]


def tagged_spans(text: str, field: Field, rows: _Rows) -> list[tuple[int, int]]:
    """Spans that the field's best labelling of all tokens of the text marks.

    Only a token that gains more by a secret label than the best change of transitions can make up
    for lets the best path leave 'outside'; a text without one is outside as a whole and is not decoded.
    """
    tokens = _TOKEN.findall(text)
    if not tokens:
        return []
    at = np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))
    t = rows.table
    emission = t[at, 0]
    emission[1:] += t[at[:-1], 1]
    emission[2:] += t[at[:-2], 2]
    emission[:-1] += t[at[1:], 3]
    emission = emission + field.weights[_file_features(text)].sum(0)
    free = field.moves[field.moves > _BARRED / 2]
    bonus = max(0.0, float(free.max() - field.moves[O, O]))
    gain = emission[:, 1:].max(1) - emission[:, 0] + bonus
    if not (gain > -bonus).any():
        return []
    labels = _viterbi(emission, field.moves)
    spans, open_ = [], False
    if not any(labels):
        return []
    for label, m in zip(labels, _TOKEN.finditer(text), strict=True):
        if label == I and open_:
            spans[-1][1] = m.end()
        elif label != O:
            spans.append([m.start(), m.end()])
        open_ = label != O
    return [(a, b) for a, b in spans]


def _value_spans(text: str) -> list[tuple[int, int]]:
    """Where the values of base secrets lie: what the field learns to mark."""
    out = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [m.span() for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return sorted(out + [m.span() for m in _HEX.finditer(text)])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows of tokens with labels: one around each base secret, one anywhere in each text."""
    names = ["secret", "place", "tokens", "labels", "file"]
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            spans = _value_spans(text)
            mark = xxhash.xxh3_64_intdigest(text)
            middles = [(True, a) for a, _ in spans] + [(False, mark % len(text))]
            for secret, middle in middles:
                start, end = max(0, middle - 200), middle + 300
                if start and (space := text.find(" ", start, middle)) >= 0:
                    start = space
                tokens, labels, before = [], [], O
                found = list(_TOKEN.finditer(text, start, min(end, len(text))))
                center = next((k for k, m in enumerate(found) if m.end() > middle), len(found))
                for m in found[max(0, center - AROUND) : center + AROUND]:
                    inside = next((a for a, b in spans if a < m.end() and m.start() < b), None)
                    label = O if inside is None else I if before != O and inside == before_span else B
                    before, before_span = label, inside
                    tokens.append(m[0]), labels.append(label)
                if tokens:
                    out.append((secret, xxhash.xxh3_64_intdigest(f"{mark} {middle}") >> 1, tokens, labels, _file_features(text)))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on at most `sample` different windows of docs.text, the first in order of hash.

    No table marks secrets, so the values in base matches are the labels. Windows are cut on the
    executors. How many different ones lie below each power of two of the hash is counted first, so that
    only a few times `sample`, however many tasks there are, are sorted and reach the driver; each has
    at most 2 * AROUND tokens. Without base matches the field marks nothing.
    """
    windows = docs.select(F.col("text").cast("string")).mapInArrow(_windows, "secret boolean, place long, tokens array<string>, labels array<int>, file array<int>")
    size = F.length(F.bin("place"))  # the hash lies below 2 to the power of this
    counts = windows.groupBy("secret", size.alias("size")).agg(F.approx_count_distinct("place").alias("n")).collect()
    chosen = F.lit(False)
    for secret in (True, False):
        below, power = 0, 64
        for row in sorted((r for r in counts if r.secret == secret), key=lambda r: r.size):
            below, power = below + row.n, row.size
            if below >= sample:  # twice what is wanted, for the error of the counts
                break
        chosen = chosen | ((F.col("secret") == secret) & (size <= power))
    different = sorted(windows.where(chosen).dropDuplicates(["secret", "place"]).collect(), key=lambda r: r.place)
    rows = [r for secret in (True, False) for r in [r for r in different if r.secret == secret][: sample // 2]]
    return fit_windows([(r.tokens, r.labels, r.file) for r in rows])


def fit_windows(windows: list[tuple[list[str], list[int], list[int]]]) -> Field:
    """Maximizes the likelihood of the labels by Adam; forward and backward sums run over all windows of a batch at once."""
    moves = np.zeros((3, 3))
    moves[O, I] = _BARRED
    if not any(any(labels) for _, labels, _ in windows):
        moves[O, B] = _BARRED
        return Field(np.zeros((FEATURES, 3)), moves, frozenset())
    counts = Counter(w for tokens, labels, _ in windows for w in {t.lower() for t, y in zip(tokens, labels, strict=True) if y == O})
    words = frozenset(w for w, n in counts.items() if n >= 5)
    length = max(len(tokens) for tokens, _, _ in windows)
    slots = np.full((len(windows), length, 12), FEATURES)  # the last row of weights stays zero
    truth, mask = np.zeros((len(windows), length), int), np.zeros((len(windows), length), bool)
    for k, (tokens, labels, file) in enumerate(windows):
        rows = [_token_features(_shape(t), t.lower() if t.lower() in words else "") for t in tokens]
        for j, row in enumerate(rows):
            found = [*row[0], *(rows[j - 1][1] if j else ()), *(rows[j - 2][2] if j > 1 else ()), *(rows[j + 1][3] if j + 1 < len(rows) else ()), *file]
            slots[k, j, : len(found)] = found
        truth[k, : len(labels)], mask[k, : len(labels)] = labels, True
    weights = np.zeros((FEATURES + 1, 3))
    moments, step, random = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((3, 3)), np.zeros((3, 3))], 0, np.random.default_rng(SEED)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(ROUNDS):
        for part in np.array_split(random.permutation(len(windows)), max(1, len(windows) // 128)):
            s, y, m = slots[part], truth[part], mask[part]
            e = weights[s].sum(2)
            n = len(part)
            alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
            alpha[:, 0] = e[:, 0] + moves[O]
            for j in range(1, length):
                step_to = logsum(alpha[:, j - 1, :, None] + moves, 1) + e[:, j]
                alpha[:, j] = np.where(m[:, j, None], step_to, alpha[:, j - 1])
            for j in range(length - 2, -1, -1):
                step_back = logsum(moves + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
                beta[:, j] = np.where(m[:, j + 1, None], step_back, beta[:, j + 1])
            z = logsum(alpha[:, -1], 1)
            p = np.exp(np.clip(alpha + beta - z[:, None, None], -60, 0)) * m[..., None]
            d = (np.eye(3)[y] * m[..., None] - p) / n
            gw = np.zeros_like(weights)
            for label in range(3):
                gw[:, label] = np.bincount(s.ravel(), np.repeat(d[..., label].ravel(), s.shape[2]), minlength=FEATURES + 1)
            pair = np.exp(np.clip(alpha[:, :-1, :, None] + moves + (e + beta)[:, 1:, None, :] - z[:, None, None, None], -60, 0)) * m[:, 1:, None, None]
            seen = np.zeros((3, 3))
            np.add.at(seen, (y[:, :-1][m[:, 1:]], y[:, 1:][m[:, 1:]]), 1.0)
            gm = (seen - pair.sum((0, 1))) / n
            gm[O, I] = 0
            step += 1
            for at, g, w in ((0, gw - 1e-4 * weights, weights), (2, gm, moves)):
                moments[at] = 0.9 * moments[at] + 0.1 * g
                moments[at + 1] = 0.999 * moments[at + 1] + 0.001 * g * g
                w += 0.05 * (moments[at] / (1 - 0.9**step)) / (np.sqrt(moments[at + 1] / (1 - 0.999**step)) + 1e-8)
            weights[FEATURES] = 0
    return Field(weights[:FEATURES], moves, words)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs(doc_id, text).

    Spans are kind:start:end in code points, by start and then kind. Base spans cover the whole
    match of a pattern; spans of the field, kind `crf`, are added where they touch no base span.
    Texts are read whole; null ones count as empty, with no spans. Repeated rows each get theirs.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field or fit(docs)).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Field(*shared.value)
        rows = known.rows()
        for batch in batches:
            counts, digests, lines = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = [s for s in tagged_spans(text or "", known, rows) if all(s[1] <= a or b <= s[0] for a, _, _, b in base)]
                counts.append([sum(k == kind for _, _, k, _ in base) for kind in KINDS])
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in base).encode()).hexdigest())
                lines.append(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base + [(a, 3, "crf", b) for a, b in more])))
            each = list(zip(*counts, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in each), pa.array(digests, pa.string()), pa.array(lines, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
