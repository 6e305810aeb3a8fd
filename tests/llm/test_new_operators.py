"""Token alignment, rule ledger and Merkle manifest against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedloom.llm import align, ledger, merkle
from feedloom.llm.common import large_rows

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  a", "\n\n", "<|endoftext|> x", "<s> </s> <unk> <0x41>", "a▁b", "é𝔘𝔫😀", "\x00a\x00", "日本語テキスト", "\t tab", "a" * 3000,
    "'ll we've 12345", "x y", "\x0b\x0c\r one one one one", "# * $ % & | < >", "a a a a", "a b c a b c", "x\nx\n\n \nx ", "- one\n• two\nthree...", "É" * 60,
]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def _loop_alignment(rows):
    first, second = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b, groups = [], [], []
        if text:
            whole = (" " + text).encode()
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            parts = (
                [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a],
                [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b],
            )
            if any(b"".join(p) != whole for p in parts):
                a, b = [], []
            else:
                ends = [[sum(map(len, p[: k + 1])) for k in range(len(p))] for p in parts]
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    written = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return docs, [
        (d, len(a), len(b), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(written(g).encode()).hexdigest() if a else "")
        for d, a, b, g, links in docs
    ]


def _mixed_texts(spark, n):
    found = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n).collect()]
    return [t[:2500] for t in found]


@pytest.mark.parametrize("together", [300, 1 << 19])
def test_alignment_equals_loops(spark, together):
    texts = ODD + _mixed_texts(spark, 25) * 2
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, links int, block string").repartition(3)
    docs, want = _loop_alignment(rows)
    assert _sorted(align.link_scores(df, BYTES, PIECES, together, 3 * together).collect()) == _sorted(want)
    if together > 300:
        got = align.token_groups(df, BYTES, PIECES).collect()
        cut = lambda r: [(r.a[i:x], r.b[j:y]) for (i, j), (x, y) in zip([(0, 0), *zip(r.a_end, r.b_end)], zip(r.a_end, r.b_end), strict=False)]
        assert sorted(map(str, ((r.doc_id, r.a, r.b, cut(r), [tuple(p) for p in r.links]) for r in got))) == sorted(map(str, docs))


def test_alignment_of_empty_tables_and_long_white_space(spark):
    assert align.link_scores(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES).count() == 0
    aligner = align.Aligner(BYTES, PIECES)
    found = aligner.align([(1, " " * 1_100_000 + "x"), (2, "word " * 200_000)])
    assert found.group_from[-1] == len(found.a_last) and all(n > 0 for n in np.diff(found.group_from))
    assert sum(len(aligner.first.bytes[i]) for i in found.a.tolist()) == 1_100_002 + 1_000_001


def test_galloping_finds_all_common_values():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 1), (3, 5000), (5000, 3), (700, 900), (1, 100_000)):
        a, b = (np.unique(rng.integers(0, 4 * max(n, m) + 1, k)) for k in (n, m))
        x, y = align.galloping_intersection(a, b)
        assert np.array_equal(a[x], np.intersect1d(a, b)) and np.array_equal(b[y], np.intersect1d(a, b))


def _loop_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), len(lines),
        sum(any(c.isalpha() for c in w) for w in words), sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines),
        sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
    )


def _loop_failed(m):
    words, chars, symbols, copies, repeated, lines, letters, marked, cut = m
    tests = [
        words < 50, 100 * repeated > 50 * words, chars < 3 * words, chars > 10 * words, 10 * symbols > words, 100 * copies > 30 * lines,
        100 * letters < 80 * words, 100 * marked > 90 * lines, 100 * cut > 30 * lines, words > 100000,
    ]
    return sum(1 << i for i, failed in enumerate(tests) if failed)


def _ledger_rows(spark):
    rng = random.Random(4)
    texts = ODD + _mixed_texts(spark, 60) + [" ".join(rng.choices("abc", k=n)) for n in (2, 3, 4, 9, 70, 200)]
    texts += ["\n".join(rng.choices(["- w o", "same line", "end...", "42 43", "|x|"], k=30)) for _ in range(20)] + ["wörd " * 120_000]
    return [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]


def test_ledger_equals_loops(spark):
    rows = _ledger_rows(spark)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, failed string, n_words int").repartition(3)
    got = ledger.ledger(df)
    want = [(d, *(m := _loop_measures(t)), _loop_failed(m)) for d, t in rows]
    assert _sorted(got.collect()) == _sorted(want)
    kept = Counter((r.doc_id, r.kept, r.base_failed) for r in ledger.base_rules(df).collect())
    strict, weak = 0b1010011, 0b110101100
    assert kept == Counter((w[0], not (w[-1] & strict or (w[-1] & weak).bit_count() >= 2), bool(w[-1] & 3)) for w in want)
    assert ledger.base_rules(df.limit(0)).count() == 0


def test_ablations_equal_policies_without_the_rule(spark):
    entries = ledger.ledger(spark.createDataFrame(_ledger_rows(spark), "doc_id long, text string"))
    bits = [r.failed for r in entries.collect()]
    place = {r.name: 1 << r.bit for r in ledger.RULES}

    def kept(failed, policy, without=None):
        names = lambda group: [n for n in group if n != without and failed & place[n]]
        return not names(policy.strict) and len(names(policy.weak)) < policy.enough

    got = {(r.policy, r.rule): tuple(r)[2:] for r in ledger.ablations(entries).collect()}
    want = {}
    for p in ledger.POLICIES.values():
        for rule in p.strict + p.weak:
            now, less = [kept(b, p) for b in bits], [kept(b, p, rule) for b in bits]
            want[p.version, rule] = (len(bits), sum(b & place[rule] > 0 for b in bits), sum(now), sum(less), sum(x and not y for x, y in zip(less, now, strict=True)))
    assert got == want
    assert {r.rows for r in ledger.ablations(entries.limit(0)).collect()} == {0}
    shared = ledger.shared_failures(entries, [(entries.n_words > 50).alias("long")]).collect()
    for r in shared:
        mine = [e.failed for e in entries.collect() if (e.n_words > 50) == r.long]
        every, some, odd = ~0, 0, 0
        for b in mine:
            every, some, odd = every & b, some | b, odd ^ b
        assert (r.rows, r.any, r.all, r.odd) == (len(mine), some, every, odd)
    with pytest.raises(KeyError):
        ledger.mask(("no such rule",))


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _loop_leaf(row):
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _loop_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def _loop_proofs(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, _loop_leaf(r))) for x in langs}
    trees = {x: _loop_levels([_loop_leaf(r) for r in ordered[x]]) for x in langs}
    top = _loop_levels([trees[x][-1][0] for x in langs])
    out = []
    for j, lang in enumerate(langs):
        for i, row in enumerate(ordered[lang]):
            changed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                changed[3] += 1
            seen, others = _loop_leaf(changed), []
            for tree, at in ((trees[lang], i), (top, j)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    others += run[: at % 2] + run[at % 2 + 1 :]
                    run[at % 2] = seen
                    seen, at = _hash("".join(run)), at // 2
            out.append((row[0], _loop_leaf(row), trees[lang][-1][0], top[-1][0], _hash("".join(others)), seen, seen == top[-1][0]))
    return out, trees


DOCS = "doc_id long, source string, lang string, n_chars long, text string, rank int, tree string"


@pytest.mark.parametrize(("n", "langs"), [(1, ["a"]), (5, ["a", None]), (700, ["en", "de", None, "é", ""]), (2600, ["en"] * 12 + ["fr"])])
def test_proofs_equal_loops(spark, n, langs):
    rng = random.Random(n)
    rows = [
        (None if rng.random() < 0.05 else rng.randrange(2 * n), rng.choice([None, "s", "é"]), rng.choice(langs), rng.choice([None, -1, (1 << 63) - 1, rng.randrange(99)]), rng.choice([None, "", "é x\n"]))
        for _ in range(n)
    ]
    rows += rows[:1] * (n // 4)  # one row repeated
    df = spark.createDataFrame([(*r, 0, "t") for r in rows], DOCS).repartition(3)
    want, trees = _loop_proofs(rows)
    assert _sorted(merkle.verified_rows(df).collect()) == _sorted(want)
    if n == 2600:
        inner, _ = merkle.trees(df)
        nodes = [
            (f"{len(x)}:{x}", k, i << k, min((i + 1) << k, len(tree[0])), digest)
            for x, tree in trees.items() for k, level in enumerate(tree) for i, digest in enumerate(level)
        ]
        assert _sorted(inner.nodes().collect()) == _sorted(nodes)


def test_proofs_of_an_empty_table(spark):
    assert merkle.verified_rows(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_are_aligned_from_small_batches(spark, monkeypatch):
    name, seen, table = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, align.Stage.table
    monkeypatch.setattr(align.Stage, "table", lambda self, df, to: (seen.update({to: spark.conf.get(name)}), table(self, df, to))[1])
    before = spark.conf.get(name)
    assert align.link_scores(spark.createDataFrame([(1, "a text")], "doc_id long, text string"), BYTES, PIECES).count() == 1
    assert seen["blocks"] == str(align.ROWS) and spark.conf.get(name) == before


def test_links_of_many_texts_are_small_rows(spark, monkeypatch):
    """Three million characters are several rows of the blocks table, with two bytes a link, and give the counts of loops over a third of them."""
    seen, table = {}, align.Stage.table

    def watched(self, df, to):
        kept = table(self, df, to)
        if to == "blocks":
            seen["rows"], seen["links"], seen["bytes"] = kept.agg(F.count("*"), F.sum(F.size("docs")), F.sum(F.length("links"))).first()
        return kept

    monkeypatch.setattr(align.Stage, "table", watched)
    texts = [" ".join(f"word{i * k % 97} of {k}" for k in range(400)) for i in range(1, 4)]
    df = spark.range(0, 600, 1, 1).withColumn("text", F.array(*map(F.lit, texts))[(F.col("id") % 3).cast("int")]).withColumnRenamed("id", "doc_id")
    chars = df.agg(F.sum(F.length("text"))).first()[0]
    got = align.link_scores(df, BYTES, PIECES).collect()
    assert seen["rows"] >= chars // align.BLOCK >= 2 and seen["links"] == 600 and seen["bytes"] == 2 * sum(r.n_links for r in got)
    _, want = _loop_alignment(list(enumerate(texts)))
    assert {tuple(r)[1:5] + (r.count_sum, r.groups_sha256) for r in got} == {(*w[1:5], w[6] * 200, w[7]) for w in want}


def test_large_rows_are_written_in_small_row_groups(spark, tmp_path):
    name = "parquet.block.size.row.check.min"
    rows = spark.createDataFrame([(random.Random(i).randbytes(1 << 20),) for i in range(40)], "x binary").coalesce(1)
    with large_rows(spark):
        rows.write.parquet(str(tmp_path / "rows"))
    assert spark.conf.get(name, None) is None
    (file,) = (tmp_path / "rows").glob("*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert groups.num_rows == 40 and max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 20 << 20
