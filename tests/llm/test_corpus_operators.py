"""Chat formatting, sharding, the classifier, the pipeline and the registered queries."""

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm import chat, quality, shards
from feedloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR
from workloads.check import normalized

TURNS = "conv_id long, turn long, role string, text string"


def _render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_preferences_share_the_longest_prefix(spark):
    rng = random.Random(1)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, ""]))
    pairs = [(i, [turn() for _ in range(rng.randint(0, 4))], [turn() for _ in range(rng.randint(0, 4))]) for i in range(150)]
    pairs += [(900, None, [("user", "x")]), (901, [("user", "x")], [("user", "x")])]
    schema = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    clean = spark.createDataFrame(pairs, schema).withColumns({
        c: F.transform(c, lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.text, F.lit("")).alias("text"))) for c in ("chosen", "rejected")
    })
    got = {r.id: r for r in chat.preference_examples(clean).collect()}
    for i, a, b in pairs:
        a, b = ([(r or "", t or "") for r, t in x or []] for x in (a, b))
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        row = got[i]
        assert (row.shared_turns, row.prompt, row.chosen, row.rejected) == (k, _render(a[:k]), _render(a[k:]), _render(b[k:]))
        for mask, rest in ((row.chosen_mask, a[k:]), (row.rejected_mask, b[k:])):
            assert mask == ",".join(f"{int(r == 'assistant')}x{len(_render([(r, t)]))}" for r, t in rest)


def test_conversations_with_nulls_and_repeats(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 1, "user", "x"), (2, None, None, None)]
    lists = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.turn_lists(spark.createDataFrame(rows, TURNS)).collect()}
    assert lists == {1: [("user", "a"), ("user", "a"), ("assistant", "b")], None: [("user", "x")], 2: [("", "")]}
    out = {r.conv_id: r.rejected_id for r in chat.drifted_pairs(spark.createDataFrame(rows, TURNS)).collect()}
    assert out == {1: 2, 2: 1, None: None}
    assert chat.drifted_pairs(spark.createDataFrame([], TURNS)).count() == 0


def test_shards_are_equal_and_gapless(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.choice([None, "", "é" * rng.randint(1, 50), "same"])) for _ in range(1003)] + [(7, "same")] * 400 + [(None, "x")] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(5)
    placed = shards.placed(df, 40)
    got = placed.collect()
    again = sorted(map(tuple, shards.placed(df.repartition(2), 40).collect()), key=str)
    assert sorted(map(tuple, got), key=str) == again  # the layout of the input does not matter
    counts = [0] * 40
    for r in got:
        counts[r.shard] += 1
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(40) for k in range(counts[s])]
    key = lambda d, t: (d if d is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted(key(*r) for r in rows) == sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    rises = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 0.4 * len(order) < rises < 0.6 * len(order)
    assert shards.placed(df.limit(0), 40).count() == 0


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    rows = [(i % 70, f"t{i % 50}", i) for i in range(500)] + [(1, "hot", 0)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, copy long").repartition(4)
    shards.write_shards(df, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.copy) for r in back.collect()) == sorted(rows)
    per = back.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in per) and max(r.n for r in per) - min(r.n for r in per) <= 1


def test_shuffle_moves_whole_records(spark, monkeypatch):
    """What the second pass writes holds each text, and the places are read from it."""
    rows, written, table = [(i, f"text {i} é") for i in range(200)], [], shards.Stage.table
    monkeypatch.setattr(shards.Stage, "table", lambda self, df, name: (written.append((out := table(self, df, name)).collect()), out)[1])
    got = shards.placed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).collect()
    assert sorted(tuple(r.record) for r in written[-1]) == rows and len({r.bucket for r in written[-1]}) == 8
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == [(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows]


def test_classifier_learns_and_handles_odd_rows(spark):
    rng = random.Random(3)
    good, bad = (["Der", "city", "was", "built", "in", "spring.", "People", "came"], ["BUY!!", "NOW!!", "$$$x", "click|", "|here", "WIN!!"])
    docs = [(i, " ".join(rng.choices(good if i % 4 else bad, k=rng.randint(5, 60)))) for i in range(700)]
    docs += [(900, None), (901, ""), (902, "city was " * 100_000), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    learned = quality.training_labels(labels)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in learned.collect())
    model = quality.fit(df, learned)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.7) == bool(i % 4) for i in range(700)) and got[902] >= 0.7
    assert all(0 <= s <= 1 for s in got.values())
    kept = quality.keep_quality(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, s in got.items() if s >= 0.7}
    one_class = quality.fit(df, labels.where("quality = 1").selectExpr("doc_id", "quality AS label"))
    assert all(r.score > 0.9 for r in quality.score(df, one_class).collect())
    nothing = quality.fit(df.limit(0), labels.limit(0).selectExpr("doc_id", "quality AS label"))
    assert quality.score(df.limit(0), nothing).count() == 0


def test_held_out_accuracy(spark):
    rows = QUERIES["op5_quality_scores"](spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = rows.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    got, want = normalized(QUERIES[name](spark, SF_DIR).toPandas()), normalized(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("extra", F.lit(1))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF_DIR).cache()
        assert docs.columns == before.columns, name
        sizes.append(docs.count())
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert pieces.select("doc_id").distinct().count() == sizes[4]
    assert corpus_pipeline.run(spark, SF_DIR).count() == pieces.count()
