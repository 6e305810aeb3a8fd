import random
import re
import time
from pathlib import Path

import pytest

from feedloom.llm import components, neardup
from feedloom.llm.common import Stage, planned_once
from feedloom.llm.components import connected_components

DOCS = "doc_id long, text string, component_id string, rep int"


def _shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _brute(rows, k):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, _shingles(t, k)) for d, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), d == find(d)) for d, s in sets)


def _result(spark, rows, k, schema=DOCS):
    df = spark.createDataFrame([(*r, None, None) for r in rows], schema)
    return neardup.near_duplicates(df, shingle_words=k)


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, k):
    """Families of edited copies, of which many members are linked to some members only."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 150]))]
        for _ in range(50 if family else 90):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((" " if rng.random() < 0.5 else "\n").join(copy).title() + " " * rng.randint(0, 2))
    texts += ["", "   ", "One", "one", "one two", "ONE  two", "é É", "é é"] + [" ".join(rng.choices(words, k=30)) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    assert sorted(map(tuple, _result(spark, rows, k).collect())) == _brute(rows, k)
    shared = [(d // 3, t) for d, t in rows[:200]]  # ids with several texts
    assert sorted(map(tuple, _result(spark, shared, k).collect())) == _brute(shared, k)


def test_ids_with_several_texts(spark):
    a, b = "one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(5, a), (5, b), (9, a + " more"), (7, b + " more"), (5, ""), (5, a)]
    assert sorted(map(tuple, _result(spark, rows, 2).collect())) == _brute(rows, 2)
    assert {r.component_id for r in _result(spark, rows, 2).collect()} == {5}


def test_group_around_a_common_passage(spark, monkeypatch):
    """5,000 texts share a passage; some are edited copies of others. Candidates grow with the group, not with its square."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for i in range(5000):
        own = [f"w{rng.randrange(4000)}" for _ in range(25)]
        if i % 10 == 9:
            own = texts[-1].split()[60:]
            own[rng.randrange(25)] = "edit"
        texts.append(f"{passage} {' '.join(own)}")
    rows = list(enumerate(texts))
    # the passage is shared by all; two texts are linked where enough of the rest is shared too
    counted, alike = [], neardup._alike

    def counting(share, hashes):
        keep, seen = alike(share, hashes), spark.sparkContext.accumulator(0)
        counted.append(seen)

        def run(batches):
            def each():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch
            return keep(each())
        return run

    monkeypatch.setattr(neardup, "_alike", counting)
    got = sorted(map(tuple, _result(spark, rows, 2).collect()))
    sets = [_shingles(t, 2) for t in texts]
    index = {}
    for i, s in enumerate(sets):
        for shingle in s:
            index.setdefault(shingle, []).append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = len(_shingles(passage, 2))
    for i, s in enumerate(sets):
        shared = {}
        for shingle in s:
            if len(index[shingle]) < 100:
                for j in index[shingle]:
                    if j > i:
                        shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            both = n + common
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == [(i, len(sets[i]), find(i), i == find(i)) for i in range(len(rows))]
    assert sum(a.value for a in counted) < 10 * len(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None), (4, "")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in _result(spark, rows, 2).collect())
    assert got == [(0, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert _result(spark, [], 2).count() == 0


def test_long_text_equals_its_copy(spark):
    text = " ".join(f"word{i % 7919}" for i in range(200_000))
    got = {r.doc_id: r.component_id for r in _result(spark, [(5, text), (9, text + " more"), (7, "word1")], 5).collect()}
    assert got == {5: 5, 9: 5, 7: 7}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (None, 7)]
    links += [(b, a) for a, b in links[:30]]
    rng.shuffle(links)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)}


def test_shuffle_files_go_and_empty_rounds_are_left_out(spark):
    base = [[f"w{i}x{k}" for k in range(40)] for i in range(20)]
    texts = [" ".join(b) for b in base] + [" ".join([*b, "more"]) for b in base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {p.name for f in folders for p in Path(f).rglob("shuffle_*.data")}
    before = held()
    spark.sparkContext.setJobGroup("neardup", "jobs are counted")
    try:
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, shingle_words=2).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("neardup"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i % 20 for i in range(40)}
    assert jobs < 150  # the rounds on open buckets have nothing to do here
    for _ in range(50):  # files are deleted a moment later
        if len(held() - before) <= 10:
            break
        time.sleep(0.2)
    assert len(held() - before) <= 10  # of some hundred; what reads df itself may stay
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rows_are_counted_while_they_are_written(spark):
    """No query of its own counts what a table holds: the driver keeps a plan and its figures for each."""
    store = spark._jsparkSession.sharedState().statusStore()
    texts = [" ".join(f"w{i % 20}x{k}" for k in range(40)) + " more" * (i // 20) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    before = store.executionsCount()
    result = neardup.near_duplicates(df, shingle_words=2)
    for _ in range(50):  # the store follows a moment later
        seen = store.executionsCount()
        time.sleep(0.2)
        if store.executionsCount() == seen:
            break
    assert seen - before < 20
    assert {r.doc_id: r.component_id for r in result.collect()} == {i: i % 20 for i in range(40)}


@pytest.mark.parametrize("rows", [0, 1, 57])
def test_counted_tables(spark, rows):
    with Stage(spark) as stage:
        kept, count = stage.counted(spark.range(rows).repartition(3).distinct())
        again, same = stage.counted(kept.where("id >= 0"), "named")
        assert count == same == rows == kept.count() == again.count()


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Tasks hold a batch of whole texts on both sides of the pipe, and pairs have two of them."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(1500):
        copy = list(base)
        copy[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    large, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def watched(make):
        def made(*args):
            work = make(*args)

            def run(batches):
                def each():
                    for batch in batches:
                        seen.add(batch.num_rows)
                        large.add(int(batch.num_rows > 500))
                        yield batch
                return work(each())
            return run
        return made

    for name in ("_signer", "_alike", "_confirmed", "_against_hub"):
        monkeypatch.setattr(neardup, name, watched(getattr(neardup, name)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = neardup.near_duplicates(df, shingle_words=2).collect()
    assert len(got) == 1500 and {r.component_id for r in got} == {0}
    assert seen.value > 4 * 1400 and large.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_few_rows_are_planned_once(spark, monkeypatch, few):
    """A query on few rows is about one job, not one for each of its stages and broadcasts; larger inputs give the same rows."""
    monkeypatch.setattr(neardup, "FEW", few)
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(name) for name in names]
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(40)]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(40)] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.sparkContext.setJobGroup(f"planned-{few}", "jobs are counted")
    try:
        got = sorted(map(tuple, neardup.near_duplicates(df, shingle_words=2).collect()))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"planned-{few}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == _brute(rows, 2)
    assert (jobs < 80) == (few > 0)  # 158 and 50 when written
    assert [spark.conf.get(name) for name in names] == before


def test_few_rows_need_few_queries(spark):
    """Links are found by two queries, classes by one with one shuffle: the driver holds a plan, jobs and tasks for each."""
    store = spark._jsparkSession.sharedState().statusStore()
    texts = [" ".join(f"w{i % 20}x{k}" for k in range(40)) + " more" * (i // 20) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    before = store.executionsCount()
    result = neardup.near_duplicates(df, shingle_words=2)
    for _ in range(50):  # the store follows a moment later
        seen = store.executionsCount()
        time.sleep(0.2)
        if store.executionsCount() == seen:
            break
    assert seen - before < 15
    assert {r.doc_id: r.component_id for r in result.collect()} == {i: i % 20 for i in range(40)}


def test_few_rows_get_no_generated_code(spark):
    plan = lambda: spark.range(9).selectExpr("id % 2 AS k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    with planned_once(spark):
        assert "*(" not in plan()
    assert spark.conf.get("spark.sql.codegen.wholeStage") == before == "true"


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_rounds_on_few_edges(spark, monkeypatch, few):
    """Rounds of either kind end at the least node of each component, and few edges are shuffled three times a round."""
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(11)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (None, 7), (3, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = sorted(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == sorted((x, find(x)) for x in parent if x != find(x))
    with planned_once(spark):
        edges = spark.createDataFrame([(9, 3), (9, 4), (4, 1)], "u long, v long")
        assert components._stars(edges)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
