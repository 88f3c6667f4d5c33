"""Problem 1 against brute force."""

import itertools
import random
import re

import pytest

from weft.llm import near


def word_sets(text, k):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(*(w[i:] for i in range(k)))), len(w)


def brute(texts, k, least, least_words):
    sets = {i: word_sets(t, k) for i, t in texts if t is not None}
    ok = {i: s for i, (s, n) in sets.items() if n >= max(k, least_words)}
    return {(a, b) for a, b in itertools.combinations(sorted(ok), 2) if len(ok[a] & ok[b]) >= least * len(ok[a] | ok[b])}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + rng.choice([0, 1, 2])] = [f"x{rng.randrange(10**6)}"] * rng.choice([0, 1])
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    texts, i = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(12, 120))]
        for n in (0, 0, 1, 2, 4, 7):
            i += 1
            texts.append((i, edited(rng, base, n)))
    phrase = "one phrase that a very large share of all records has in common with the others".split()
    texts += [(i + j, " ".join(phrase + [rng.choice(vocabulary) for _ in range(40)])) for j in range(1, 80)]
    return texts


def test_pairs_equal_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "id long, text string")
    members, links = near.near_duplicates(df, k=3, least=0.5, crowded=8)
    got = {(r.a, r.b) for r in near.expanded(members, links).collect()}
    want = brute(corpus, 3, 0.5, 12)
    assert len(want) > 300
    assert got <= want
    assert len(got) >= 0.995 * len(want)


def test_default_is_five_words_and_four_fifths(spark, corpus):
    df = spark.createDataFrame(corpus, "id long, text string")
    members, links = near.near_duplicates(df)
    assert {(r.a, r.b) for r in near.expanded(members, links).collect()} == brute(corpus, 5, 0.8, 12)


def test_groups_of_copies_and_components(spark, rows):
    text = " ".join(f"word{i}" for i in range(30))
    other = " ".join(f"other{i}" for i in range(30))
    data = [(i, text) for i in range(1, 8)] + [(20, text + " tail"), (30, other)]
    df = spark.createDataFrame(data, "id long, text string")
    members, links = near.near_duplicates(df, k=3, least=0.5)
    assert rows(members, "id", "cls_id") == [(i, 1) for i in range(1, 8)] + [(20, 20), (30, 30)]
    assert rows(links, "a", "b") == [(1, 20)]
    assert len(rows(near.expanded(members, links))) == 8 * 7 // 2
    groups = near.components(members.selectExpr("cls_id AS id").distinct(), links)
    assert rows(groups) == [(1, 1), (20, 1), (30, 30)]


def test_components_of_a_long_path(spark, rows):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    nodes = spark.range(1, 103)
    got = rows(near.components(nodes, links))
    assert got == [(i, 1 if i <= 60 else 100 if i in (100, 101) else i) for i in range(1, 103)]


def test_awkward_rows(spark, rows):
    long = " ".join(f"l{i % 5000}" for i in range(60_000))
    data = [(1, None), (2, ""), (3, " \n "), (None, "a b c d e f g h i j k l m n"), (5, "too short a text"), (6, long), (7, long + " end"), (8, "same " * 40), (9, "same " * 41), (9, "same " * 41)]
    df = spark.createDataFrame(data, "id long, text string").selectExpr("*", "id AS cls", "text AS print", "1 AS _chunk")
    members, links = near.near_duplicates(df, k=3, least=0.5)
    assert rows(members, "id") == [(6,), (7,), (8,), (9,)]
    assert rows(links, "a", "b")[0] == (6, 7)
    empty = near.near_duplicates(df.limit(0))
    assert rows(empty[0]) == [] and rows(near.expanded(*empty)) == []


def test_large_family_loses_no_pair(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(80)]
    texts = [(0, " ".join(base))]
    for i in range(1, 301):
        w = list(base)
        for j in rng.sample(range(80), 3):
            w[j] = f"e{i}x{j}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "id long, text string")
    members, links = near.near_duplicates(df, k=3, least=0.5)
    want = brute(texts, 3, 0.5, 12)
    assert len(want) > 44_000 and {(0, i) for i in range(1, 301)} <= want
    assert {(r.a, r.b) for r in near.expanded(members, links).collect()} == want


def test_short_fingerprints_meet(spark, rows):
    data = [(8, "same " * 40), (9, "same " * 41), (10, "same " * 40 + "end"), (11, "other " * 30)]
    df = spark.createDataFrame(data, "id long, text string")
    members, links = near.near_duplicates(df, k=3, least=0.5)
    # one sequence each, the same one; and one of two
    assert [(r.a, r.b, r.similarity) for r in links.orderBy("a", "b").collect()] == [(8, 9, 1.0), (8, 10, 0.5), (9, 10, 0.5)]


def test_components_that_are_not_settled_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        near.components(spark.range(1, 61), links, most_rounds=2)


def test_variants_are_shuffled_once(spark):
    rng = random.Random(7)
    texts = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(40))) for i in range(1000)]
    texts += [(1000 + i, texts[i][1] + " end") for i in range(20)]
    df = spark.createDataFrame(texts, "id long, text string")
    jvm = spark.sparkContext._jvm

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before, old = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert near.near_duplicates(df, k=3, least=0.5)[1].count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # 28 variants a record
    rows = sum(n for k, n in written().items() if k not in before)
    assert rows < 45 * len(texts), rows


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_keys_meet_over_batches(spark, batch):
    rng = random.Random(batch)
    data = [(key, rng.randrange(300), rng.choice([4, 5, 9]), b"u%d" % key, key % 3, 50) for key, n in enumerate([1, 2, 5, 1, 6, 40, 3, 23, 17, 6, 1, 5, 12]) for _ in range(n)]
    df = spark.createDataFrame(data, "key long, id long, size int, used binary, of long, n long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = near.met_rows(df, 0.5, 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    by = {}
    for r in data:
        by.setdefault(r[0], []).append(r)
    want = {tuple(sorted((x[1], y[1]))) for g in by.values() if len(g) <= 5 for x, y in itertools.combinations(g, 2) if x[1] != y[1] and 2 * min(x[2], y[2]) >= max(x[2], y[2])}
    assert {(r.id, r.b) for r in got if r.b is not None} == want
    crowded = sorted((r.key, r.id, r["size"], bytes(r.used), r.of, r.n) for r in got if r.b is None and r.total is None)
    assert crowded == sorted(r for g in by.values() if len(g) > 5 for r in g)
    for of in range(3):
        sums = [len(g) for key, g in by.items() if key % 3 == of]
        parts = [r for r in got if r.total is not None and r.of == of]
        assert (sum(r.total for r in parts), sum(r.same for r in parts)) == (sum(sums), sum(c * (c - 1) for c in sums))
