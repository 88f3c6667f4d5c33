"""Conflicts (A9) against all pairs, with every bound small enough to matter, and what they shuffle."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import rules, vectors

SECTION = "id long, file string, owner string, heading string, text string"


def _sections(seed, n):
    """Families of edited copies, many of them equal, under few files, owners and headings."""
    rng = random.Random(seed)
    words = [f"term{i}" for i in range(80)] + ["_Edge_", "Naïve", "節点検索", "値"]
    data = []
    for i in range(n):
        base = data[rng.randrange(len(data))][4].split() if data and rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.choice([12, 40]))]
        base = [w if rng.random() < rng.choice([0.9, 0.98, 1]) else rng.choice(words) for w in base]
        data.append((i, f"f{rng.randrange(n // 3):02d}", rng.choice(["x", "y", None]), rng.choice(["H", "K", None]), " ".join(base)))
    return data


def _all_pairs(spark, data, k):
    df = spark.createDataFrame(data, SECTION)
    body = F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), "text")
    cnt = {r.id: Counter(r.t) for r in df.select("id", T.rule_terms(body).alias("t")).collect()}
    freq = Counter(w for c in cnt.values() for w in c)
    v = {i: {w: n * math.log(1 + len(data) / freq[w]) for w, n in c.items()} for i, c in cnt.items()}
    norm = {i: math.sqrt(sum(x * x for x in c.values())) for i, c in v.items()}
    want = []
    for a in data:
        for b in data:
            if (a[1], a[3] or "") < (b[1], b[3] or "") and a[2] != b[2]:
                shared = v[a[0]].keys() & v[b[0]].keys()
                sim = sum(v[a[0]][w] * v[b[0]][w] for w in shared) / (norm[a[0]] * norm[b[0]])
                if len(shared) >= 2 and 0.3 <= sim < 0.999:
                    want.append((-round(sim, 9), a[1], a[3] or "", b[1], b[3] or "", a[0], b[0], round(sim, 6)))
    return [x[-3:] for x in sorted(want)[:k]]


@pytest.mark.parametrize(("seed", "n", "known", "block", "thresholds"), [(1, 90, 7, 3, (0.98, 0.75)), (2, 150, 200_000, 2048, (0.995, 0.9)), (3, 40, 0, 2, (0.5,))])
def test_conflicts_equal_all_pairs(spark, monkeypatch, seed, n, known, block, thresholds):
    monkeypatch.setattr(vectors, "KNOWN", known)
    monkeypatch.setattr(rules, "BLOCK", block)
    monkeypatch.setattr(rules, "THRESHOLDS", tuple((t, 0) for t in (*thresholds, 0.3)))
    data = _sections(seed, n)
    got = [(r.id_a, r.id_b, round(r.similarity, 6)) for r in rules.conflicts(spark.createDataFrame(data, SECTION), 60).collect()]
    assert got == _all_pairs(spark, data, 60)


def test_terms_are_those_of_the_expression(spark):
    texts = ["", "__ _a_ a_b_ _Foo__bar_ the THE x", "Naïve İstanbul ſtraße K9", "節点検索 値 カタカナa漢_字", "tab\tand space\x0bend x1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, t string")
    for r in df.withColumn("want", T.rule_terms(F.col("t"))).collect():
        _, term, count, new, _ = vectors._counted([r.t.encode()], {})
        assert {new[i].decode(): n for i, n in zip(term, count, strict=True)} == Counter(r.want)


def test_conflicts_shuffle_no_rows_of_terms(spark, monkeypatch):
    monkeypatch.setattr(rules, "THRESHOLDS", ((0.98, 0), (0.3, 0)), raising=False)
    rng = random.Random(5)
    words = [f"term{i}" for i in range(3000)]
    data = [(i, f"f{i:05d}", "xy"[i % 2], None, " ".join(rng.choices(words, [1 / (i + 5) for i in range(3000)], k=60))) for i in range(2000)]
    data += [(i, f"f{i:05d}", "xy"[i % 2], None, data[i - 1999][4] + " term900") for i in range(2000, 2040)]
    sections = spark.createDataFrame(data, SECTION)
    jvm = spark.sparkContext._jvm

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    assert rules.conflicts(sections, 20).count() == 20
    assert sum(n for k, n in written().items() if k not in before) < 40 * len(data)
