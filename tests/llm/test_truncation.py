"""Problem 3: held-out accuracy on artificially cut values, limits, and awkward rows."""

import random

import pytest

from weft.llm import truncation as T

SCHEMA = "id long, source string, field string, text string, chars int, cut int"
NOUNS = "cache index token session folder window buffer record panel editor module resolver".split()
VERBS = "keeps drops merges rejects loads writes sorts counts".split()
ADJ = "stale warm empty private shared sorted".split()


def sentence(rng):
    return f"The {rng.choice(ADJ)} {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.randrange(99)} {rng.choice(NOUNS)}s before the next {rng.choice(NOUNS)}."


def whole(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return f"open the {rng.choice(ADJ)} {rng.choice(NOUNS)}"
    if kind == 1:
        return "Steps\n" + "\n".join(f"- sort and load {rng.choice(NOUNS)}s" for _ in range(rng.randrange(2, 6)))
    if kind == 2:
        return sentence(rng) + "\n```\nlet x = load(&y);\n```"
    if kind == 3:
        return '{"note": "' + sentence(rng) + '"}'
    if kind == 4:
        return sentence(rng) + rng.choice(["\nexit 1", "\nResult: 3 passed, 0 failed", " Files: a/b.rs, … (+3 more)"])
    return " ".join(sentence(rng) for _ in range(rng.randrange(1, 6)))


@pytest.fixture(scope="module")
def values():
    rng = random.Random(4)
    out, lost = [], set()
    for i in range(3000):
        t, source = whole(rng), rng.choice(["limited", "marked", "free", "torn"])
        if source == "limited" and len(t) > 150:
            t = t[:150]
            if t[-1] not in ". ":
                lost.add(i)
        elif source == "marked" and len(t) > 120:
            t = t[:119] + "…"
            lost.add(i)
        elif source == "torn" and rng.random() < 0.2 and len(t) > 60 and not t.startswith("Steps"):
            t = t[: rng.randrange(30, len(t) - 3)]
            if not T.finished(t):
                lost.add(i)
        out.append((i, source, "request", t, 1, 1))
    return out, lost


def test_held_out_accuracy(spark, values):
    rows, lost = values
    got = {r.id for r in T.cut_values(spark.createDataFrame(rows, SCHEMA), train=1000).where("cut").collect()}
    assert len(lost) > 200
    assert len(got & lost) / len(lost) > 0.95
    assert len(got & lost) / len(got) > 0.9


def test_limits_are_found(spark, values):
    got = {(r.source, r.field): list(r.chars) for r in T.limits(spark.createDataFrame(values[0], SCHEMA)).collect()}
    assert 150 in got["limited", "request"] and 120 in got["marked", "request"]
    assert 150 not in got.get(("free", "request"), [])


@pytest.mark.parametrize(
    "text, done",
    [("A sentence.", True), ("See a/b_12.", False), ("A quote: \"inner.", False), ("Files: a, … (+5 more)", True), ("x.\n```\ncode();", False), ("x.\n```\ncode();\n```", True), ('{"a": "b."}', True), ('{"a": "b.', False), ("cut…", False), ("…", False), ("", True), ("保存する。", True), ("保存す", False), ("Done.\nexit 101", True), ("Result: 1 passed, 2 failed", True), ("and the", False)],
)
def test_finished(text, done):
    assert T.finished(text) is done


def test_awkward_rows(spark, rows):
    data = [(1, "s", "f", None, 1, 1), (2, "s", "f", "", 1, 1), (3, None, "f", "  \n", 1, 1), (4, None, None, "x" * 300_000, 1, 1), (4, None, None, "x" * 300_000, 1, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    got = rows(T.cut_values(df), "id", "cut")
    assert [r[0] for r in got] == [2, 3, 4, 4] and not got[0][1] and not got[1][1]
    assert rows(T.cut_values(df.limit(0))) == []
