"""Problems 6 and 8 against brute force."""

import random
import re

import numpy as np
import pytest

from weft.llm import leak, repetition, words

W = re.compile(r"[^\W_]+")


def brute_leaks(docs, items, n=12):
    grams = lambda t: {tuple(w[i : i + n]) for w in [W.findall((t or "").lower())] for i in range(len(w) - n + 1)}
    g = {i: grams(t) for i, t in items}
    return sorted({(d, i) for d, t in docs for i in g if grams(t) & g[i]})


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(5)
    v = [f"v{i}" for i in range(60)] + ["日本", "x_y", "Ünder"]
    text = lambda n: " ".join(rng.choice(v) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(i, text(rng.randrange(5, 60))) for i in range(25)]
    docs = []
    for d in range(120):
        t = text(rng.randrange(0, 120))
        if d % 3 == 0:
            w = W.findall(rng.choice(items)[1])
            k = rng.randrange(8, 16)
            s = rng.randrange(max(1, len(w) - k))
            t += " | " + " - ".join(w[s : s + k]).upper() + " | " + text(20)
        docs.append((d, t))
    return docs, items


@pytest.mark.parametrize("bound", [leak.BOUND, 700])
def test_leaks_equal_brute_force(spark, rows, leaky, bound):
    docs, items = leaky
    got = leak.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), bound=bound)
    want = brute_leaks(docs, items)
    assert len(want) > 15
    assert rows(got, "doc_id", "item_id") == want
    assert got.where("length < 12").isEmpty()


def test_winnowing_keeps_one_per_window():
    lists = [[b"w%d" % (i * i % 97) for i in range(300)], [], [b"a"] * 40]
    h, off = words.flat(lists, words.Hasher())
    f, own, at = leak.winnow(h, off)
    g, g_own = words.shingles(h, off, leak.K)
    for t, begin in ((0, 0), (2, 300)):
        starts = sorted(at[own == t] - begin)
        n = (g_own == t).sum()
        assert all(any(s <= x < s + leak.WINDOW for x in starts) for s in range(n - leak.WINDOW + 1))
    assert not (own == 1).any()


def test_longest_run(spark, rows):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(1, f"a b {passage} c"), (2, " ".join(passage.split()[:11])), (3, "a " * 5000), (1, f"a b {passage} c")]
    items = [(7, f"z {passage}"), (8, "a " * 300), (7, f"z {passage}")]
    got = leak.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == [(1, 7, 2, 40), (3, 8, 0, 300)]


def test_leaks_awkward_rows(spark, rows):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, passage, 5), (4, passage + " x" * 300_000, 5)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, passage, 1), (4, passage, 1)], "item_id long, text string, doc_id long")
    assert rows(leak.leaks(docs, items), "doc_id", "item_id") == [(4, 4)]
    assert rows(leak.leaks(docs.limit(0), items)) == [] and rows(leak.leaks(docs, items.limit(0))) == []
    with pytest.raises(ValueError):
        leak.leaks(docs, items, least=11)


def test_shares_equal_brute_force(spark, rows):
    rng = random.Random(9)
    texts = [None, "", " ", "one two three four", "one two three four five", "a b c d e " * 30, "Line.\nLine.\r\nOther line.\n\nPara\n\nPara"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(60)]
    docs = list(enumerate(texts)) + [(5, texts[5])]
    got = repetition.repeated_shares(spark.createDataFrame([(i, t, 0.5, 1) for i, t in docs], "doc_id long, text string, share double, sequences int"))
    want = []
    for i, t in docs:
        w = W.findall((t or "").lower())
        g = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        want.append((i, len(g), len(set(g)), 1 - len(set(g)) / len(g) if g else 0.0))
    assert [r[:3] for r in rows(got, "doc_id", "sequences", "distinct")] == sorted(w[:3] for w in want)
    assert np.allclose([r[1] for r in rows(got, "doc_id", "share")], [w[3] for w in sorted(want)])
    last = {r.doc_id: r for r in got.collect()}[6]
    assert (last.line_share, last.paragraph_share) == (pytest.approx(2 / 5), pytest.approx(1 / 3))
    assert rows(repetition.repeated_shares(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_line_frequency(spark, rows):
    head = "Copyright  the Authors"
    docs = [(i, "big", f"{head}\nline {i}\nCOPYRIGHT the authors") for i in range(30)] + [(90, "big", head), (91, None, head), (92, "big", None), (93, "big", " \n"), (94, "small", f"{head}\nx")]
    got = repetition.line_frequency(spark.createDataFrame(docs, "doc_id long, host string, text string"), most_docs=5)
    by = {r.doc_id: r for r in got.collect()}
    assert (by[3].lines, by[3].removed, by[3].rejected) == (3, 2, True)
    assert (by[90].left_share, by[90].rejected) == (0.0, True)
    assert (by[91].removed, by[94].removed) == (0, 0) and 92 not in by and 93 not in by
    assert by[94].rejected is False
