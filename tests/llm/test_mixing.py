"""Problem 7: permutations, token counts, shares and caps."""

import numpy as np
import pytest

from weft.llm import mixing as M

DOCS = "doc_id long, source string, text string, tokens long, start long"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation_is_a_bijection(n):
    for key in (0, 1, 99):
        got = M.permuted(np.arange(n), n, np.full(n, key))
        assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        a, b = M.permuted(np.arange(n), n, np.full(n, 1)), M.permuted(np.arange(n), n, np.full(n, 2))
        assert (a != b).mean() > 0.9 and (a != np.arange(n)).mean() > 0.9


def test_tokens_are_those_of_the_vocabulary(spark, rows):
    enc = M.encoding()
    texts = ["Hello world", "", None, "日本語のテキスト", "<|endoftext|>"]
    got = rows(M.token_counts(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")), "doc_id", "tokens")
    assert got == [(i, len(enc.encode_ordinary(t)) if t else 0) for i, t in enumerate(texts)]
    assert enc.decode(enc.encode_ordinary("Hello 日本 x_1")) == "Hello 日本 x_1"


@pytest.fixture(scope="module")
def mix(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(20 + i % 90))
    docs = [(i, ("big", " BIG ", "mid", "mid")[i % 4] if i % 30 else "tiny", text(i), 1, 1) for i in range(900)]
    docs += [(2000, None, "no source", 1, 1), (2001, "big", None, 1, 1), (2002, "big", "", 1, 1), (2003, "other", "elsewhere", 1, 1), (5, "Big", text(5), 1, 1)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 4), ("void", 0.05, 9)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)


def test_shares_and_caps(spark, mix):
    chosen, shares = M.mixture(*mix, slots=64)
    by = {r.source: r for r in shares.collect()}
    assert by["void"].actual_share == 0 and by["void"].docs == 0
    assert sum(r.actual_share for r in by.values()) == pytest.approx(1)
    for s in ("big", "mid", "tiny"):
        assert by[s].weight == pytest.approx(by[s].target_share / 0.95)
        assert by[s].actual_share == pytest.approx(by[s].planned_share, abs=0.01)
        assert by[s].planned_share == pytest.approx(by[s].weight, abs=0.05)
    cap = {"big": 1, "mid": 2, "tiny": 4}
    got = chosen.collect()
    assert got and all(1 <= r.repeats <= cap[r.source] for r in got)
    assert all(r.tokens_used <= r.repeats * r.tokens for r in got)
    assert len({r.doc_id for r in got}) == len(got) and not {2000, 2001, 2002, 2003} & {r.doc_id for r in got}
    for s in cap:
        assert sum(r.tokens_used for r in got if r.source == s) == by[s].tokens_used


def test_a_larger_total_is_capped_and_refilled(spark, mix):
    chosen, shares = M.mixture(*mix, total_tokens=10**9, slots=64)
    by = {r.source: r for r in shares.collect()}
    for s, cap in (("big", 1), ("mid", 2), ("tiny", 4)):
        assert by[s].tokens_used == cap * by[s].tokens_available  # no tail and no draw is lost


def test_same_seed_same_mix(spark, mix, rows):
    a, b = (M.mixture(*mix, slots=64, seed=s)[0] for s in (3, 3))
    assert rows(a) == rows(b)
    assert rows(a) != rows(M.mixture(*mix, slots=64, seed=4)[0])


def test_empty_tables(spark, mix, rows):
    docs, targets = mix
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0)), (docs.limit(0), targets.limit(0))):
        chosen, shares = M.mixture(d, t)
        assert rows(chosen) == [] and all(r.actual_share == 0 for r in shares.collect())


def test_no_source_is_dropped(spark):
    docs = [(i, "big", " ".join(f"w{i}x{j}" for j in range(200))) for i in range(200)] + [(1000, "one", "just a few words"), (1001, "few", " ".join(f"f{j}" for j in range(150)))]
    targets = [("big", 0.6, 3), ("one", 0.1, 2), ("few", 0.3, 4)]
    chosen, shares = M.mixture(spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(targets, TARGETS), most_off=0.15)
    by = {r.source: r for r in shares.collect()}
    assert by["one"].tokens_used == 2 * by["one"].tokens_available > 0
    off = sum(max(0, r.weight - r.planned_share) for r in by.values())
    assert off == pytest.approx(0.15, abs=0.01)
    assert all(r.actual_share == pytest.approx(r.planned_share, abs=0.01) for r in by.values())


def test_whole_numbers_keep_the_sum():
    for x in ([0.5, 0.5, 1.0], [3.2, 3.2, 3.6], [0.0, 0.0], [1.0, 2.0]):
        got = M.rounded(np.array(x))
        assert got.sum() == round(sum(x)) and (abs(got - np.array(x)) < 1).all()


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_shares_on_the_test_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    for r in M.mixture(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))[1].collect():
        assert r.actual_share == pytest.approx(r.planned_share, abs=0.01), r
