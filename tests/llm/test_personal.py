"""Problem 4: mentions planted in held-out texts, the aggregation of votes, redaction, and awkward rows."""

import random
import sys

import numpy as np
import pytest

from weft.llm import personal as P

GIVEN = [a + b for a in ("Mar", "Jol", "Tev", "Kru", "Sho", "Pel", "Dra", "Vio") for b in ("ina", "esh", "olo", "uka", "ira")]
FAMILY = [a + b for a in ("Brand", "Hold", "Swer", "Trell", "Quon", "Wick", "Nor", "Felt") for b in ("ander", "oxley", "umba", "enby", "holt")]
PLAIN = ["The cache keeps stale windows on slow disks.", "Why does the loader merge records since the upgrade?", "See lines 120-584 and 555-584 of the trace.", "Task id 48864 and build 2033864 are unrelated.", "Started at 2033-11-08 10:22:38 and never ended.", "It took 4 fast lane passes and 807 street tiles.", "Clone git@forge.test:tools/store.git first.", "Pin @scope/loader@2.9.1 in the lockfile.", "Graph Store and Session Recall disagree.", "Bump the parser to 4.12.0.153 and rerun.", "Offset 4294967701 overflows.", "- sort and quote links\n- merge the stale index"]


def person(rng, listed=True):
    g, f = rng.choice(GIVEN[: 30 if listed else 40]), rng.choice(FAMILY[: 30 if listed else 40])
    n = rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}"])
    return rng.choice([n, n, n.upper(), n.lower() if "." not in n else n])


def mention(rng, listed):
    kind = rng.choice(P.KINDS)
    if kind == "name":
        a, b = rng.choice([("Thanks, signed ", "."), ("Ask ", " about this before we merge."), ("Cleared with ", " today."), ("Ms. ", " lives nearby.")])
        return kind, a, person(rng, listed), b
    if kind == "email":
        u = rng.choice(["mari.holt", "j_k+ci", "T99"])
        return kind, "Contact is ", rng.choice([f"{u}@mail-lab.dev.example", f"{u} [at] lab [dot] test", f"{u}(at)lab.example".upper().replace("(AT)", "(at)")]), " please."
    if kind == "phone":
        return kind, rng.choice(["Call ", "Text "]), rng.choice(["+44 7700 900123", "(281) 555-0119", "+999 (0)99-8233-736", "01632 960893", "999.555.0184"]), " if the job hangs."
    if kind == "identity":
        a, n = rng.choice([("passport ", "V2453001"), ("tax id ", "15-5633212"), ("", "906-85-6538"), ("ID no. ", "9205 4680 5236"), ("", "DZ 86 62 94 C")])
        return kind, "Profile says " + a, n, ", born in spring."
    return kind, rng.choice(["He moved to ", "The parcel label says "]), rng.choice(["58b Tansylow Street", "6 Mosscombe Rd", "130 Umberham Drive, Flat 3", "Pellham Lane 170", "Ostwickstrasse 191", "74 copperham street"]), " last week."


def texts(seed, n, listed=True):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t, want = "", []
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.5:
                t += rng.choice(PLAIN) + " "
            else:
                kind, a, m, b = mention(rng, listed)
                want.append((kind, len(t + a)))
                t += a + m + b + " "
        out.append((t, want))
    return out


NAMES = [(n, "given") for n in GIVEN[:30]] + [(n, "family") for n in FAMILY[:30]]


@pytest.fixture(scope="module")
def finder():
    return P.Finder(NAMES, [t for t, _ in texts(1, 4000)])


def test_held_out_mentions(finder):
    hit = want_n = got_n = 0
    for t, want in texts(2, 600, listed=False):
        got = {(k, s) for k, s, _, _ in finder.mentions(t)}
        hit += len(got & set(want))
        want_n += len(want)
        got_n += len(got)
    assert want_n > 500 and hit / want_n > 0.95 and hit / got_n > 0.95


def test_redaction_changes_nothing_else(finder):
    t = "Ask Marina Brandander about this before we merge. Contact is a.b@lab.test please."
    assert finder.redacted(t) == "Ask [NAME] about this before we merge. Contact is [EMAIL] please."
    for plain in PLAIN:
        assert finder.redacted(plain) == plain


def test_reliable_labelers_are_found():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    say = lambda good, talk: np.where(rng.random(4000) < talk, np.where(rng.random(4000) < good, np.where(y, 1, -1), np.where(y, -1, 1)), 0)
    p, table = P.reliabilities(np.stack([say(0.95, 0.9), say(0.85, 0.8), say(0.8, 0.7), say(0.5, 0.9)], 1))
    assert ((p > 0.5) == y).mean() > 0.94
    assert table[0, 1, 2] > table[2, 1, 2] and abs(table[3, 1, 2] - table[3, 0, 2]) < 0.1


def test_found_and_redacted_frames(spark, rows):
    data = [("t", i, "f", t) for i, (t, _) in enumerate(texts(3, 800))] + [("t", 900, "f", None), ("t", 901, "f", ""), ("t", 902, "f", "a@" + "b" * 200_000 + " 1" * 100_000), ("t", 0, "f", texts(3, 1)[0][0]), ("t", None, "f", "x")]
    values = spark.createDataFrame([(*r, 5, "k") for r in data], "tbl string, id long, field string, text string, start_pos int, kind string")
    names = spark.createDataFrame([(1, *n) for n in NAMES] + [(2, None, None)], "name_id long, name string, name_part string")
    got = rows(P.found(values, names), "rec_id", "kind", "start_pos")
    want = sorted({(i, k, s + 1) for i, (t, w) in enumerate(texts(3, 800)) for k, s in w})
    assert len(set(got) & set(want)) > 0.95 * len(want) and len(set(got)) == len(got)
    red = {r.id: r.text for r in P.redact(values, names).collect() if r.id is not None}
    assert red[900] is None and red[901] == "" and "[" in "".join(v or "" for v in red.values())
    assert rows(P.found(values.limit(0), names)) == [] and rows(P.found(values.limit(0), names.limit(0))) == []


def test_words_and_contexts_come_from_all_texts(spark):
    rng = random.Random(8)
    data = [("turns", i, "request", rng.choice(PLAIN)) for i in range(3000)]
    for j in range(12):  # a context and a word so rare that a sample of 200 texts hardly holds them
        data[250 * j + 7] = ("turns", 250 * j + 7, "request", f"The quibbleworth ledger was countersealed by {GIVEN[j]} {FAMILY[j]} yesterday.")
    df = spark.createDataFrame(data, "tbl string, id long, field string, text string").repartition(4)
    names = spark.createDataFrame(NAMES, "name string, name_part string")
    small, full = P.train(df, names, most=200), P.train(df, names, most=10_000)
    assert "countersealed by" in small.contexts.names() and small.contexts.share == full.contexts.share
    assert "quibbleworth" in small.names.common and small.names.common == full.names.common
    whole = P.Finder(NAMES, [t for *_, t in data])
    assert full.contexts.share == whole.contexts.share and full.names.common == whole.names.common


def test_templates_that_are_not_known_beforehand():
    """Words before a mention are learnt: mentions in lower case, of names outside the list, behind words this test makes up."""
    rng = random.Random(12)
    lead = ["escorted by ", "rubber-stamped by ", "the key went to "]
    data = [rng.choice(lead) + rng.choice([f"{rng.choice(GIVEN[:30])} {rng.choice(FAMILY[:30])}", f"{rng.choice(GIVEN[:30])} {rng.choice(FAMILY[:30])}".lower()]) + " yesterday." for _ in range(600)]
    data += [rng.choice(PLAIN) for _ in range(2400)]
    f = P.Finder(NAMES, data)
    assert {"escorted by", "stamped by", "went to"} <= set(f.contexts.names())
    unlisted = [(g.lower(), n.lower()) for g in GIVEN[30:] for n in FAMILY[30:]]
    found = [any(k == "name" and s == len(a) for k, s, _, _ in f.mentions(f"{a}{g} {n} yesterday.")) for a in lead for g, n in unlisted]
    assert np.mean(found) > 0.9


def test_letters_of_any_script_and_places():
    names = NAMES + [("José", "given"), ("Álvarez", "family"), ("Nguyễn", "family"), ("Văn", "given"), ("Анна", "given"), ("Иванова", "family"), ("İpek", "given"), ("Öztürk", "family")]
    f = P.Finder(names, [t for t, _ in texts(1, 3000)])
    for t, m in (("Ask José Álvarez about this", "José Álvarez"), ("Ask ÁLVAREZ, JOSÉ about this", "ÁLVAREZ, JOSÉ"), ("Ask Nguyễn Văn about this", "Nguyễn Văn"), ("Ask Анна Иванова about this", "Анна Иванова"), ("Ask İpek Öztürk about this", "İpek Öztürk")):
        assert [(k, t[s:e]) for k, s, e, _ in f.mentions(t)] == [("name", m)], t
    # a letter whose lower case is longer moves nothing
    low = "Ask marina brandander about this before we merge."
    assert [(s - 2, e - 2) for _, s, e, _ in f.mentions("İ " + low)] == [(s, e) for _, s, e, _ in f.mentions(low)] == [(4, 21)]
    assert P.lowered("İSTANBUL") == "İstanbul" and len(P.lowered("ẞİǅ" * 9)) == 27
    for t, kind, m in (("He moved to 12 Rue de la Paix last week.", "address", "12 Rue de la Paix"), ("social insurance number: 046 454 286", "identity", "046 454 286")):
        assert (kind, m) in [(k, t[s:e]) for k, s, e in P.spans(t, f.names)]
    t = "social insurance number: 046 454 286"
    assert [(k, t[s:e]) for k, s, e, _ in f.mentions(t)] == [("identity", "046 454 286")]


def test_signs_are_looked_up_in_one_pass():
    """A text without a candidate costs a few calls, however many words and signs are looked for, and nothing is lost by that."""
    f, rng = P.Finder(NAMES, [t for t, _ in texts(1, 3000)]), random.Random(4)
    plain = ["The cache keeps stale windows on slow disks.", "A row of the table is close to the road map, so walk the graph first.", "Wählt das größte Fenster auf dem Weg zum Index.", "see also\nthe parade of ßtale rows"]
    calls = 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    got = [P.spans(t, f.names) for t in plain]
    sys.setprofile(None)
    assert got == [[]] * 4 and calls < 40 * len(plain)

    pieces = ["12", "58b", "Tansylow", "copperham", "Street", "street,", "Rd.", "St", "row", "rows", "Lane 170", "way, 7", "way.9", "Flat 3", "12 rue", "de la Paix", "weg 4", "Ostwickstrasse 191", "٣٤", "close_2", "Marina", "brandander", "MARINA,", "Élan", "J.", "a@b.test", "x (at) y.test", "dot", "+44 7700 900123", "1234", "56", "passport V2453001", "see", "the", "."]
    found = 0
    for _ in range(6000):
        t = rng.choice(["", " "]) + "".join(rng.choice(pieces) + rng.choice([" ", " ", " ", "", ", "]) for _ in range(rng.randrange(1, 9)))
        low, got = P.lowered(t), set(P.spans(t, f.names))
        want = {("address", *m.span()) for on, rs in ((P._STREETS, (P._NUMBERED, P._STREET_FIRST)), (P._ABROAD, (P._FOREIGN,)), (P._JOINED_ENDS, (P._JOINED,))) if any(w in low for w in on) for r in rs for m in r.finditer(t)}
        want |= {("identity", *m.span()) for m in P._CODES.finditer(t) if P._SIX.search(t)}
        mails = {m.span() for m in P._EMAIL.finditer(t)} | {m.span() for m in P._SPELT.finditer(t) if " dot " in low}
        want |= {("email", *m) for m in mails}
        names = {("name", m.start("a"), m.end("b")) for m in P._CAPS.finditer(t)}
        want |= {x for x in names if not any(a < x[2] and x[1] < b for a, b in mails)}
        assert {x for x in got if x[0] in ("address", "email")} == {x for x in want if x[0] in ("address", "email")} and want <= got, t
        found += len(want)
    assert found > 2000


def test_word_counts_of_any_text():
    t = ["the Cache keeps the caches", "x86 ab abc1def ABC don't", "größe ßtale naïve_word naïve", "the"]
    assert P.word_counts(t) == {"the": 2, "keeps": 1, "caches": 1, "abc": 1, "def": 1, "don": 1, "größe": 1, "ßtale": 1, "naïve": 1, "word": 1}


def test_short_street_words_before_any_sign():
    names = P.Names(NAMES, [], set())
    for end in ("", "?", "!", ";", ")", ":", "\n", ".", ",", '"', " now"):
        assert [(k, s) for k, s, _ in P.spans(f"He moved to 6 Mosscombe Rd{end}", names) if k == "address"] == [("address", 12)], end
    assert P.spans("He moved to 6 mosscombe rdx", names) == []
