"""Problem 3: text cut off by field limits, by a classifier trained on artificially cut values.

1. **Statistics over all values.**  Complete words (and the parts of identifiers) are counted in a
   fixed number of hashed bins; lengths in characters and bytes that stand out per source and
   field are its limits.
2. **Training.**  From a bounded hash sample, values that look finished are negatives.  They are cut
   at random places and at the limits, partly with the mark a feeder leaves, and the pieces are
   positives - unless the piece looks finished too, as its loss isn't visible.
3. **Scoring.**  A hashed logistic regression over closing characters, punctuation, open brackets
   and quotes, last words and length-to-limit features scores every value.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm import logit
from weft.llm.words import hashed_counts

#: Bins of the word counts, and the most values a model is trained on.
BINS, TRAIN_VALUES = 1 << 18, 12_000
#: Weight of a cut clause against a whole one: clauses are short, so limits hardly ever cut them.
CLAUSE_WEIGHT = 0.15

_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_A-Za-z]+")
_FULL = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"(?:…|\.\.\.|\[\.\.\.\]|[\[(<](?:…|truncated|cut|snip(?:ped)?|more|continued|省略)[\])>])$", re.I)
_MORE = re.compile(r"\(\+\d+ more\)$")
_RESULT = re.compile(r"(?:^|\n)Result: \d+ passed, \d+ failed$")
_EXIT = re.compile(r"(?:^|\n)exit (?:code )?-?\d+$")
_CLAUSE = re.compile(r"[^A-Z\n.?!。？！…\"{}][^\n.?!。？！…\"{}]*(?:\.[a-z0-9]{1,5})?")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_RUNS = re.compile(r"[a-z]+|[A-Z]+|\d+")
#: Closing lines and marks are looked for in so many last characters.
_NEAR = 48


def _bin(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) & (BINS - 1)


def word_counts(values: DataFrame) -> bytes:
    """Counts (up to 255, one byte per bin) of the words and identifier parts that are complete in ``values.text``.

    A text's last run of word characters is not counted: it may be cut.
    """

    def bin_ids(b: pa.RecordBatch) -> np.ndarray:
        memo: dict[str, int] = {}
        out: list[int] = []
        for t in b.column("text").to_pylist():
            if t:
                end = len(t)
                while end and (t[end - 1].isalnum() or t[end - 1] == "_"):
                    end -= 1
                for w in _PART.findall(t, 0, end):
                    i = memo.get(w)
                    if i is None:
                        i = memo[w] = _bin(w.lower())
                    out.append(i)
        return np.array(out, np.int64)

    return hashed_counts(values.select("text"), BINS, bin_ids).tobytes()


def limits(values: DataFrame, least: int = 8, factor: float = 6.0) -> DataFrame:
    """``(source, field, chars, bytes)``: arrays of the lengths that stand out.

    A length stands out if at least ``least`` values have it, and ``factor`` times as many as the
    mean over the ten lengths on either side.  The counts are per source, field and length: few rows.
    """
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("n"))))
    counts = values.select("source", "field", unit.alias("u")).select("source", "field", "u.*").groupBy("source", "field", "unit", "n").agg(F.count("*").alias("c"))
    near = W.partitionBy("source", "field", "unit").orderBy("n").rangeBetween(-10, 10)
    mean = (F.sum("c").over(near) - F.col("c")) / 20
    spikes = counts.withColumn("mean", mean).where((F.col("c") >= least) & (F.col("c") > factor * F.col("mean")) & (F.col("n") >= 40))
    pick = lambda u: F.array_sort(F.collect_set(F.when(F.col("unit") == u, F.col("n"))))
    return spikes.groupBy("source", "field").agg(pick("chars").alias("chars"), pick("bytes").alias("bytes"))


def _form(text: str, last: str) -> str:
    """The layout at the end of a value."""
    if text.count("```") % 2:
        return "code"
    if text[:1] in "{[":
        return "json"
    if last[:2] in ("- ", "* ") or last[:1].isdigit() and re.match(r"\d+[.)] ", last):
        body = last.split(" ", 1)[1] if " " in last else ""
        return "item-clause" if body[:1].islower() or body[:1] == "`" else "item"
    if last in ("-", "*"):
        return "item-empty"
    if ord(text[-1]) > 0x2E7F and text[-1].isalpha() or _CJK.search(last[-30:]):
        return "cjk"
    if "\n" not in text and len(text) < 80 and _CLAUSE.fullmatch(text) and not text[0].isupper():
        return "clause"
    return "line" if "\n" in text else "prose"


def closed(text: str) -> bool:
    """Whether nothing is left open: quotes, code marks, brackets."""
    return not (text.count("```") % 2 or text.count("`") % 2 or text.count('"') % 2 or text.count("{") > text.count("}") or text.count("「") > text.count("」"))


def _ending(t: str) -> str:
    """A closing line or mark at the end of a value."""
    e, c = t[-_NEAR:], t[-1]
    if c == ")" and _MORE.search(e):
        return "more"
    if c == "d" and _RESULT.search(e):
        return "result"
    if c.isdigit() and _EXIT.search(e):
        return "exit"
    return "mark" if c in "….])>" and _MARK.search(e) else "none"


def finished(text: str) -> bool:
    """Whether a value visibly ends: a last sentence, quotation, code block or object closed, or a closing line."""
    t = text.rstrip()
    if not t:
        return True
    end = _ending(t)
    if end in ("more", "result", "exit"):
        return True
    if end == "mark" or not closed(t):
        return False
    tail = t[-80:].split()[-1]
    if t[-1] in ".?!" and "/" in tail and tail[-2:-1].isdigit():
        return False  # inside a file name
    return t[-1] in '.?!。？！"}」' or t.endswith("```")


def features(text: str, chars: list[int], octets: list[int], counts: np.ndarray) -> list[str]:
    """Names of the features of a value's end."""
    t = text.rstrip()
    if not t:
        return ["blank"]
    last = t[t.rfind("\n") + 1 :]
    form, c = _form(t, last), t[-1]
    kind = "a" if c.isalpha() and c.islower() else "A" if c.isupper() else "w" if c.isalpha() else "9" if c.isdigit() else c
    tail = t[-80:].split()[-1]
    shape = _RUNS.sub(lambda m: "a" if m.group()[0] > "Z" else "A" if m.group()[0] > "9" else "9", tail[-24:])[-5:]
    done = finished(t)
    parts = _PART.findall(tail)
    word = parts[-1].lower() if parts and (c.isalnum()) else ""
    n = int(counts[_bin(word)]) if word and not word.isdigit() else -1
    known = "none" if n < 0 else "0" if n == 0 else "1" if n < 3 else "2" if n < 30 else "3"
    whole = _FULL.findall(t[-60:])
    before = whole[-2].lower() if len(whole) > 1 else ""
    size, octet = len(text), len(text.encode())
    at = size in chars or any(0 <= b - octet <= 3 for b in octets) and octet != size
    over = next((m for m in chars if size <= m), 0)
    ends = _ending(t)
    camel = "`" if t.endswith("`") else "id" if re.search(r"[a-z][A-Z]|_", tail) else "path" if "/" in tail else "word"
    opens = "".join(k for k, v in (("c", t.count("```") % 2), ("t", (t.count("`") - 3 * t.count("```")) % 2), ("q", t.count('"') % 2), ("b", t.count("{") > t.count("}")), ("p", t.count("(") > t.count(")")), ("j", t.count("「") > t.count("」"))) if v)
    f = [
        "bias", f"form={form}", f"last={kind}", f"form,last={form},{kind}", f"done={done}", f"form,done={form},{done}", f"ends={ends}", f"open={opens}", f"open,done={opens},{done}",
        f"known={known}", f"form,known={form},{known}", f"camel,known={camel},{known}", f"shape={shape}", f"at={at}", f"at,done={at},{done}", f"word={word}", f"form,word={form},{word}",
        f"form,nwords={form},{min(len(last.split()), 9)}", f"left={min(9, (over - size) // 4) if over and over - size < 40 else 'far'}", f"bad={chr(0xFFFD) in t[-2:]}",
    ]
    if form.endswith("clause") and not done:
        f += [f"before={before}", f"before,nwords={before},{min(len(last.split()), 9)}", f"suffix={word[-3:]}", f"suffix={word[-2:]}"]
    return f


def _invisible(piece: str, rest: str, counts: np.ndarray) -> bool:
    """Whether a cut clause reads like a whole one: without its last word, its plural or the last digits of a name."""
    if not piece[-1].isalnum():
        return False
    if not rest[0].isalnum():
        return len(rest.split()) == 1
    if piece[-1].isdigit() and rest[0].isdigit():
        return True
    parts = _PART.findall(piece)
    return bool(parts) and not parts[-1].isdigit() and counts[_bin(parts[-1].lower())] >= 30


def examples(values: list[tuple[str, list[int], list[int]]], counts: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Negatives and artificially cut positives, with weights, from ``(text, limits in characters, limits in bytes)``."""
    rng = random.Random(seed)
    x, y, weights = [], [], []

    def add(text: str, label: int, at: bool, weight: float = 1.0) -> None:
        weights.append(weight)
        n, m = len(text), len(text.encode())
        x.append(logit.index(features(text, [n] if at and n == m or at and rng.random() < 0.5 else [], [m] if at else [], counts)))
        y.append(label)

    every = sorted({n for _, c, _ in values for n in c}) or [120, 255, 400]
    for text, chars, octets in values:
        t = text.rstrip()
        if not t or len(text) in chars or len(text.encode()) in octets:
            continue
        last = t[t.rfind("\n") + 1 :]
        clause = _form(t, last) in ("clause", "item-clause")
        if not finished(t) and not clause:
            continue
        if clause and t[-1].isalnum():
            parts = _PART.findall(t)
            if parts and not parts[-1].isdigit() and counts[_bin(parts[-1].lower())] < 3:
                continue  # perhaps cut itself
        add(text, 0, False)
        if rng.random() < 0.15:
            add(text, 0, True)
        places = [rng.randrange(1, len(t)) for _ in range(2) if len(t) > 1] + [len(t) - rng.randrange(1, min(12, len(t))) for _ in range(1) if len(t) > 1]
        places += [m for m in every if m < len(t)][:2]
        for p in places:
            piece, at = t[:p], rng.random() < 0.4
            mark = rng.random()
            if mark < 0.15:
                add(piece[:-1] + "…", 1, at)
            elif mark < 0.17:
                add(piece + rng.choice(["...", " [...]", " [truncated]", "…"]), 1, at)
            rest = t[p:]
            if finished(piece):
                add(piece, 0, at)
            elif rest[0] == "\n" and clause:
                continue  # between two entries: nothing to see
            elif clause and _invisible(piece, rest, counts):
                continue
            else:
                add(piece, 1, at, CLAUSE_WEIGHT if clause else 1.0)
    return logit.matrix(x), np.array(y, np.float64), np.array(weights)


def cut_values(values: DataFrame, train: int = TRAIN_VALUES, threshold: float = 0.5) -> DataFrame:
    """``(id, source, field, score, cut)`` of every row of ``values(id, source, field, text)`` with a text.

    Null texts are left out; empty and blank ones are never cut.  The model is trained on at most
    ``train`` values, taken by a hash of their id; every value is scored as a whole.
    """
    spark = values.sparkSession
    values = values.where("text IS NOT NULL").select("id", "source", "field", "text")
    counts = word_counts(values)
    lim = limits(values)
    # the limits are a few numbers per source and field; a hint would be wrong should there be very many sources
    rows = values.join(lim, ["source", "field"], "left") if lim.limit(10_001).count() > 10_000 else values.join(F.broadcast(lim), ["source", "field"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in ("chars", "bytes")})
    n = values.count()
    pool = rows.where(F.pmod(F.xxhash64("id", "field"), F.lit(1_000_000)) < int(min(1.0, 1.3 * train / max(n, 1)) * 1_000_000) + 1)
    sample = pool.select("text", "chars", "bytes").orderBy(F.xxhash64("id", "field")).limit(train).collect()
    c = np.frombuffer(counts, np.uint8)
    x, y, weights = examples([(r.text, list(r.chars), list(r.bytes)) for r in sample], c)
    w = logit.fit(x, y, weights) if len(y) else np.zeros(logit.DIM, np.float32)
    model = spark.sparkContext.broadcast((w, counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, counts = model.value
        counts = np.frombuffer(counts, np.uint8)
        for b in batches:
            texts, chars, octets = (b.column(k).to_pylist() for k in ("text", "chars", "bytes"))
            p = logit.scores(w, logit.matrix([logit.index(features(t, a, o, counts)) for t, a, o in zip(texts, chars, octets)])) if texts else np.zeros(0)
            p = np.where([bool(t.strip()) for t in texts], p, 0.0) if texts else p
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), b.column("field"), pa.array(p, pa.float64()), pa.array(p >= threshold, pa.bool_())], ["id", "source", "field", "score", "cut"])

    return rows.select("id", "source", "field", "text", "chars", "bytes").mapInArrow(score, "id long, source string, field string, score double, cut boolean")
