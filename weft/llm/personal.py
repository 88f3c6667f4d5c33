"""Problem 4: personal information inside free text, by aggregating weak labelers.

*Candidates* are spans that some pattern, name list or context proposes, wide enough to hold
every mention and many spans that are none.  *Labelers* vote on each candidate: patterns look at
its shape, gazetteers at its words, context labelers at the words around it, a morphology model
(trained on the name list) at the letters.  *Expectation-maximisation* estimates how reliable each
labeler is, per kind, and gives every candidate of a bounded sample a probability.  A hashed logistic
regression trained on these probabilities is the final *span classifier*.  What the labelers know of the
corpus, its common words and the contexts of names, is counted over all texts.  The classifier scores every candidate
of every text, overlapping spans are settled by score, and the rest are the mentions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import logit

KINDS = ("email", "phone", "identity", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Most texts that the labelers' reliabilities and the span classifier are fitted on.
TRAIN_TEXTS = 30_000
#: Most names that are sent to the executors.
NAMES = 100_000

_AT = r"(?:[@＠]|\s?[\[({<]\s?(?:at|AT|At)\s?[\])}>]\s?)"
_DOT = r"(?:[.．]|\s?[\[({<]\s?(?:dot|DOT|Dot)\s?[\])}>]\s?)"
# every part is bounded, and none can start inside a word: long texts take linear time
_EMAIL = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?=[A-Za-z0-9_%+-])){{0,120}}{_AT}[A-Za-z0-9-]{{1,120}}(?:{_DOT}[A-Za-z0-9-]{{1,120}}){{0,8}}")
_SPELT = re.compile(r"\b[A-Za-z0-9][\w.+%-]{0,120} (?:at|AT) [A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"(?<![\w/:.,-])(?:[(]?\+|\()?[(]?\d(?:[\d ().\-]*\d)?(?![\w])")
_CODES = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{2}-\d{7}|(?:19|20)?\d{6}[-+]\d{4}|\d{4} \d{4} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,9})(?![\w-])")
_CODE_CUE = re.compile(r"(?i:\b(?:passport|tax id|tax no|personal number|id no|id number|identity|national id|ssn|social security|insurance)(?:\s?(?:no|number|nr|#)\b)?\.?:?)\s+([A-Z0-9][A-Z0-9 \-]{4,18}[A-Z0-9])(?![\w-])")
_LONG = "street lane road avenue drive close court square terrace way place crescent gardens hill row walk mews grove boulevard park parade quay rise".split()
_SHORT = "st ln rd ave dr ct sq ter pl blvd".split()
_JOINED_ENDS = ("strasse ", "straße ", "str. ", "weg ", "gasse ", "allee ", "platz ")
_SUFFIX = rf"(?i:(?:{'|'.join(_LONG)})\b|(?:{'|'.join(_SHORT)})\b\.?)"
_UNIT = r"(?i:flat|unit|apt|apartment|suite|room|floor)\.? \w{1,5}\b"
_STREET_WORD = r"(?!(?i:the|a|an|of|for|per|and|or|to|in|on|at|with|from|by|ms|is|was|lives|moved)\b)[A-Za-z][a-z'’-]+"
_NUMBERED = re.compile(rf"(?<![\w./-])(?:{_UNIT},? )?\d{{1,5}}[a-z]?,? (?:{_STREET_WORD} ){{1,3}}?{_SUFFIX}(?:,? {_UNIT})?")
_STREET_FIRST = re.compile(rf"\b(?:(?:[A-Z][a-z'’-]+ ){{1,3}}|(?<![A-Z])\b{_STREET_WORD} ){_SUFFIX},? \d{{1,5}}[a-z]?\b(?![-. ]?\d)(?:,? {_UNIT})?")
_JOINED = re.compile(rf"\b[^\W\d_]{{3,}}(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz) \d{{1,5}}[a-z]?\b(?:,? {_UNIT})?")
_STREETS = tuple(f" {w}" for w in _LONG + _SHORT)
_DIGIT = re.compile(r"\d")
_NUMBER_NEXT = re.compile(r"\.?,? \d")
_ABROAD = tuple(f" {w} " for w in "rue avenue boulevard place chemin impasse allée quai via viale piazza corso calle avenida plaza paseo rua travessa ulica".split())
_SIX = re.compile(r"\d\D?\d\D?\d\D?\d\D?\d\D?\d")
# what a text must hold, in lower case, to be searched for more; looked up together with the names
_MAIL, _DOT_WORD, _STREET, _STREET_ABROAD, _STREET_JOINED, _NAME, _LEARNT = (1 << i for i in range(7))
_SIGNS = ((("@", "＠", "at]", "at)", "at}", "at>", "at ]"), _MAIL), ((" dot ",), _DOT_WORD), (_STREETS, _STREET), (_ABROAD, _STREET_ABROAD), (_JOINED_ENDS, _STREET_JOINED))
# letters of the scripts that have case: Latin with all its extensions, Greek, Cyrillic, Armenian
_LETTERS = [chr(c) for c in (*range(0x41, 0x590), *range(0x1E00, 0x2000)) if chr(c).isalpha()]
_UP, _LOW = "".join(c for c in _LETTERS if c.isupper()), "".join(c for c in _LETTERS if c.islower()) + "̀-̣"
_ANY = _UP + _LOW
_FOREIGN = re.compile(rf"(?<![\w./-])\d{{1,5}}(?:\s?(?:bis|ter|[a-z]))?,? (?i:rue|avenue|boulevard|place|chemin|impasse|allée|quai|via|viale|piazza|corso|calle|avenida|plaza|paseo|rua|travessa|ulica)(?: (?i:de la|de las|de los|de|del|della|delle|di|du|des|da|do|dos|das))?(?:(?: (?:[lLdD]['’])?[{_UP}][\w'’-]*){{1,3}}| [{_LOW}][\w'’-]*)")
_PAIR = re.compile(rf"[{_UP}][{_ANY}]*\.?,? [{_UP}]")
_FIRST, _SECOND = rf"[{_ANY}]{{2,}}|[{_UP}]\.?", rf"[{_ANY}]{{2,}}|[{_UP}]\."
_CAPS = re.compile(rf"(?<![\w'./@-])(?=(?P<a>[{_UP}][{_LOW}]+|[{_UP}]{{3,}}|[{_UP}]\.?)(?P<sep>,? )(?P<b>[{_UP}][{_LOW}]+|[{_UP}]{{3,}}|[{_UP}]\.)(?![\w'/@]))")
_NEXT = re.compile(rf"\s?(?<!\w)(?=(?P<a>{_FIRST})(?P<sep>,? )(?P<b>{_SECOND})(?![\w'/@]))")
_RIGHT = re.compile(rf"(,? )({_SECOND})(?![\w'/@])")
_LEFT = re.compile(rf"(?<![\w'./@-])({_FIRST})(,? )$")
# an ASCII text as classes of its characters, in which both searches jump to a capital or a digit
_CLASSES = bytes(ord("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c) for c in map(chr, range(128))) + bytes(128)
_CLASS_PAIR = re.compile(rb"A[Aa]*\.?,? A")
_CLASS_SIX = re.compile(rb"9[^9]?9[^9]?9[^9]?9[^9]?9[^9]?9")
_LETTERS_ONLY = bytes(i if chr(i).isalpha() else 32 for i in range(128)) + b" " * 128
_WORDS = re.compile(r"[^\W_]+|[^\w\s]")
_LETTERED = re.compile(r"[^\W\d_]{3,}")
_SHAPE = re.compile(rf"[{_UP}]+|[{_LOW}]+|\d")


def _shape(s: str) -> str:
    return _SHAPE.sub(lambda m: "9" if m.group()[0].isdigit() else "A" if m.group()[0].isupper() else "a", s)[:24]


def lowered(text: str) -> str:
    """``text`` in lower case with every character in its place: a letter whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Names:
    """The name list as lookup tables, with a model of the letters of names."""

    def __init__(self, rows: list[tuple[str, str]], others: list[str], common: set[str]):
        import ahocorasick

        self.common = common
        self.given = {n.lower() for n, p in rows if p == "given"}
        self.family = {n.lower() for n, p in rows if p == "family"}
        both = self.given | self.family
        words = sorted({w for w in others if w not in both})
        labelled = [(w, 1.0) for w in sorted(both)] + [(w, 0.0) for w in words]
        x = logit.matrix([logit.index(self._letters(w)) for w, _ in labelled])
        y = np.array([v for _, v in labelled])
        weight = np.where(y == 1, max(1.0, (y == 0).sum() / max(1, (y == 1).sum())), 1.0)
        self.letters = logit.fit(x, y, weight, epochs=8) if both else np.zeros(logit.DIM, np.float32)
        self._auto, self._first = ahocorasick.Automaton(), []
        self._add((both, _NAME), *_SIGNS)
        self._memo: dict[str, float] = {}

    def _add(self, *groups: tuple[Iterable[str], int]) -> None:
        """Strings to be looked up in one pass over a text, with what each stands for; one string can stand for several things."""
        for keys, sign in groups:
            for k in filter(None, keys):
                self._auto.add_word(k, (len(k), sign | self._auto.get(k, (0, 0))[1]))
        self._auto.make_automaton()

    def learn(self, lefts: list[str]) -> None:
        """Contexts (``l2 l1``, in lower case) after which any two words are a candidate."""
        self._first = [b for a, b in (c.rsplit(" ", 1) for c in sorted(lefts)) if a == "^"]
        keys = {k for a, b in (c.rsplit(" ", 1) for c in lefts) if a != "^" for k in (f"{a} {b}", a + b if not (a[-1:].isalnum() and b[:1].isalnum()) else f"{a} {b}")}
        self._add((keys, _LEARNT))

    def scan(self, text: str, low: str) -> tuple[int, list[int], list[tuple[int, int]], list[tuple[int, int]]]:
        """All signs in a text, the ends of its words for streets, its whole words that are in the list, and the two words after each learnt context."""
        signs, streets, hits, n = 0, [], [], len(low)
        ends = [len(f) for f in self._first if low.startswith(f)]
        for end, (size, sign) in self._auto.iter(low):
            signs |= sign
            if sign & (_NAME | _LEARNT | _STREET):
                s, e = end - size + 1, end + 1
                if sign & _STREET and (e == n or not (low[e].isalnum() or low[e] == "_")):
                    streets.append(e)
                if sign & _NAME and (s == 0 or not (low[s - 1].isalnum() or low[s - 1] in "_@")) and (e == n or not (low[e].isalnum() or low[e] in "_@")):
                    hits.append((s, e))
                if sign & _LEARNT and (s == 0 or not (low[s - 1].isalnum() or low[s - 1] == "_") or not low[s].isalnum()):
                    ends.append(e)
        return signs, streets, hits, [(m.start("a"), m.end("b")) for at in ends if (m := _NEXT.match(text, at))]

    @staticmethod
    def _letters(w: str) -> list[str]:
        w = f"^{w}$"
        return ["bias", f"len={min(len(w), 14)}"] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [f"end={w[-5:]}"]

    def morph(self, w: str) -> float:
        """How much the letters of a lower-case word look like a name's, in 0..1."""
        p = self._memo.get(w)
        if p is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            p = self._memo[w] = float(logit.scores(self.letters, np.array([logit.index(self._letters(w))]))[0])
        return p


def spans(text: str, names: Names) -> list[tuple[str, int, int]]:
    """All candidate spans ``(kind, start, end)`` of a text."""
    low = lowered(text)
    signs, streets, hits, pairs = names.scan(text, low)  # most texts hold nothing: one pass says so
    if text.isascii():
        classes = text.encode().translate(_CLASSES)
        six, pair = _CLASS_SIX.search(classes), _CLASS_PAIR.search(classes)
    else:
        six, pair = _SIX.search(text), _PAIR.search(text)
    if not (signs or six or pair or pairs):
        return []
    out: set[tuple[str, int, int]] = set()
    mails = [m.span() for m in _EMAIL.finditer(text)] if signs & _MAIL else []
    if signs & _DOT_WORD:
        mails += [m.span() for m in _SPELT.finditer(text)]
    out.update(("email", *m) for m in mails)
    if six:
        for m in _DIGITS.finditer(text):
            s, e = m.span()
            n = sum(c.isdigit() for c in m.group())
            if 7 <= n <= 16:
                if text.count("(", s, e) > text.count(")", s, e):
                    s += 1
                out.add(("phone", s, e))
        out.update(("identity", *m.span()) for m in _CODES.finditer(text))
        if "passport" in low or "id " in low or "number" in low or "no." in low or "ssn" in low or "identity" in low or "insurance" in low or "security" in low:
            for m in _CODE_CUE.finditer(text):
                if any(c.isdigit() for c in m.group(1)):
                    out.add(("identity", *m.span(1)))
    if streets and _DIGIT.search(text, 0, streets[-1]):  # a house number stands before the street or right after it
        out.update(("address", *m.span()) for m in _NUMBERED.finditer(text))
    if any(_NUMBER_NEXT.match(low, e) for e in streets):
        out.update(("address", *m.span()) for m in _STREET_FIRST.finditer(text))
    if signs & _STREET_ABROAD:
        out.update(("address", *m.span()) for m in _FOREIGN.finditer(text))
    if signs & _STREET_JOINED:
        out.update(("address", *m.span()) for m in _JOINED.finditer(text))
    if pair:
        pairs += [(m.start("a"), m.end("b")) for m in _CAPS.finditer(text)]
    for s, e in hits:
        if m := _RIGHT.match(text, e):
            pairs.append((s, m.end(2)))
        if m := _LEFT.search(text, max(0, s - 24), s):
            pairs.append((m.start(1), e))
    for s, e in pairs:
        if not any(a < e and s < b for a, b in mails):
            out.add(("name", s, e))
    return sorted(out)


#: Labelers vote 1 (a mention), -1 (none) or 0 (no opinion).
_PHONE_SHAPES = re.compile(r"(?:\+|00)\d[\d ().\-]{7,18}|\(\d{2,5}\)[ -]?\d[\d \-]{4,9}|0\d{2,4}[ -]\d{3,6}(?:[ -]\d{3,4})?|\d{3}[-.]\d{3}[-.]\d{4}")
_FUNCTION = frozenset("the a an and or of to in on with for from by at is was it this that he she they we you user about mr ms dr mrs".split())


def _around(text: str, s: int, e: int) -> tuple[list[str], list[str]]:
    """Up to three words or signs before and after a span, in lower case."""
    return _WORDS.findall(text[max(0, s - 30) : s].lower())[-3:], _WORDS.findall(text[e : e + 24].lower())[:3]


def _edges(text: str, s: int, e: int) -> tuple[str, str, str]:
    """The word before a span, the word before that, and the word after it; ``^`` and ``$`` where a text ends."""
    left, right = _around(text, s, e)
    return (left[-1] if left else "^"), (left[-2] if len(left) > 1 else "^"), (right[0] if right else "$")


def _contexts(kind: str, l1: str, l2: str, r1: str) -> tuple[str, str, str, str]:
    """A candidate's contexts, with its kind: two words before and one after, two words before, one word before, one word after."""
    return f"{kind}:{l2} {l1}|{r1}", f"{kind}:{l2} {l1}", f"{kind}:{l1}", f"{kind}:|{r1}"


def sure(text: str, kind: str, s: int, e: int, names: Names) -> bool:
    """Whether a candidate's own characters leave little doubt; the contexts of each kind are learnt from these."""
    body = text[s:e]
    if kind == "email":
        return body.count("@") == 1 and bool(re.search(r"\.[A-Za-z-]{2,}$", body)) and text[e : e + 1] != ":"
    if kind == "phone":
        return body[0] in "+(" and bool(_PHONE_SHAPES.fullmatch(body))
    if kind == "identity":
        return bool(_CODES.fullmatch(body))
    if kind == "address":
        words = re.findall(r"[^\W\d_]{2,}", body)
        return len(words) > 1 and all(w[0].isupper() for w in words)
    a, b = re.split(r",? ", lowered(body), maxsplit=1)
    return a in names.given and b in names.family or a in names.family and b in names.given


class Contexts:
    """What is known of contexts: how often candidates in them are sure, counted over all texts."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.share = {c: hits / n for c, (n, hits) in counts.items()}

    def names(self) -> list[str]:
        """The contexts ``l2 l1`` in which names are usual."""
        return [c[5:] for c, p in self.share.items() if c.startswith("name:") and "|" not in c and " " in c and p >= 0.4]

    def votes(self, kind: str, l1: str, l2: str, r1: str) -> tuple[int, int]:
        """By the words before and by the word after: 1 where candidates of the kind are usually sure, -1 where they hardly ever are, else 0."""
        *before, after = (self.share.get(c) for c in _contexts(kind, l1, l2, r1))
        known = max((p for p in before if p is not None), default=0.2)
        return self._vote(known), self._vote(0.2 if after is None else after)

    @staticmethod
    def _vote(share: float) -> int:
        return 1 if share >= 0.4 else -1 if share < 0.02 else 0


def judge(text: str, kind: str, s: int, e: int, names: Names, contexts: Contexts) -> tuple[list[int], list[str]]:
    """The labelers' votes on a candidate, and its features for the span classifier."""
    body = text[s:e]
    l1, l2, r1 = _edges(text, s, e)
    context, after = contexts.votes(kind, l1, l2, r1)
    f = ["bias", f"l1={l1}", f"l2={l2},{l1}", f"r1={r1}", f"context={context}", f"after={after}"]
    if kind == "email":
        host = re.split(_AT, body, maxsplit=1)[-1]
        dotted = bool(re.search(rf"{_DOT}[A-Za-z-]{{2,}}$", host)) or " dot " in host.lower()
        remote = text[e : e + 1] == ":" and text[e + 1 : e + 2] not in ("", " ", "\n") or body.lower().startswith("git@")
        scope = text[s - 1 : s] in ("@", "/") or text[e : e + 1] in ("/", "@")
        plain = body.count("@") == 1
        # an address ends where its host does: what runs on into a path is a remote
        votes = [1 if dotted and not remote else -1, -1 if remote else 0, -1 if scope else 1 if not remote else 0, 1 if plain and dotted and not remote else 0, context]
        f += [f"dotted={dotted}", f"remote={remote}", f"scope={scope}", f"plain={plain}", f"end={host[-4:].lower()}"]
    elif kind == "phone":
        n = sum(c.isdigit() for c in body)
        good = bool(_PHONE_SHAPES.fullmatch(body)) and not _CODES.fullmatch(body)
        date = bool(re.match(r"(?:19|20)\d\d-\d\d-\d\d", body)) or text[e : e + 1] == ":"
        version = bool(re.fullmatch(r"\d{1,2}(?:\.\d{1,4}){2,4}", body)) and not re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", body)
        bare = body.isdigit() and not body.startswith("0")
        numbered = any(m.span(1) == (s, e) for m in _CODE_CUE.finditer(text, max(0, s - 40), min(len(text), e + 1)))
        votes = [1 if good else -1, -1 if date or version else 0, -1 if bare else 0, context, after, -1 if not good and context < 1 else 0, -1 if _CODES.fullmatch(body) else 0, -1 if numbered else 0, 1 if 9 <= n <= 13 and not bare else -1]
        f += [f"good={good}", f"date={date}", f"version={version}", f"bare={bare}", f"n={n}", f"shape={_shape(body)}", f"code={bool(_CODES.fullmatch(body))}", f"numbered={numbered}", f"sign={body[0] if not body[0].isdigit() else body[:1] == '0'}"]
    elif kind == "identity":
        known = bool(_CODES.fullmatch(body))
        digits = sum(c.isdigit() for c in body)
        cue = any(m.span(1) == (s, e) for m in _CODE_CUE.finditer(text, max(0, s - 40), min(len(text), e + 1)))
        lettered = body[:1].isalpha()
        phone = bool(_PHONE_SHAPES.fullmatch(body)) and not known
        votes = [1 if known else 0, 1 if cue else 0, context, after, -1 if phone and not cue else 0, -1 if digits < 6 else 1]
        f += [f"known={known}", f"cue={cue}", f"digits={digits}", f"shape={_shape(body)}", f"phone={phone}", f"lettered={lettered}"]
    elif kind == "address":
        words = re.findall(r"[^\W\d_]+", re.sub(r"\b\d+[a-z]?\b", "", re.split(rf",? {_UNIT}", body)[0]))
        caps = all(w[0].isupper() for w in words)
        suffix = words[-1].lower() if words else ""
        street = words[-2].lower() if len(words) > 1 else suffix
        coined = street not in names.common or caps
        votes = [1 if caps else 0, context, after, 1 if coined else -1, 1 if re.search(_UNIT + "$", body) else 0]
        f += [f"caps={caps}", f"suffix={suffix}", f"coined={coined}", f"words={len(words)}", f"caps,context={caps},{context}", f"first={body[:1].isdigit()}", f"end3={street[-4:]}"]
    else:
        m = re.match(r"([^,\s]+)(,? )(\S+)$", body)
        a, sep, b = m.group(1), m.group(2), m.group(3)
        x, y = lowered(a.rstrip(".")), lowered(b.rstrip("."))
        gx, fx, gy, fy = x in names.given, x in names.family, y in names.given, y in names.family
        ix, iy = len(x) == 1, len(y) == 1
        px, py = (1.0 if gx or fx else 0.0 if ix else names.morph(x)), (1.0 if gy or fy else 0.0 if iy else names.morph(y))
        swapped = "," in sep
        fits = (fx and gy) if swapped else (gx and fy) or (fx and gy)
        initial = ix and not swapped and a[0].isupper() or iy and swapped and b[0].isupper()
        other = py if ix else px if iy else min(px, py)
        case = _shape(a)[:2] + ("," if swapped else "") + _shape(b)[:2]
        small = a[0].islower() and b[0].islower()
        mixed = a[0].islower() != b[0].islower()
        common = x in _FUNCTION or y in _FUNCTION or (x in names.common and not (gx or fx)) or (y in names.common and not (gy or fy))
        known_context = context == 1
        votes = [
            1 if fits else 0,
            1 if initial and (fx or fy or other > 0.6) else 0,
            1 if other > 0.7 else -1 if other < 0.3 else 0,
            -1 if common else 0,
            context,
            -1 if mixed and not initial else 0,
            -1 if (gx and gy) or (fx and fy and not gx and not gy) else 0,
        ]
        bucket = lambda p: "h" if p > 0.8 else "m" if p > 0.4 else "l"
        role = lambda g, f_, i: "i" if i else "b" if g and f_ else "g" if g else "f" if f_ else "-"
        rx, ry = role(gx, fx, ix), role(gy, fy, iy)
        f += [f"case={case}", f"roles={rx}{sep}{ry}", f"morph={bucket(px)}{bucket(py)}", f"roles,morph={rx}{sep}{ry},{bucket(px)}{bucket(py)}", f"common={common}", f"mixed={mixed}", f"lowered={small}", f"x={x[-4:]}", f"y={y[-4:]}", f"sep={sep}", f"roles,context={rx}{sep}{ry},{known_context}", f"morph,context={bucket(px)}{bucket(py)},{known_context}", f"morph,case={bucket(px)}{bucket(py)},{case}", f"morph,common={bucket(px)}{bucket(py)},{common}"]
    return votes, [f"{kind}:{k}" for k in f]


def reliabilities(votes: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over votes (-1, 0, 1) of labelers (columns) on candidates (rows).

    Returns each candidate's probability of being a mention and, per labeler, the probabilities of its
    three votes given no mention and given a mention (an array labelers x 2 x 3).
    """
    p = np.clip(0.5 + votes.sum(1) / (2 * np.maximum(1, np.abs(votes).sum(1))) * 0.8, 0.05, 0.95)
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.clip(p.mean(), 0.01, 0.99)
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                hit = votes[:, j] == v
                table[j, 1, v + 1] = (p[hit].sum() + 0.5) / (p.sum() + 1.5)
                table[j, 0, v + 1] = ((1 - p)[hit].sum() + 0.5) / ((1 - p).sum() + 1.5)
        z = np.full(len(p), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            z += np.log(table[j, 1, votes[:, j] + 1]) - np.log(table[j, 0, votes[:, j] + 1])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, table


def word_counts(texts: list[str]) -> Counter[str]:
    """In how many of ``texts`` each word occurs in lower case, as names hardly do."""
    every: Counter[str | bytes] = Counter()
    for t in texts:
        every.update(set(t.encode().translate(_LETTERS_ONLY).split() if t.isascii() else _LETTERED.findall(t)))
    out: Counter[str] = Counter()
    for w, c in every.items():  # each word is looked at once, not once a text
        if len(w) > 2 and w.islower():
            out[w if isinstance(w, str) else w.decode()] += c
    return out


def common_words(counts: dict[str, int], n: int) -> set[str]:
    """The words of many of ``n`` texts: vocabulary, whatever their letters; names and streets are spread thin."""
    return {w for w, c in counts.items() if c >= max(5, n / 1000)}


def context_counts(texts: list[str], names: Names) -> tuple[Counter[str], Counter[str]]:
    """The contexts of candidates in ``texts``: how often each occurs, and how often with a sure candidate."""
    every: Counter[str] = Counter()
    hits: Counter[str] = Counter()
    for t in texts:
        for k, s, e in spans(t, names):
            known = sure(t, k, s, e, names)
            for c in _contexts(k, *_edges(t, s, e)):
                every[c] += 1
                hits[c] += known
    return every, hits


def usual(n: int) -> float:
    """How many of ``n`` texts a context must occur in to be known."""
    return max(3.0, n / 200_000)


class Finder:
    """The trained span classifier with its tables; built on the driver, used on executors.

    ``common`` words and ``counts`` of contexts come from all texts of a corpus (see ``train``); without them ``texts`` are all there is.
    """

    def __init__(self, name_rows: list[tuple[str, str]], texts: list[str], common: set[str] | None = None, counts: dict[str, tuple[int, int]] | None = None):
        if common is None:
            common = common_words(word_counts(texts), len(texts))
        if counts is None:
            every, hits = context_counts(texts, Names(name_rows, [], set()))
            counts = {c: (n, hits[c]) for c, n in every.items() if n >= usual(len(texts))}
        self.names, self.contexts = Names(name_rows, sorted(common), common), Contexts(counts)
        self.names.learn(self.contexts.names())
        per_text = [(t, spans(t, self.names)) for t in texts]
        by: dict[str, list] = {k: [] for k in KINDS}
        for t, ss in per_text:
            for k, s, e in ss:
                by[k].append(judge(t, k, s, e, self.names, self.contexts))
        x, y = [], []
        self.tables: dict[str, np.ndarray] = {}
        for k, rows in by.items():
            if rows:
                p, self.tables[k] = reliabilities(np.array([v for v, _ in rows]))
                x += [logit.index(f) for _, f in rows]
                y.append(p)
        self.w = logit.fit(logit.matrix(x), np.concatenate(y), epochs=10) if x else np.zeros(logit.DIM, np.float32)

    def mentions(self, text: str) -> list[tuple[str, int, int, float]]:
        """``(kind, start, end, score)`` of the mentions of a text, not overlapping, in order."""
        ss = spans(text, self.names)
        if not ss:
            return []
        p = logit.scores(self.w, logit.matrix([logit.index(judge(text, *c, self.names, self.contexts)[1]) for c in ss]))
        kept: list[tuple[str, int, int, float]] = []
        for i in sorted(range(len(ss)), key=lambda i: (-(round(p[i], 3)), -(ss[i][2] - ss[i][1]), ss[i][1])):
            k, s, e = ss[i]
            if p[i] >= 0.5 and not any(a < e and s < b for _, a, b, _ in kept):
                kept.append((k, s, e, float(p[i])))
        return sorted(kept, key=lambda m: m[1])

    def redacted(self, text: str) -> str:
        """The text with a typed placeholder for each mention; all else is unchanged."""
        out, at = [], 0
        for k, s, e, _ in self.mentions(text):
            out += [text[at:s], PLACEHOLDER[k]]
            at = e
        return "".join(out) + text[at:]


def corpus_counts(texts: DataFrame, names: Names) -> DataFrame:
    """``(key, n, hits)`` over all ``texts(text)``: texts of each word (``word:...``), candidates and sure ones of each context."""
    sent = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("text").to_pylist()
            n, hits = context_counts(values, sent.value)
            n.update({f"word:{w}": c for w, c in word_counts(values).items()})
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([hits[k] for k in n], pa.int64())], ["key", "n", "hits"])

    return texts.mapInArrow(run, "key string, n long, hits long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def train(values: DataFrame, name_list: DataFrame, most: int = TRAIN_TEXTS) -> Finder:
    """A finder with the words and contexts of all texts and the name list (at most ``NAMES`` names).

    Reliabilities and the classifier are fitted on at most ``most`` texts, taken by a hash.  The driver gets the words of
    at least a thousandth of the texts, and the contexts that at least one of 200,000 texts has.
    """
    rows = name_list.where("name IS NOT NULL").select("name", "name_part").distinct().limit(NAMES + 1).collect()
    if len(rows) > NAMES:
        raise ValueError(f"the name list is meant to be small; filter it to {NAMES} names")
    name_rows = sorted((r.name, r.name_part or "") for r in rows)
    full = values.where("text <> ''")
    n = full.count()
    is_word = F.startswith("key", F.lit("word:"))
    counted = corpus_counts(full.select("text"), Names(name_rows, [], set())).where(F.col("n") >= F.when(is_word, max(5, n / 1000)).otherwise(usual(n)))
    got = counted.collect()  # at most a thousand times the words of a text, and 200,000 times the contexts of a text
    common = {r.key[5:] for r in got if r.key.startswith("word:")}
    contexts = {r.key: (r.n, r.hits) for r in got if not r.key.startswith("word:")}
    pool = full.where(F.pmod(F.xxhash64("tbl", "id", "field"), F.lit(1_000_000)) < int(min(1.0, 1.2 * most / max(n, 1)) * 1_000_000) + 1)
    texts = [r.text for r in pool.orderBy(F.xxhash64("tbl", "id", "field")).select("text").limit(most).collect()]
    return Finder(name_rows, texts, common, contexts)


def found(values: DataFrame, name_list: DataFrame) -> DataFrame:
    """``(tbl, rec_id, field, kind, start_pos, end_pos, score)``: every mention in ``values(tbl, id, field, text)``.

    Positions are 1-based, in characters; ``end_pos`` is the last character's.  Null and empty texts
    have no mention.  Rows repeated under one id give their mentions once.
    """
    values = values.where("text IS NOT NULL AND id IS NOT NULL").select("tbl", "id", "field", "text")
    model = values.sparkSession.sparkContext.broadcast(train(values, name_list))  # a fixed number of weights and the name list
    schema = "tbl string, rec_id long, field string, kind string, start_pos long, end_pos long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = model.value
        for b in batches:
            out = []
            for tbl, i, field, t in zip(*(c.to_pylist() for c in b.columns)):
                out += [(tbl, i, field, k, s + 1, e, p) for k, s, e, p in finder.mentions(t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["tbl", "rec_id", "field", "kind", "start_pos", "end_pos", "score"])

    return values.mapInArrow(run, schema).dropDuplicates(["tbl", "rec_id", "field", "kind", "start_pos"])


def redact(values: DataFrame, name_list: DataFrame) -> DataFrame:
    """``values(tbl, id, field, text)`` with typed placeholders in place of the mentions; null texts stay null."""
    values = values.select("tbl", "id", "field", "text")
    model = values.sparkSession.sparkContext.broadcast(train(values, name_list))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = model.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([t and finder.redacted(t) for t in b.column("text").to_pylist()], pa.string())], ["tbl", "id", "field", "text"])

    return values.mapInArrow(run, "tbl string, id long, field string, text string")
