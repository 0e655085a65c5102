"""Problem 5: noise in text from scanned pages.

Method: sequence labelling of lines.  A hidden Markov model over layout features
(numbers, case of the first letter, end mark, sentence marks, neighbours) labels
every line of a value as body, break (its last word goes on in the next line),
header (running line or page number), reading (a column of figures) or list item; paragraphs
are put together from all lines but the confirmed running lines and numbers.  Words are checked against the
corpus: a word is misread when another word one misreading away is at least
``ratio`` times as frequent in the language where the word is most at home.

The mapper only gathers evidence (broken words, joined words, suspicious words,
running-line candidates): a hyphen at a line end is a break where the line is labelled
as body, break or item, a line is looked up as a running line where its header score is
near the best.  What needs the corpus is confirmed by joins with the
word tables and the running-line table, so nothing that grows with the corpus is
broadcast.  The list of known words sent along, the ``KNOWN`` most frequent good ones,
only saves rows that the joins would refuse: a good word is never bad, and two words
that are both among the most frequent can only be parts of a word that is 20 times as
frequent as one of them, hence in the list as well.  The repair applies what was
confirmed for the value, no more and no less: it has no word list of its own.

Defined results: NULL and empty values have no evidence; a value that is one
running line or number as a whole is no case unless a word in it is misread;
ties between neighbour words go to the more frequent, then the alphabetically
first; values of any length are read whole; extra columns are ignored.  A repaired
value is in the consistent form of problem 6, in which its damage was found; markup
stays; a word whose rest stands in another value keeps its mark.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repetition, skeleton
from .common import melt_fields
from .crf import LinearChain
from .lines import _halves, line_key, one_misreading

#: At most this many words travel with the tasks.
KNOWN = 200_000
#: A neighbour must be this many times as frequent for a word to count as its misreading.
RATIO = 20
#: Only values that compress below this share of their bytes are searched for loops (a text without one doesn't).
LOOPING = 0.3
#: A line whose header score is at most this much below its best score is looked up among the running lines.
DOUBT = 5.0
#: Runs of letters longer than this are unspaced runs, not words of any of the languages.
MAX_WORD = 100

# Function words that tell the Latin-script languages apart.
STOP = {
    "en": "the of and is are was were be been a an at by with from than for to which while not more in on if then this that these those it its as or but has have had can will would "
    "should must may when where there their they we our into over under between after before during through each such",
    "de": "der die das dem den und ist sind war waren nicht von bei mit auf zu zum zur wird werden wurde einer eine einem einen eines ein als so sich auch aus nach durch für über unter "
    "zwischen oder aber wenn dass daß kann können muß muss bis noch nur sowie dieser diese dieses",
    "fr": "le la les du de des et est sont une un au aux pour dans sur par que qui il elle ils se ce cette ces son sa ses avec sans sous entre ou mais donc plus ne pas peut être "
    "après avant lorsque dont très deux leur",
}
_STOP = {w: lang for lang, ws in STOP.items() for w in ws.split()}
# Digits and signs, and the letters they are read for (Cyrillic, Latin).
DIGIT_LETTERS = {
    "0": "оo", "1": "лli", "3": "зe", "4": "чa", "5": "бs", "6": "бb", "8": "вb", "9": "яg",
    "|": "il", "!": "il", "@": "аa", "€": "еe", "$": "s",
}

_L = r"[^\W\d_]"
_WORD = re.compile(rf"{_L}+")
_BREAK = re.compile(rf"(?<![^\W\d_])({_L}++)(?:-[ \t]*\r?\n[ \t]*|- +|[ \t]*¬[ \t]*\r?\n?[ \t]*)({_L}+)")
_END_BREAK = re.compile(rf"({_L}{{2,}})(?:-|¬)\s*\Z")
_SPACED = re.compile(rf"(?<![\w-])(?:{_L} ){{2,}}{_L}(?!\w)")
_DIGIT_WORD = re.compile(rf"(?<!\w)(?={_L}*\d)(?:{_L}{{1,}}\d{{1,2}}|\d(?={_L}{{3}}))(?:{_L}|\d(?={_L}))*(?![\w])")
# quick tests before the slower expressions
_SPACED_HINT = re.compile(rf" {_L} {_L}(?!\w)")
_DIGIT_HINT = re.compile(rf"\d(?={_L}{{3}})|(?<={_L})\d")
_WITH_DIGIT = re.compile(r"\w*\d\w*")
_SIGN_HINT = re.compile(rf"[|!@€$](?={_L})")
_SIGN_WORD = re.compile(rf"{_L}+[|!@€$]{_L}+")
_COMPOUND = re.compile(rf"(?<![^\W\d_]){_L}++(?:-{_L}++)+")
_BREAK_HINT = re.compile(r"-[ \t\r\n]|¬")
#: The rest of a word whose first half stands in another value.
_REST = re.compile(r"\A\s*[^\W\d_A-ZА-ЯЁÄÖÜ]+")
_RUN = re.compile(rf"{_L}+(?: +{_L}+)+")
_MARKUP = re.compile(r"<[^<>\n]*>|\\[A-Za-z]+|&#?\w+;|\{\{[^{}\n]*\}\}|\]\([^()\n]*\)|\$[^$\n]*\$|\\\([^\n]*?\\\)|`[^`\n]*`|~\\cite\{\w*\}")
_NUM_LINE = re.compile(r"\s*(?:\d{1,4}|\[\d{1,4}\]|[-—–]\s?\d{1,4}\s?[-—–]|(?:с|С|p|P|pp|S|s|стр|Стр|Seite|page)\.?\s?\d{1,4})\s*")
_BARE = re.compile(r"\s*\d{1,4}\s*")
_LIST_MARK = re.compile(r"(?:\d{1,2}[.)]|[•·—–*-]|[a-zа-я]\)) +(?=\D)")
_READING = re.compile(r"\s*[-+]?\d+(?:[.,]\d+)?\s*")
_ENDS = frozenset(".!?:;…»\"')]")
_HYPH = re.compile(rf"{_L}[-¬]\s*$")
_HEAD_PART = re.compile(rf"({_L}+)[-¬]\s*\Z")
_TAIL_PART = re.compile(rf"\s*({_L}+)")
_NEXT = re.compile(rf"({_L}+)( +)(?=({_L}+))")
_UK = re.compile("[іїєґІЇЄҐ]")
_CYR = re.compile("[Ѐ-ӿ]")
_CANON = skeleton.Canonicaliser()

#: Stands for a piece of markup while a value is repaired; read as a space.
_MARK = "\ufdd0"
_ASIDE = re.compile(f"{_MARKUP.pattern}|{_MARK}")

STATES = ("body", "break", "header", "reading", "list")
SIZES = (3, 3, 3, 3, 2, 3, 3, 2, 2)


def consistent(text: str) -> str:
    """The value without look-alike characters."""
    if not text.isascii() and (skeleton._ODD_RE.search(text) or skeleton.mixed(text)):
        text = _CANON(text)[0]
    return text


def clean_marks(text: str) -> str:
    """The value without markup and look-alike characters, so that their faults don't count here."""
    text = consistent(text)
    if "<" in text or "\\" in text or "&" in text or "{" in text or "](" in text or "`" in text or "$" in text:
        text = _MARKUP.sub(" ", text)
    return text


def line_bins(lines: list[str]) -> np.ndarray:
    """Layout features of the lines of one value, as small category numbers."""
    out = []
    n = len(lines)
    strip = [x.strip() for x in lines]
    digit = [x[:1].isdigit() or x[:1] in "-+" for x in strip]
    nums = [d and _READING.fullmatch(x) is not None for d, x in zip(digit, strip)]
    ends = [x[-1:] in _ENDS for x in strip]
    for i, s in enumerate(strip):
        first = s[:1]
        words = s.count(" ") + 1
        short = len(s) <= 14
        out.append((
            1 if nums[i] and _BARE.fullmatch(s) else 2 if short and _NUM_LINE.fullmatch(s) else 0,
            0 if first.islower() else 1 if first.isupper() else 2,
            0 if s[-1:] in "-¬" and _HYPH.search(s[-3:]) else 1 if ends[i] else 2,
            0 if words <= 1 else 1 if words <= 9 else 2,
            ". " in s or ", " in s,
            2 if i == 0 else int(not ends[i - 1]),
            2 if i + 1 == n else int(strip[i + 1][:1].islower()),
            (i > 0 and nums[i - 1]) or (i + 1 < n and nums[i + 1]),
            _LIST_MARK.match(s) is not None,
        ))
    return np.array(out, np.int64).reshape(-1, len(SIZES))


def _made_up(rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Seeded values with known labels: wrapped prose, running lines, page numbers, columns of figures."""
    import textwrap

    def word() -> str:
        return "".join(rng.choice(list("aeiounrtsl"), rng.integers(2, 10)))

    out = []
    for _ in range(150):
        text = " ".join(" ".join(word() for _ in range(rng.integers(5, 14))).capitalize() + str(rng.choice([".", ", " + word() + "."])) for _ in range(rng.integers(2, 7)))
        body = textwrap.wrap(text, int(rng.integers(45, 70))) if rng.random() < 0.6 else [text[: len(text) // 2].rsplit(". ", 1)[0] + ".", text]
        if rng.random() < 0.3:
            mark = str(rng.choice(["{}) ", "{}. ", "• ", "— "]))
            body = [mark.format(k + 1) + f"{word()} {word()}".capitalize() + str(rng.choice([f" {k + 7};", ";", "", "."])) for k in range(int(rng.integers(2, 8)))]
        lines = [(x, 4 if _LIST_MARK.match(x) else 0) for x in body]
        for i in range(len(lines) - 1):
            if rng.random() < 0.15 and lines[i][1] == 0:
                lines[i] = (lines[i][0] + word()[:3] + str(rng.choice(["-", "¬", "- "])), 1)
        if rng.random() < 0.6:
            k = int(rng.integers(1, 999))
            title = " ".join(word() for _ in range(rng.integers(3, 7)))
            head = str(rng.choice([str(k), f"- {k} -", f"[{k}]", f"p. {k}", title.capitalize(), title.upper(), f"{title.capitalize()} {k}", f"{k} {title.capitalize()}", title]))
            lines.insert(int(rng.choice([0, len(lines), rng.integers(0, len(lines) + 1)])), (head, 2))
        if rng.random() < 0.25:
            lines += [(str(rng.integers(1, 99)), 3) for _ in range(rng.integers(2, 8))]
        out.append(([x for x, _ in lines], [y for _, y in lines]))
    return out


@lru_cache
def default_model(seed: int = 5) -> LinearChain:
    """Emission and transition log-probabilities by counting on the made-up values."""
    model = LinearChain(len(STATES), sum(SIZES))
    offs = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
    emit, trans = np.full((len(STATES), sum(SIZES)), 0.5), np.full((len(STATES), len(STATES)), 0.5)
    for lines, labels in _made_up(np.random.default_rng(seed)):
        for b, y in zip(line_bins(lines), labels):
            emit[y, offs + b] += 1
        for a, b in zip(labels[:-1], labels[1:]):
            trans[a, b] += 1
    for o, n in zip(offs, SIZES):
        model.emit[:, o : o + n] = np.log(emit[:, o : o + n] / emit[:, o : o + n].sum(1, keepdims=True))
    model.trans = np.log(trans / trans.sum(1, keepdims=True))
    return model


def label_lines(lines: list[str], model: LinearChain) -> list[int]:
    """State of every line of one value; blank lines are skipped by the caller."""
    return label_many([lines], model)[0][0]


def label_many(values: list[list[str]], model: LinearChain) -> tuple[list[list[int]], list[list[bool]]]:
    """States of the lines of many values, and whether a line could be a header by its own looks (within ``DOUBT`` nats)."""
    full = [x for x in values if x]
    if not full:
        return [[] for _ in values], [[] for _ in values]
    b = np.concatenate([line_bins(x) for x in full])
    offs = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
    x = np.zeros((len(b), sum(SIZES)))
    x[np.arange(len(b))[:, None], b + offs] = 1.0
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in full])])
    lab = model.decode_many(x, bounds)
    lab[(b[:, 0] == 1) & (b[:, 7] == 1)] = STATES.index("reading")  # figures next to figures are a column
    own = x @ model.emit.T
    may = (own[:, STATES.index("header")] >= own.max(1) - DOUBT) | (lab == STATES.index("header"))
    parts = iter((lab[a:c].tolist(), may[a:c].tolist()) for a, c in zip(bounds[:-1], bounds[1:]))
    both = [next(parts) if v else ([], []) for v in values]
    return [a for a, _ in both], [b for _, b in both]


def outside_loops(text: str) -> set[str] | None:
    """The words of a text that loops, but for those inside what it has said before and those broken off where a loop begins.

    None for a text that doesn't loop.  A loop begins where the first window that comes again stood for the first time;
    recognition ran away there in the middle of a word.
    """
    raw = text.encode()
    if len(text) <= 120 or len(zlib.compress(raw, 1)) >= LOOPING * len(raw):
        return None
    even = re.sub(r"\d", "0", text)  # a loop may count
    codes = np.frombuffer(even.encode("utf-32-le", "surrogatepass"), np.uint32)
    said = repetition.covered(repetition.seen_windows(codes, np.zeros(len(codes), np.int64)))
    begun = np.flatnonzero(said & ~np.concatenate([[False], said[:-1]])).tolist()
    edges = {e for b in begun for e in (b, even.find(even[b : b + repetition.WINDOW]))}
    near = {e + k for e in edges for k in range(-3, 5)}
    return {m[0] for m in _WORD.finditer(text) if m.end() not in near and not said[m.start() : m.end()].any()}


def language(words: list[str]) -> str:
    """Language of lower-case words by script and function words; x when nothing tells."""
    cyr = [w for w in words if "\u0400" <= w[0] <= "\u04ff"]
    if cyr and len(cyr) * 2 >= len(words):
        return "uk" if _UK.search("".join(cyr)) else "ru"
    votes = Counter([_STOP[w] for w in words if w in _STOP])
    return max(sorted(votes), key=votes.__getitem__) if votes else "x"


def word_table(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(lang, word, n) over all values; words at a break don't count.  Counted per batch before the shuffle."""

    def run(it):
        counts: dict[str, Counter[str]] = {}
        for pdf in it:
            for row in zip(*[pdf[f] for f in fields]):
                for v in {v for v in row if v}:
                    t = clean_marks(v)
                    if _BREAK_HINT.search(t):
                        t = _BREAK.sub(" ", t)
                    ws = _WORD.findall(t.lower())
                    counts.setdefault(language(ws), Counter()).update(ws)
            if sum(map(len, counts.values())) > 400_000:
                yield _counts(counts)
                counts = {}
        yield _counts(counts)

    return df.select(*fields).mapInPandas(run, "lang string, word string, n long").where(F.length("word") <= MAX_WORD).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counts(counts: dict[str, Counter[str]]) -> pd.DataFrame:
    rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
    return pd.DataFrame(rows, columns=["lang", "word", "n"])


def _variants(word: Column) -> Column:
    """The word, and the word less one letter and less two neighbouring letters at every place."""
    at = F.sequence(F.lit(1), F.length(word))

    def less(k: int) -> Column:
        return F.transform(at, lambda i: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + k, F.length(word)))))

    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), less(1), less(2)))


def judge_words(words: DataFrame, ratio: int = RATIO, min_length: int = 4) -> tuple[DataFrame, DataFrame]:
    """(bad words, good words).

    A word belongs to the language where it is most frequent.  There it is bad if a word one misreading away is
    ``ratio`` times as frequent, or if it is two frequent words without the space.  Function words are never bad.
    """
    rank = F.struct("n", F.col("lang") != "x", "lang")
    home = words.groupBy("word").agg(F.max_by(F.struct("lang", "n"), rank).alias("h"), F.sum("n").alias("n_all")).select("word", "h.lang", "h.n", "n_all")
    long = home.where(F.length("word") >= min_length)
    solid = words.where(F.col("n") >= ratio)
    frequent = solid.where(F.length("word") >= min_length).select("lang", F.col("word").alias("right"), F.col("n").alias("n_right"), F.explode(_variants(F.col("word"))).alias("v"))
    best = words.groupBy("lang").agg(F.max("n").alias("best"))
    rare = long.join(F.broadcast(best), "lang").where(F.col("n") * ratio <= F.col("best")).select("lang", "word", "n", F.explode(_variants(F.col("word"))).alias("v"))
    misread = rare.join(frequent, ["lang", "v"]).where((F.col("n") * ratio <= F.col("n_right")) & one_misreading(F.col("word"), F.col("right"))).groupBy("word").agg(F.max_by("right", F.struct("n_right", "right")).alias("fix"))
    # two frequent words run together
    splits = F.transform(F.sequence(F.lit(2), F.length("word") - 2), lambda i: F.struct(F.substring("word", F.lit(1), i).alias("a"), F.substring(F.col("word"), i + 1, F.length("word")).alias("b")))
    cut = long.where(F.length("word") >= 5).join(F.broadcast(best), "lang").where(F.col("n") * ratio <= F.col("best")).select("word", "lang", "n", F.explode(splits).alias("s")).select("word", "lang", "n", "s.a", "s.b")
    parts = solid
    glued = (
        cut.join(parts.select(F.col("word").alias("a"), F.col("lang"), F.col("n").alias("na")), ["a", "lang"]).where(F.col("na") >= F.col("n") * ratio)
        .join(parts.select(F.col("word").alias("b"), F.col("lang"), F.col("n").alias("nb")), ["b", "lang"]).where(F.col("nb") >= F.col("n") * ratio)
        .groupBy("word").agg(F.max_by(F.concat_ws(" ", "a", "b"), F.struct(F.least("na", "nb"), "a")).alias("fix"))
    )
    bad = misread.unionByName(glued).where(~F.col("word").isin(*_STOP)).groupBy("word").agg(F.min("fix").alias("fix"))
    good = home.join(bad, "word", "left_anti").select("word", F.col("n_all").alias("n"))
    return bad, good


def known_words(good: DataFrame, limit: int = KNOWN, floor: int = 3) -> list[str]:
    """The most frequent good words: at most ``limit`` strings reach the driver."""
    return [r.word for r in good.where(F.col("n") >= floor).orderBy(F.desc("n"), "word").limit(limit).collect()]


class Gatherer:
    """Evidence of damage in values; the lines of many values are decoded at once."""

    def __init__(self, known: frozenset[str], model: LinearChain):
        self.known, self.model = known, model

    def many(self, values: list[str]) -> list[list[tuple[str, str]]]:
        """Per value its (kind, item) pairs: sure, good (the joined word must be one), parts, bad (must be bad), line."""
        texts = [clean_marks(v) for v in values]
        lines = [[x for x in t.split("\n") if x and not x.isspace()] if "\n" in t else [] for t in texts]
        lines = [x if len(x) > 1 else [] for x in lines]
        labels, may = label_many(lines, self.model)
        return [self.one(t, x, y, m) for t, x, y, m in zip(texts, lines, labels, may)]

    def one(self, text: str, lines: list[str], labels: list[int], may: list[bool]) -> list[tuple[str, str]]:
        out: set[tuple[str, str]] = set()
        body = text
        if True in may:
            if len(lines) > 1 and any(y in (0, 1, 4) for y in labels):
                for ln, y, m in zip(lines, labels, may):
                    if _NUM_LINE.fullmatch(ln):
                        if y == 2:
                            out.add(("sure", "number"))
                    elif m:
                        out.add(("line", ln))
            kept = [(x, m) for x, y, m in zip(lines, labels, may) if y != 2 or not _NUM_LINE.fullmatch(x)]
            body = "\n".join(x for x, _ in kept)
            if "-" in body or "¬" in body:
                out.update(("good", w) for w in _around(kept))
        for ln in (x.rstrip() for x, y in zip(lines, labels) if y in (2, 3)):
            if ln[-1:] in ("-", "¬"):  # a running line or reading doesn't go on in the next line
                body = body.replace(ln, ln[:-1])
        if "-" in body or "¬" in body:
            if _BREAK_HINT.search(body):
                for m in _BREAK.finditer(body):
                    out.add(("sure", "break") if "¬" in m[0] else ("good", (m[1] + m[2]).lower()))
                body = _BREAK.sub(" ", body)
            if body.rstrip()[-1:] in ("-", "¬") and (m := _END_BREAK.search(body, max(0, len(body.rstrip()) - 2 * MAX_WORD))):
                out.add(("sure", "end"))
                body = body[: m.start()] + " "
            if "-" in body:
                body = _COMPOUND.sub(" ", body)  # parts of a compound need not be words
        if _SPACED_HINT.search(body):
            for m in _SPACED.finditer(body):
                w = m[0].replace(" ", "").lower()
                out.update(("good", x) for x in (w, w[1:], w[:-1]) if len(x) >= 3)  # a one-letter word may stand before or after
        if _DIGIT_HINT.search(body):
            for m in _DIGIT_WORD.finditer(body):
                out.update(("good", w) for w in self.digits(m[0].lower()))
            body = _WITH_DIGIT.sub(" ", body)
        if _SIGN_HINT.search(body):
            for m in _SIGN_WORD.finditer(body):
                out.update(("good", w) for w in self.digits(m[0].lower()))
        low = _REST.sub("", body).lower() if body[:1].islower() or body[:1].isspace() else body.lower()
        known = self.known
        ws = _WORD.findall(low)
        strange = set(ws) - known
        if len(ws) > 1 and (strange or not known.isdisjoint(map(add, ws[:-1], ws[1:]))):
            for m in _RUN.finditer(low):
                parts = m[0].split()
                joined = list(map(add, parts[:-1], parts[1:]))
                if strange.isdisjoint(parts) and known.isdisjoint(joined):
                    continue
                for x, y, j in zip(parts[:-1], parts[1:], joined):
                    if len(j) <= MAX_WORD and (j in known or x in strange or y in strange):
                        out.add(("parts", f"{x} {y}"))
        odd = {w for w in strange if 4 <= len(w) <= MAX_WORD}
        if odd and (whole := outside_loops(low)) is not None:
            odd &= whole
        out.update(("bad", w) for w in odd)
        return sorted(out)

    @staticmethod
    def digits(token: str) -> list[str]:
        """Known words the token could be with its digits read as letters."""
        cyr = bool(_CYR.search(token))
        forms = [""]
        for c in token:
            if c in DIGIT_LETTERS or c.isdigit():
                opts = [x for x in DIGIT_LETTERS.get(c, "") if bool(_CYR.match(x)) == cyr]
                forms = [f + o for f in forms for o in opts]
            else:
                forms = [f + c for f in forms]
        return [f for f in forms if len(f) >= 4]


def _around(lines: list[tuple[str, bool]]) -> Iterator[str]:
    """The words that are whole if the lines between their halves, all candidates for running lines, go."""
    for i, (line, _) in enumerate(lines[:-2]):
        a = _HEAD_PART.search(line) if line.rstrip()[-1:] in ("-", "¬") else None
        for j in range(i + 2, len(lines) if a else 0):
            if not lines[j - 1][1]:
                break
            b = _TAIL_PART.match(lines[j][0])
            if b and b[1][0].islower():
                yield (a[1] + b[1]).lower()


def evidence(df: DataFrame, known: list[str], fields: tuple[str, ...], key: str = "id", source: str = "source") -> DataFrame:
    """(key, field, source, kind, item) of every value of ``fields``."""
    words = frozenset(known)
    model = default_model()

    def run(it):
        fn = Gatherer(words, model)
        for pdf in it:
            rows: list[tuple] = []
            distinct = list({v for f in fields for v in pdf[f] if v})
            done = dict(zip(distinct, fn.many(distinct)))
            for k, src, *vals in zip(pdf[key], pdf[source], *[pdf[f] for f in fields]):
                rows += [(k, f, src, a, b) for f, v in zip(fields, vals) if v for a, b in done[v]]
            yield pd.DataFrame(rows, columns=[key, "field", source, "kind", "item"])

    types = dict(df.dtypes)
    return df.select(key, source, *fields).mapInPandas(run, f"{key} {types[key]}, field string, {source} {types[source]}, kind string, item string")


def running_lines(blocks: DataFrame, min_pages: int = 3) -> DataFrame:
    """(source, key) of the running lines: texts of header and footer blocks that stand on ``min_pages`` pages of the source."""
    edge = blocks.where(F.col("category").isin("Page-header", "Page-footer") & F.col("source").isNotNull())
    rows = edge.select("source", "page", F.explode(F.split("text", "\n")).alias("line")).select("source", "page", line_key(F.col("line")).alias("key"))
    return rows.where(F.length("key") >= 4).groupBy("source", "key").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= min_pages).select("source", "key")


def confirm(ev: DataFrame, words: DataFrame, bad: DataFrame, good: DataFrame, running: DataFrame, key: str = "id", floor: int = 3, ratio: int = RATIO) -> DataFrame:
    """(key, field, kind, item, fix, n): the evidence that the corpus tables bear out; n is how frequent a whole word is."""
    cols = [key, "field", "kind", "item"]
    none = F.lit(None).cast("long").alias("n")
    sure = ev.where(F.col("kind") == "sure").select(*cols, F.lit(None).cast("string").alias("fix"), none)
    odd = ev.where(F.col("kind") == "bad").join(bad.withColumnRenamed("word", "item"), "item").select(*cols, "fix", none)
    whole = good.where(F.col("n") >= floor).select(F.col("word").alias("whole"), F.col("n").alias("n_whole"))
    joined = ev.where(F.col("kind") == "good").join(whole, F.col("item") == F.col("whole")).select(*cols, F.col("whole").alias("fix"), F.col("n_whole").alias("n"))
    # a word in two: the parts are no words, or hardly ever stand alone
    total = words.groupBy("word").agg(F.sum("n").alias("n"))
    parts = ev.where(F.col("kind") == "parts").select(*cols, F.split("item", " ").alias("ab")).select(*cols, F.col("ab")[0].alias("a"), F.col("ab")[1].alias("b"))
    parts = parts.join(whole, F.concat("a", "b") == F.col("whole"))
    for c in ("a", "b"):
        parts = parts.join(total.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    split = parts.where(F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))) * ratio <= F.col("n_whole")).select(*cols, F.col("whole").alias("fix"), F.col("n_whole").alias("n"))
    cand = ev.where(F.col("kind") == "line").withColumn("key", line_key(F.col("item"))).where(F.length("key") >= 4)
    halves = lambda d: d.withColumn("half", F.explode(F.array_distinct(F.array(*_halves()))))
    run = halves(running).select("source", "half", F.col("key").alias("centre"))
    lines = halves(cand).join(run, ["source", "half"]).where(one_misreading(F.col("key"), F.col("centre"))).select(*cols, F.lit("").alias("fix"), none)
    return sure.unionByName(odd).unionByName(joined).unionByName(split).unionByName(lines).distinct()


#: What was confirmed in one value: (kind, item) -> (how frequent the word is, fix).
Found = dict[tuple[str, str], tuple[int, str]]


def repair(value: str, known: frozenset[str], fixes: dict[str, str] | None = None, model: LinearChain | None = None) -> str:
    """One value repaired where no corpus tables are at hand: ``known`` words and listed misreadings confirm its evidence."""
    model = model or default_model()
    found: Found = {(k, i): (0, i) for k, i in Gatherer(known, model).many([value])[0] if k == "sure" or (k == "good" and i in known)}
    found |= {("bad", w): (0, fix) for w, fix in (fixes or {}).items()}
    return repair_many([value], [found], model)[0]


def repair_many(values: list[str], found: list[Found], model: LinearChain) -> list[str]:
    """Continuous paragraphs: exactly the confirmed lines and numbers dropped, words joined and misreadings replaced."""
    texts, marks = zip(*[_set_aside(v) for v in values]) if values else ((), ())
    lines = [[x for x in t.replace(_MARK, " ").split("\n") if x and not x.isspace()] if "\n" in t else [] for t in texts]
    labels, _ = label_many([x if len(x) > 1 else [] for x in lines], model)
    return [_repair_one(t, list(m), y, f) for t, m, y, f in zip(texts, marks, labels, found)]


def _set_aside(value: str) -> tuple[str, list[str]]:
    """The value as ``clean_marks`` reads it, with a sign where that has a space for markup, and the markup."""
    marks: list[str] = []
    return _ASIDE.sub(lambda m: marks.append(m[0]) or _MARK, consistent(value)), marks


def _edit(pattern: re.Pattern, fn, text: str) -> str:
    """``pattern.sub`` that reads the signs of markup as spaces; those inside a changed match stand behind it."""
    if _MARK not in text:
        return pattern.sub(fn, text)
    out, at = [], 0
    for m in pattern.finditer(text.replace(_MARK, " ")):
        new = fn(m)
        if new != m[0]:
            out += [text[at : m.start()], new, _MARK * text.count(_MARK, *m.span())]
            at = m.end()
    return "".join(out) + text[at:]


def _repair_one(text: str, marks: list[str], labels: list[int], found: Found) -> str:
    label, mark = iter(labels), iter(marks)
    kept_marks: list[str] = []
    paras: list[list[tuple[str, int]]] = [[]]
    for ln in text.split("\n"):
        own = [next(mark) for _ in range(ln.count(_MARK))]
        plain = ln.replace(_MARK, " ")
        blank = not plain or plain.isspace()
        y = 4 if blank else next(label, 0)
        if (not blank and ("line", plain) in found) or (y == 2 and ("sure", "number") in found and _NUM_LINE.fullmatch(plain)):
            continue
        if not blank or own:
            paras[-1].append((ln, y))
            kept_marks += own
        elif paras[-1]:
            paras.append([])
    if not any(paras) and labels:  # nothing but running lines: no damage by them
        kept_marks, paras = marks, [[(ln, 0) for ln in text.split("\n")]]
    out = ""
    for para in filter(None, paras):
        for k, (ln, y) in enumerate(para):
            ln = ln.strip("\r")
            own_line = k and y in (3, 4)
            gap = "" if not out else "\n" if _goes_on(out, ln, found) else "\x01\x01" if not k else "\x01" if own_line else "\n"
            out += gap + ln
    out = _words(out, found)
    out = re.sub(r"[ \t\r]*\n[ \t]*", " ", out).replace("\x01", "\n")
    rest = iter(kept_marks)
    return re.sub(_MARK, lambda m: next(rest), out)


def _goes_on(before: str, line: str, found: Found) -> bool:
    """Does the line begin with the rest of a confirmed broken word?"""
    a = _HEAD_PART.search(before[-2 * MAX_WORD :].replace(_MARK, " "))
    b = _TAIL_PART.match(line.replace(_MARK, " ")) if a else None
    return b is not None and ("good", (a[1] + b[1]).lower()) in found


def _words(text: str, found: Found) -> str:
    """The confirmed words joined, read and replaced, in the order in which the evidence was gathered."""
    kinds = {k for k, _ in found}

    def spaced(m: re.Match) -> str:
        w = m[0].replace(" ", "")
        low = w.lower()
        for part, whole in ((low, w), (low[1:], f"{w[0]} {w[1:]}"), (low[:-1], f"{w[:-1]} {w[-1]}")):
            if ("good", part) in found:
                return whole
        return m[0]

    def letters(m: re.Match) -> str:
        forms = [f for f in Gatherer.digits(m[0].lower()) if ("good", f) in found]
        return _case(m[0], min(forms, key=lambda f: (-found["good", f][0], f))) if forms else m[0]

    if "-" in text or "¬" in text:
        text = _edit(_BREAK, lambda m: m[1] + m[2] if "¬" in m[0] or ("good", (m[1] + m[2]).lower()) in found else m[0], text)
    if "good" in kinds:
        for pattern, fn in ((_SPACED, spaced), (_DIGIT_WORD, letters), (_SIGN_WORD, letters)):
            text = _edit(pattern, fn, text)
    if "parts" in kinds:
        end = -1

        def join(m: re.Match) -> str:
            nonlocal end
            if m.start() == end or ("parts", f"{m[1]} {m[3]}".lower()) not in found:
                return m[0]
            end = m.end()
            return m[1]

        text = _edit(_NEXT, join, text)
    if "bad" in kinds:
        text = _edit(_WORD, lambda m: _case(m[0], found["bad", m[0].lower()][1]) if ("bad", m[0].lower()) in found else m[0], text)
    return text


def repair_values(df: DataFrame, confirmed: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """(key, field, clean) of every value with confirmed damage: all that was confirmed is applied, paragraphs put together."""
    cols = ("kind", "item", "fix", "n")
    found = confirmed.groupBy(key, "field").agg(F.collect_set(F.struct(*cols)).alias("_f"))
    found = found.select(key, "field", *[F.col(f"_f.{c}").alias(c) for c in cols])
    values = melt_fields(df.select(key, *fields).dropDuplicates([key]), key, fields)
    types = dict(df.dtypes)

    def run(it):
        model = default_model()
        for pdf in it:
            got = [{(k, i): (0 if n is None or n != n else int(n), fix) for k, i, fix, n in zip(*row)} for row in zip(*[pdf[c] for c in cols])]
            pdf["clean"] = repair_many(pdf["value"].tolist(), got, model)
            yield pdf[[key, "field", "clean"]]

    return values.join(found, [key, "field"]).mapInPandas(run, f"{key} {types[key]}, field string, clean string")


def _case(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new
