"""Problem 7: missing or wrong language labels, and passages in another language.

Method: multinomial naive Bayes over hashed character n-grams.  The log-probability
matrix (languages x buckets, a fixed size) travels with the tasks; texts are scored
in numpy by looking up each word's summed n-gram scores, adding them up per piece
(sentence, line, bracket or quotation) and decoding the pieces with a penalty for
changing the language.  Runs of pieces in one language are passages; the language
with most words is the main one; the confidence of a passage or item is its
tempered posterior.

The matrix is fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of
their key, whose label names one of the languages.  Labels may be wrong: after the
first fit the sample is relabelled by its own scores and fitted again.

Defined results: NULL, blank or wordless texts have no language and confidence 0;
ties go to the first language in ``LANGS``; texts are scored whole; an empty sample
gives a matrix without preference, hence the first language with confidence 0.2.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut_lineage
from .crf import LinearChain

LANGS = ("ru", "en", "de", "uk", "fr")
#: Most labelled documents used for fitting.
SAMPLE = 2_000
#: Buckets of the n-gram hash.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Words a passage needs.
PASSAGE = 8
#: Cost of changing the language between two pieces, in nats per n-gram order.
SWITCH = 7.0

# Ways to name the five languages, lower case.
NAMES = {
    "ru": "ru rus russian русский russisch russe російська",
    "en": "en eng english английский englisch anglais англійська",
    "de": "de deu ger german deutsch немецкий allemand німецька",
    "uk": "uk ukr ukrainian українська украинский ukrainisch ukrainien",
    "fr": "fr fra fre french français francais французский französisch французька",
}
_NAME = {n: code for code, names in NAMES.items() for n in names.split()}

_WORD = re.compile(r"[^\W\d_]+")
#: Code, tags, commands, entities, link targets and formulas have no language.
_MARKUP = re.compile(r"```.*?(?:```|\Z)|<[^<>\n]*>|\\\([^\n]*?\\\)|\\[A-Za-z]+(?:\{(?:itemize|enumerate|center)\})?|&#?\w+;|\{\{[^{}\n]*\}\}|\]\([^()\n]*\)|\$\$?[^$\n]*\$\$?", re.S)
_MAY = re.compile(r"[<\\&`$]|\{\{|\]\(")
_PIECE = re.compile(r"[^.!?;:\n()\[\]{}«»„“”\"|<>]+")


def code_of(label: str | None) -> str | None:
    """Language code that a label names, in any spelling or with a region; None if it names none of them."""
    if label is None:
        return None
    t = label.strip().lower()
    return _NAME.get(t) or _NAME.get(re.split(r"[-_ ]", t)[0] if t else "")


def grams(word: str) -> np.ndarray:
    """Bucket of every n-gram of the word with its borders marked."""
    w = f"^{word}$"
    return np.array([xxhash.xxh32_intdigest(w[i : i + n].encode()) % BUCKETS for n in ORDERS for i in range(len(w) - n + 1)], np.int64)


class Scorer:
    """Per-word language scores under the matrix, remembered by word."""

    def __init__(self, logp: np.ndarray, limit: int = 200_000):
        self.logp, self.limit = logp, limit
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGS)), np.float32)

    def index(self, words: Iterable[str]) -> list[int]:
        ids, get = self.ids, self.ids.get
        out = []
        for w in words:
            i = get(w)
            if i is None:
                i = ids[w] = len(ids)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[i] = self.logp[:, grams(w)].sum(1) / len(ORDERS)
            out.append(i)
        return out

    def trim(self) -> None:
        if len(self.ids) > self.limit:
            self.ids.clear()


_CHAIN = LinearChain(len(LANGS), len(LANGS))
_CHAIN.emit = np.eye(len(LANGS))
_CHAIN.trans = -SWITCH * (1 - np.eye(len(LANGS)))


_S, _W = [f"s{k}" for k in range(len(LANGS))], [f"w{k}" for k in range(len(LANGS))]


def runs(texts: list[str], scorer: Scorer) -> pd.DataFrame:
    """(text, passage, start, end, lab, words, s0...): every passage in order, with its offsets in code points and scores.

    ``text`` is the position in ``texts``; texts without words have no rows.
    """
    flat: list[int] = []
    pieces: list[tuple[int, int, int, int]] = []
    for t, text in enumerate(texts):
        if _MAY.search(text):
            text = _MARKUP.sub(lambda m: " " * len(m[0]), text)
        for m in _PIECE.finditer(text):
            ws = _WORD.findall(m[0].lower())
            if ws:
                flat += scorer.index(ws)
                pieces.append((t, m.end() - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), len(ws)))
    if not flat:
        return pd.DataFrame({c: pd.Series(dtype=float if c in _S else "int64") for c in ("text", "passage", "start", "end", "lab", "words", *_S)})
    own, start, end, size = np.array(pieces, np.int64).T
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    score = np.add.reduceat(scorer.rows[np.array(flat)].astype(np.float64), at, axis=0)
    score -= score.max(1, keepdims=True)
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), [len(own)]])
    lab = _CHAIN.decode_many(score, bounds)
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (lab[1:] != lab[:-1])])
    out = pd.DataFrame({"text": own[new], "start": start[new], "end": end[np.concatenate([new[1:], [True]])], "lab": lab[new]})
    out.insert(1, "passage", out.groupby("text").cumcount() + 1)
    first = np.flatnonzero(new)
    out["words"] = np.add.reduceat(size, first)
    out[_S] = np.add.reduceat(score, first, axis=0)
    return out


def passages(texts: list[str], scorer: Scorer) -> pd.DataFrame:
    """(text, lang, words, longest, confidence): per text and language, its words and its longest passage."""
    g = runs(texts, scorer).groupby(["text", "lab"], sort=True).agg(words=("words", "sum"), longest=("words", "max"), **{c: (c, "sum") for c in _S}).reset_index()
    if g.empty:
        return pd.DataFrame({"text": pd.Series(dtype="int64"), "lang": pd.Series(dtype=object), "words": pd.Series(dtype="int64"), "longest": pd.Series(dtype="int64"), "confidence": pd.Series(dtype=float)})
    s = g[_S].to_numpy() / np.sqrt(g["words"].to_numpy())[:, None]
    e = np.exp(s - s.max(1, keepdims=True))
    g["confidence"] = (e / e.sum(1, keepdims=True))[np.arange(len(g)), g["lab"]]
    g["lang"] = [LANGS[i] for i in g["lab"]]
    return g[["text", "lang", "words", "longest", "confidence"]].astype({"words": "int64", "longest": "int64"})


def _train_counts(texts: Iterable[str], labels: Iterable[str]) -> pd.DataFrame:
    """(lang, bucket, n) of one batch."""
    words: dict[str, Counter] = {}
    for t, lab in zip(texts, labels):
        if t and lab:
            words.setdefault(lab, Counter()).update(_WORD.findall(t.lower()))
    rows = []
    for lab, c in words.items():
        acc = np.zeros(BUCKETS)
        for w, n in c.items():
            np.add.at(acc, grams(w), n)
        hit = np.flatnonzero(acc)
        rows.append(pd.DataFrame({"lang": lab, "bucket": hit, "n": acc[hit]}))
    return pd.concat(rows) if rows else pd.DataFrame({"lang": [], "bucket": [], "n": []})


def matrix(counts: pd.DataFrame) -> np.ndarray:
    """Smoothed log-probabilities, languages x buckets."""
    m = np.full((len(LANGS), BUCKETS), 0.1)
    for lang, bucket, n in zip(counts["lang"], counts["bucket"], counts["n"]):
        m[LANGS.index(lang), int(bucket)] += n
    return np.log(m / m.sum(1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, rounds: int = 2) -> np.ndarray:
    """The matrix, fitted on a bounded sample of labelled rows; at most languages x buckets counts reach the driver."""
    names = F.create_map(*[F.lit(x) for kv in _NAME.items() for x in kv])
    base = F.split(F.lower(F.trim(F.col(label))), "[-_ ]")[0]
    coded = docs.withColumn("_code", F.coalesce(names[F.lower(F.trim(F.col(label)))], names[base])).where(F.col("_code").isNotNull() & F.col(text).isNotNull())
    rows = cut_lineage(bounded_sample(coded.select(key, "_code", text), key, sample).select("_code", text))  # every round reads it
    logp: np.ndarray | None = None
    for _ in range(rounds):
        current = logp

        def count(it):
            scorer = Scorer(current) if current is not None else None
            for pdf in it:
                labels = pdf["_code"].tolist()
                if scorer is not None:
                    labels = main_languages(pdf[text].tolist(), scorer)
                yield _train_counts(pdf[text], labels)

        got = rows.mapInPandas(count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        logp = matrix(got)
    return logp


def main_languages(texts: list[str], scorer: Scorer) -> list[str | None]:
    out: list[str | None] = [None] * len(texts)
    p = passages([t or "" for t in texts], scorer)
    if len(p):
        best = p.sort_values(["text", "words"], ascending=[True, False], kind="stable").drop_duplicates("text")
        for t, lang in zip(best["text"], best["lang"]):
            out[t] = lang
    return out


def language_rows(df: DataFrame, logp: np.ndarray, key: str, text: str = "text", extra: tuple[str, ...] = (), chunk_chars: int = 500_000) -> DataFrame:
    """(key, extra..., lang, words, longest, confidence): one row per item and language found in it."""
    types = dict(df.dtypes)

    def run(it):
        scorer = Scorer(logp)
        for pdf in it:
            texts = [t or "" for t in pdf[text]]
            a = 0
            while a < len(texts):
                b, n = a, 0
                while b < len(texts) and (n == 0 or n + len(texts[b]) <= chunk_chars):
                    n += len(texts[b]) + 1
                    b += 1
                p = passages(texts[a:b], scorer)
                head = pdf[[key, *extra]].iloc[a:b].reset_index(drop=True)
                res = head.iloc[p["text"].to_numpy()].reset_index(drop=True)
                for c in ("lang", "words", "longest", "confidence"):
                    res[c] = p[c].to_numpy()
                yield res
                scorer.trim()
                a = b

    head = ", ".join(f"{c} {types[c]}" for c in (key, *extra))
    return df.select(key, *extra, text).mapInPandas(run, f"{head}, lang string, words long, longest long, confidence double")


def passage_rows(df: DataFrame, logp: np.ndarray, key: str, fields: tuple[str, ...], extra: tuple[str, ...] = (), chunk_chars: int = 500_000) -> DataFrame:
    """(key, extra..., field, first, passage, start, end, w0..., s0...): one row per passage, and one without a passage number per value.

    Words and scores are kept per language, so that rows can be added up; ``verdict`` turns them into language and
    confidence.  ``first`` marks the item's first field that is not NULL.
    """
    types = dict(df.dtypes)
    names = [key, *extra, "field", "first", "passage", "start", "end", *_W, *_S]

    def run(it):
        scorer = Scorer(logp)
        for pdf in it:
            at: dict[str, int] = {}
            cells = []
            for i, row in enumerate(zip(*[pdf[f] for f in fields])):
                first = next((f for f, v in zip(fields, row) if v is not None), None)
                cells += [(i, f, f == first, at.setdefault(v or "", len(at))) for f, v in zip(fields, row)]
            texts, a = list(at), 0
            head = pd.DataFrame(cells, columns=["_i", "field", "first", "text"])
            while a < len(texts):
                b, n = a, 0
                while b < len(texts) and (n == 0 or n + len(texts[b]) <= chunk_chars):
                    n += len(texts[b]) + 1
                    b += 1
                r = runs(texts[a:b], scorer)
                r["text"] += a
                for k, c in enumerate(_W):
                    r[c] = np.where(r["lab"] == k, r["words"], 0).astype("int64")
                whole = pd.DataFrame({"text": range(a, b)}).merge(r.groupby("text")[_W + _S].sum().reset_index(), on="text", how="left").fillna(0)
                rows = head.merge(pd.concat([r, whole]), on="text")
                out = pd.concat([pdf[[key, *extra]].iloc[rows["_i"]].reset_index(drop=True), rows], axis=1)[names]
                yield out.astype({c: "Int64" for c in ("passage", "start", "end")} | dict.fromkeys(_W, "int64"))
                scorer.trim()
                a = b

    head = ", ".join(f"{c} {types[c]}" for c in (key, *extra))
    numbers = ", ".join([f"{c} long" for c in ("passage", "start", "end", *_W)] + [f"{c} double" for c in _S])
    return df.select(key, *extra, *fields).mapInPandas(run, f"{head}, field string, first boolean, {numbers}")


def pooled(rows: DataFrame, key: str) -> DataFrame:
    """(key, w0..., s0...): the rows of each key added up."""
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in (*_W, *_S)])


def verdict() -> list:
    """(lang, words, confidence) of rows with words and scores: the language with most words and its tempered posterior."""
    w, s = F.array(*_W), F.array(*_S)
    words = sum((F.col(c) for c in _W[1:]), F.col(_W[0]))
    at = F.array_position(w, F.array_max(w)).cast("int")
    own = F.element_at(s, at)
    odds = F.aggregate(F.transform(s, lambda x: F.exp(F.least((x - own) / F.sqrt(words), F.lit(700.0)))), F.lit(0.0), lambda acc, x: acc + x)
    spoken = words > 0
    return [F.when(spoken, F.element_at(F.array(*[F.lit(x) for x in LANGS]), at)).alias("lang"), F.coalesce(words, F.lit(0)).alias("words"), F.coalesce(F.when(spoken, 1 / odds), F.lit(0.0)).alias("confidence")]


def main_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, main): the language with most words of each key; ties go to the first in ``LANGS``."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang"))
    total = rows.groupBy(key, "lang").agg(F.sum("words").alias("words"))
    return total.groupBy(key).agg(F.max_by("lang", F.struct("words", -rank)).alias("main"))


def label_code(col: str):
    """Column form of ``code_of``."""
    names = F.create_map(*[F.lit(x) for kv in _NAME.items() for x in kv])
    low = F.lower(F.trim(F.col(col)))
    return F.coalesce(names[low], names[F.split(low, "[-_ ]")[0]])


def wrong_labels(items: DataFrame, main: DataFrame, key: str, label: str = "lang") -> DataFrame:
    """(key, lang): items whose label is missing, names no language or not the main one."""
    return items.select(key, label_code(label).alias("_code")).join(main, key).where(~F.col("_code").eqNullSafe(F.col("main"))).select(key, F.col("main").alias("lang"))


def foreign_passages(rows: DataFrame, main: DataFrame, key: str, words: int = PASSAGE) -> DataFrame:
    """Rows whose language is not the main one and whose longest passage has at least ``words`` words."""
    return rows.where(F.col("longest") >= words).join(main, key).where(F.col("lang") != F.col("main")).drop("main")
