"""Problem 10: per-document text quality statistics.

Method: every line of a document gets statistics (letters, digits, symbols, cells,
leaders, list marks, end punctuation, share of common words); a hidden Markov
model over the lines labels each as prose, list, table or junk by Viterbi
decoding; label shares by characters and the plain statistics are the document's
quality row.  The emission tables are fitted by counting on seeded made-up lines
of the four kinds and the transitions favour staying in a kind, so the model is
the same for every input; the common words come from all documents.

Defined results: a NULL or blank document has zero counts, NULL ratios and the
shape ``junk``; ties of shares go to the first of prose, list, table, junk; long
documents are labelled whole; the common-word list may be empty.
"""

from __future__ import annotations

import math
import re
import textwrap
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .crf import LinearChain

#: A list of this many common words is sent to all tasks; a longer one is joined.
SENT = 300_000
KINDS = ("prose", "list", "table", "junk")
_WORD = re.compile(r"[^\W\d_]{2,}")
_MARK = re.compile(r"\s*(?:[•·*–—\-+§]|\(?\d{1,3}(?:\.\d{1,3})*[.)]|\d{1,3}(?:\.\d{1,3})+(?=\s+[^\W\d])|\(?[a-zа-я][.)])\s+(?=\S)", re.I)
_LEADER = re.compile(r"(?:\.{3,}|(?: \.){3,}|…{2,}|_{3,})\s*\d*\s*$")
_TAIL_NUM = re.compile(r"[\s,;]\(?[\dIVXLC]{1,5}(?:[–-]\d+)?\)?[.;,]?\s*$")
_NUMBER = re.compile(r"(?<!\w)[-+−]?\d+(?:[.,]\d+)*%?(?!\w)")
_DIGIT = re.compile(r"\d")
_CELL = re.compile(r"\t| {2,}|\s*[;|]\s*(?=\S)|(?<=[^\d\s]),(?=\S)|,(?=[^\W\d])")
#: A two-byte character read as two single ones: a lead byte followed by a continuation byte or its stand-in.
_BYTE_PAIR = re.compile("[\u00c2-\u00df\u00e0-\u00ef][\u0080-\u00bf]")
#: A sentence that ends inside the line, or a clause mark.
_INNER = re.compile(r"[.!?] +[^\W\d_]|[^\W\d_], [^\W\d_]")
_CELL_HINT = re.compile(r"[\t;|,]|  ")
#: Words shorter than this say nothing about whether a line's words are known.
KNOWN_LETTERS = 4
#: Columns of ``line_stats``.
STATS = ("letters", "digits", "known", "long_words", "words", "numbers", "cells", "tokens", "mark", "leader", "tail", "chars", "pairs", "spaces", "ends", "lower", "inner")


def line_stats(line: str, common: frozenset[str] | None) -> tuple[float, ...]:
    """Counts of one line that is not blank, in the order of ``STATS``; without a word list every word is known."""
    words = _WORD.findall(line)
    long_words = [w for w in words if len(w) >= KNOWN_LETTERS]
    known = len(long_words) if common is None else sum(w in common or w.lower() in common for w in long_words)
    tokens = line.split()
    digits = len(_DIGIT.findall(line))
    tail = line[-16:]
    return (
        sum(map(len, words)), digits, known, len(long_words), len(words), len(_NUMBER.findall(line)) if digits else 0,
        len(_CELL.findall(line.strip())) if _CELL_HINT.search(line) else 0, len(tokens), _MARK.match(line) is not None,
        ("..." in line or ". ." in line or "…" in line or "___" in line) and _LEADER.search(line) is not None, _TAIL_NUM.search(tail) is not None,
        len(line), 0 if line.isascii() else len(_BYTE_PAIR.findall(line)), line.count(" "), tokens[-1][-1] in _END if tokens else False,
        tokens[0][0].islower() if tokens else False, _INNER.search(line) is not None,
    )


_END = frozenset(".!?:;…»\"')")


def bins(m: np.ndarray) -> np.ndarray:
    """The statistics of many lines as small category numbers, one column per emission table."""
    c = {k: m[:, i] for i, k in enumerate(STATS)}
    n = np.maximum(c["chars"], 1)
    rate = lambda x, cuts: np.digitize(x, cuts)
    known = np.where(c["long_words"] == 0, 0, 1 + rate(c["known"] / np.maximum(c["long_words"], 1), [0.34, 0.67]))
    return np.column_stack(
        [
            rate(c["letters"] / n, [0.3, 0.55]), rate(c["digits"] / n, [0.05, 0.3]), known, rate(c["words"], [2, 6]),
            rate(c["numbers"] / (c["tokens"] + 1), [0.15, 0.4]), rate(c["cells"], [2, 4]), rate(c["cells"] / (c["tokens"] + 1), [0.34]),
            c["mark"] + 2 * c["leader"], c["tail"], rate(c["pairs"] / n, [0.1]), rate(c["spaces"] / n, [0.03, 0.35]), rate(n, [48, 100]),
            rate(c["chars"] / np.maximum(c["tokens"], 1), [3.4, 14]),
            c["lower"], c["inner"], c["ends"], rate((n - c["letters"] - c["digits"] - c["spaces"]) / n, [0.15, 0.6]),
        ]
    ).astype(np.int64)


#: Number of categories of each emission table.
SIZES = (3, 3, 4, 3, 3, 3, 2, 4, 2, 2, 3, 3, 3, 2, 2, 2, 3)


def _made_up(rng: np.random.Generator) -> list[tuple[str, list[str]]]:
    """Seeded documents of one kind each; every word of two letters or more is 'common' except in junk."""
    def word() -> str:
        return "w" + "".join(rng.choice(list("aeiounrtsl"), rng.integers(2, 9)))

    def num() -> str:
        return str(rng.integers(1, 999)) + ("," + str(rng.integers(0, 99)) if rng.random() < 0.5 else "")

    def misread() -> str:
        """A Cyrillic sentence whose bytes were taken for single characters."""
        text = " ".join("".join(rng.choice(list("абвгдеиклмнопрст"), rng.integers(2, 10))) for _ in range(rng.integers(6, 12))) + ", 17 " + str(rng.choice([".", ""]))
        return re.sub("[\x80-\x9f]", "·", text.encode().decode("latin-1"))

    out = []
    for _ in range(60):
        text = " ".join((" ".join(word() for _ in range(rng.integers(5, 14))).capitalize() + str(rng.choice([".", ", " + word() + ".", " 17.", f" {num()} kg {word()} {num()} mm, {word()} — {num()}."]))) for _ in range(rng.integers(3, 14)))
        out.append(("prose", [text] if rng.random() < 0.3 else textwrap.wrap(text, int(rng.integers(45, 80)))))
        style = rng.integers(0, 5)
        long = 9 if style < 4 else 5
        rows = []
        for i in range(int(rng.integers(4, 30))):
            item = " ".join(word() for _ in range(rng.integers(1, long)))
            item = item.capitalize() if rng.random() < 0.8 else item
            rows.append([f"{i}. {item}", f"• {item}", f"1.{i} {item} {'.' * int(rng.integers(4, 20))} {i}", f"{item}, {i}, {i + 3}", f"{item}"][style])
        out.append(("list", rows))
        sep = str(rng.choice([";", "    ", "\t", " | ", "  "]))
        width = int(rng.choice([3, 3, 4, 4, 5, 6, 7]))
        out.append(("table", [sep.join([word() + " " + word()] * width)] + [sep.join([f"{word()} {word()}" if rng.random() < 0.6 else num()] + [num() if rng.random() < 0.93 else "—" for _ in range(width - 1)]) for _ in range(rng.integers(3, 20))]))
        soup = list("&*_^\\{-@[;<!}.=|<~'/>#§°¦") + list("abIl1")
        kind = rng.integers(0, 6)
        alnum = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
        rows = [["".join(rng.choice(soup + [" ", ";", "|", ":", ","] * int(rng.integers(0, 3)), 70)), "".join(rng.choice(alnum, 72)), " ".join(rng.choice(list("abcdefg12345:;.,"), 40)), misread(), " ".join("".join(rng.choice(list("0123456789abcdef"), 2)) for _ in range(16)), " ".join("".join(rng.choice(list("bcdfghjklmnp"), rng.integers(2, 11))) for _ in range(10))][kind] for _ in range(rng.integers(2, 14))]
        out.append(("junk", rows))
    return out


@lru_cache
def default_model(seed: int = 11, stay: float = 3.0) -> LinearChain:
    """Hidden Markov model: emission log-probabilities by counting, transitions that favour staying."""
    docs = _made_up(np.random.default_rng(seed))
    model = LinearChain(len(KINDS), sum(SIZES))
    counts = np.full((len(KINDS), sum(SIZES)), 0.2)
    offs = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
    for kind, rows in docs:
        words = frozenset() if kind == "junk" and not any(_BYTE_PAIR.search(r) for r in rows) else None
        for b in bins(np.array([line_stats(r, words) for r in rows], float)):
            counts[KINDS.index(kind), offs + b] += 1
    for o, n in zip(offs, SIZES):
        part = counts[:, o : o + n]
        model.emit[:, o : o + n] = np.log(part / part.sum(1, keepdims=True))
    model.trans = np.eye(len(KINDS)) * stay
    return model


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n_docs): in how many documents each lower-case word stands; counted per batch before the shuffle."""

    def run(it):
        for pdf in it:
            c: Counter[str] = Counter()
            for t in pdf[text]:
                if t:
                    c.update({w for w in _WORD.findall(t.lower())})
            yield pd.DataFrame({"word": list(c.keys()), "n": list(c.values())})

    return docs.select(text).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n_docs"))


def common_words(docs: DataFrame, text: str = "text", min_docs: int = 3, rate: float = 1e-5) -> DataFrame:
    """The words that stand in at least ``min_docs`` documents and in ``rate`` of all, however many these are."""
    least = max(min_docs, math.ceil(rate * docs.count()))
    return cut_lineage(word_counts(docs, text).where(F.col("n_docs") >= least).select("word"))


def known_words(docs: DataFrame, common: DataFrame, key: str, text: str) -> DataFrame:
    """(key, known): the common ones among the words of each document, by a join with the whole table."""
    kind = dict(docs.dtypes)[key]

    def run(it):
        for pdf in it:
            rows = [(k, w) for k, t in zip(pdf[key], pdf[text]) if t for w in set(_WORD.findall(t.lower())) if len(w) >= KNOWN_LETTERS]
            yield pd.DataFrame(rows, columns=[key, "word"])

    words = docs.select(key, text).mapInPandas(run, f"{key} {kind}, word string")
    return words.join(common, "word").groupBy(key).agg(F.collect_set("word").alias("known"))


def label(texts: list[str], common: frozenset[str], model: LinearChain | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line statistics, line labels, first line of each text) of the lines that are not blank."""
    model = model or default_model()
    lines = [[ln for ln in (t or "").splitlines() if not ln.isspace() and ln] for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    stats = np.array([line_stats(ln, common) for x in lines for ln in x], float).reshape(-1, len(STATS))
    x = np.zeros((len(stats), sum(SIZES)))
    offs = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
    x[np.arange(len(stats))[:, None], bins(stats) + offs] = 1.0
    return stats, model.decode_many(x, bounds), bounds


SCHEMA = "n_lines long, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, end_punct_share double, common_word_share double, prose_share double, list_share double, table_share double, junk_share double, shape string"


def summarise(stats: np.ndarray, lab: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    """One row of document statistics per text."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    total = {k: np.bincount(owner, stats[:, i], n) for i, k in enumerate(STATS)}
    lines = np.diff(bounds)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.column_stack([np.bincount(owner, stats[:, STATS.index("chars")] * (lab == k), n) / total["chars"] for k in range(len(KINDS))])
        tokens = np.where(total["long_words"] > 0, total["known"] / total["long_words"], np.where(lines > 0, 0.0, np.nan))
        cols = [
            lines, total["words"].astype(np.int64), np.where(total["words"] > 0, total["letters"] / total["words"], np.where(lines > 0, 0.0, np.nan)),
            (total["chars"] - total["letters"] - total["digits"] - total["spaces"]) / total["chars"], total["digits"] / total["chars"],
            total["ends"] / lines, tokens, *share.T,
        ]
    shape = np.array(KINDS, object)[np.where(lines > 0, np.nan_to_num(share).argmax(1), len(KINDS) - 1)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(dict(zip(names, [*cols, shape])))


def quality(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", sent: int = SENT) -> DataFrame:
    """(key, statistics..., label shares, shape) of every document.

    A list of at most ``sent`` common words is sent to all tasks; a longer one is joined with the words of the documents.
    """
    few = [r.word for r in common.limit(sent + 1).collect()]
    words = frozenset(few) if len(few) <= sent else None
    rows = docs.select(key, text) if words is not None else docs.select(key, text).join(known_words(docs, common, key, text), key, "left")
    model = default_model()

    def run(it):
        for pdf in it:
            texts = pdf[text].tolist()
            for a in range(0, len(texts), 512):
                own = words if words is not None else frozenset(w for ws in pdf["known"].iloc[a : a + 512] if ws is not None for w in ws)
                res = summarise(*label(texts[a : a + 512], own, model))
                res.insert(0, key, pdf[key].to_numpy()[a : a + 512])
                yield res.astype(object).where(res.notna(), None) if res.isna().any().any() else res

    kind = dict(docs.dtypes)[key]
    return rows.mapInPandas(run, f"{key} {kind}, {SCHEMA}")
