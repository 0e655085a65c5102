"""Problem 4: repetition inside a single document.

Method: line sequence labelling.  A value is cut into short lines (clauses, and
pieces of an unbroken run); a linear-chain conditional random field marks each
line as content or as repeated text by Viterbi decoding; the share of letters in
repeated lines is the share of repeated content, which decides.  Features are
counted over all earlier text of the same value at three scales: the share of a
line that lies in a window of 5 (parts of words), 12 (words and phrases) and 24
characters (clauses and sentences) that the value has shown before, and its length.
A phrase that a technical text happens to use twice shows in the short windows only,
between lines of content; a loop shows in all of them, line after line.  The
field is fitted on seeded made-up sequences with known loops, so it is the same
for every input.

``exact_share`` is given beside it, measured without the model: the share of
characters inside a window of 12 that the value has shown before.

Text is compared without digits, letter case and spacing.  Defined results: NULL
gives no row; an empty value, or one shorter than two windows, has share 0; texts
of any length are measured whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import melt_fields
from .crf import LinearChain

#: Characters that must recur in a row for a window to count as said before.
WINDOW = 12
#: Longest line: longer ones are labelled in pieces of this many characters, so that a loop may begin anywhere.
PIECE = 16
#: Windows of the finer and the coarser scale, and number of features of a line.
SHORT, LONG, FEATURES = 5, 24, 5
_DROP = re.compile(r"[\d\s]+")
#: A line ends after its sentence or line mark; runs without marks are cut by length.
_CUT = re.compile(rf"[^\n.!?;,]{{0,{PIECE}}}(?:[\n.!?;,]+|(?=.))", re.S)
_JSON_N = re.compile(r"\\n")


def normal(text: str) -> str:
    return _DROP.sub("", _JSON_N.sub("\n", text).lower())


def _cuts(text: str) -> list[tuple[str, int]]:
    """Lines of the text, each in compared form with its length as it stands; lines without a compared character vanish."""
    parts = ((_DROP.sub("", m), len(m)) for m in _CUT.findall(_JSON_N.sub("\n", text).lower()))
    return [p for p in parts if p[0]]


def seen_windows(codes: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For every position: does the window that begins there occur earlier in the same owner?"""
    n = len(codes) - window + 1
    out = np.zeros(len(codes), bool)
    if n <= 0:
        return out
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9) + owner[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    inside = owner[:n] == owner[window - 1 : window - 1 + n]
    order = np.argsort(h, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = h[order][1:] == h[order][:-1]
    out[order[same]] = True
    out[:n] &= inside
    return out


def covered(seen: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions inside any window that was seen before."""
    step = np.zeros(len(seen) + window, np.int32)
    at = np.flatnonzero(seen)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step)[: len(seen)] > 0


def _layout(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all lines end to end, their text and line number, each text's first line, each line's full length."""
    lines = [_cuts(t) for t in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    flat = [p for x in lines for p, _ in x]
    raw = np.array([n for x in lines for _, n in x], float)
    lens = np.array([len(p) for p in flat], np.int64)
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.repeat(np.arange(len(flat)), lens)
    owner = np.repeat(np.repeat(np.arange(len(texts)), counts), lens)
    return codes, owner, line, np.concatenate([[0], np.cumsum(counts)]), raw


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(matrix of line features, bounds of the texts, line lengths, exact share of each text)."""
    codes, owner, line, bounds, raw = _layout(texts)
    n_lines = int(bounds[-1])
    if not len(codes):
        return np.zeros((0, FEATURES)), bounds, np.zeros(0, np.int64), np.zeros(len(texts))
    cov = covered(seen_windows(codes, owner)).astype(float)
    size = np.bincount(line, minlength=n_lines)
    scale = lambda flags: np.bincount(line, flags, n_lines) / size
    share = scale(cov)
    x = np.column_stack([np.ones(n_lines), share, *[scale(covered(seen_windows(codes, owner, w), w)) for w in (SHORT, LONG)], np.log1p(size)])
    total = np.bincount(owner, minlength=len(texts))
    exact = np.bincount(owner, cov, len(texts)) / np.maximum(total, 1)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    standing = np.bincount(text_of, share * raw, len(texts)) / np.maximum(np.bincount(text_of, raw, len(texts)), 1)
    exact = np.maximum(exact, standing)
    return x, bounds, size, exact


def _sample(rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """A made-up value and the character ranges that repeat."""
    vocab = ["".join(rng.choice(list("abcdefghijklmnoprstuvwz"), rng.integers(2, 10))) for _ in range(60)]

    def sentence(k: int) -> str:
        return " ".join(rng.choice(vocab, k)) + ". "

    text = "".join(sentence(int(rng.integers(4, 12))) for _ in range(rng.integers(1, 8)))
    spans: list[tuple[int, int]] = []
    if rng.random() < 0.6:
        unit = "".join(sentence(int(rng.integers(1, 9))) for _ in range(rng.integers(1, 4)))
        text += unit
        for _ in range(rng.integers(1, 8)):
            spans.append((len(text), len(text) + len(unit)))
            text += unit
    text += "".join(sentence(int(rng.integers(4, 12))) for _ in range(rng.integers(0, 3)))
    return text, spans


@lru_cache
def default_model(n: int = 120, seed: int = 7) -> LinearChain:
    """The field fitted on ``n`` seeded sequences with known loops."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(n):
        text, spans = _sample(rng)
        x, _, size, _ = features([text])
        flags = np.zeros(len(text), bool)
        for a, b in spans:
            flags[a:b] = True
        y = []
        for m in _CUT.finditer(text):
            if m[0] and _DROP.sub("", m[0]):
                y.append(int(flags[m.start() : m.end()].mean() > 0.5))
        if len(y) == len(x) and len(y):
            data.append((x, np.array(y)))
    return LinearChain(2, FEATURES).fit(data)


def shares(texts: list[str], model: LinearChain | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(share of letters in lines labelled repeated, exact share) of every text."""
    model = model or default_model()
    x, bounds, size, exact = features(texts)
    lab = model.decode_many(x, bounds)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    total = np.bincount(owner, size, len(texts))
    return np.bincount(owner, size * lab, len(texts)) / np.maximum(total, 1), exact


def measure(df: DataFrame, fields: tuple[str, ...] = ("text_b", "arbiter_text", "arbiter_raw"), key: str = "id", chunk_chars: int = 400_000) -> DataFrame:
    """(key, field, labelled_share, exact_share) of every value."""
    model = default_model()

    def run(it):
        for pdf in it:
            texts = pdf["value"].tolist()
            lab, exact = np.zeros(len(texts)), np.zeros(len(texts))
            a = 0
            while a < len(texts):
                b, n = a, 0
                while b < len(texts) and (n == 0 or n + len(texts[b]) <= chunk_chars):
                    n += len(texts[b]) + 1
                    b += 1
                lab[a:b], exact[a:b] = shares(texts[a:b], model)
                a = b
            yield pd.DataFrame({key: pdf[key], "field": pdf["field"], "labelled_share": lab, "exact_share": exact})

    kind = dict(df.dtypes)[key]
    return melt_fields(df.select(key, *fields), key, fields).mapInPandas(run, f"{key} {kind}, field string, labelled_share double, exact_share double")
