import itertools
import random

import numpy as np

from pagespark.llm import repetition as rep
from pagespark.llm.crf import LinearChain


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    m = LinearChain(3, 2)
    m.emit, m.trans = rng.normal(size=(3, 2)), rng.normal(size=(3, 3))
    lens = [0, 4, 1, 6, 3]
    x = rng.normal(size=(sum(lens), 2))
    bounds = np.concatenate([[0], np.cumsum(lens)])
    got = m.decode_many(x, bounds)
    score = lambda y, z: sum(z[t] @ m.emit[y[t]] for t in range(len(y))) + sum(m.trans[a, b] for a, b in zip(y, y[1:]))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            best = max(itertools.product(range(3), repeat=int(b - a)), key=lambda y: score(y, x[a:b]))
            assert tuple(got[a:b]) == best


def test_gradient_raises_likelihood():
    rng = np.random.default_rng(2)
    data = []
    for _ in range(40):
        y = (np.cumsum(rng.random(12) < 0.2) % 2).astype(int)
        data.append((np.column_stack([np.ones(12), y + rng.normal(0, 0.4, 12)]), y))
    m = LinearChain(2, 2).fit(data[:20])
    right = np.mean([np.mean(m.decode(x) == y) for x, y in data[20:]])
    assert right > 0.9 and m.trans[0, 0] > m.trans[0, 1]


def brute(text, w=rep.WINDOW):
    t = "".join(p for p, _ in rep._cuts(text))
    cov = set()
    for i in range(len(t) - w + 1):
        if t[: i + w - 1].find(t[i : i + w]) not in (-1, i):
            cov.update(range(i, i + w))
    return len(cov) / max(1, len(t))


def test_covered_share_against_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        s = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 200))) + "".join(rng.choice("abcdefgh. ") for _ in range(80))
        codes, owner, line, bounds, raw = rep._layout([s, "x" + s])
        cov = rep.covered(rep.seen_windows(codes, owner))
        assert abs(np.bincount(owner, cov, 2)[0] / max(1, (owner == 0).sum()) - brute(s)) < 1e-9


LOOP = "The core is set in the mould before the metal runs. "


def test_held_out_accuracy():
    """Made-up values the model has not seen: the share of lines labelled as they were made."""
    rng = np.random.default_rng(99)
    right = total = 0
    model = rep.default_model()
    for _ in range(60):
        text, spans = rep._sample(rng)
        x, bounds, size, _ = rep.features([text])
        flags = np.zeros(len(text), bool)
        for a, b in spans:
            flags[a:b] = True
        y = [flags[m.start() : m.end()].mean() > 0.5 for m in rep._CUT.finditer(text) if m[0] and rep._DROP.sub("", m[0])]
        lab = model.decode_many(x, bounds)
        right += int((lab == np.array(y, int)).sum())
        total += len(y)
    assert right / total > 0.9


def test_operator(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000))
    rows = [(1, LOOP * 6, None, "e"), (2, "One line only about the press and its heavy hammer.", "", "e"), (3, None, "start " + "0,0," * 60, "e"), (4, "word " * 300, "1 2 3", "e"), (5, long, None, "e")]
    df = spark.createDataFrame(rows, "id long, text_b string, arbiter_text string, field string").withColumnRenamed("field", "other")
    got = {(r.id, r.field): r for r in rep.measure(df, fields=("text_b", "arbiter_text")).collect()}
    hit = {k for k, r in got.items() if r.labelled_share >= 0.5}
    assert hit == {(1, "text_b"), (3, "arbiter_text"), (4, "text_b")}
    assert got[2, "arbiter_text"].exact_share == 0 and got[5, "text_b"].exact_share < 0.1
    assert rep.measure(df.limit(0), fields=("text_b",)).count() == 0
