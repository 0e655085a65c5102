import random

import numpy as np
import pytest

from pagespark.llm import shape


def docs():
    rng = random.Random(1)
    w = "steel mould casting riser frame hollow metal corner heated liquid narrow crystal bearing shaft piston valve".split()
    sent = lambda: (" ".join(rng.choice(w) for _ in range(rng.randrange(6, 12)))).capitalize() + "."
    out = []
    for i in range(12):
        out.append((f"prose{i}", "prose", " ".join(sent() for _ in range(8))))
        out.append((f"list{i}", "list", "\n".join(f"{k}) {rng.choice(w).capitalize()} {rng.choice(w)}, {k + 3};" for k in range(1, 15))))
        out.append((f"toc{i}", "list", "\n".join(f"1.{k} {rng.choice(w).capitalize()} {rng.choice(w)} {'.' * 15} {k * 2}" for k in range(1, 15))))
        out.append((f"table{i}", "table", "\n".join(";".join(str(rng.randrange(900)) for _ in range(6)) for _ in range(12))))
        out.append((f"soup{i}", "junk", "".join(rng.choice("&*_^\\{-@[<!}=|~'/>#§ ") for _ in range(400))))
        out.append((f"gib{i}", "junk", "\n".join(" ".join("".join(rng.choice("bcdfghjklmnpqrst") for _ in range(7)) for _ in range(9)) for _ in range(5))))
    out.append(("mixed", "prose", " ".join(sent() for _ in range(10)) + "\n• steel\n• mould\n" + " ".join(sent() for _ in range(10))))
    return out


def test_shapes(spark):
    rows = docs()
    df = spark.createDataFrame([(k, t, 1) for k, _, t in rows], "doc_id string, text string, shape int")
    got = {r.doc_id: r for r in shape.quality(df.select("doc_id", "text"), shape.common_words(df)).collect()}
    wrong = [k for k, kind, _ in rows if got[k].shape != kind]
    assert not wrong
    assert abs(sum(got["mixed"][f"{k}_share"] for k in shape.KINDS) - 1) < 1e-9


def test_long_word_lists_are_joined(spark):
    df = spark.createDataFrame([(k, t, 1) for k, _, t in docs()] + [("none", None, 1), ("twice", "Steel mould.", 1), ("twice", "Steel mould.", 1)], "doc_id string, text string, word int")
    common = shape.common_words(df)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(shape.quality(df, common, sent=3)) == key(shape.quality(df, common))
    assert shape.common_words(df, rate=0.5).count() < common.count()


def test_statistics(spark):
    df = spark.createDataFrame([(1, "Steel is hot.\nMould 12"), (2, None), (3, "   \n "), (4, "x " * 60_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in shape.quality(df, spark.createDataFrame([("steel",)], "word string")).collect()}
    a = got[1]
    assert (a.n_lines, a.n_words) == (2, 4) and a.mean_word_length == pytest.approx(15 / 4) and a.end_punct_share == 0.5 and a.common_word_share == 0.5
    assert got[2].shape == got[3].shape == "junk" and got[2].symbol_ratio is None and got[2].n_lines == 0
    assert got[4].n_lines == 1
    assert shape.quality(df.limit(0), shape.common_words(df.limit(0))).count() == 0


def test_model_is_a_distribution():
    m = shape.default_model()
    at = 0
    for n in shape.SIZES:
        assert np.allclose(np.exp(m.emit[:, at : at + n]).sum(1), 1)
        at += n
