import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagespark.llm import packing


def brute(sizes, cap):
    """Levels chosen by trying every one and summing all squares; the fullest of the best."""
    n, out = [0] * cap, []
    for s in sizes:
        best = None
        for h in range(cap - s, -1, -1):
            if h and not n[h]:
                continue
            m = n[:]
            if h:
                m[h] -= 1
            if h + s < cap:
                m[h + s] += 1
            q = sum(v * v for v in m)
            if best is None or q < best[0]:
                best = (q, h, m)
        n = best[2]
        out.append(best[1])
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=50))))
def test_pack_against_brute_force(case):
    cap, sizes = case
    box = packing.pack(np.array(sizes, np.int64), cap)
    fill, levels = {}, []
    for s, b in zip(sizes, box.tolist()):
        levels.append(fill.get(b, 0))
        fill[b] = fill.get(b, 0) + s
    assert levels == brute(sizes, cap) and all(v <= cap for v in fill.values())


def test_fill(spark):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 900, 3000)]
    rows = [(i, s, "x") for i, s in enumerate(sizes)] + [(9000, 5000, "x"), (9001, 2048, "x"), (9002, 0, "x"), (9003, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, container string")
    got = packing.fill(df, per_stream=1000).toPandas()
    assert (got.groupby("container").length.sum() <= packing.CAPACITY).all()
    back = got.groupby("doc_id").length.sum().to_dict()
    assert back == {i: s or 0 for i, s, _ in rows}
    assert set(got[got.container.isna()].doc_id) == {9002, 9003}  # returned, but in no container
    assert set(got[got.duplicated("doc_id", keep=False)].doc_id) == {9000}
    assert got[got.doc_id == 9000].sort_values("piece_no").start.tolist() == [0, 2048, 4096]
    u = packing.usage(spark.createDataFrame(got)).first()
    assert u.unused_share < 0.03 and u.used == sum(s for _, s, _ in rows if s)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.fill(df).count() == 0


def test_tokens_round_trip():
    tokens = pytest.importorskip("pagespark.llm.tokens")
    import os

    if not os.path.exists(tokens.DEFAULT):
        pytest.skip("no vocabulary file")
    text = "The casting cools in the mould. Литьё остывает. " * 50
    enc = tokens.encoding()
    ids = enc.encode_ordinary(text)
    assert "".join(tokens.token_slices(text, list(range(0, len(ids), 4096)), 4096)) == text
