import numpy as np
import pytest

from pagespark.llm import mixing


def docs(spark, rng, sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, source, int(rng.integers(1, 200)), 1))
            k += 1
    return rows


def test_weights_are_met(spark):
    rows = docs(spark, np.random.default_rng(1), {"a": 3000, "b": 400, "c": 50, "d": 900})
    df = spark.createDataFrame(rows + [(99_999, None, 5, 1), (99_998, "a", None, 1), (99_997, "a", 0, 1)], "doc_id long, source string, tokens long, uses int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 8)], "source string, weight double, max_repeats int")
    used, report = mixing.mixture(df.drop("uses"), t)
    rep = {r.source: r for r in report.collect()}
    for r in rep.values():
        assert r.share == pytest.approx(r.weight, abs=0.01)
    got = used.collect()
    limit = {"a": 1, "b": 4, "c": 8}
    assert all(1 <= r.uses <= limit[r.source] for r in got) and "d" not in {r.source for r in got}
    size = {}
    for _, s, n, _ in rows:
        size[s] = size.get(s, 0) + n
    total = min(size[s] * limit[s] / w for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        spent = sum(r.tokens * r.uses for r in got if r.source == s)
        assert w * total - 200 <= spent <= w * total + 1e-6  # never over, and short by less than one document


def test_thresholds_are_nested(spark):
    rows = docs(spark, np.random.default_rng(2), {"a": 500, "b": 500})
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long, x int")
    t = mixing.targets_of(spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, weight double, max_repeats int"))
    h = mixing.hashed(df)
    small = {r.doc_id for r in mixing.mix(h, mixing.plan(h, t, 20_000)).collect()}
    large = {r.doc_id for r in mixing.mix(h, mixing.plan(h, t, 60_000)).collect()}
    assert small < large


def test_equal_sizes_ties_and_edges(spark):
    df = spark.createDataFrame([(i, "a", 10) for i in range(100)], "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("a", 1.0, None), ("z", 0.0, 3), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    used, report = mixing.mixture(df, t)
    assert used.count() == 100 and report.first().share == 1.0
    part = mixing.mixture(df, t, total=255)[0]
    assert part.count() == 25
    none = spark.createDataFrame([("a", 0.5, 1), ("gone", 0.5, 1)], "source string, weight double, max_repeats int")
    used, report = mixing.mixture(df, none)
    assert used.count() == 100 and {r.source: r.share for r in report.collect()} == {"a": 1.0, "gone": 0.0}
    used, report = mixing.mixture(df.limit(0), t)
    assert used.count() == 0 and report.count() == 1


def test_many_sources(spark, monkeypatch):
    """Thousands of sources, by join as by broadcast, with a plan that doesn't grow with them."""
    rng = np.random.default_rng(4)
    rows = [(i, f"s{i % 3000}", int(rng.integers(1, 50))) for i in range(15_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    t = spark.createDataFrame([(f"s{k}", 1.0 + k % 3, 2) for k in range(3000)], "source string, weight double, max_repeats int")
    used, report = mixing.mixture(df, t)
    got = sorted(used.collect())
    spent = {}
    for r in got:
        spent[r.source] = spent.get(r.source, 0) + r.tokens * r.uses
    targets = mixing.targets_of(t)
    budget = {r.source: r.budget for r in mixing.plan(mixing.hashed(df), targets).collect()}
    assert len(budget) == 3000 and all(spent.get(s, 0) <= b + 1e-6 for s, b in budget.items())
    assert abs(sum(r.share for r in report.collect()) - 1) < 1e-9
    monkeypatch.setattr(mixing, "SMALL", 10)
    assert sorted(mixing.mixture(df, t)[0].collect()) == got


def test_boundary_is_refined_to_the_last_document(spark):
    """A bucket of several documents is told apart further: no document that fits is left out."""
    df = spark.createDataFrame([(i, "a", 1) for i in range(20_000)], "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    assert mixing.mixture(df, t, total=12_345)[0].count() == 12_345
