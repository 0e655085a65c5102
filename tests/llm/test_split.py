import random

import pytest

from pagespark.llm import split

LIMITS = [("Text", 60, 12), ("Tiny", 5, 2), ("Table", 80, 0), ("Odd", 7, None)]
LIM = {c: (m, o or 0) for c, m, o in LIMITS}


def pieces(spark, rows):
    df = spark.createDataFrame(rows, "id long, final string, category string, piece string")
    out = {}
    for r in split.split_items(df, LIMITS).collect():
        out.setdefault(r.id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in out.items()}


def test_round_trip_limits_and_overlap(spark):
    rng = random.Random(1)
    words = ["core", "mould.", "the;", "a", "steel,", "line\n", "par\n\n", "\U0001f600\U0001f601", "é", "</tr>", "x" * 90, "\r\n"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), rng.choice(["Text", "Tiny", "Table", "Odd"]), "e") for i in range(120)]
    got = pieces(spark, rows)
    assert set(got) == {r[0] for r in rows}
    for i, text, cat, _ in rows:
        m, o = LIM[cat]
        p = got[i]
        assert "".join(r.piece[r.core_start - r.start :] for r in p) == text
        assert all(len(r.piece) <= m and r.n_chars == len(r.piece) for r in p)
        assert all(r.core_start - r.start == min(o, r.core_start) for r in p[1:])
        assert (len(p) > 1) == (len(text) > m)


def test_cuts_at_the_strongest_boundary(spark):
    text = "First sentence here is long. Second one, with a clause, goes on.\n\nNext paragraph starts and goes on for a while."
    p = pieces(spark, [(1, text, "Text", "e")])[1]
    assert p[0].piece.endswith("long. ") or p[0].piece.endswith("\n\n")
    row = "<tr><td>a</td><td>b</td></tr>"
    p = pieces(spark, [(2, "<table>" + row * 6 + "</table>", "Table", "e")])[2]
    assert all(r.piece.endswith("</tr>") or r.piece.endswith("</table>") for r in p)


def test_defined_cases(spark):
    got = pieces(spark, [(1, None, "Text", None), (2, "", "Text", None), (3, "x" * 100, "Formula", None), (4, "y" * 60, "Text", None), (5, "abc", None, None)])
    assert set(got) == {2, 4} and len(got[4]) == 1
    assert pieces(spark, []) == {}
    with pytest.raises(ValueError):
        split.split_items(spark.createDataFrame([], "id long, final string, category string"), [("Text", 0, 0)])


def test_table_of_limits_equals_list(spark):
    rows = [(i, "word and more; text.\n" * (i % 7), ["Text", "Tiny", "Table", "Odd", "None"][i % 5]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, final string, category string")
    table = spark.createDataFrame([*LIMITS, ("Text", 90, 1), (None, 3, 1), ("None", None, 1)], "category string, max_chars int, overlap_chars int")
    assert sorted(split.split_items(df, table).collect()) == sorted(split.split_items(df, LIMITS).collect())
    with pytest.raises(Exception, match="under 1"):
        split.split_items(df, spark.createDataFrame([("Text", 0, 0)], "category string, max_chars int, overlap_chars int")).collect()


def test_overlap_over_several_pieces(spark):
    df = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz" * 3, "Text"), (2, "\U0001f600" * 50, "Text")], "id long, final string, category string")
    for r in split.split_items(df, [("Text", 10, 8)]).collect():
        text = ("abcdefghijklmnopqrstuvwxyz" * 3) if r.id == 1 else "\U0001f600" * 50
        assert r.piece == text[r.start : r.start + r.n_chars] and r.core_start - r.start == min(8, r.core_start) and r.n_chars <= 10


def test_long_text(spark):
    text = "word and more. " * 40_000
    p = pieces(spark, [(1, text, "Text", "e")])[1]
    assert "".join(r.piece[r.core_start - r.start :] for r in p) == text
