import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagespark.functions import answers, tables

T1 = "<table><tr><th>Steel</th><th>kg</th></tr><tr><td>A</td><td>12</td></tr></table>"


def test_reader():
    t = tables.read_tables("x<table><tr><td rowspan=2>a<br>b</td><td colspan='3'>c<img src=q></td></tr><tr><td colspan=no>d</table>")[0]
    assert [[(c["text"], c["rowspan"], c["colspan"], c["imgs"]) for c in r] for r in t] == [[("a\nb", 2, 1, 0), ("c", 1, 3, 1)], [("d", 1, 1, 0)]]
    assert tables.read_tables(None) == [] and tables.read_tables("plain < text") == []


def brute_tree(a, b, structure=False):
    """Least cost over every order-keeping alignment of rows and, in aligned rows, of cells."""

    def aligned(n, m, drop, add, change):
        best = None
        for k in range(min(n, m) + 1):
            for x in itertools.combinations(range(n), k):
                for y in itertools.combinations(range(m), k):
                    c = sum(drop(i) for i in range(n) if i not in x) + sum(add(j) for j in range(m) if j not in y) + sum(change(i, j) for i, j in zip(x, y))
                    best = c if best is None else min(best, c)
        return best

    row = lambda i, j: aligned(len(a[i]), len(b[j]), lambda _: 1, lambda _: 1, lambda x, y: tables._cost(a[i][x], b[j][y], structure))
    return aligned(len(a), len(b), lambda i: 1 + len(a[i]), lambda j: 1 + len(b[j]), row)


def test_tree_distance_against_brute_force():
    rng = random.Random(2)
    cell = lambda: {"text": rng.choice(["ab", "abc", "x", ""]), "rowspan": 1, "colspan": rng.choice([1, 1, 2]), "head": False, "imgs": 0}
    make = lambda: [[cell() for _ in range(rng.randrange(0, 4))] for _ in range(rng.randrange(0, 4))]
    for _ in range(60):
        a, b = make(), make()
        for s in (False, True):
            assert tables.tree_distance(a, b, s) == pytest.approx(brute_tree(a, b, s))


def test_teds_cases():
    assert tables.teds_one(T1, T1) == 1.0
    assert tables.teds_one(T1.replace("th>", "td>"), T1) == 1.0
    assert tables.teds_one("", T1) == 0.0 and tables.teds_one(T1, "none") is None
    assert tables.teds_one(T1.replace("12", "13"), T1) == pytest.approx(1 - 0.5 / 7)
    assert tables.teds_one(T1.replace("12", "13"), T1, True) == 1.0


def test_columns(spark):
    wide = "<table><tr><td>h</td><td>a</td><td>b</td></tr><tr><td>r</td><td></td><td>5</td></tr><tr><td>d</td><td>—</td><td>10—50</td><td>—</td></tr><tr><td colspan=3>¹ Note to it.</td></tr></table>"
    two = "<table><tr><td>a</td><td>b</td></tr></table>between<table><tr><td>c</td><td>d</td></tr></table>"
    df = spark.createDataFrame([(1, wide), (2, T1), (3, None), (4, "no table"), (5, two), (6, two.replace("between", "Таблица 5"))], "id long, m string")
    p = df.select("id", tables.parse_table("m").alias("t"), tables.canonical_table("m").alias("c"), tables.merge_fragments("m").alias("g"), tables.table_count("m").alias("n"))
    from pyspark.sql import functions as F

    t = F.col("t")
    got = {r.id: r for r in p.select("*", tables.width(t).alias("w"), tables.single_values(t).alias("s"), tables.invented_dashes(t).alias("d"), tables.footnote_rows(t).alias("f")).collect()}
    assert got[1].w == 4 and got[1].s == [1] and got[1].d == [2] and got[1].f == "¹ Note to it."
    assert got[2].c == "1x1:Steel|1x1:kg\n1x1:A|1x1:12" and got[2].f is None and got[2].s == []
    assert got[3].t is None and got[3].c is None and got[4].t is None and got[4].c == "no table"
    assert got[5].n == 2 and got[5].g == '<table><tr><td>a</td><td>b</td></tr><tr><td colspan="2">between</td></tr><tr><td>c</td><td>d</td></tr></table>'
    assert got[6].g is None and got[1].g is None


def test_pipe_tables(spark):
    df = spark.createDataFrame([("x\n| a | b\\|c |\n|---|:-:|\n| 1 | 2 |\n\ny | z",)], "m string")
    got = df.select(tables.pipe_tables("m").alias("x")).first().x
    assert "<table><tr><td>a</td><td>b|c</td></tr><tr><td>1</td><td>2</td></tr></table>" in got and got.endswith("y | z")


@pytest.mark.parametrize(
    "raw, text, fixes, note",
    [
        ("Text here\n---\nFIXES: none", "Text here", [], None),
        ('{"text": "a\\nb", "fixes": [{"was": "x", "now": "y"}]}', "a\nb", [("x", "y")], None),
        ('{"text": "cut off in the mid', "cut off in the mid", [], "truncated"),
        ('```\nbody\nFIXES: [{"was": "a]", "now": "b"}]\n```', "body", [("a]", "b")], None),
        ("body\n**FIXES:** [{'was': 'a', 'now': 'b'}, 3]", "body", [("a", "b")], None),
        ("body\nFIXES: [{'was': 'a'", "body", [], "fixes unread"),
        ("plain", "plain", [], None),
        ("", "", [], None),
    ],
)
def test_answers(raw, text, fixes, note):
    got = answers.read_answer(raw)
    assert (got["text"], [(f["was"], f["now"]) for f in got["fixes"]], got["note"]) == (text, fixes, note)
    assert answers.read_answer(None) is None


def test_levenshtein_against_brute_force():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcё") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        assert tables.levenshtein(a, b) == slow(a, b) and tables.levenshtein(list(a), list(b)) == slow(a, b)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300))
    other = long[:100] + "x" + long[130:]
    assert tables.levenshtein(long, other) == slow(long, other)


def test_passes_over_tables(spark):
    rows = [
        ("<table><tr><td>n</td><td>a</td><td>b</td></tr><tr><td>x</td><td></td><td>7</td></tr><tr><td colspan=3>* see 5<br>** and 6</td></tr></table>",),
        ("<table><tfoot><tr><td>Note: one</td></tr></tfoot><tr><td>1</td><td>2</td></tr></table>",), ("<table><tr><td>* only</td></tr></table>",), ("<table><tr><th>a</th></tr><tr><td>Total | 3 &lt; 4</td></tr></table>",),
    ]
    df = spark.createDataFrame(rows, "m string").select(tables.parse_table("m").alias("t"))
    got = [(r.h, r.n) for r in df.select(tables.html_of(tables.spread_singles(tables.without_notes(F.col("t")))).alias("h"), tables.notes(F.col("t")).alias("n")).collect()]
    assert got == [
        ('<table><tr><td>n</td><td>a</td><td>b</td></tr><tr><td>x</td><td colspan="2">7</td></tr></table>', ["* see 5", "** and 6"]),
        ("<table><tr><td>1</td><td>2</td></tr></table>", ["Note: one"]), ("<table><tr><td>* only</td></tr></table>", []), ("<table><tr><th>a</th></tr><tr><td>Total | 3 &lt; 4</td></tr></table>", []),
    ]
    caps = spark.createDataFrame([("*Таблица IX.12*",), ("Т а б л и ц а 13",), ("**Продолжение табл. 4",), ("Текст о таблица",), ("",)], "c string")
    assert [r.x for r in caps.select(tables.is_new_caption(F.col("c")).alias("x")).collect()] == [True, True, True, False, False]


def forest_distance(a, b, cost, memo):
    """Edit distance of two ordered forests of (label, children), straight from its definition."""
    if not a and not b:
        return 0.0
    key = (a, b)
    if key not in memo:
        size = lambda f: sum(1 + size(c) for _, c in f)
        if not a or not b:
            memo[key] = float(size(a) + size(b))
        else:
            (la, ca), (lb, cb) = a[-1], b[-1]
            memo[key] = min(
                forest_distance(a[:-1] + ca, b, cost, memo) + 1, forest_distance(a, b[:-1] + cb, cost, memo) + 1,
                forest_distance(ca, cb, cost, memo) + forest_distance(a[:-1], b[:-1], cost, memo) + cost(la, lb),
            )
    return memo[key]


def test_tree_likeness_against_the_whole_tree_distance():
    """Rows are aligned with rows: against the distance that may also move cells between rows, likeness is never higher,
    equal in nearly all pairs, and off by little in the rest."""
    rng = random.Random(7)

    def table():
        return tuple(tuple(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4)))

    def html(t):
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in t) + "</table>"

    def tree(t):
        return (("table", tuple(("tr", tuple((c, ()) for c in r)) for r in t)),)

    def cost(x, y):
        if "table" in (x, y) or "tr" in (x, y):
            return 0.0 if x == y else 1.0
        return float(x != y)

    off = []
    for _ in range(400):
        p, g = table(), table()
        n = max(1 + len(t) + sum(map(len, t)) for t in (p, g))
        whole = 1 - forest_distance(tree(p), tree(g), cost, {}) / n
        off.append(whole - tables.teds_one(html(p), html(g)))
    assert min(off) > -1e-9 and sum(o > 1e-9 for o in off) <= 0.2 * len(off) and sum(off) / len(off) < 0.02
    print(f"differs in {sum(o > 1e-9 for o in off)} of {len(off)}, at most {max(off):.3f}, mean {sum(off) / len(off):.4f}")
