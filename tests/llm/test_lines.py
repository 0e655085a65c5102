import math
import random
from collections import defaultdict

from pagespark.llm import lines

SCHEMA = "id long, source string, page string, text string, extra string"


def rows_of(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def same(a, b):
    """Equal but for one letter changed, lost, added or read as two."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :] or any(a[:k] == b[:k] and a[k + 1 :] == b[k + 2 :] for k in range(len(a)))


def run(spark, data):
    df = rows_of(spark, data)
    table = lines.line_table(lines.lines_of(df))
    rep = lines.repeated(table, lines.page_counts(df))
    return {(r.id, r.line_no) for r in lines.found(table, rep).collect()}, df, rep


def noise(i, n=25):
    rng = random.Random(i)
    return "".join(rng.choice("abcdefghijkl") for _ in range(n))


def book(n_pages, rng, title, extra=()):
    out, i = [], 0
    for p in range(n_pages):
        body = "".join(rng.choice("abcdefghijklmnop") for _ in range(30))
        head = title if p % 2 else title.upper() + f" {p}"
        if p == 3:
            head = head.replace(head[5], "q", 1)
        out.append((i, "s", f"p{p}", f"{head}\n{body} x", "e"))
        i += 1
    return out


def test_title_found_in_all_its_readings(spark):
    data = book(12, random.Random(1), "Deep moulds and the hot core")
    got, _, _ = run(spark, data)
    assert got == {(i, 0) for i in range(12)}


def test_letter_read_as_two_and_lookalikes(spark):
    data = [(i, "s", f"p{i}", "Вертикальный вал", "e") for i in range(6)]
    data += [(10, "s", "p10", "Вертикалыный вaл", "e"), (11, "s", "p11", "Вертикальньгй вал 7", "e"), (12, "s", "p12", "Горизонтальный вал", "e")]
    got, _, _ = run(spark, data)
    assert {10, 11} <= {i for i, _ in got} and 12 not in {i for i, _ in got}


def test_threshold_share_and_count(spark):
    few = [(i, "s", f"p{i}", "Running title here", "e") for i in range(4)]
    assert run(spark, few)[0] == set()
    wide = [(i, "s", f"p{i}", "Running title here" if i < 5 else noise(i), "e") for i in range(130)]
    assert run(spark, wide)[0] == set()  # 5 of 130 pages is under 4 %
    assert len(run(spark, wide[:125])[0]) == 5


def test_brute_force(spark):
    rng = random.Random(5)
    heads = ["alpha beta gamma", "alpha beta delta", "short", "abcd", "zz"]
    data = []
    for i in range(120):
        h = rng.choice(heads)
        if rng.random() < 0.2 and len(h) > 4:
            k = rng.randrange(len(h))
            h = h[:k] + rng.choice("xyzw") + h[k + 1 :]
        data.append((i, rng.choice(["s", "t"]), f"p{rng.randrange(40)}", h + "\n" + "".join(rng.choice("abcdefgh") for _ in range(12)), "e"))
    got, df, _ = run(spark, data)
    keyed = [(r.id, r.source, r.page, r.line_no, r.key) for r in lines.lines_of(df).collect()]
    pages, n = defaultdict(set), defaultdict(set)
    for _, s, p, _, k in keyed:
        pages[s, k].add(p)
    for _, s, p, *_ in data:
        n[s].add(p)
    want = set()
    for i, s, _, no, k in keyed:
        need = max(5, math.ceil(0.04 * len(n[s]) - 1e-9))
        centres = [c for (q, c) in pages if q == s and same(c, k)]
        if any(len(pages[s, c]) >= need * 0.25 and len(set().union(*[pages[s, m] for (q, m) in pages if q == s and same(m, c)])) >= need for c in centres):
            want.add((i, no))
    assert got == want


def test_rare_readings_of_a_class_count(spark):
    """48 of 1,200 pages are needed: a centre on 12, and four readings on 9 each that share different halves with it."""
    base = "theoldworkshopofcastingandforging"
    readings = [base] * 12 + [base[:3] + "q" + base[4:]] * 9 + [base[:-3] + "q" + base[-2:]] * 9 + [base[:5] + base[6:]] * 9 + [base[:-6] + base[-5:]] * 9
    data = [(i, "s", f"p{i}", readings[i] if i < 48 else noise(i), "e") for i in range(1200)]
    assert {i for i, _ in run(spark, data)[0]} == set(range(48))
    assert run(spark, data + [(5000 + i, "s", f"q{i}", noise(5000 + i), "e") for i in range(25)])[0] == set()


def test_light_half_is_counted(spark):
    """A reading that shares only a half that few pages have still belongs to the class."""
    base = "theoldworkshopofcastingandforging"
    data = [(i, "s", f"p{i}", base, "e") for i in range(4)] + [(4, "s", "p4", base[:-2] + "zg", "e"), (5, "s", "p5", "q" + base[1:], "e")]
    assert {i for i, _ in run(spark, data)[0]} == set(range(6))


def test_delta_alone_is_enough(spark):
    """The state's tables and the delta give the whole result; no old line is handed over again."""
    data = book(20, random.Random(2), "Deep moulds and the hot core")
    for cut in (4, 16):
        old, new = rows_of(spark, data[:cut]), rows_of(spark, data[cut:])
        state, delta = lines.line_table(lines.lines_of(old)), lines.line_table(lines.lines_of(new))
        counts = lines.count_table(state)
        before = lines.repeated(state, lines.page_counts(old), counts=counts)
        merged = lines.merge_counts(lines.merge_counts(counts, state, delta), lines.merge(state, delta), delta)  # delivered twice
        every = rows_of(spark, data)
        whole = lines.line_table(lines.lines_of(every))
        key = lambda d: sorted(map(tuple, d.collect()))
        assert key(merged) == key(lines.count_table(whole))
        pages = lines.page_counts(lines.page_table(old).unionByName(lines.page_table(new)))
        after = lines.repeated(lines.merge(state, delta), pages, counts=merged)
        assert key(after) == key(lines.repeated(whole, lines.page_counts(every)))
        crossed = lines.crossings(before, after)
        assert (before.count() == 0) == (cut == 4) and (crossed.where("crossed").count() > 0) == (cut == 4)
        clean = {r.id: r.clean for r in lines.rebuild(every, lines.merge(state, delta), after, crossed, delta).collect()}
        assert all("moulds" not in t.lower() and t.endswith(" x") for t in clean.values())
        assert set(clean) == set(range(20) if cut == 4 else range(16, 20))  # old documents only for lines that crossed


def test_lines_fall_behind(spark):
    few = [(i, "s", f"p{i}", "Running title here", "e") for i in range(5)]
    more = [(100 + i, "s", f"q{i}", noise(i), "e") for i in range(200)]
    old, every = rows_of(spark, few), rows_of(spark, few + more)
    a, b = lines.line_table(lines.lines_of(old)), lines.line_table(lines.lines_of(every))
    before, after = lines.repeated(a, lines.page_counts(old)), lines.repeated(b, lines.page_counts(every))
    crossed = lines.crossings(before, after)
    assert before.count() == 1 and after.count() == 0 and [r.crossed for r in crossed.collect()] == [False]
    assert {r.clean for r in lines.rebuild(every, b, after, crossed).collect()} == {"Running title here"}


def test_nulls_empty_and_repeats(spark):
    data = [(1, None, "p", "Some title", None), (2, "s", None, "Some title", None), (3, "s", "p", None, None), (4, "s", "p", "", None), (5, "s", "p", "12 34", None)]
    assert run(spark, data)[0] == set()
    assert run(spark, [])[0] == set()
    again = [(i, "s", "p1", "Some title", "e") for i in range(9)]
    assert run(spark, again)[0] == set()  # one page, however often
