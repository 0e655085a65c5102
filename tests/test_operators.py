import pytest
from pyspark.sql import functions as F

from pagespark import schemas
from pagespark.operators import consensus, evaluate, events, geometry, guard, layout, pages, tablediff, vocabulary

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def test_decisions(spark):
    long_a = "Структура металла зависит от скорости охлаждения отливки в форме. " * 3
    long_b = long_a.replace("зависит", "зависят", 1)
    rows = [
        (1, "text", "same text", "same text", "accept"), (2, "text", long_a, long_b, "accept"), (3, "text", "Чугун", "Чутун", "arbiter"), (4, "text", "1 350 мм", "1350 мм", "arbiter"), (5, "text", long_a + "12", long_b + "13", "arbiter"),
        (6, None, "x", None, "nodraft"), (7, "text", "x", None, "arbiter"), (8, "page", "x", "x", "arbiter"), (9, "text", "", "", "arbiter"), (10, "table", "<table><tr><th>a</th></tr></table>", "<table><tr><td>a</td></tr></table>", "accept"),
        (11, "table", "<table><tr><td colspan=2>a</td></tr></table>", "<table><tr><td>a</td></tr></table>", "arbiter"), (12, "formula", "$$x^{2}$$", "x^2", "accept"), (13, "formula", "$$x=5$$", "x=6", "arbiter"), (14, "formula", "$$x_{1}=5$$", "x_{2}=5", "accept"), (15, "formula", "x{", None, "arbiter"), (16, "formula", "x", None, "accept"),
    ]
    df = spark.createDataFrame(rows, "id long, kind string, text_a string, text_b string, want string")
    got = {r.id: r for r in consensus.decide(consensus.prepare(df)).collect()}
    assert {i: r.decision for i, r in got.items()} == {r[0]: r[4] for r in rows}
    assert got[1].final == "same text" and got[3].final is None and 0 < got[2].cer_ab <= 0.01
    fast = {r.id: r.decision for r in consensus.decide(consensus.prepare(df), mode="fast").collect()}
    assert fast[3] == "accept" and fast[10] == "arbiter" and fast[8] == "arbiter" and fast[6] == "nodraft"
    with pytest.raises(ValueError):
        consensus.decision(0.1, "other")
    sweep = {(r.tau): r.arbiter for r in consensus.sweep(consensus.prepare(df), [0.0, 0.01]).collect()}
    assert sweep[0.0] == sweep[0.01] + 1


def test_judge_scripts(spark):
    rows = [
        ("text", "Сталь мягкая", None, "Steel мягкая", None), ("text", "Сталь 12 MPa", None, "Сталь 12 MPa", None), ("text", "Модель", None, "Мoдель", None),
        ("formula", "x", None, "abc", None), ("text", " ", None, "Сталь VII", None), ("text", None, None, " ", None), ("text", " ", "", "алмаз", ""),
    ]
    df = spark.createDataFrame(rows, "kind string, text_a string, text_b string, answer string, error string")
    got = [r.verdict for r in consensus.judge(df).collect()]
    assert [(v.status, v.note) for v in got] == [
        ("rejected", "script changed: Steel"), ("done", None), ("rejected", "script changed: Мoдель"), ("done", None), ("done", "unverified: no drafts"),
        ("failed", "empty answer, no drafts"), ("failed", "no answer"),
    ]
    assert got[0].cer is None and got[0].text == "Сталь мягкая"


def test_judge(spark):
    rows = [
        (1, "text", "metal cools", "metal cools", "metal cools", None), (2, "text", "metal cools", None, "something else entirely here", None), (3, "text", "", None, "new text", None),
        (4, "text", "abc", "abd", None, None), (5, "text", "ab" * 400, "good draft", "x", "timeout"), (6, "text", "", None, "", None),
    ]
    df = spark.createDataFrame(rows, "id long, kind string, text_a string, text_b string, answer string, error string")
    got = {r.id: r.verdict for r in consensus.judge(df).collect()}
    assert (got[1].status, got[1].source) == ("done", "arbiter") and (got[2].status, got[2].source) == ("rejected", "fallback_a")
    assert got[3].note == "unverified: no drafts; latin: new, text; cyrillic share 0.00" and got[4].note == "no answer" and got[5].source == "fallback_b" and got[6].status == "failed"


@pytest.mark.parametrize(
    "was, now, reason",
    [
        ("сталь мягкая", "сталь, сталь мягкая", "duplicates word"), ("0,15", ",15", None), ("Po", "Ро", "element to Cyrillic"),
        ("C + 1/3 Si", "C + <sup>1/8</sup> Si", "changes digits"), ("1 дм³", "1 дм²", None), ("0,15", ",15", None), ("a×b", "a××b", "doubles operator"), ("т/мм", "т мм", "changes operator"), ("5.0<sub>2</sub>", "5.0", "deletes index"),
        ("слово", "", "deletes text"), ("a & b", "a &amp; b", "escapes markup"), ("l", "t", "ambiguous single letter"), ("длинный текст", "текст", "deletes span"), ("ковка", "ковка, ковка", "duplicates word"), ("перенос", "пере-нос", "keeps line-break hyphen"),
        ("0,3% C и Mo", "0,3% С и Мо", "element to Cyrillic"), ("трсбует", "требует", None), ("x", "x", None), ("СТО261", "CTO261", None), ("З5", "35", None),
    ],
)
def test_fix_reasons(spark, was, now, reason):
    df = spark.createDataFrame([(was, now)], "was string, now string")
    assert df.select(consensus.fix_reason(F.col("was"), F.col("now")).alias("r")).first().r == reason


def test_context_reasons(spark):
    rows = [("1", 5, "a", "b"), ("2", 5, "b", "c"), ("3", 6, "ковка", "ковку"), ("4", 7, "литой", "литый"), ("5", 8, "x", "yz"), ("6", 8, "12", "13"), ("7", 9, None, "q")]
    df = spark.createDataFrame(rows, "id string, block long, was string, now string")
    refused = spark.createDataFrame([("x", "yz")], "was string, now string")
    corpus = spark.createDataFrame([("b", "ковка", 3), ("b", "литой", 1)], "book string, word string, n long")
    got = {r.id: r.reason for r in consensus.context_reasons(df, refused, corpus).collect()}
    assert got == {"1": "ambiguous single letter", "2": "ambiguous single letter", "3": "normalizes term", "4": None, "5": "rejected by user", "6": "changes digits"}
    shifted = spark.createDataFrame([("1", 5, "ab", "bc"), ("2", 5, "bc", "cd"), ("3", 6, "ab", "xy")], "id string, block long, was string, now string")
    assert {r.id: r.reason for r in consensus.context_reasons(shifted).collect()} == {"1": "shifts value", "2": "shifts value", "3": None}


def test_guard(spark):
    own = "Сущность магнитных методов заключается в создании в детали равномерного магнитного поля, и равномер-"
    table = "*Таблица IX.11*\n\n| Выявление дефектов при намагничивании |  |  |\n| :-- | :-- | :-- |\n| Режим для контроля | Н, Э | Размеры дефекта |\n| А | 60 | 2,5 |\n| Б | 30 | 10 |"
    html = "<table><tr><td>Режим для контроля</td><td>Н, Э</td><td>Размеры дефекта</td></tr><tr><td>А</td><td>60</td><td>2,5</td></tr><tr><td>Б</td><td>30</td><td>10</td></tr></table>"
    rows = [
        (1, "p", "text", own, own + "\n\n" + table), (2, "p", "caption", "Таблица IX.11", None), (3, "p", "text", "Выявление дефектов при намагничивании", None), (4, "p", "table", html, html),
        (5, "q", "text", "** Масса указана без учета шкафов управления.", "Диаметр ячейки сила 10 мм.\n* Масса указана без учета шкафов управления."), (6, "q", "text", "* Диаметр ячейки сита 16 мм.", None),
        (7, "r", "text", "Таблица IX.11 и текст", "Таблица IX.11 и текст"), (8, "r", "caption", "Таблица IX.11", None),
        (9, "s", "text", "", "Таблица IX.11"), (10, "s", "caption", "Таблица IX.11", None), (11, "s", "text", "Сравниваем $|D|$.", "Сравниваем $ |D| $ с $ |C| $."), (12, None, "text", "a", "b"),
    ]
    df = spark.createDataFrame([(i, "b", p, k, None, "done", a, b) for i, p, k, a, b in rows], "id long, book string, page string, kind string, parent long, drafts_status string, text_a string, text_b string")
    got = {r.id: r.clean for r in guard.guarded(df).collect()}
    assert got == {1: own, 5: "* Масса указана без учета шкафов управления.", 9: ""}
    assert guard.likeness("abcdef", "zzabcxefzz") == 83 and guard.likeness("abcdef", "zzzzzzzz") == 0
    assert guard.common("abcbdab", "bdcaba") == 4 and guard.guarded(df.limit(0)).count() == 0


def chain(spark, nums):
    df = spark.createDataFrame([("b", f"p{i}", i, n) for i, n in enumerate(nums)], "book string, name string, idx int, num int")
    return [r.printed for r in layout.number_chain(df).orderBy("idx").collect()]


def test_number_chain(spark):
    assert chain(spark, [10, 11, 99, 13, None, 15]) == ["10", "11", "12", "13", "14", "15"]
    assert chain(spark, [1, 2, 3, 1, 2, 3]) == ["1", "2", "3", None, None, None]
    assert chain(spark, [5, None, None, None, None, 10]) == [None] * 6
    assert chain(spark, []) == []


def test_headers(spark):
    rows = []
    for i in range(4):
        rows += [(i * 10, "b", f"p{i}", "Text", (100, 20, 600, 60), "CASTING MACHINES"), (i * 10 + 1, "b", f"p{i}", "Text", (100, 200, 900, 400), "A plain paragraph"), (i * 10 + 2, "b", f"p{i}", "Page-footer", (450, 1340, 550, 1390), str(201 + i))]
    rows.append((99, "b", "p0", "Page-header", (0, 0, 9, 9), "Таблица IV.16"))
    df = spark.createDataFrame(rows, f"id long, book string, page string, category string, bbox {BOX}, txt string").withColumn("height", F.lit(1400)).withColumn("sig", F.lower("txt"))
    sigs = layout.repeated_signatures(df)
    assert [(r.sig, r.pages) for r in sigs.collect()] == [("casting machines", 4)]
    acts = {r.id: r.action for r in layout.header_blocks(df, sigs).collect()}
    assert acts == {**{i * 10: "drop" for i in range(4)}, **{i * 10 + 2: "drop" for i in range(4)}, 99: "caption"}
    assert {(r.page, r.num) for r in layout.number_candidates(df).collect()} == {(f"p{i}", 201 + i) for i in range(4)}
    tilted = df.withColumn("bbox", F.when(F.col("id") == 0, F.struct(F.lit(1).alias("x1"), F.lit(1300).alias("y1"), F.lit(9).alias("x2"), F.lit(1390).alias("y2"))).otherwise(F.col("bbox")))
    assert layout.repeated_signatures(tilted).count() == 0


def words(spark, *known):
    return spark.createDataFrame([("b", w) for w in known], "book string, word string")


def test_stitches(spark):
    ps = spark.createDataFrame([("b", f"p{i}", i) for i in range(4)], "book string, name string, idx int")
    rows = [(1, "b", "p0", 0, "Text", "Структура ме-"), (2, "b", "p0", 1, "Footnote", "* Note."), (3, "b", "p1", 0, "Text", "талла зависит."), (4, "b", "p2", 0, "Text", "новый"), (5, "b", "p3", 0, "Text", "а) пункт")]
    df = spark.createDataFrame(rows, "id long, book string, page string, ord int, category string, txt string")
    assert [(r.id, r.join_to, r.hyphen) for r in layout.stitches(df, ps, words(spark, "металла")).collect()] == [(3, 1, "металла")]
    assert layout.stitches(df, ps, words(spark, "другое")).first().hyphen is None  # no word of the book: the hyphen stays
    gap = df.where("page <> 'p1'")
    assert {(r.id) for r in layout.stitches(gap, ps, words(spark)).collect()} == set()


def test_continuations_and_roman(spark):
    rows = [(1, "b", "p", 0, "Caption", "Продолжение табл. IV. 15"), (2, "b", "p", 1, "Text", "x"), (3, "b", "p", 2, "Table", "t"), (4, "b", "p", 3, "Table", "t"), (5, "b", "q", 0, "Caption", "Окончание таблицы 7"), (6, "b", "r", 0, "Table", "t")]
    df = spark.createDataFrame(rows, "id long, book string, page string, ord int, category string, txt string")
    assert [(r.id, r.continues) for r in layout.continuations(df).collect()] == [(3, "IV.15")]
    refs = spark.createDataFrame([("a", "рис. IV.5, табл. II.3, рис. III.1, рис. 1.7"), ("c", "рис. I.5, табл. II.3, рис. III.1"), ("d", "рис. 3.2 и рис. V.1")], "book string, txt string").withColumn("category", F.lit("Text"))
    assert {r.book: r.is_roman for r in layout.roman_books(refs).collect()} == {"a": True, "c": False, "d": False}
    own = spark.createDataFrame([("a", "см. рис. 1.28 и табл. 1V.4, рис. 3.2", "Text"), ("a", "1.28", "Text"), ("c", "рис. 1.28", "Text")], "book string, txt string, category string").withColumn("id", F.monotonically_increasing_id())
    assert [r.fixed for r in layout.roman_references(own, layout.roman_books(refs)).collect()] == ["см. рис. I.28 и табл. IV.4, рис. 3.2"]


def test_vocabulary(spark):
    rows = [(1, "b", "Сталь и сталь, сине-зелёный <b>x</b> пере-\nнос 12Х18 $y$"), (2, "b", "перенос сине-зелёный"), (3, "b", None), (4, "b", "")]
    df = spark.createDataFrame(rows, "id long, book string, txt string")
    v = vocabulary.vocabulary(df)
    assert {(r.word, r.n) for r in v.collect()} == {("сталь", 2), ("и", 1), ("перенос", 1), ("x", 1)}
    c = vocabulary.compounds(df)
    assert {(r.word, r.n) for r in c.collect()} == {("сине-зелёный", 2)}
    assert [(r.id, r.joined) for r in vocabulary.line_breaks(df, v, c).collect()] == [(1, "перенос")]
    d = spark.createDataFrame([("сталь",)], "word string")
    assert [r.word for r in vocabulary.unknown_words(v, d).collect()] == ["перенос"]


def test_geometry(spark):
    B = lambda *b: dict(zip(("x1", "y1", "x2", "y2"), b))
    rows = [(1, "b", "p", "Text", B(0, 0, 1000, 1000)), (2, "b", "p", "Table", B(100, 100, 400, 400)), (3, "b", "p", "Picture", B(900, 900, 1300, 1300)), (4, "b", "q", "Table", B(0, 0, 10, 10)), (5, "b", "p", "Text", None), (6, "b", "p", "Caption", B(120, 120, 130, 130))]
    df = spark.createDataFrame(rows, f"id long, book string, page string, category string, bbox {BOX}")
    kinds = df.withColumn("kind", schemas.kind_of(F.col("category"))).withColumn("parent", F.lit(None).cast("long"))
    assert [(r.id, r.other, r.share) for r in geometry.masked(kinds).collect()] == [(1, 2, 1.0)]
    titled = kinds.withColumn("kind", F.when(F.col("id") == 1, "title").otherwise(F.col("kind")))
    assert [r.id for r in geometry.masked(titled).collect()] == [1]
    assert geometry.masked(kinds.withColumn("parent", F.when(F.col("id") == 2, 9))).count() == 0
    assert {(r.id, r.inside) for r in geometry.centres_inside(df, df.where("category='Table'")).collect()} == {(6, 2)}
    pairs = geometry.page_pairs(df, df).where("l.id < r.id")
    ids = sorted((r.l.id, r.r.id) for r in pairs.collect())
    assert ids == sorted(set(ids))  # each pair once, though boxes share many grid cells
    c = spark.createDataFrame([(-5.0, 1.5, 50.0, 30.0), (5.0, 5.0, 5.0, 9.0), (float("nan"), 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r.x for r in c.select(geometry.clamp(*[F.col(k) for k in "abcd"], F.lit(40), F.lit(100)).alias("x")).collect()]
    assert tuple(got[0]) == (0, 2, 40, 30) and got[1] is None and got[2] is None


def test_greedy_and_suppression(spark):
    p = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 1, 2, 0.95), ("a", 2, 2, 0.9), ("a", 2, 1, 0.6), ("b", 1, 1, 0.4)], "k string, l long, r long, score double")
    assert {(r.k, r.l, r.r) for r in geometry.greedy(p, ["k"]).collect()} == {("a", 1, 2), ("a", 2, 1)}
    assert geometry.greedy(p.limit(0), ["k"]).count() == 0
    assert geometry.suppress([(0.9, (0, 0, 10, 10)), (0.8, (1, 1, 10, 10)), (0.7, (20, 20, 30, 30))]) == [0, 2]
    assert geometry.rows_of([(50, 0, 60, 10), (0, 1, 10, 11), (0, 30, 10, 40)]) == [1, 0, 2]
    df = spark.createDataFrame([(0, 0, 0), (0, 2, 0), (0, 0, 3), (2, 4, 2)], "m long, p long, g long")
    got = [tuple(r.x) for r in df.select(geometry.counts(F.col("m"), F.col("p"), F.col("g")).alias("x")).collect()]
    assert got[0] == (1, 1, 1) and got[1] == (0, 1, 0) and got[2] == (0, 0, 0) and got[3] == pytest.approx((0.5, 1, 2 / 3))


def test_floats_and_footnotes(spark):
    assert pages.float_order([(1, "Text", (0, 0, 100, 100)), (2, "Picture", (0, 300, 100, 400)), (3, "Caption", (0, 405, 100, 420)), (4, "Text", (0, 120, 100, 280)), (5, "Text", (0, 430, 100, 500))], 1000) == [1, 4, 2, 3, 5]
    assert pages.float_order([(1, "Picture", (200, 0, 400, 200)), (2, "Text", (0, 0, 180, 100)), (3, "Text", (0, 300, 400, 350))], 1000) == [2, 1, 3]
    two = [(1, "Picture", (0, 300, 90, 400)), (2, "Text", (0, 0, 90, 200)), (3, "Text", (100, 0, 190, 200))]
    assert pages.float_order(two, 1000) == [1, 2, 3]
    rows = [(1, "b", "p", 0, "Table", "x *"), (2, "b", "p", 1, "Text", "plain"), (3, "b", "p", 2, "Text", "* first"), (4, "b", "p", 3, "Text", "goes on"), (5, "b", "p", 4, "Text", "¹ tail"), (6, "b", "p", 5, "Text", "** tail")]
    df = spark.createDataFrame(rows, "id long, book string, page string, ord int, category string, txt string")
    assert sorted(r.id for r in pages.promoted(df).collect()) == [3, 5, 6]


def test_places():
    t = "сталь 45 и сталь 450, чугун"
    assert pages.place_in(t, "и ", "сталь", " 450") == ("exact", 11)
    assert pages.place_in(t, None, "45", None) == ("token", 6)
    assert pages.place_in(t, None, "сталь", None)[0] == "ambiguous" and pages.place_in(t, None, "медь", None)[0] == "absent"


def test_scores(spark):
    df = spark.createDataFrame([(1, "5 5 6", "5 6 6"), (2, "no", "none"), (3, "7", "x"), (4, "", "8")], "id long, p string, g string")
    got = {r.id: (r.precision, r.recall, r.f1) for r in evaluate.number_scores(df, F.col("p"), F.col("g"), "id").collect()}
    assert got[1] == pytest.approx((2 / 3, 2 / 3, 2 / 3), abs=1e-5) and got[2] == (1, 1, 1) and got[3] == (0, 0, 0) and got[4] == (0, 0, 0)
    df = spark.createDataFrame([("a b c", "a x c"), ("", ""), ("z", ""), (None, "q")], "p string, g string")
    assert [round(r.w, 4) for r in df.select(evaluate.word_error("p", "g").alias("w")).collect()] == [0.3333, 0, 1, 1]
    assert evaluate.concordance([1, 2, 3]) == 1 and evaluate.concordance([2, 1]) == 0 and evaluate.concordance([1]) is None
    s = spark.createDataFrame([("c", "m", 0.9, 0.2), ("c", "n", 0.9, 0.1), ("c", "o", None, 0.0), ("d", "m", 0.1, None)], "cat string, name string, f1 double, cer double")
    assert {r.cat: r.best for r in evaluate.best(s, "cat", "name", "f1", "cer").collect()} == {"c": "n", "d": "m"}


def test_events_and_diffs(spark, monkeypatch):
    import datetime as dt

    t = lambda m: dt.datetime(2031, 3, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [(1, t(0), "b", "Info"), (2, t(5), "b", "ERROR"), (3, t(8), "b", "error"), (4, t(300), "b", "error"), (5, t(120), "b", "info"), (6, t(1), None, "info"), (1, t(0), "b", "Info")]
    e = events.cleaned(spark.createDataFrame(rows, "id long, ts timestamp_ntz, book string, level string"))
    assert e.count() == 6
    assert [(r.id, r.behind_s) for r in events.late(e).collect()] == [(5, 180 * 60)]
    assert sorted((r.session, r.n) for r in events.sessions(e, 3600, "book", ["id"]).collect()) == [(1, 3), (2, 1), (3, 1)]
    assert [(r.start, r.n) for r in events.streaks(e, "book", F.col("level") == "error", 2, "id").collect()] == [(2, 3)]
    whole = [sorted(map(str, d.collect())) for d in (events.late(e), events.sessions(e, 3600, "book", ["id"]), events.streaks(e, "book", F.col("level") == "error", 2, "id"))]
    monkeypatch.setattr(events, "IDS", 2)  # every stretch of two ids and of an hour
    monkeypatch.setattr(events, "SECONDS", 3600)
    assert whole == [sorted(map(str, d.collect())) for d in (events.late(e), events.sessions(e, 3600, "book", ["id"]), events.streaks(e, "book", F.col("level") == "error", 2, "id"))]
    assert {r.id: r.n for r in events.rolling(e, "book", 600).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1}
    assert [r.id for r in events.tail(e, 2).collect()] == [5, 6]
    assert events.tumbling(e, "1 hour").agg(F.sum("n")).first()[0] == 6 and events.sliding(e, "1 hour", "30 minutes", "level").agg(F.sum("n")).first()[0] == 12
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k long, v string, w long")
    b = spark.createDataFrame([(1, "x", None), (2, "q", 1), (4, "n", 1)], "k long, v string, w long")
    assert {(r.k, r.change) for r in tablediff.sync(a, b, ["k"], ["v", "w"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    assert [r.k for r in tablediff.wanted(a, b, ["k"]).collect()] == [3]
