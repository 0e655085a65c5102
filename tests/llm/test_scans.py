import pytest

from pagespark.llm import scans

WORDS = "the casting cools slowly in a mould and feeds from riser while metal fills every corner of hollow frame before sand drops".split()
KNOWN = frozenset(WORDS)
G = scans.Gatherer(KNOWN, scans.default_model())


@pytest.mark.parametrize(
    "value, kinds",
    [
        ("The casting cools slowly in the mould.", set()),
        ("The cast-\ning cools in the mould", {("good", "casting")}),
        ("The cast- ing cools in the mould", {("good", "casting")}),
        ("The cast¬\ning cools in the mould", {("sure", "break")}),
        ("The casting cools in the moul-", {("sure", "end")}),
        ("The c a s t i n g cools", {("good", "casting"), ("good", "asting"), ("good", "castin")}),
        ("The ca5ting cools", {("good", "casting")}),
        ("The castlng cools", {("bad", "castlng")}),
        ("The so-called casting cools", set()),
        ("From 1905-\n1910 the casting cools", set()),
        ("", set()),
    ],
)
def test_evidence(value, kinds):
    assert {e for e in G.many([value])[0] if e[0] not in ("parts", "line")} == kinds


PROSE = "The casting cools slowly in the mould and the metal fills\nevery corner of the hollow frame before the sand drops.\nThe riser feeds the casting while the metal cools slowly."


@pytest.mark.parametrize("head", ["- 45 -", "[12]", "137", "p. 33"])
@pytest.mark.parametrize("at", ["first", "last"])
def test_page_numbers_at_the_edge(head, at):
    value = f"{head}\n{PROSE}" if at == "first" else f"{PROSE}\n{head}"
    assert ("sure", "number") in G.many([value])[0]


def test_columns_of_readings_and_single_numbers():
    assert ("sure", "number") not in G.many([PROSE + "\n45\n61\n72\n88"])[0]
    assert G.many(["137"])[0] == []


def test_list_items_are_read_like_prose():
    got = G.many(["1) Casting frame 4;\n2) Hollow riser 7;\n3) Met- al mould 9;\n4) Cornfr sand 12."])[0]
    assert {("good", "metal"), ("bad", "cornfr")} <= set(got)


def test_running_line_is_a_candidate():
    assert ("line", "Hollow frame and riser 31") in G.many([f"{PROSE}\nHollow frame and riser 31"])[0]


def test_repair():
    value = f"- 45 -\n{PROSE}\n\nThe cast-\ning c o o l s slow¬\nly in the castlng."
    got = scans.repair(value, KNOWN, {"castlng": "casting"})
    assert got.split("\n\n")[0] == PROSE.replace("\n", " ")
    assert got.split("\n\n")[1] == "The casting cools slowly in the casting."
    assert scans.repair("", KNOWN) == ""


def test_words_are_judged_by_the_corpus(spark):
    counts = [("en", "casting", 400), ("en", "castlng", 3), ("en", "cast", 300), ("en", "mould", 500), ("en", "rnould", 2), ("en", "castingmould", 1), ("en", "plate", 200), ("de", "platte", 300), ("de", "plate", 1), ("en", "rare", 2), ("en", "castings", 60), ("x", "caſting", 1)]
    words = spark.createDataFrame(counts, "lang string, word string, n long")
    bad, good = scans.judge_words(words)
    assert {(r.word, r.fix) for r in bad.collect()} == {("castlng", "casting"), ("rnould", "mould"), ("castingmould", "casting mould")}
    assert "plate" in {r.word for r in good.collect()}


def test_whole_path(spark):
    rows = [(i, "s", f"p{i % 9}", "Text", PROSE, PROSE if i % 2 else None, PROSE, "x") for i in range(60)]
    rows += [(100, "s", "p1", "Text", PROSE.replace("riser feeds", "riscr feeds"), None, None, "x"), (101, "s", "p2", "Text", None, "Hollow frame and riser\n" + PROSE, None, "x"), (102, "s", "p2", "Text", "", None, None, "x"), (103, None, None, "Text", PROSE, None, None, "x"), (104, "s", "p3", "Text", "Hollow frame and riser", None, None, "x")]
    df = spark.createDataFrame(rows, "id long, source string, page string, category string, text_a string, text_b string, final string, kind string")
    fields = ("text_a", "text_b", "final")
    heads = spark.createDataFrame([("s", f"p{i}", "Page-header", f"Hollow frame and riser {i}") for i in range(5)], "source string, page string, category string, text string")
    words = scans.word_table(df, fields)
    bad, good = scans.judge_words(words)
    ev = scans.evidence(df, scans.known_words(good), fields)
    got = {(r.id, r.field, r.kind) for r in scans.confirm(ev, words, bad, good, scans.running_lines(heads)).collect()}
    assert got == {(100, "text_a", "bad"), (101, "text_b", "line")}
    assert scans.word_table(df.limit(0), fields).count() == 0


def test_all_that_is_confirmed_is_repaired(spark):
    df = spark.createDataFrame(
        [
            (1, "The ca5ting cools and the mou|d drops."), (2, "Here a c o o l s slowly and <b>the cast-\ning</b> fil ls."), (3, f"{PROSE}\nHollow frame and riser 31"), (4, f"Hollow frame and riser\n{PROSE}\n45"),
            (5, "The metal fills every cor-\nHollow frame and riser 31\nner of the hollow frame."), (6, "The <i>castlng</i> cools."),
        ],
        "id long, final string",
    )
    rows = [(1, "good", "casting", "casting", 9), (1, "good", "mould", "mould", 9), (2, "good", "cools", "cools", 9), (2, "good", "casting", "casting", 9), (2, "parts", "fil ls", "fills", 9), (3, "line", "Hollow frame and riser 31", "", None)]
    rows += [(4, "sure", "number", None, None), (5, "line", "Hollow frame and riser 31", "", None), (5, "good", "corner", "corner", 9), (6, "bad", "castlng", "casting", None)]
    confirmed = spark.createDataFrame([(i, "final", *r) for i, *r in rows], "id long, field string, kind string, item string, fix string, n long")
    flat = PROSE.replace("\n", " ")
    got = {r.id: r.clean for r in scans.repair_values(df, confirmed, ("final",)).collect()}
    assert got == {1: "The casting cools and the mould drops.", 2: "Here a cools slowly and <b>the casting</b> fills.", 3: flat, 4: f"Hollow frame and riser {flat}", 5: "The metal fills every corner of the hollow frame.", 6: "The <i>casting</i> cools."}


def test_word_broken_around_a_running_line_is_evidence():
    assert ("good", "corner") in G.many(["The metal fills every cor-\nHollow frame and riser 31\nner of the hollow frame."])[0]


def test_loops_keep_their_evidence():
    """A misread word before a loop counts, the word broken off where the loop begins doesn't, nor do its repeats."""
    known = frozenset("the casting cools slowly in mould and sand of a workshop for hollow shaft position".split())
    head = "the castlng cools slowly in the mould and the sand of a worksh\n"
    value = head + "".join(f"Position {k}. the hollow shaft. " for k in range(1, 40)) + "Position 41. the holl"
    got = scans.Gatherer(known, scans.default_model()).many([value])[0]
    assert {w for k, w in got if k == "bad"} == {"castlng"}
    assert scans.outside_loops("no loop in here") is None


def test_long_words_are_seen():
    word = "a" * 30 + "b" * 40
    got = scans.Gatherer(frozenset(), scans.default_model()).many([f"one {word} two", "x" * 70 + "-"])
    assert ("bad", word) in got[0] and ("sure", "end") in got[1]


def test_hyphen_counts_by_the_label_of_its_line():
    known = frozenset(["moulding"])
    gather = scans.Gatherer(known, scans.default_model())
    lines = ["The casting cools slowly in the mou-", "lding of the shop, and the metal is", "hot and dry."]
    for label, want in ((1, True), (0, True), (4, True), (2, False), (3, False)):
        got = gather.one("\n".join(lines), lines, [label, 0, 0], [False, False, False])
        assert (("good", "moulding") in got) == want
