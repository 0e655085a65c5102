import random

import pytest

from pagespark.llm import markup

C = markup.Cleaner(markup.fit([]))
CASES = [
    ("a <b>bold</b> word", "a bold word", "tag"),
    ("x&nbsp;y &laquo;z&raquo;", "x y «z»", "entity"),
    ("## Head\n\ntext", "## Head\n\ntext", "heading"),
    ("== Head ==\ntext", "## Head\ntext", "heading"),
    ("\\section{Head}\ntext", "## Head\ntext", "command"),
    ("some **bold** and *slanted* `code`", "some bold and slanted `code`", "bold,code,italic"),
    ("see [the part](#sec-3) now", "see the part now", "link"),
    ("see [[part|the part]] now", "see the part now", "wikilink"),
    ("load $x^{2}$ kept", "load $x^{2}$ kept", "math"),
    ("cut~\\cite{b1} here", "cut here", "command,escape"),
    ("<ul><li>one</li><li>two</li></ul> end", "- one\n\n- two\n\nend", "tag"),
    ("<table><tr><td>speed</td><td>load</td></tr><tr><td>7</td><td></td></tr></table>", "speed | load\n\n7 |", "tag"),
    ("a\n{| class=x\n! one !! two\n|-\n| Stahl || 81\n|}\nb", "a\n\none | two\n\nStahl | 81\n\nb", "wikirow,wikitable"),
    ("<b>run</b>\n```\nif x:\n    y  = 1\n```\n- a\n  - b", "run\n```\nif x:\n    y  = 1\n```\n- a\n  - b", "fence,tag"),
    ("<nav><a href='/'>Home</a> News Contact</nav><p>The casting cools slowly in the sand.</p><footer>Imprint and rights</footer>", "The casting cools slowly in the sand.", "tag"),
    ("<script>var x = 1;</script>The casting cools <b>slowly</b>.", "The casting cools slowly.", "tag"),
    ("text '''strong''' here", "text strong here", "wikibold"),
]


@pytest.mark.parametrize("raw, clean, kinds", CASES)
def test_cases(raw, clean, kinds):
    got = C(raw)
    assert (got[0], got[1]) == (clean, kinds)


@pytest.mark.parametrize("raw", ["t < 72, d > 22", "grade #51", "mean ~ 49.", "{86; 8}", "A & B", "C:\\work\\new8", "72 * 3 = 216", "[13]", "* item", "** item", "word[^5]", "n == 24", "a_47, b_17", "| 16 | .", "1) one", "", "plain"])
def test_signs_that_stand_for_themselves(raw):
    assert C(raw)[1] == "" and C(raw)[0] == raw


def test_region_is_the_best_run():
    rng = random.Random(3)
    w = markup.fit([])
    kinds = ["word", "aside", "tag", "comment", "begin", "template"]
    for _ in range(200):
        toks = [markup.Token(rng.choice(kinds), i, i + 1, 0) for i in range(rng.randrange(0, 12))]
        a, b = markup.region(toks, w)
        best = max([0.0] + [sum(w[t.kind] for t in toks[i:j]) for i in range(len(toks)) for j in range(i + 1, len(toks) + 1)])
        assert abs(sum(w[t.kind] for t in toks[a:b]) - best) < 1e-9


def test_residue_is_the_turned_scan():
    w = markup.fit([])
    toks = markup.tokens("plain words <b>bold</b> and more words of the page")
    assert markup.residue(toks, w) == pytest.approx(max(-w["tag"], -2 * w["tag"] - w["word"]))
    assert markup.residue(markup.tokens("plain words"), w) == 0


def test_weights_come_from_labelled_pages(spark):
    """Menu lines made of links that the other draft lacks make links count against the content."""
    rows = [(i, "[one](/a) [two](/b) [three](/c)\nThe casting cools *slowly* in the sand.", None, "The casting cools slowly in the sand.") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, final string, arbiter_text string, text_a string")
    w, plain = markup.sample_weights(df, ("final", "arbiter_text"), "text_a"), markup.fit([])
    assert w["link"] < plain["link"] and w["word"] > 0
    assert markup.sample_weights(df.limit(0), ("final", "arbiter_text"), "text_a") == plain


def test_operator(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", None, 1), (2, None, "ok", 2), (3, "", "`c` d", 3), (4, "<br/>" * 20_000, None, 4)], "id long, final string, arbiter_text string, value int")
    got = {(r.id, r.field, r.clean) for r in markup.clean_markup(df).collect()}
    assert got == {(1, "final", "x"), (3, "arbiter_text", "`c` d"), (4, "final", "")}
    assert markup.clean_markup(df.limit(0)).count() == 0
