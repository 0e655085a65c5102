import random

import pytest

from pagespark.functions import homoglyphs, markdown, tables
from pagespark.operators import layout

GOLD = "# Head\n\nThe casting cools in the mould at 1 350 °C and more.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$$x^{2}$$\n\nA second paragraph that is long enough to count."


def test_take_apart():
    p = markdown.take_apart(GOLD + "\n\n* note¹ text[^1]\n\n![pic](x.png)")
    assert p["paragraphs"] == ["Head", "The casting cools in the mould at 1 350 °C and more.", "A second paragraph that is long enough to count.", "note text"]
    assert len(p["tables"]) == 1 and p["formulas"] == ["x^{2}"]
    assert markdown.take_apart("")["paragraphs"] == []


def test_scores():
    s = markdown.score(GOLD, GOLD)
    assert (s["cer"], s["wer"], s["num_f1"], s["teds"], s["formula_cer"], s["order_share"]) == (0, 0, 1, 1, 0, 1)
    head, cast, table, formula, second = GOLD.split("\n\n")
    assert markdown.score("\n\n".join([head, second, cast, table, formula]), GOLD)["order_share"] == 0
    e = markdown.score(None, GOLD)
    assert e["cer"] == 1 and e["num_recall"] == 0 and e["teds"] == 0 and e["order_share"] is None
    assert markdown.score("", "")["num_f1"] == 1 and markdown.score("x", "")["cer"] == 1
    assert markdown.score(GOLD.replace("| 1 |", "| 3 |"), GOLD)["num_recall"] == pytest.approx(4 / 5, abs=0.11)


def test_best_window():
    hay = "noise " * 10 + "the casting cools slowly in the mould" + " noise" * 10
    like, at = markdown.best_window("the casting coo1s slowly in the mould", hay)
    assert like > 0.9 and abs(at - 60) <= 4
    assert markdown.best_window("abcdefgh", "zzz")[0] == 0


def test_every_start_is_measured():
    par = "the casting cools slowly in the mold"
    for off in range(8):
        hay = "z" * (16 + off) + "tqe casting cools slowly in the qold" + "z" * 40
        like, at = markdown.best_window(par, hay)
        assert like == pytest.approx(34 / 36) and at == 16 + off
    rng = random.Random(3)
    for _ in range(60):
        needle, hay = ("".join(rng.choices("abc", k=n)) for n in (rng.randrange(1, 7), rng.randrange(0, 12)))
        least = min(tables.levenshtein(needle, hay[i:j]) for i in range(len(hay) + 1) for j in range(i, len(hay) + 1))
        like, start, end = markdown.best_stretch(needle, hay)
        assert like == pytest.approx(1 - least / len(needle)) and (like == 0 or tables.levenshtein(needle, hay[start:end]) == least)


def test_regions_lose_no_stretch():
    rng = random.Random(5)
    words = ["casting", "mould", "slowly", "the", "sand", "of", "a", "riser"]
    for _ in range(120):
        needle = " ".join(rng.choices(words, k=rng.randrange(6, 12)))
        copy = list(needle)
        for _ in range(rng.randrange(0, len(needle) // 4)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz ")
        hay = " ".join(rng.choices(words, k=20)) + " " + "".join(copy) + " " + " ".join(rng.choices(words, k=20))
        whole = markdown.best_stretch(needle, hay)
        found = markdown.find_like(needle, hay, 0.8)
        assert found[0] == (pytest.approx(whole[0]) if whole[0] >= 0.8 else 0)


def test_order_looks_behind_the_last_hit_first():
    one, two = "the casting cools slowly in the mould", "a second paragraph with other words in it"
    assert markdown.order_share(f"{two} {one} {two.replace('words', 'w0rds')}", [one, two]) == 1
    assert markdown.order_share(f"{two} {one}", [one, two]) == 0


@pytest.mark.parametrize(
    "raw, want",
    [("Мoдель", "Модель"), ("Сплав 12X18 прочен", "Сплав 12Х18 прочен"), ("газ CO2 и Fe3O4", "газ CO2 и Fe3O4"), ("твёрдость HRC45 стали", "твёрдость HRC45 стали"), ("the grade 12X18", "the grade 12X18"), ("сталь $X_1$ <b class='A1'>AB</b>", "сталь $X_1$ <b class='A1'>AB</b>"), ("точка Ac1 стали", "точка Ac1 стали"), ("", "")],
)
def test_output_homoglyphs(spark, raw, want):
    df = spark.createDataFrame([(raw,), (None,)], "t string")
    assert [r.x for r in df.select(homoglyphs.fix_output("t").alias("x")).collect()] == [want, None]


def test_chains(spark):
    ps = spark.createDataFrame([("b", f"p{i}", i) for i in range(5)], "book string, name string, idx int")
    rows = [(1, "b", "p0", 0, "Text", "Структура ме-"), (2, "b", "p1", 0, "Text", "талла зависит от"), (3, "b", "p2", 0, "Text", "формы."), (4, "b", "p3", 0, "Text", "Новый и"), (5, "b", "p4", 0, "Text", "дальше.")]
    df = spark.createDataFrame(rows, "id long, book string, page string, ord int, category string, txt string")
    words = spark.createDataFrame([("b", "металла")], "book string, word string")
    got = [(r.id, r.blocks, r.text) for r in layout.chains(df, layout.stitches(df, ps, words), ps).orderBy("id").collect()]
    assert got == [(1, 3, "Структура металла зависит от формы."), (4, 2, "Новый и дальше.")]
