"""Text functions against plain Python readings of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagespark.functions import text


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        ("10⁻³ м²", "10-3 м2"), ("«a» — b", '"a" - b'), ("Мoдeль A", "Модель A"), ("0{,}5  x", "0,5 x"), ("5 × 27 мм", "5 x 27 мм"), ("сталь 12Х18Н10Т", "сталь 12Х18Н10Т"), ("12Х18", "12x18"),
        ("a&nbsp;&lt;b", "a <b"), ("", ""), (None, None), ("  x \n y ", "x y"),
    ],
)
def test_normal(spark, raw, want):
    assert one(spark, text.normal, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1 350 мм, 0,5%", ["1350", "0,5"]), ("1350 мм, 0,5 %", ["1350", "0,5"]), ("x = -3 и (-4,5)", ["-3", "-4,5"]), ("10^{-3}", ["10", "3"]), ("1 000 000", ["1000000"]),
        ("от 3-5", ["3", "5"]), ("нет", []), ("12 3456", ["12", "3456"]),
    ],
)
def test_numbers(spark, raw, want):
    assert one(spark, text.numbers, raw) == want


@pytest.mark.parametrize("raw, want", [("$$x^{2}$$", "x^2"), ("\\(\\text{a} \\left( b \\right)\\)", "a(b)"), ("$a\\cdot b$", "a·b"), ("\\mathrm{\\text{q}}", "q"), ("x_{12}", "x_{12}")])
def test_formula_form(spark, raw, want):
    assert one(spark, text.formula_form, raw) == want


def test_text_form_equates_markup(spark):
    a = one(spark, text.text_form, "**Сталь** <i>мягкая</i>, пере-\nнос $x^2$")
    b = one(spark, text.text_form, "Стaль мягкая, перенос x^2")
    assert a == b


@pytest.mark.parametrize("a, b, want", [("", "", 0.0), ("abc", "abd", 1 / 3), ("ёж", "еж", 0.5), ("", "ab", 1.0)])
def test_distance_share(spark, a, b, want):
    assert one(spark, text.distance_share, a, b) == pytest.approx(want)


@pytest.mark.parametrize("p, g, want", [("", "", 0.0), ("x", "", 1.0), ("abcdefgh", "ab", 1.0), ("ab", "abcd", 0.5)])
def test_gold_distance(spark, p, g, want):
    assert one(spark, text.gold_distance, p, g) == pytest.approx(want)


@pytest.mark.parametrize("raw, want", [("ab" * 400, True), ("x" + "abc" * 250, True), ("ab" * 100, False), ("".join(random.Random(1).choices("abcdefgh", k=900)), False), (None, None)])
def test_looping(spark, raw, want):
    assert one(spark, text.looping, raw) in ((want,) if raw is not None else (None, False))


@pytest.mark.parametrize("raw, want", [("1", "I"), ("11", "II"), ("1V", "IV"), ("IV", None), ("1111", None), ("X1", "XI")])
def test_roman(spark, raw, want):
    assert one(spark, text.roman_chapter, raw) == want


def test_stem_and_slug(spark):
    r = one(spark, text.stem_parts, "Ivanov_Casting_of_iron_1956")
    assert (r.title, r.author, r.year) == ("Casting of iron", "Ivanov", 1956)
    assert one(spark, text.slug, "1.2 Формы, и стержни!") == "12-формы-и-стержни"


def test_strip_tags_keeps_relations(spark):
    assert one(spark, text.strip_tags, "t < 500<br>x<sup>2</sup>") == "t < 500 x2"


@pytest.mark.parametrize("raw, want", [("<p>a</p><ul><li>b</li></ul>", "a\n\n- b"), ("a<br/>b&amp;c", "a\nb&c"), ("<math>x</math>", "$x$")])
def test_plain_from_html(spark, raw, want):
    assert re.sub(r"\n+\Z", "", one(spark, text.plain_from_html, raw)) == want


@pytest.mark.parametrize("raw, want", [("сталь и чугун", "ru"), ("the steel is hot and this", "en"), ("der Stahl ist heiß und gut", "de"), ("xyz abc", "ru"), ("", "ru")])
def test_language_vote(spark, raw, want):
    def vote(c):
        k = text.language_counts(c)
        return text.vote(k["cyr"], k["lat"], k["de"], k["en"])

    assert one(spark, vote, raw) == want
