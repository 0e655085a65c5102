import pytest

from pagespark.llm import skeleton

C = skeleton.Canonicaliser(["CTO261", "41Т4Х18", "HB30"])
CASES = [
    ("plain text", "plain text", ""),
    ("в\u00a0тексте", "в тексте", "space"),
    ("пр\u200dинимают", "принимают", "invisible"),
    ("де\u00adталь", "деталь", "invisible"),
    ("и\u0306од", "йод", "accent"),
    ("１２１ мм", "121 мм", "joined"),
    ("ﬂange", "flange", "joined"),
    ("мoдель", "модель", "alphabet"),
    ("carriagе", "carriage", "alphabet"),
    ("СТО261", "CTO261", "designation"),
    ("41T4X18", "41Т4Х18", "designation"),
    ("Сплав 41Т4Х18 и HB30", "Сплав 41Т4Х18 и HB30", ""),
    ("24² … 3½ № 5 — «a» ×", "24² … 3½ № 5 — «a» ×", ""),
    ("п0дшипник", "п0дшипник", ""),
    ("", "", ""),
]


@pytest.mark.parametrize("raw, clean, fault", CASES)
def test_cases(raw, clean, fault):
    assert C(raw) == (clean, fault)


def test_canonical_is_stable():
    for raw, *_ in CASES:
        once = C(raw)[0]
        assert C(once)[0] == once


def test_skeleton_equates_lookalikes():
    assert skeleton.skeleton("Скорость") == skeleton.skeleton("Cкopocть") != skeleton.skeleton("Скорости")


def test_operator_with_nulls_and_no_codes(spark):
    df = spark.createDataFrame([(1, "мoдель", None, "x"), (2, None, "", "x"), (3, "ok", "１" * 50_000, "x")], "id long, text_a string, final string, value string")
    got = {(r.id, r.field, r.faults) for r in skeleton.canonicalise(df, []).collect()}
    assert got == {(1, "text_a", "alphabet"), (3, "final", "joined")}
    assert skeleton.canonicalise(df.limit(0), []).count() == 0


def test_groups(spark):
    df = spark.createDataFrame([(1, "вал", "вaл"), (2, "вал", None), (3, "шов", "")], "id long, text_a string, final string")
    got = {(r.n_spellings, r.n_rows, r.spelling) for r in skeleton.skeleton_groups(skeleton.survey(df, [])[1]).collect()}
    assert got == {(2, 3, "вал"), (1, 1, "шов")}


def test_group_names_the_spelling(spark):
    """A word that could be of either alphabet takes the spelling its group has; without the group the rule would miss it."""
    rows = [(1, "xox сор", "cоp of it"), (2, "cop cop cop", None), (3, "Cталь", "Сталь"), (4, "１２", "x\u00a0y"), (5, "41T4X18", "41Т4Х18")]
    df = spark.createDataFrame(rows, "id long, text_a string, final string")
    got = {(r.id, r.field): (r.was, r.now, r.faults) for r in skeleton.respell(*skeleton.survey(df, ["41Т4Х18"])).collect()}
    assert got == {
        (1, "final"): ("cоp", "cop", "alphabet"), (3, "text_a"): ("Cталь", "Сталь", "alphabet"), (4, "text_a"): ("１２", "12", "joined"),
        (4, "final"): ("\u00a0", " ", "space"), (5, "text_a"): ("41T4X18", "41Т4Х18", "designation"),
    }
    none = skeleton.respell(*skeleton.survey(df.limit(0), []))
    assert none.count() == 0


def test_designations_as_a_table(spark):
    rows = [(1, "сталь 41T4X18 и СТО261", "41Т4Х18"), (2, "CTO261 и В7", "мoдель A5"), (3, None, "41Т4Х1８")]
    df = spark.createDataFrame(rows, "id long, text_a string, final string")
    codes = ["41Т4Х18", "CTO261", "HB30"]
    table = spark.createDataFrame([(c,) for c in [*codes, None, ""]], "code string")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(skeleton.found_in(df, table)[1]) == key(skeleton.found_in(df, codes)[1])
    assert key(skeleton.canonicalise(df, table)) == key(skeleton.canonicalise(df, codes)) and skeleton.canonicalise(df, codes).count() == 3
