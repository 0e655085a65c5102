import random

import numpy as np
import pytest

from pagespark.llm import languages as lg

TEXTS = {
    "ru": "литьё остывает в форме медленно пока металл заполняет каждый угол полой рамы перед тем как песок опускается вниз и деталь готова к осмотру",
    "en": "the casting cools slowly in the mould while the metal fills every corner of the hollow frame before the sand drops and the part is ready",
    "de": "der guss kühlt langsam in der form während das metall jede ecke des hohlen rahmens füllt bevor der sand fällt und das teil fertig ist",
    "uk": "виливок охолоджується повільно у формі поки метал заповнює кожен кут порожньої рами перед тим як пісок опускається і деталь готова",
    "fr": "la pièce refroidit lentement dans le moule tandis que le métal remplit chaque coin du cadre creux avant que le sable tombe et que tout soit prêt",
}


def sentence(rng, lang, n=9):
    w = TEXTS[lang].split()
    return " ".join(rng.choice(w) for _ in range(n)).capitalize() + "."


def corpus(rng, n):
    out = []
    for i in range(n):
        lang = lg.LANGS[i % 5]
        label = lang if rng.random() < 0.85 else rng.choice(lg.LANGS)
        out.append((i, " ".join(sentence(rng, lang) for _ in range(4)), label, "x"))
    return out


@pytest.fixture(scope="module")
def logp(spark):
    df = spark.createDataFrame(corpus(random.Random(1), 100), "doc_id long, text string, lang string, words string")
    return lg.fit(df)


def test_held_out_accuracy(logp):
    rng = random.Random(2)
    texts, want = zip(*[(sentence(rng, lang), lang) for lang in lg.LANGS for _ in range(40)])
    got = lg.main_languages(list(texts), lg.Scorer(logp))
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.97


def test_passages(spark, logp):
    rng = random.Random(3)
    main = " ".join(sentence(rng, "ru") for _ in range(5))
    rows = [(1, main, "ru"), (2, main + " " + sentence(rng, "en", 12), "RU"), (3, main + " (the hollow frame)", "Russian"), (4, None, None), (5, "", ""), (6, "12 34 5", "en"), (7, main * 400, "?"), (8, main, "de")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    found = lg.language_rows(df, logp, "id")
    main_of = lg.main_of(found, "id")
    assert {r.id: r.main for r in main_of.collect()} == {i: "ru" for i in (1, 2, 3, 7, 8)}
    assert {(r.id, r.lang) for r in lg.foreign_passages(found, main_of, "id").collect()} == {(2, "en")}
    assert {(r.id, r.lang) for r in lg.wrong_labels(df, main_of, "id").collect()} == {(7, "ru"), (8, "ru")}
    assert all(0 < r.confidence <= 1 for r in found.collect())


@pytest.mark.parametrize("label, code", [("RU", "ru"), ("ru-RU", "ru"), ("rus", "ru"), ("German", "de"), ("en_GB", "en"), ("xx", None), ("", None), (None, None), ("?", None), ("und", None)])
def test_labels(label, code):
    assert lg.code_of(label) == code


def test_empty_sample(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = lg.fit(empty)
    assert m.shape == (5, lg.BUCKETS) and np.allclose(m[0], m[1])


def test_every_item_and_passage_has_its_row(spark, tmp_path):
    from pagespark.llm import queries

    rng = random.Random(4)
    ru, de = " ".join(sentence(rng, "ru") for _ in range(3)), [sentence(rng, "de", 12) for _ in range(3)]
    text = f"<b>{ru}</b> " + " ".join(f"{x} {ru}" for x in de)
    train = [(i, t, lab) for i, t, lab, _ in corpus(rng, 100)]
    spark.createDataFrame([*train, (900, text, None), (901, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", "ru"), ("empty", None)], "name string, lang string").write.parquet(f"{tmp_path}/books.parquet")
    block = [(1, "b", "Text", ru, de[0]), (1, "b", "Text", ru, de[0]), (2, "b", "Text", None, ru), (3, "b", "Formula", "x^2", None)]
    spark.createDataFrame(block, "id long, book string, category string, final string, text_a string").write.parquet(f"{tmp_path}/blocks.parquet")
    rows = queries.p7_languages(spark, str(tmp_path)).collect()
    one = sorted((r for r in rows if r.item == "900" and r.passage), key=lambda r: r.passage)
    assert [r.passage for r in one] == [1, 2, 3, 4, 5, 6, 7] and [r.lang for r in one] == ["ru", "de"] * 3 + ["ru"]
    assert [text[r.start : r.end] + "." for r in one if r.lang == "de"] == de and all(0 < r.confidence <= 1 for r in one)
    whole = {(r.src, r.item, r.field): (r.lang, r.confidence > 0) for r in rows if r.passage is None}
    assert whole["documents", "900", "text"] == ("ru", True) and whole["documents", "901", "text"] == (None, False)
    assert {k[1:]: v for k, v in whole.items() if k[0] == "blocks"} == {("1", "final"): ("ru", True), ("1", "text_a"): ("de", True), ("2", "final"): (None, False), ("2", "text_a"): ("ru", True), ("3", "final"): (None, False), ("3", "text_a"): (None, False)}
    assert {k[1]: v for k, v in whole.items() if k[0] == "books"} == {"b": ("ru", True), "empty": (None, False)}
    assert len(rows) == len({(r.src, r.item, r.field, r.passage) for r in rows})
