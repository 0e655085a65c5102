"""Comparing two drafts of a block and deciding between them; replaying the decision for other thresholds."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tables, text
from . import pages


def prepare(df: DataFrame) -> DataFrame:
    """Adds ca, cb (canonical forms by kind), cer, same_numbers, usable and index_free_numbers.

    Everything here is independent of the thresholds: computed once, whatever is decided from it later.
    """
    a, b = F.col("text_a"), F.col("text_b")
    kind = F.coalesce("kind", F.lit(""))

    def form(c: Column) -> Column:
        return F.when(kind == "table", tables.canonical_table(c)).when(kind == "formula", text.formula_form(c)).otherwise(text.text_form(c))

    def index_free(c: Column) -> Column:
        return text.numbers(F.regexp_replace(text.formula_form(c), r"(?U)_\s*\{[^{}]*\}|_\s*\\?\w", ""))

    alike = a == b  # most drafts agree to the letter: nothing is compared for them
    out = df.withColumn("ca", form(a)).withColumn("cb", F.when(alike, F.col("ca")).otherwise(form(b)))
    out = out.withColumn("cer", text.distance_share(F.col("ca"), F.col("cb")))
    out = out.withColumn("same_numbers", F.when(alike, F.lit(True)).otherwise(text.same_multiset(text.numbers(a), text.numbers(b))))
    balanced = (count(a, r"\{") == count(a, r"\}")) & (count(a, r"\\begin") == count(a, r"\\end")) & (count(a, r"\\left") == count(a, r"\\right"))
    out = out.withColumn("usable", (kind == "formula") & (F.length("ca") > 0) & balanced)
    return out.withColumn("formula_numbers_agree", F.when((kind == "formula") & alike, F.lit(True)).when(kind == "formula", text.same_multiset(index_free(a), index_free(b))))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def decision(tau: Column | float, mode: str = "cascade") -> Column:
    """accept, arbiter or nodraft for a prepared row; the first rule that holds decides."""
    if mode not in ("cascade", "fast"):
        raise ValueError(f"mode must be 'cascade' or 'fast', got {mode!r}")
    kind = F.col("kind")
    rule = F.when(kind.isNull(), "nodraft")
    if mode == "fast":
        return rule.when(kind.isin("table", "page"), "arbiter").otherwise("accept")
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    ca, cb, b = F.col("ca"), F.col("cb"), F.col("text_b")
    return (
        rule.when(F.col("usable"), F.when(b.isNull() | F.col("formula_numbers_agree"), "accept").otherwise("arbiter"))
        .when(b.isNull() | (kind == "page"), "arbiter")
        .when((ca == "") & (cb == ""), "arbiter")
        .when(ca == cb, F.when((kind == "formula") & ~F.col("same_numbers"), "arbiter").otherwise("accept"))
        .when(kind.isin("table", "formula"), "arbiter")
        .when((F.col("cer") <= tau) & F.col("same_numbers"), "accept")
        .otherwise("arbiter")
    )


def decide(df: DataFrame, tau: float = 0.01, mode: str = "cascade") -> DataFrame:
    """Prepared rows with decision, cer as reported, final and final_source."""
    d = decision(tau, mode)
    out = df.withColumn("decision", d)
    measured = F.when((F.col("decision") == "nodraft") | (F.lit(mode) == "fast") | F.col("text_b").isNull() | (F.col("kind") == "page"), F.lit(None).cast("double")).otherwise(F.col("cer"))
    taken = F.col("decision") != "arbiter"
    return out.withColumn("cer_ab", measured).withColumn("final", F.when(taken, F.col("text_a"))).withColumn("final_source", F.when(taken, F.lit("a")))


def sweep(prepared: DataFrame, taus: list[float], group: list[str] | None = None) -> DataFrame:
    """Decisions for every threshold in one pass: (group..., tau, blocks, arbiter, share)."""
    grid = F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau")
    cols = ["kind", "text_b", "ca", "cb", "cer", "same_numbers", "usable", "formula_numbers_agree"]
    keys = [*(group or []), "tau"]
    rows = prepared.select(*(group or []), *[c for c in cols if c not in (group or [])], grid)
    d = rows.withColumn("decision", decision(F.col("tau"))).where("decision <> 'nodraft'")
    arb = F.count_if(F.col("decision") == "arbiter")
    return d.groupBy(*keys).agg(F.count("*").alias("blocks"), arb.alias("arbiter"), F.round(arb / F.count("*"), 4).alias("share"))


# --- judging an answer ----------------------------------------------------------------------------------------


def fallback(a: Column, b: Column) -> Column:
    """struct(text, source): draft A unless blank or looping, else draft B if it has text, else A."""
    good_a = (F.trim(F.coalesce(a, F.lit(""))) != "") & ~text.looping(a)
    use_b = ~F.coalesce(good_a, F.lit(False)) & (F.trim(F.coalesce(b, F.lit(""))) != "")
    return F.struct(F.when(use_b, b).otherwise(a).alias("text"), F.when(use_b, "fallback_b").otherwise("fallback_a").alias("source"))


# Latin units, elements and standards that a Cyrillic answer may use.
KEPT_LATIN = "Fe Mn Si Cr Ni Mo Cu Al Mg Ti Zn Pb Sn Co Ca Na Mo Nb Zr Ce HB HRC HV HRB MPa GPa kPa kgf Pa mm cm min max SiO Al2O CaO MgO FeO MnO CO NaOH ISO GOST".lower().split()


def letter_words(c: Column) -> Column:
    """Runs of letters outside tags and formulas."""
    return F.regexp_extract_all(F.regexp_replace(c, r"<[^>]*>|\$[^$]*\$", " "), F.lit(r"(\p{L}+)"), F.lit(1))


def _all_latin(w: Column) -> Column:
    return w.rlike("^[A-Za-z]{3,}$") & ~w.rlike("^[IVXLCDM]+$") & ~F.lower(w).isin(*KEPT_LATIN)


def script_change(answer: Column, drafts: Column) -> Column:
    """First word of the answer that no draft has and that changes the script: Latin letters only, or two alphabets."""
    known = F.transform(F.flatten(F.transform(drafts, letter_words)), F.lower)
    both = lambda w: w.rlike("[А-Яа-яЁё]") & w.rlike("[A-Za-z]")
    return F.get(F.filter(letter_words(answer), lambda w: (_all_latin(w) | both(w)) & ~F.array_contains(known, F.lower(w))), F.lit(0))


def blind_note(answer: Column) -> Column:
    """Remark on an answer that no draft can vouch for: its Latin words, and its share of Cyrillic letters if under half."""
    latin = F.array_sort(F.array_distinct(F.filter(letter_words(answer), _all_latin)))
    letters, cyr = F.regexp_count(answer, F.lit(r"\p{L}")), F.regexp_count(answer, F.lit("[А-Яа-яЁё]"))
    share = F.when(letters > 0, cyr / letters).otherwise(F.lit(1.0))
    return F.concat(
        F.lit("unverified: no drafts"), F.when(F.size(latin) > 0, F.concat(F.lit("; latin: "), F.array_join(latin, ", "))).otherwise(""),
        F.when(share < 0.5, F.concat(F.lit("; cyrillic share "), F.format_string("%.2f", share))).otherwise(""),
    )


def judge(df: DataFrame, tau: float = 0.15, chars: int = 3, lang: str | None = None) -> DataFrame:
    """Adds verdict struct(status, source, text, cer, note) for an answer to two drafts.

    Needs kind, text_a, text_b, answer, error, and a column ``lang`` (name given by ``lang``) where the language
    matters: Russian answers other than formulas must not change the script.  The budget of changes is the larger of
    ``tau`` times the length of the nearer draft and ``chars``.
    """
    kind = F.coalesce("kind", F.lit(""))
    form = lambda c: F.when(kind == "table", tables.canonical_table(c)).when(kind == "formula", text.formula_form(c)).otherwise(text.text_form(c))
    drafts = F.filter(F.array("text_a", "text_b"), lambda d: d.isNotNull() & (F.trim(d) != ""))
    russian = (kind != "formula") & (F.lit(True) if lang is None else F.coalesce(F.col(lang), F.lit("ru")) == "ru")
    out = df.withColumn("_fb", fallback(F.col("text_a"), F.col("text_b"))).withColumn("_drafts", drafts).withColumn("_script", F.when(russian, script_change(F.col("answer"), F.col("_drafts"))))
    bare = F.when(kind == "table", F.regexp_replace("answer", r"<img\b[^>]*>", "")).otherwise(F.col("answer"))
    out = out.withColumn("_ans", form(bare))
    for c, name in (("text_a", "_da"), ("text_b", "_db")):
        d = form(F.col(c))
        out = out.withColumn(name, F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct(F.levenshtein(F.col("_ans"), d).alias("d"), d.alias("t"))))
    far_off = F.col("_script").isNull()  # a change of script is reported without a distance
    out = out.withColumn("_near", F.least("_da", "_db")).withColumn("_cer", F.when(far_off, F.col("_near.d") / F.greatest(F.length("_ans"), F.length("_near.t"), F.lit(1))))
    limit = F.greatest(F.lit(tau) * F.length("_near.t"), F.lit(float(chars)))
    reason = F.when(F.col("_script").isNotNull(), F.concat(F.lit("script changed: "), "_script")).when(
        F.col("_near.d") > limit, F.concat(F.lit("cer "), F.format_string("%.3f", F.col("_cer")), F.lit(": "), F.col("_near.d").cast("string"), F.lit(" chars > "), F.bround(limit, 0).cast("long").cast("string"))
    )
    out = out.withColumn("_reason", reason)
    s = lambda status, source, txt, cer, note: F.struct(F.lit(status).alias("status"), source.alias("source"), txt.alias("text"), cer.cast("double").alias("cer"), note.cast("string").alias("note"))
    arb, none = F.lit("arbiter"), F.lit(None)
    blank_answer = F.trim("answer") == ""
    blank_draft = F.coalesce(F.trim("_fb.text") == "", F.lit(True))
    blind_remark = F.when(russian, blind_note(F.col("answer"))).otherwise("unverified: no drafts")
    verdict = (
        F.when(F.col("error").isNotNull() | F.col("answer").isNull(), s("failed", F.col("_fb.source"), F.col("_fb.text"), none, F.coalesce(F.nullif("error", F.lit("")), F.lit("no answer"))))
        .when((F.size("_drafts") == 0) & blank_answer, s("failed", arb, F.col("answer"), none, F.lit("empty answer, no drafts")))
        .when(F.size("_drafts") == 0, s("done", arb, F.col("answer"), none, blind_remark))
        .when(F.col("_reason").isNull(), s("done", arb, F.col("answer"), F.col("_cer"), none))
        .when(blank_draft & ~blank_answer, s("done", arb, F.col("answer"), F.col("_cer"), F.concat(F.lit("kept: fallback empty: "), "_reason")))
        .otherwise(s("rejected", F.col("_fb.source"), F.col("_fb.text"), F.col("_cer"), F.col("_reason")))
    )
    return out.withColumn("verdict", verdict).drop("_fb", "_drafts", "_script", "_ans", "_da", "_db", "_near", "_cer", "_reason")


# --- proposed corrections -------------------------------------------------------------------------------------

# Signs whose loss changes the meaning, signs that must not be doubled, letters that pass for digits or for each other.
RELATIONS = "/×÷·=±<>≤≥%+"
DOUBLED = "×÷·=±"
CONFUSED = "OoОоlIіЗзбВАСЕНКМРТХаерсух"
CONFUSED_AS = "0000111336BACEHKMPTXaepcyx"
# Element symbols that a correction must not turn into Cyrillic.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu"
).split()
SCRIPT = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"


def _no_scripts(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)<(?:sub|sup)>.*?</(?:sub|sup)>", "")
    c = F.regexp_replace(c, r"[\^_]\{[^{}]*\}|[\^_].", "")
    return F.translate(F.regexp_replace(c, r"<[^<>]*>", ""), SCRIPT, "")


def _signs(c: Column) -> Column:
    plain = text.compose(F.regexp_replace(c, r"</?[A-Za-z][^<>]*>", ""))
    return F.regexp_extract_all(plain, F.lit(f"([{RELATIONS}])"), F.lit(1))


def _loses(a: Column, b: Column) -> Column:
    """Does array b lack an element of array a, counting repeats?"""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return text.once(F.struct(a.alias("a"), b.alias("b")), lambda s: F.exists(F.array_distinct(s["a"]), lambda x: times(s["a"], x) > times(s["b"], x)))


def same_number(was: Column, now: Column) -> Column:
    """Decimal fractions that differ in a leading zero only: 0.15 and .15."""
    fraction = lambda c: F.regexp_extract(F.trim(c), r"^0?([.,]\d+)$", 1)
    return (fraction(was) != "") & (fraction(was) == fraction(now))


def fix_reason(was: Column, now: Column) -> Column:
    """Why a correction must not be made, NULL if it may; rules in order, the first that holds names the reason."""
    digits = lambda c: F.regexp_replace(_no_scripts(c), r"\D", "")
    looks = lambda c: F.translate(F.translate(F.regexp_replace(c, r"<[^<>]*>", ""), SCRIPT, "01234567890123456789"), CONFUSED, CONFUSED_AS)
    plain = lambda c: F.trim(_no_scripts(c))
    twice = F.lit(False)
    for op in DOUBLED:
        twice = twice | (F.regexp_count(now, F.lit(op + op)) > F.regexp_count(was, F.lit(op + op)))
    indexes = lambda c: F.regexp_count(F.replace(c, F.lit("⁻"), F.lit("")), F.lit(r"\d(?:<(sub|sup)>[-−+]?\d+</\1>|[₀-₉⁰-⁹]+)"))
    double_word = lambda c: c.rlike(rf"(?U)\b([{text.LETTER}]{{3,}}),\s*\1\b")
    hyphens = F.regexp_extract_all(now, F.lit(rf"([{text.LETTER}]{{2,}}-[{text.LETTER}]{{2,}})"), F.lit(1))
    return (
        F.when((was == now) | same_number(was, now), F.lit(None).cast("string"))
        .when((F.trim(was) != "") & (F.trim(now) == ""), "deletes text")
        .when(text.compose(was) == text.compose(now), "escapes markup")
        .when((digits(was) != digits(now)) & (looks(was) != looks(now)), "changes digits")
        .when(twice, "doubles operator")
        .when(_loses(_signs(was), _signs(now)), "changes operator")
        .when(indexes(now) < indexes(was), "deletes index")
        .when((F.translate(now, text.CYRILLIC_TWINS, text.LATIN_TWINS) == F.translate(was, text.CYRILLIC_TWINS, text.LATIN_TWINS)) & (_latin_elements(now) < _latin_elements(was)), "element to Cyrillic")
        .when(plain(was).rlike("^[A-Za-z]$") & plain(now).rlike("^[A-Za-z]$"), "ambiguous single letter")
        .when((plain(now) != "") & (plain(now) != plain(was)) & plain(was).contains(plain(now)), "deletes span")
        .when(double_word(now) & ~double_word(was), "duplicates word")
        .when(F.exists(hyphens, lambda h: was.contains(F.replace(h, F.lit("-"), F.lit(""))) & ~was.contains(h)), "keeps line-break hyphen")
    )


def _latin_elements(c: Column) -> Column:
    """Two-letter element symbols that stand alone, and one-letter ones after a percent sign."""
    plain = F.regexp_replace(c, r"(?s)<(?:sub|sup)>.*?</(?:sub|sup)>", " ")
    two = F.filter(F.regexp_extract_all(plain, F.lit(rf"(?<![{text.LETTER}])([A-Z][a-z])(?![{text.LETTER}])"), F.lit(1)), lambda e: e.isin(*[x for x in ELEMENTS if len(x) == 2]))
    one = F.filter(F.regexp_extract_all(plain, F.lit(rf"%\s*([A-Z])(?![{text.LETTER}])"), F.lit(1)), lambda e: e.isin(*[x for x in ELEMENTS if len(x) == 1]))
    return F.size(two) + F.size(one)


def context_reasons(fixes: DataFrame, refused: DataFrame | None = None, corpus: DataFrame | None = None, seen: int = 2) -> DataFrame:
    """(id, block, was, now, reason): the rules that need more than the pair itself, around ``fix_reason``.

    A refused pair comes first.  After the rules of the pair: in one answer, what one fix puts in is what another takes
    out (shifts value); a term the corpus has at least ``seen`` times is changed by two letters at most (normalizes term).
    """
    rows = fixes.where("was is not null and now is not null").select("id", "block", "was", "now")
    real = rows.where("was <> now")
    chained = real.select("block", F.col("was").alias("t")).intersect(real.select("block", F.col("now").alias("t"))).withColumn("_c", F.lit(True))
    out = rows
    for side in ("was", "now"):
        out = out.join(chained.select("block", F.col("t").alias(side), F.col("_c").alias(f"_{side}")), ["block", side], "left")
    out = out.withColumn("_no", F.lit(False)) if refused is None else out.join(refused.select("was", "now", F.lit(True).alias("_no")).distinct(), ["was", "now"], "left")
    term = F.lit(False)
    if corpus is not None:
        out = out.withColumn("_term", F.lower("was")).join(corpus.groupBy(F.col("word").alias("_term")).agg(F.sum("n").alias("_n")), "_term", "left")
        bare = F.lower(F.rtrim("now", F.lit(".,:;")))
        long = rf"^[{text.LETTER}]{{5,}}$"
        term = F.col("was").rlike(long) & bare.rlike(long) & (F.levenshtein(F.lower("was"), bare, 2) >= 0) & (F.coalesce("_n", F.lit(0)) >= seen)
    shifts = F.coalesce("_was", F.lit(False)) | F.coalesce("_now", F.lit(False))
    own = fix_reason(F.col("was"), F.col("now"))
    same = (F.col("was") == F.col("now")) | same_number(F.col("was"), F.col("now"))
    reason = F.when(~same & F.coalesce("_no", F.lit(False)), "rejected by user").otherwise(F.coalesce(own, F.when(~same & shifts, "shifts value"), F.when(~same & term, "normalizes term")))
    return out.select("id", "block", "was", "now", reason.alias("reason"))


FIXES = "array<struct<was:string,now:string,reason:string>>"


@F.pandas_udf(T.StringType())
def rolled_back(answer: pd.Series, drafts: pd.Series, fixes: pd.Series) -> pd.Series:
    """The answer with refused corrections taken back: where all drafts have what was printed and every place of the
    new text is due to a correction."""

    def one(text_: str | None, printed: np.ndarray, rows: np.ndarray) -> str | None:
        if text_ is None:
            return None
        refused = [f for f in rows if f["reason"] is not None]
        due = Counter(f["now"] for f in refused)
        for f in refused:
            was, now = f["was"], f["now"]
            if now and len(printed) and all(was in d for d in printed):
                at = [i for i in pages.occurrences(text_, now) if pages.stands_alone(text_, i, i + len(now))]
                if 0 < len(at) <= due[now]:
                    text_ = text_[: at[0]] + was + text_[at[0] + len(now) :]
        return text_

    return pd.Series([one(*row) for row in zip(answer, drafts, fixes)], dtype=object)


def sanitized(blocks: DataFrame, corpus: DataFrame | None = None, refused: DataFrame | None = None) -> DataFrame:
    """(id, text, kept, rejected): every answer with its corrections judged by the rules, the refused ones taken back.

    Needs id, text_a, text_b, answer and fixes (array of was, now).  Corrections of a leading zero only are dropped.
    """
    one = blocks.where(F.col("answer").isNotNull() & (F.size("fixes") > 0))
    rows = one.select(F.col("id").alias("block"), F.posexplode("fixes").alias("pos", "f")).select("block", "pos", F.coalesce("f.was", F.lit("")).alias("was"), F.coalesce("f.now", F.lit("")).alias("now"))
    rows = rows.where(~((F.col("was") != F.col("now")) & same_number(F.col("was"), F.col("now")))).withColumn("id", F.concat_ws(":", "block", "pos"))
    judged = context_reasons(rows, refused, corpus).select("id", "reason")
    found = rows.join(judged, "id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "was", "now", "reason"))).alias("_f"))
    all_ = F.transform("_f", lambda f: F.struct(f["was"].alias("was"), f["now"].alias("now"), f["reason"].alias("reason"))).cast(FIXES)
    drafts = F.filter(F.array("text_a", "text_b"), lambda d: d.isNotNull() & (F.trim(d) != ""))
    out = one.join(found.withColumnRenamed("block", "id"), "id").withColumn("_all", all_).withColumn("text", rolled_back(F.col("answer"), drafts, F.col("_all")))
    pair = lambda f: F.struct(f["was"].alias("was"), f["now"].alias("now"))
    return out.select("id", "text", F.transform(F.filter("_all", lambda f: f["reason"].isNull()), pair).alias("kept"), F.filter("_all", lambda f: f["reason"].isNotNull()).alias("rejected"))


def worth_reporting(fixes: Column, drafts: Column, final: Column, source: Column) -> Column:
    """The corrections that a report shows: of an accepted answer, seen in all drafts and in the result, not of a dash only."""
    dash = lambda c: F.translate(c, "–—−", "---")
    kept = F.filter(fixes, lambda f: (f["was"] != f["now"]) & final.contains(f["now"]) & F.forall(drafts, lambda d: d.contains(f["was"])) & (dash(f["was"]) != dash(f["now"])))
    return F.when((source == "arbiter") & (F.size(drafts) > 0), kept).otherwise(F.slice(fixes, 1, 0))


def denied(fixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fixes whose (was, now) pair is on the list of refused pairs; NULLs never match."""
    return fixes.join(pairs.select("was", "now").distinct(), ["was", "now"], "left_semi")
