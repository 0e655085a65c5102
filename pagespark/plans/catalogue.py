"""Queries over the page and block store and the star schema, by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import answers, homoglyphs, markdown, sketches, tables, text
from ..operators import books, consensus, evaluate, events, geometry, guard, layout, pages, tablediff, vocabulary
from ..sources import files
from ..streaming import live
from . import sqlforms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# Common table expressions of the SQL side: one row per block and per page.
B = "b AS (SELECT DISTINCT ON (id) * FROM blocks ORDER BY id)"
P = (
    "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, name ORDER BY (layout_status = 'done') DESC, layout_seconds DESC NULLS LAST, "
    "printed DESC NULLS LAST, idx DESC NULLS LAST, height DESC NULLS LAST) AS rn FROM pages) WHERE rn = 1)"
)
TXT = "coalesce(final, text_a)"


def _txt():
    return F.coalesce("final", "text_a").alias("txt")


def _blocks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    need = {"final", "text_a", *cols}
    return schemas.block_rows(spark, d, *sorted(need)).select("id", *cols, _txt())


@query(
    "decision_counts",
    f"WITH {B} SELECT kind, decision, count(*) AS blocks, round(avg(cer_ab), 6) AS mean_cer FROM b GROUP BY kind, decision",
)
def decision_counts(spark, d):
    """Blocks and mean draft distance by kind and decision."""
    b = schemas.block_rows(spark, d, "kind", "decision", "cer_ab")
    return b.groupBy("kind", "decision").agg(F.count("*").alias("blocks"), F.round(F.avg("cer_ab"), 6).alias("mean_cer"))


_FREE_SQL = lambda c: sqlforms.numbers(f"regexp_replace({sqlforms.formula_form(c)}, '_\\s*\\{{[^{{}}]*\\}}|_\\s*\\\\?[\\pL\\pN_]', '', 'g')")
_COUNT_SQL = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_BALANCED_SQL = " AND ".join(f"{_COUNT_SQL('text_a', a)} = {_COUNT_SQL('text_a', b)}" for a, b in (("\\{", "\\}"), ("\\\\begin", "\\\\end"), ("\\\\left", "\\\\right")))
# Both drafts in canonical form by kind, with their distance and whether their numbers agree.
D_SQL = f"""f AS (SELECT id, kind, text_a, text_b, CASE kind WHEN 'table' THEN {sqlforms.table_form("text_a")} WHEN 'formula' THEN {sqlforms.formula_form("text_a")} ELSE {sqlforms.text_form("text_a")} END AS ca,
      CASE kind WHEN 'table' THEN {sqlforms.table_form("text_b")} WHEN 'formula' THEN {sqlforms.formula_form("text_b")} ELSE {sqlforms.text_form("text_b")} END AS cb FROM b),
    m AS (SELECT *, CASE WHEN ca = cb THEN 0.0::DOUBLE ELSE {sqlforms.distance("ca", "cb")} / greatest(length(ca), length(cb)) END AS cer, text_a = text_b OR list_sort({sqlforms.numbers("text_a")}) = list_sort({sqlforms.numbers("text_b")}) AS same,
      kind = 'formula' AND length(ca) > 0 AND {_BALANCED_SQL} AS usable, text_a = text_b OR list_sort({_FREE_SQL("text_a")}) = list_sort({_FREE_SQL("text_b")}) AS free FROM f)"""
DECIDE_SQL = """CASE WHEN kind IS NULL THEN 'nodraft' WHEN usable THEN CASE WHEN text_b IS NULL OR free THEN 'accept' ELSE 'arbiter' END WHEN text_b IS NULL OR kind = 'page' THEN 'arbiter' WHEN ca = '' AND cb = '' THEN 'arbiter'
      WHEN ca = cb THEN CASE WHEN kind = 'formula' AND NOT same THEN 'arbiter' ELSE 'accept' END WHEN kind IN ('table','formula') THEN 'arbiter' WHEN cer <= {tau} AND same THEN 'accept' ELSE 'arbiter' END"""


@query(
    "consensus_decisions",
    f"""WITH {B}, {D_SQL}, d AS (SELECT *, {DECIDE_SQL.format(tau="0.01")} AS decision FROM m)
    SELECT id, kind, decision, round(CASE WHEN decision = 'nodraft' OR text_b IS NULL OR kind = 'page' THEN NULL ELSE cer END, 6) AS cer_ab, CASE WHEN decision <> 'arbiter' THEN 'a' END AS final_source FROM d""",
)
def consensus_decisions(spark, d):
    """Both drafts compared in canonical form: decision and distance of every block."""
    b = schemas.block_rows(spark, d, "kind", "text_a", "text_b", heavy=True)
    out = consensus.decide(consensus.prepare(b))
    return out.select("id", "kind", "decision", F.round("cer_ab", 6).alias("cer_ab"), "final_source")


TAUS = [0.0, 0.005, 0.01, 0.02, 0.05]


@query(
    "threshold_sweep",
    f"""WITH {B}, g AS (SELECT unnest([0.0, 0.005, 0.01, 0.02, 0.05]::DOUBLE[]) AS tau)
    SELECT kind, tau, count(*) AS blocks, count(*) FILTER (WHERE cer_ab > tau) AS arbiter, round(count(*) FILTER (WHERE cer_ab > tau) / count(*), 4) AS share
    FROM b CROSS JOIN g WHERE cer_ab IS NOT NULL AND kind IS NOT NULL GROUP BY kind, tau""",
)
def threshold_sweep(spark, d):
    """Share of blocks over each distance threshold, from the stored distances: one pass for the whole grid."""
    b = schemas.block_rows(spark, d, "kind", "cer_ab").where("cer_ab is not null and kind is not null")
    rows = b.select("kind", "cer_ab", F.explode(F.array(*[F.lit(t) for t in TAUS])).alias("tau"))
    over = F.count_if(F.col("cer_ab") > F.col("tau"))
    return rows.groupBy("kind", "tau").agg(F.count("*").alias("blocks"), over.alias("arbiter"), F.round(over / F.count("*"), 4).alias("share"))


@query(
    "replayed_sweep",
    f"""WITH {B}, {D_SQL}, g AS (SELECT unnest([0.0, 0.005, 0.01, 0.02, 0.05]::DOUBLE[]) AS tau), d AS (SELECT kind, tau, {DECIDE_SQL.format(tau="tau")} AS decision FROM m CROSS JOIN g WHERE kind IS NOT NULL)
    SELECT kind, tau, count(*) AS blocks, count(*) FILTER (WHERE decision = 'arbiter') AS arbiter, round(count(*) FILTER (WHERE decision = 'arbiter') / count(*), 4) AS share FROM d GROUP BY kind, tau""",
)
def replayed_sweep(spark, d):
    """The same from the drafts themselves: canonical forms once, every threshold decided from them."""
    b = schemas.block_rows(spark, d, "kind", "text_a", "text_b", heavy=True)
    return consensus.sweep(consensus.prepare(b), TAUS, ["kind"])


@query(
    "digit_agreement",
    f"""WITH {B} SELECT kind, count(*) AS blocks, count(*) FILTER (WHERE list_sort({sqlforms.numbers("text_a")}) = list_sort({sqlforms.numbers("text_b")})) AS same FROM b WHERE text_a IS NOT NULL AND text_b IS NOT NULL GROUP BY kind""",
)
def digit_agreement(spark, d):
    """In how many blocks do both drafts hold the same numbers, each as often?"""
    b = schemas.block_rows(spark, d, "kind", "text_a", "text_b").where("text_a is not null and text_b is not null")
    same = text.same_multiset(text.numbers(F.col("text_a")), text.numbers(F.col("text_b")))
    return b.select("kind", same.alias("same")).groupBy("kind").agg(F.count("*").alias("blocks"), F.count_if("same").alias("same"))


@query(
    "language_vote",
    f"""WITH {B}, {P}, first AS (SELECT book, name FROM (SELECT book, name, row_number() OVER (PARTITION BY book ORDER BY idx, name) AS r FROM p) WHERE r <= 10),
    t AS (SELECT b.book, regexp_replace(b.text_a, '\\$\\$[^$]+\\$\\$|\\$[^$\\n]+\\$', ' ', 'g') AS s FROM b JOIN first f ON b.book = f.book AND b.page = f.name
      WHERE b.category IN ('Text','Title','Section-header','List-item','Caption') AND b.text_a IS NOT NULL),
    w AS (SELECT book, len(regexp_extract_all(s, '[А-Яа-яЁёІіЇїЄє]')) AS cyr, len(regexp_extract_all(s, '[A-Za-zÄÖÜäöüß]')) AS lat,
      len(regexp_extract_all(s, '[äöüßÄÖÜ]')) + len(list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ('der','die','das','und','nicht','mit','wird','ist','ein','eine'))) AS de,
      len(list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ('the','and','of','is','with','for','which','are','this'))) AS en FROM t),
    v AS (SELECT book, sum(cyr)::BIGINT AS cyr, sum(lat)::BIGINT AS lat, sum(de)::BIGINT AS de, sum(en)::BIGINT AS en FROM w GROUP BY book)
    SELECT *, CASE WHEN cyr >= lat THEN 'ru' WHEN de > en THEN 'de' WHEN en > de THEN 'en' ELSE 'ru' END AS lang FROM v""",
)
def language_vote(spark, d):
    """Language of every book from the text blocks of its first ten pages."""
    pages = schemas.page_rows(spark, d)
    r = F.row_number().over(Window.partitionBy("book").orderBy("idx", "name"))
    first = pages.select("book", F.col("name").alias("page"), r.alias("r")).where("r <= 10").drop("r")
    b = schemas.block_rows(spark, d, "book", "page", "category", "text_a").where("category in ('Text','Title','Section-header','List-item','Caption') and text_a is not null")
    plain = F.regexp_replace("text_a", r"\$\$[^$]+\$\$|\$[^$\n]+\$", " ")
    tokens = F.regexp_extract_all(F.lower(plain), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    among = lambda words: F.size(F.filter(tokens, lambda w: w.isin(*words)))
    german = [w for w in text.GERMAN.split("|") if w != "für"]
    counted = b.join(first, ["book", "page"]).select(
        "book", text.count_matches(plain, "[А-Яа-яЁёІіЇїЄє]").alias("cyr"), text.count_matches(plain, "[A-Za-zÄÖÜäöüß]").alias("lat"),
        (text.count_matches(plain, "[äöüßÄÖÜ]") + among(german)).alias("de"), among(text.ENGLISH.split("|")).alias("en"),
    )
    v = counted.groupBy("book").agg(*[F.sum(c).alias(c) for c in ("cyr", "lat", "de", "en")])
    return v.withColumn("lang", text.vote(*[F.col(c) for c in ("cyr", "lat", "de", "en")]))


SIG_SQL = f"trim(regexp_replace(regexp_replace(lower({sqlforms.normal(TXT)}), '[0-9]+', '', 'g'), '\\s+', ' ', 'g'))"
BAND_SQL = "bbox IS NOT NULL AND (bbox.y2 <= 0.08 * height OR bbox.y1 >= 0.92 * height)"


def _sig():
    return text.signature(F.col("txt"))


def _placed(spark, d):
    b = _blocks(spark, d, "book", "page", "ord", "category", "bbox", "parent")
    return layout.with_pages(b, schemas.page_rows(spark, d)).withColumn("sig", _sig())


@query(
    "running_signatures",
    f"""WITH {B}, {P}, j AS (SELECT b.*, p.height, {SIG_SQL} AS sig FROM b JOIN p ON b.book = p.book AND b.page = p.name),
    r AS (SELECT book, page, sig, floor((bbox.y1 + bbox.y2) / 2) AS mid, height FROM j WHERE category IN ('Text','Section-header','Title') AND {BAND_SQL} AND length(sig) BETWEEN 4 AND 80)
    SELECT book, sig, count(DISTINCT page) AS pages FROM r GROUP BY book, sig
    HAVING count(DISTINCT page) >= 3 AND greatest(max(mid) - avg(mid), avg(mid) - min(mid)) <= 0.03 * max(height)""",
)
def running_signatures(spark, d):
    """Body lines in the edge bands that return at one height."""
    return layout.repeated_signatures(_placed(spark, d))


CAPTION_SQL = r"regexp_matches(txt, '(?i)^\s*(?:Таблица|Табл\.|Продолжение|Окончание|Рис\.|Table|Tabelle|Fig\.)')"
BARE_SQL, EDGE_SQL = r"'^\s*[-—–]?\s*([0-9]{1,4})\s*[-—–]?\s*$'", r"'^([0-9]{1,4})\s+\S|\S\s+([0-9]{1,4})$'"


@query(
    "header_actions",
    f"""WITH {B}, {P}, j AS (SELECT b.id, b.book, b.page, b.category, b.bbox, p.height, {TXT} AS txt, {SIG_SQL} AS sig FROM b JOIN p ON b.book = p.book AND b.page = p.name),
    r AS (SELECT book, page, sig, floor((bbox.y1 + bbox.y2) / 2) AS mid, height FROM j WHERE category IN ('Text','Section-header','Title') AND {BAND_SQL} AND length(sig) BETWEEN 4 AND 80),
    s AS (SELECT book, sig FROM r GROUP BY book, sig HAVING count(DISTINCT page) >= 3 AND greatest(max(mid) - avg(mid), avg(mid) - min(mid)) <= 0.03 * max(height)),
    k AS (SELECT j.id, category IN ('Page-header','Page-footer') AS edge, {CAPTION_SQL} AS cap, category IN ('Text','Section-header','Title') AND {BAND_SQL} AND (s.sig IS NOT NULL OR regexp_matches(txt, {BARE_SQL})) AS body
      FROM j LEFT JOIN s ON j.book = s.book AND j.sig = s.sig)
    SELECT id, CASE WHEN cap AND edge THEN 'caption' ELSE 'drop' END AS action FROM k WHERE (cap AND edge) OR (NOT cap AND (edge OR body))""",
)
def header_actions(spark, d):
    """Blocks to drop as running lines or numbers, and captions taken for headers."""
    b = _placed(spark, d)
    return layout.header_blocks(b, layout.repeated_signatures(b))


@query(
    "page_number_chain",
    f"""WITH {P}, pos AS (SELECT book, name, idx, try_cast(printed AS INTEGER) AS num, row_number() OVER (PARTITION BY book ORDER BY idx, name) AS pos FROM p),
    c AS (SELECT *, lag(pos) OVER o AS lp, lag(num) OVER o AS ln, lead(pos) OVER o AS np, lead(num) OVER o AS nn FROM pos WHERE num IS NOT NULL WINDOW o AS (PARTITION BY book ORDER BY pos)),
    ok AS (SELECT * FROM c WHERE coalesce(abs(lp - pos) <= 3 AND ln - num = lp - pos, false) OR coalesce(abs(np - pos) <= 3 AND nn - num = np - pos, false)),
    f AS (SELECT book, pos, num AS kept FROM (SELECT *, row_number() OVER (PARTITION BY book, num ORDER BY pos) AS rn FROM ok) WHERE rn = 1),
    j AS (SELECT pos.*, f.kept, CASE WHEN f.kept IS NOT NULL THEN pos.pos END AS kp FROM pos LEFT JOIN f ON pos.book = f.book AND pos.pos = f.pos),
    s AS (SELECT *, last_value(kept IGNORE NULLS) OVER b AS pk, last_value(kp IGNORE NULLS) OVER b AS pp, first_value(kept IGNORE NULLS) OVER a AS nk, first_value(kp IGNORE NULLS) OVER a AS np FROM j
      WINDOW b AS (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY book ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT book, name, idx, num, CAST(coalesce(kept, CASE WHEN nk - pk = np - pp THEN pk + pos - pp END) AS VARCHAR) AS printed FROM s""",
)
def page_number_chain(spark, d):
    """Printed page numbers that their neighbours bear out, gaps filled."""
    pages = schemas.page_rows(spark, d).select("book", "name", "idx", F.expr("try_cast(printed as int)").alias("num"))
    return layout.number_chain(pages)


@query(
    "number_candidates",
    f"""WITH {B}, t AS (SELECT book, page, {TXT} AS txt FROM b WHERE {TXT} IS NOT NULL),
    c AS (SELECT book, page, CASE WHEN regexp_matches(txt, {BARE_SQL}) THEN CAST(regexp_extract(txt, {BARE_SQL}, 1) AS INTEGER)
      WHEN regexp_matches(trim(txt, ' '), {EDGE_SQL}) THEN 100000 + CAST(concat(regexp_extract(trim(txt, ' '), {EDGE_SQL}, 1), regexp_extract(trim(txt, ' '), {EDGE_SQL}, 2)) AS INTEGER) END AS v FROM t WHERE NOT {CAPTION_SQL})
    SELECT book, page, CAST(min(v) % 100000 AS INTEGER) AS num FROM c WHERE v IS NOT NULL GROUP BY book, page""",
)
def number_candidates(spark, d):
    """Best printed-number candidate among the blocks of every page."""
    return layout.number_candidates(_blocks(spark, d, "book", "page").where("txt is not null"))


WORDS_SQL = (
    "list_filter(regexp_extract_all(regexp_replace(regexp_replace({t}, '<[^<>]*>|\\$[^$]*\\$', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+(?:-[ \\t]*\\r?\\n?[ \\t]*[\\p{{L}}\\p{{N}}_]+)+', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '\\p{{L}}+'))"
)


@query(
    "page_stitches",
    f"""WITH {B}, {P}, t AS (SELECT id, book, page, ord, category, {TXT} AS txt FROM b WHERE parent IS NULL AND {TXT} IS NOT NULL AND category NOT IN ('Page-header','Page-footer')),
    pos AS (SELECT book, name AS page, row_number() OVER (PARTITION BY book ORDER BY idx, name) AS pos FROM p),
    f AS (SELECT book, page, id, category, txt FROM (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY ord, id) AS r FROM t) WHERE r = 1),
    l AS (SELECT book, page, id, category, txt FROM (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY ord DESC, id DESC) AS r FROM t WHERE category <> 'Footnote') WHERE r = 1),
    e AS (SELECT f.book, f.page, f.id, f.category, f.txt, l.id AS lid, l.category AS lcat, l.txt AS ltxt, pos.pos FROM f JOIN pos ON f.book = pos.book AND f.page = pos.page LEFT JOIN l ON f.book = l.book AND f.page = l.page),
    v AS (SELECT DISTINCT book, lower(unnest({WORDS_SQL.format(t=TXT)})) AS word FROM b WHERE {TXT} IS NOT NULL),
    w AS (SELECT *, lag(lid) OVER o AS pid, lag(lcat) OVER o AS pcat, lag(ltxt) OVER o AS ptxt, pos - lag(pos) OVER o AS gap FROM e WINDOW o AS (PARTITION BY book ORDER BY pos))
    SELECT w.book, page, id, pid AS join_to, CASE WHEN v.word IS NOT NULL THEN joined END AS hyphen FROM (SELECT *, CASE WHEN regexp_matches(ptxt, '\\p{{L}}-\\s*$') THEN concat(regexp_extract(ptxt, '(\\p{{L}}+)-\\s*$', 1), regexp_extract(ltrim(txt), '^(\\p{{Ll}}+)', 1)) END AS joined FROM w) w
    LEFT JOIN v ON v.book = w.book AND v.word = lower(w.joined) WHERE gap = 1 AND pcat = 'Text' AND category = 'Text' AND regexp_matches(ltrim(txt), '^\\p{{Ll}}') AND NOT regexp_matches(ptxt, '[.!?…:;][)»”"'']* *$') AND NOT regexp_matches(ltrim(txt), '^[а-яa-z]\\)')""",
)
def page_stitches(spark, d):
    """Paragraphs that go on over the end of a page."""
    b = _blocks(spark, d, "book", "page", "ord", "category", "parent").where("parent is null and txt is not null and category not in ('Page-header','Page-footer')")
    return layout.stitches(b, schemas.page_rows(spark, d), vocabulary.vocabulary(_blocks(spark, d, "book")))


@query(
    "table_continuations",
    rf"""WITH {B}, t AS (SELECT id, book, page, ord, category, CASE WHEN category IN ('Caption','Text','Section-header') THEN nullif(regexp_replace(regexp_extract({TXT}, '(?i)^\s*(?:Продолжение|Окончание|Continuation of|Fortsetzung)\s+(?:табл(?:\.|ицы)?|Table|der Tafel|Tafel)?\s*([IVXLC]+\s*\.\s*[0-9]+|[0-9]+(?:\.[0-9]+)?)', 1), '\s+', '', 'g'), '') END AS ref FROM b WHERE parent IS NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY ord, id) AS n FROM t),
    l AS (SELECT x.id, max(y.n) AS ln FROM n x JOIN n y ON x.book = y.book AND x.page = y.page AND y.n BETWEEN x.n - 3 AND x.n - 1 AND y.ref IS NOT NULL WHERE x.category = 'Table' GROUP BY x.id),
    e AS (SELECT x.id, coalesce(max(y.n), 0) AS tn FROM n x LEFT JOIN n y ON x.book = y.book AND x.page = y.page AND y.n < x.n AND y.category = 'Table' WHERE x.category = 'Table' GROUP BY x.id)
    SELECT l.id, y.ref AS continues FROM l JOIN e ON l.id = e.id JOIN n x ON x.id = l.id JOIN n y ON y.book = x.book AND y.page = x.page AND y.n = l.ln WHERE e.tn < l.ln""",
)
def table_continuations(spark, d):
    """Tables announced as the continuation of another."""
    return layout.continuations(_blocks(spark, d, "book", "page", "ord", "category", "parent").where("parent is null"))


@query(
    "book_contents",
    f"""WITH {B}, {P}, h AS (SELECT book, page, ord, id, regexp_replace(trim({TXT}), '\\s+', ' ', 'g') AS title FROM b WHERE category IN ('Title','Section-header') AND trim({TXT}) <> ''),
    s AS (SELECT h.*, p.idx, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s\\p{{Z}}-]', '', 'g'), '[\\s\\p{{Z}}]+', '-', 'g'), '-') AS slug FROM h LEFT JOIN p ON p.book = h.book AND p.name = h.page)
    SELECT book, page, ord, id, title, slug, row_number() OVER (PARTITION BY book, slug ORDER BY idx NULLS LAST, page, ord, id) AS nth FROM s""",
)
def book_contents(spark, d):
    """Headings of every book with anchor names."""
    return layout.contents(_blocks(spark, d, "book", "page", "ord", "category"), schemas.page_rows(spark, d))


@query(
    "page_markdown",
    f"""WITH {B}, {P}, t AS (SELECT b.book, b.page, p.idx, ord, id, category, trim({TXT}, ' ') AS s FROM b JOIN p ON b.book = p.book AND b.page = p.name
      WHERE category NOT IN ('Page-header','Page-footer','Picture') AND parent IS NULL AND trim({TXT}, ' ') <> '')
    SELECT book, page, idx, string_agg(CASE category WHEN 'Title' THEN '# ' || s WHEN 'Section-header' THEN '## ' || s WHEN 'List-item' THEN '- ' || s WHEN 'Caption' THEN '*' || s || '*'
      WHEN 'Formula' THEN CASE WHEN starts_with(s, '$$') THEN s ELSE '$$' || s || '$$' END ELSE s END, chr(10) || chr(10) ORDER BY ord, id) AS markdown FROM t GROUP BY book, page, idx""",
)
def page_markdown(spark, d):
    """Every page as Markdown in reading order."""
    return layout.assemble(_blocks(spark, d, "book", "page", "ord", "category", "parent"), schemas.page_rows(spark, d))


@query(
    "footnote_numbers",
    f"""WITH {B}, {P}, t AS (SELECT id, b.book, page, ord, p.idx, regexp_extract({TXT}, '^\\s*(\\*{{1,3}}|[¹²³⁴⁵⁶⁷⁸⁹]+|[0-9]{{1,2}}\\))', 1) AS mark FROM b LEFT JOIN p ON p.book = b.book AND p.name = b.page WHERE category = 'Footnote')
    SELECT id, book, page, mark, row_number() OVER (PARTITION BY book ORDER BY idx NULLS LAST, page, ord, id) AS number FROM t WHERE mark <> ''""",
)
def footnote_numbers(spark, d):
    """Footnotes with their mark and running number."""
    return layout.footnotes(_blocks(spark, d, "book", "page", "ord", "category"), schemas.page_rows(spark, d))


_REF_SQL = "(?:^|[^\\p{{L}}\\p{{N}}_.])(?:[Рр]ис\\.|[Рр]исун[а-яё]+|[Тт]абл\\.|[Тт]аблиц[а-яё]+|[Гг]л\\.|[Гг]лав[аеуы])\\s*({n}\\.\\s?[0-9]+)"


@query(
    "roman_chapters",
    f"""WITH {B}, x AS (SELECT book, {TXT} AS t FROM b WHERE {TXT} IS NOT NULL AND book IS NOT NULL AND category IN ('Text','Caption','List-item','Section-header','Title','Footnote','Table')),
    r AS (SELECT book, 'r' AS k, unnest(regexp_extract_all(t, '{_REF_SQL.format(n="[IVX]+")}', 1)) AS v FROM x), a AS (SELECT book, 'a' AS k, unnest(regexp_extract_all(t, '{_REF_SQL.format(n="[0-9]+")}', 1)) AS v FROM x),
    u AS (SELECT DISTINCT book, k, regexp_replace(v, '\\s', '', 'g') AS v FROM (SELECT * FROM r UNION ALL SELECT * FROM a)), g AS (SELECT book, count(*) FILTER (WHERE k = 'r') AS roman, count(*) FILTER (WHERE k = 'a') AS arabic,
      coalesce(bool_or(k = 'r' AND regexp_matches(v, '^[IVX]*[VX]')), false) AS vx FROM u WHERE NOT (k = 'a' AND regexp_matches(v, '^1+\\.')) GROUP BY book)
    SELECT book, roman, arabic, roman > 0 AND vx AND roman >= 3 * arabic AS is_roman FROM g""",
)
def roman_chapters(spark, d):
    """Books that number their chapters in Roman numerals."""
    return layout.roman_books(_blocks(spark, d, "book", "category"))


@query("roman_references")
def roman_references(spark, d):
    """Texts of books with Roman chapters in which a reference had a 1 for an I."""
    b = _blocks(spark, d, "book", "category")
    return layout.roman_references(b, layout.roman_books(b))


@query(
    "vocabulary",
    f"WITH {B}, w AS (SELECT book, lower(unnest({WORDS_SQL.format(t=TXT)})) AS word FROM b WHERE {TXT} IS NOT NULL) SELECT book, word, count(*) AS n FROM w GROUP BY book, word",
)
def book_vocabulary(spark, d):
    """Whole words of every book."""
    return vocabulary.vocabulary(_blocks(spark, d, "book"))


@query(
    "frequent_words",
    f"""WITH {B}, w AS (SELECT book, lower(unnest({WORDS_SQL.format(t=TXT)})) AS word FROM b WHERE {TXT} IS NOT NULL), c AS (SELECT book, word, count(*) AS n FROM w GROUP BY book, word),
    r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, word) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""",
)
def frequent_words(spark, d):
    """The ten most frequent words of every book (a report)."""
    return vocabulary.repeated_top(vocabulary.vocabulary(_blocks(spark, d, "book")))


@query(
    "unknown_words",
    f"""WITH {B}, w AS (SELECT book, lower(unnest({WORDS_SQL.format(t=TXT)})) AS word FROM b WHERE {TXT} IS NOT NULL), c AS (SELECT book, word, count(*) AS n FROM w GROUP BY book, word),
    dict AS (SELECT DISTINCT lower(unnest({WORDS_SQL.format(t='text')})) AS word FROM documents WHERE text IS NOT NULL)
    SELECT word, sum(n)::BIGINT AS n, count(*) AS books FROM c WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM dict) GROUP BY word ORDER BY n DESC, word LIMIT 30""",
)
def unknown_words(spark, d):
    """The thirty most frequent words that the document corpus lacks (a report)."""
    docs = schemas.scan(spark, d, "documents", F.col("text").alias("txt")).where("txt is not null")
    dictionary = docs.select(F.explode(vocabulary.whole_words(F.col("txt"))).alias("word")).distinct()
    return vocabulary.unknown_words(vocabulary.vocabulary(_blocks(spark, d, "book")), dictionary)


@query(
    "line_break_joins",
    f"""WITH {B}, x AS (SELECT id, book, {TXT} AS t FROM b WHERE {TXT} IS NOT NULL),
    w AS (SELECT book, lower(unnest({WORDS_SQL.format(t='t')})) AS word FROM x), v AS (SELECT book, word, count(*) AS n FROM w GROUP BY book, word),
    soft AS (SELECT id, book, unnest(regexp_extract_all(t, '(?:\\p{{L}}+)-[ \\t]*\\r?\\n[ \\t]*(?:\\p{{Ll}}+)')) AS f, true AS soft FROM x),
    runs AS (SELECT id, book, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_-]+')) AS f FROM x), inl AS (SELECT id, book, f, false AS soft FROM runs WHERE regexp_full_match(f, '\\p{{L}}+-\\p{{Ll}}+')),
    c AS (SELECT book, lower(f) AS form, count(*) AS n FROM inl GROUP BY ALL HAVING count(*) >= 2),
    s AS (SELECT DISTINCT id, book, soft, regexp_extract(f, '^(\\p{{L}}+)-', 1) AS "left", regexp_extract(f, '-\\s*(\\p{{L}}+)$', 1) AS "right" FROM (SELECT * FROM soft UNION ALL SELECT * FROM inl))
    SELECT DISTINCT s.id, s.book, s."left", s."right", lower(s."left" || s."right") AS joined, v.n FROM s JOIN v ON v.book = s.book AND v.word = lower(s."left" || s."right")
    LEFT JOIN c ON c.book = s.book AND c.form = lower(s."left" || '-' || s."right") WHERE s.soft OR c.form IS NULL""",
)
def line_break_joins(spark, d):
    """Words broken by a hyphen that the same book has whole."""
    b = _blocks(spark, d, "book")
    return vocabulary.line_breaks(b, vocabulary.vocabulary(b), vocabulary.compounds(b))


@query(
    "looping_drafts",
    f"""WITH {B}, t AS (SELECT id, right(text_b, 600) AS t FROM b WHERE length(text_b) >= 600)
    SELECT id FROM t WHERE len(list_filter(range(1, 201), lambda k: substr(t, CAST(k + 1 AS BIGINT), CAST(600 - k AS BIGINT)) = substr(t, 1, CAST(600 - k AS BIGINT)))) > 0""",
)
def looping_drafts(spark, d):
    """Drafts whose end is one fragment over and over."""
    b = schemas.block_rows(spark, d, "text_b", heavy=True).where("length(text_b) >= 600")
    return b.where(text.looping(F.col("text_b"))).select("id")


@query(
    "plain_text_sizes",
    f"""WITH {B}, t AS (SELECT category, regexp_replace(regexp_replace({TXT}, '(?i)<br\\b[^>]*>', ' ', 'g'), '(?i)</?(?:{text.INLINE_TAGS})\\b[^>]*>', '', 'g') AS s FROM b WHERE {TXT} IS NOT NULL)
    SELECT category, count(*) AS blocks, sum(length(s))::BIGINT AS chars, max(length(s)) AS longest FROM t GROUP BY category""",
)
def plain_text_sizes(spark, d):
    """Characters without inline markup, by category."""
    s = text.strip_tags(F.col("txt"))
    b = _blocks(spark, d, "category").where("txt is not null").select("category", F.length(s).alias("n"))
    return b.groupBy("category").agg(F.count("*").alias("blocks"), F.sum("n").alias("chars"), F.max("n").alias("longest"))


@query(
    "html_table_sizes",
    f"""WITH {B} SELECT id, len(regexp_extract_all({TXT}, '(?i)<tr[ >]')) AS n_rows, len(regexp_extract_all({TXT}, '(?i)<t[dh][ >]')) AS n_cells FROM b WHERE category = 'Table' AND regexp_matches({TXT}, '(?i)<table')""",
)
def html_table_sizes(spark, d):
    """Rows and cells of every table, from the parsed cells."""
    b = _blocks(spark, d, "category").where((F.col("category") == "Table") & F.col("txt").rlike("(?i)<table"))
    t = b.select("id", tables.parse_table("txt").alias("t"))
    return t.select("id", F.size("t").alias("n_rows"), F.size(F.flatten("t")).alias("n_cells"))


# Rows and cells of tables that are HTML in one line, as SQL reads them.
T_SQL = (
    "t AS (SELECT id, list_transform(regexp_extract_all(txt, '(?i)<tr[^>]*>(.*?)</tr>', 1), lambda r: regexp_extract_all(r, '(?i)<t[dh][^>]*>.*?</t[dh]>')) AS rows "
    f"FROM (SELECT id, {TXT} AS txt FROM b WHERE category = 'Table' AND regexp_matches({TXT}, '(?i)<table'))), "
    "c AS (SELECT id, list_transform(rows, lambda r: list_transform(r, lambda x: {'text': trim(regexp_replace(regexp_replace(x, '(?i)<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), ' '), "
    "'span': coalesce(try_cast(regexp_extract(x, '(?i)^<t[dh][^>]*colspan=\"?([0-9]+)', 1) AS INTEGER), 1)})) AS rows FROM t WHERE len(rows) > 0)"
)
SINGLE_SQL = "len(r) >= 3 AND len(list_filter(r, lambda x: x.span > 1)) = 0 AND len(list_filter(r[2:], lambda x: x.text <> '')) = 1"


def _tables(spark, d):
    b = _blocks(spark, d, "category").where((F.col("category") == "Table") & F.col("txt").rlike("(?i)<table"))
    return b.select("id", tables.parse_table("txt").alias("t")).where("size(t) > 0")


@query(
    "table_findings",
    f"""WITH {B}, {T_SQL}, w AS (SELECT id, list_max(list_transform(rows, lambda r: list_sum(list_transform(r, lambda x: x.span)))) AS columns, len(list_filter(rows, lambda r: {SINGLE_SQL})) AS single_values,
      len(list_filter(rows, lambda r: len(r) >= 4 AND len(list_filter(r, lambda x: x.span > 1)) = 0 AND regexp_matches(array_to_string(list_transform(r[2:], lambda x: CASE WHEN regexp_full_match(x.text, '[-–—−]') THEN 'd' WHEN regexp_matches(x.text, '[–—]') THEN 'r' ELSE 'x' END), ''), 'ddr|rdd|drd'))) AS dash_rows,
      rows[-1] AS last, list_max(list_transform(rows[:-2], lambda r: len(r))) AS widest FROM c)
    SELECT id, CAST(columns AS INTEGER) AS columns, CAST(single_values AS INTEGER) AS single_values, CAST(dash_rows AS INTEGER) AS dash_rows,
      CASE WHEN len(last) = 1 AND coalesce(widest, 0) > 1 AND regexp_matches(last[1].text, '^\\s*(?:\\*{{1,3}}|[¹²³⁴⁵⁶⁷⁸⁹]|Примечани|Note)') THEN last[1].text END AS note FROM w""",
)
def table_findings(spark, d):
    """Columns, single-value rows, invented dashes and footnotes of every table."""
    c = F.col("t")
    return _tables(spark, d).select("id", tables.width(c).alias("columns"), F.size(tables.single_values(c)).alias("single_values"), F.size(tables.invented_dashes(c)).alias("dash_rows"), tables.footnote_rows(c).alias("note"))


@query(
    "table_spans",
    f"""WITH {B}, {T_SQL}, r AS (SELECT id, unnest(rows) AS r, generate_subscripts(rows, 1) - 1 AS row FROM c)
    SELECT id, CAST(row AS INTEGER) AS row, left(r[1].text, 40) AS label, list_filter(r[2:], lambda x: x.text <> '')[1].text AS value, CAST(len(r) - 1 AS INTEGER) AS columns FROM r WHERE {SINGLE_SQL}""",
)
def table_spans(spark, d):
    """Rows whose one value was spread over the empty cells beside it."""
    t = _tables(spark, d).select("id", F.posexplode("t").alias("row", "before"), tables.spread_singles(F.col("t")).alias("after")).withColumn("r", F.get("after", F.col("row")))
    changed = t.where(F.size("before") != F.size("r"))
    return changed.select("id", "row", F.left(F.trim(F.col("r")[0]["text"]), F.lit(40)).alias("label"), F.trim(F.col("r")[1]["text"]).alias("value"), F.col("r")[1]["colspan"].alias("columns"))


@query("tidy_tables")
def tidy_tables(spark, d):
    """Tables that change when single values are spread and footnotes moved out: their HTML and the footnotes."""
    t = _tables(spark, d).withColumn("own", tables.html_of(F.col("t"))).withColumn("notes", tables.notes(F.col("t")))
    out = t.withColumn("html", tables.html_of(tables.spread_singles(tables.without_notes(F.col("t")))))
    return out.where("html <> own").select("id", "html", "notes")


@query("table_likeness")
def table_likeness(spark, d):
    """Tree likeness of the two drafts of every table, with and without the cell texts."""
    b = schemas.block_rows(spark, d, "category", "text_a", "text_b", heavy=True).where("category = 'Table' and text_a is not null and text_b is not null")
    return b.select("id", F.round(tables.teds("text_b", "text_a"), 6).alias("teds"), F.round(tables.teds_structure("text_b", "text_a"), 6).alias("teds_structure"))


@query("draft_guard")
def draft_guard(spark, d):
    """Drafts that hold lines or tables of other blocks of the page, without them."""
    return guard.guarded(schemas.block_rows(spark, d, "book", "page", "kind", "parent", "drafts_status", "text_a", "text_b"))


_FORM_SQL = lambda c: f"CASE kind WHEN 'table' THEN {sqlforms.table_form(c)} WHEN 'formula' THEN {sqlforms.formula_form(c)} ELSE {sqlforms.text_form(c)} END"
_LOOPS_SQL = "(length({c}) >= 600 AND len(list_filter(range(1, 201), lambda k: substr(right({c}, 600), CAST(k + 1 AS BIGINT), CAST(600 - k AS BIGINT)) = substr(right({c}, 600), 1, CAST(600 - k AS BIGINT)))) > 0)"
_LETTERS_SQL = "regexp_extract_all(regexp_replace({c}, '<[^>]*>|\\$[^$]*\\$', ' ', 'g'), '\\p{{L}}+')"
_KEPT_SQL = ", ".join(f"'{w}'" for w in consensus.KEPT_LATIN)
_LATIN_SQL = f"(regexp_full_match(w, '[A-Za-z]{{3,}}') AND NOT regexp_full_match(w, '[IVXLCDM]+') AND lower(w) NOT IN ({_KEPT_SQL}))"


@query(
    "judged_answers",
    f"""WITH {B}, x AS (SELECT id, coalesce(kind, '') AS kind, text_a, text_b, arbiter_text AS answer, arbiter_error AS error, nullif(trim(coalesce(text_a, ''), ' '), '') IS NOT NULL AS has_a, nullif(trim(coalesce(text_b, ''), ' '), '') IS NOT NULL AS has_b,
      CASE WHEN kind = 'table' THEN regexp_replace(arbiter_text, '<img\\b[^>]*>', '', 'g') ELSE arbiter_text END AS bare FROM b WHERE arbiter_status IN ('done','rejected','failed')),
    y AS (SELECT *, {_FORM_SQL("bare")} AS ans, CASE WHEN has_a THEN {_FORM_SQL("text_a")} END AS fa, CASE WHEN has_b THEN {_FORM_SQL("text_b")} END AS fb, NOT (has_a AND NOT {_LOOPS_SQL.format(c="text_a")}) AND has_b AS use_b,
      list_transform(list_concat(CASE WHEN has_a THEN {_LETTERS_SQL.format(c="text_a")} ELSE [] END, CASE WHEN has_b THEN {_LETTERS_SQL.format(c="text_b")} ELSE [] END), lambda q: lower(q)) AS known, {_LETTERS_SQL.format(c="answer")} AS words FROM x),
    z AS (SELECT *, CASE WHEN kind <> 'formula' THEN list_filter(words, lambda w: ({_LATIN_SQL} OR (regexp_matches(w, '[А-Яа-яЁё]') AND regexp_matches(w, '[A-Za-z]'))) AND NOT list_contains(known, lower(w)))[1] END AS script,
      CASE WHEN fa IS NOT NULL AND ans IS NOT NULL THEN {sqlforms.distance("ans", "fa")} END AS da, CASE WHEN fb IS NOT NULL AND ans IS NOT NULL THEN {sqlforms.distance("ans", "fb")} END AS db FROM y),
    n AS (SELECT *, CASE WHEN db IS NULL OR da < db OR (da = db AND fa <= fb) THEN da ELSE db END AS d, CASE WHEN db IS NULL OR da < db OR (da = db AND fa <= fb) THEN fa ELSE fb END AS t FROM z),
    r AS (SELECT *, CASE WHEN script IS NULL THEN d / greatest(length(ans), length(t), 1) END AS cer, greatest(0.15::DOUBLE * length(t), 3.0) AS budget FROM n),
    q AS (SELECT *, CASE WHEN script IS NOT NULL THEN 'script changed: ' || script WHEN d > budget THEN 'cer ' || format('{{:.3f}}', round(cer, 3)) || ': ' || d || ' chars > ' || CAST(round_even(budget, 0) AS BIGINT) END AS reason, CASE WHEN use_b THEN text_b ELSE text_a END AS ftext,
      CASE WHEN use_b THEN 'fallback_b' ELSE 'fallback_a' END AS fsource, trim(answer, ' ') = '' AS blank, list_sort(list_distinct(list_filter(words, lambda w: {_LATIN_SQL}))) AS latin,
      CASE WHEN len(regexp_extract_all(answer, '\\p{{L}}')) > 0 THEN len(regexp_extract_all(answer, '[А-Яа-яЁё]')) / len(regexp_extract_all(answer, '\\p{{L}}')) ELSE 1.0 END AS cyr FROM r)
    SELECT id, CASE WHEN error IS NOT NULL OR answer IS NULL THEN 'failed' WHEN NOT has_a AND NOT has_b THEN CASE WHEN blank THEN 'failed' ELSE 'done' END WHEN reason IS NULL OR (coalesce(trim(ftext, ' ') = '', true) AND NOT blank) THEN 'done' ELSE 'rejected' END AS status,
      CASE WHEN error IS NOT NULL OR answer IS NULL THEN fsource WHEN (NOT has_a AND NOT has_b) OR reason IS NULL OR (coalesce(trim(ftext, ' ') = '', true) AND NOT blank) THEN 'arbiter' ELSE fsource END AS source,
      CASE WHEN error IS NULL AND answer IS NOT NULL AND (has_a OR has_b) THEN round(cer, 6) END AS cer,
      CASE WHEN error IS NOT NULL OR answer IS NULL THEN coalesce(nullif(error, ''), 'no answer') WHEN NOT has_a AND NOT has_b THEN CASE WHEN blank THEN 'empty answer, no drafts' ELSE 'unverified: no drafts' || CASE WHEN kind = 'formula' THEN '' ELSE CASE WHEN len(latin) > 0 THEN '; latin: ' || array_to_string(latin, ', ') ELSE '' END
        || CASE WHEN cyr < 0.5 THEN '; cyrillic share ' || format('{{:.2f}}', cyr) ELSE '' END END END WHEN reason IS NULL THEN NULL WHEN coalesce(trim(ftext, ' ') = '', true) AND NOT blank THEN 'kept: fallback empty: ' || reason ELSE reason END AS note FROM q""",
)
def judged_answers(spark, d):
    """Every stored answer judged against its drafts."""
    b = schemas.block_rows(spark, d, "kind", "text_a", "text_b", "arbiter_text", "arbiter_error", "arbiter_status", heavy=True).where("arbiter_status in ('done','rejected','failed')")
    j = consensus.judge(b.withColumnRenamed("arbiter_text", "answer").withColumnRenamed("arbiter_error", "error"))
    return j.select("id", "verdict.status", "verdict.source", F.round("verdict.cer", 6).alias("cer"), "verdict.note")


# What the rules of corrections look at, as SQL of one side.
_L_SQL = "A-Za-zА-Яа-яЁё"
_NOSCRIPT_SQL = f"translate(regexp_replace(regexp_replace(regexp_replace({{c}}, '(?s)<(?:sub|sup)>.*?</(?:sub|sup)>', '', 'g'), '[\\^_]\\{{{{[^{{{{}}}}]*\\}}}}|[\\^_].', '', 'g'), '<[^<>]*>', '', 'g'), '{consensus.SCRIPT}', '')"
_LOOKS_SQL = f"translate(translate(regexp_replace({{c}}, '<[^<>]*>', '', 'g'), '{consensus.SCRIPT}', '01234567890123456789'), '{consensus.CONFUSED}', '{consensus.CONFUSED_AS}')"
_SIGNS_SQL = lambda c: f"regexp_extract_all({sqlforms.unescaped(f"regexp_replace({c}, '</?[A-Za-z][^<>]*>', '', 'g')")}, '[{consensus.RELATIONS}]')"
_INDEX_SQL = "len(regexp_extract_all(replace({c}, '⁻', ''), '[0-9](?:<sub>[-−+]?[0-9]+</sub>|<sup>[-−+]?[0-9]+</sup>|[₀-₉⁰-⁹]+)'))"
_BARE_SQL = "regexp_replace({c}, '(?s)<(?:sub|sup)>.*?</(?:sub|sup)>', ' ', 'g')"
_ELEMENTS_SQL = ", ".join(f"'{e}'" for e in consensus.ELEMENTS)
_COUNTED_SQL = lambda c: (
    f"len(list_filter(regexp_extract_all({_BARE_SQL.format(c=c)}, '[{_L_SQL}]+'), lambda e: length(e) = 2 AND e IN ({_ELEMENTS_SQL}))) + len(list_filter(regexp_extract_all({_BARE_SQL.format(c=c)}, '%\\s*([A-Z])(?:[^{_L_SQL}]|$)', 1), lambda e: length(e) = 1 AND e IN ({_ELEMENTS_SQL})))"
)
_TWICE_SQL = lambda c: (
    f"len(list_filter(range(1, len(string_split({c}, ','))), lambda i: regexp_extract(string_split({c}, ',')[i], '(?:^|[^\\p{{L}}\\p{{N}}_])([{_L_SQL}]{{3,}})$', 1) <> '' AND regexp_matches(string_split({c}, ',')[i + 1], '^\\s*' || regexp_extract(string_split({c}, ',')[i], '(?:^|[^\\p{{L}}\\p{{N}}_])([{_L_SQL}]{{3,}})$', 1) || '(?:[^\\p{{L}}\\p{{N}}_]|$)'))) > 0"
)
_FRACTION_SQL = "regexp_extract(trim({c}, ' '), '^0?([.,][0-9]+)$', 1)"
_DOUBLED_SQL = " OR ".join(f"(length(now) - length(replace(now, '{op * 2}', ''))) > (length(was) - length(replace(was, '{op * 2}', '')))" for op in consensus.DOUBLED)
_CYR_LAT_SQL = f"translate({{c}}, '{text.CYRILLIC_TWINS}', '{text.LATIN_TWINS}')"


@query(
    "fix_reasons",
    f"""WITH {B}, j AS (SELECT DISTINCT ON (id) * FROM fixes ORDER BY id), f AS (SELECT id, block, was, now FROM j WHERE was IS NOT NULL AND now IS NOT NULL), refused AS (SELECT DISTINCT was, now FROM j WHERE state = 'reverted'),
    w AS (SELECT lower(unnest({WORDS_SQL.format(t=TXT)})) AS word FROM b WHERE {TXT} IS NOT NULL), corpus AS (SELECT word, count(*) AS n FROM w GROUP BY word),
    chained AS (SELECT block, was AS t FROM f WHERE was <> now INTERSECT SELECT block, now FROM f WHERE was <> now),
    x AS (SELECT f.*, f.was = f.now OR ({_FRACTION_SQL.format(c="f.was")} <> '' AND {_FRACTION_SQL.format(c="f.was")} = {_FRACTION_SQL.format(c="f.now")}) AS same, r.was IS NOT NULL AS denied, EXISTS (SELECT 1 FROM chained c WHERE c.block = f.block AND c.t IN (f.was, f.now)) AS shifts,
      trim({_NOSCRIPT_SQL.format(c="f.was")}, ' ') AS pw, trim({_NOSCRIPT_SQL.format(c="f.now")}, ' ') AS pn, {_SIGNS_SQL("f.was")} AS sw, {_SIGNS_SQL("f.now")} AS sn, lower(rtrim(f.now, '.,:;')) AS bare, coalesce(corpus.n, 0) AS seen
      FROM f LEFT JOIN refused r ON r.was = f.was AND r.now = f.now LEFT JOIN corpus ON corpus.word = lower(f.was))
    SELECT id, block, was, now, CASE WHEN same THEN NULL WHEN denied THEN 'rejected by user' WHEN trim(was, ' ') <> '' AND trim(now, ' ') = '' THEN 'deletes text' WHEN {sqlforms.unescaped("was")} = {sqlforms.unescaped("now")} THEN 'escapes markup'
      WHEN regexp_replace(pw, '[^0-9]', '', 'g') <> regexp_replace(pn, '[^0-9]', '', 'g') AND {_LOOKS_SQL.format(c="was")} <> {_LOOKS_SQL.format(c="now")} THEN 'changes digits' WHEN {_DOUBLED_SQL} THEN 'doubles operator'
      WHEN len(list_filter(list_distinct(sw), lambda o: len(list_filter(sw, lambda p: p = o)) > len(list_filter(sn, lambda p: p = o)))) > 0 THEN 'changes operator' WHEN {_INDEX_SQL.format(c="now")} < {_INDEX_SQL.format(c="was")} THEN 'deletes index'
      WHEN {_CYR_LAT_SQL.format(c="now")} = {_CYR_LAT_SQL.format(c="was")} AND {_COUNTED_SQL("now")} < {_COUNTED_SQL("was")} THEN 'element to Cyrillic' WHEN regexp_full_match(pw, '[A-Za-z]') AND regexp_full_match(pn, '[A-Za-z]') THEN 'ambiguous single letter'
      WHEN pn <> '' AND pn <> pw AND contains(pw, pn) THEN 'deletes span' WHEN {_TWICE_SQL("now")} AND NOT ({_TWICE_SQL("was")}) THEN 'duplicates word'
      WHEN len(list_filter(regexp_extract_all(now, '[{_L_SQL}]{{2,}}-[{_L_SQL}]{{2,}}'), lambda h: contains(was, replace(h, '-', '')) AND NOT contains(was, h))) > 0 THEN 'keeps line-break hyphen' WHEN shifts THEN 'shifts value'
      WHEN regexp_full_match(was, '[{_L_SQL}]{{5,}}') AND regexp_full_match(bare, '[{_L_SQL}]{{5,}}') AND {sqlforms.distance("lower(was)", "bare")} <= 2 AND seen >= 2 THEN 'normalizes term' END AS reason FROM x""",
)
def fix_reasons(spark, d):
    """Rule by which each journalled correction would be refused."""
    f = schemas.scan(spark, d, "fixes", "id", "block", "was", "now", "state").dropDuplicates(["id"])
    return consensus.context_reasons(f, f.where("state = 'reverted'"), vocabulary.vocabulary(_blocks(spark, d, "book")))


@query(
    "fix_journal",
    "WITH f AS (SELECT DISTINCT ON (id) * FROM fixes ORDER BY id) SELECT book, count(*) FILTER (WHERE state = 'applied') AS applied, count(*) FILTER (WHERE state = 'reverted') AS reverted, "
    "count(*) FILTER (WHERE state = 'not_found') AS not_found, count(*) FILTER (WHERE state = 'applied' AND suggested) AS suggested FROM f GROUP BY book",
)
def fix_journal(spark, d):
    """States of the corrections of every book."""
    f = schemas.scan(spark, d, "fixes", "id", "book", "state", "suggested").dropDuplicates(["id"])
    n = lambda c: F.count_if(c)
    s = F.col("state")
    return f.groupBy("book").agg(n(s == "applied").alias("applied"), n(s == "reverted").alias("reverted"), n(s == "not_found").alias("not_found"), n((s == "applied") & F.col("suggested")).alias("suggested"))


@query(
    "refused_pairs",
    "WITH f AS (SELECT DISTINCT ON (id) * FROM fixes ORDER BY id), d AS (SELECT DISTINCT was, now FROM f WHERE state = 'reverted') SELECT f.id, f.was, f.now FROM f JOIN d ON f.was = d.was AND f.now = d.now WHERE f.state = 'applied'",
)
def refused_pairs(spark, d):
    """Applied corrections whose pair was reverted elsewhere."""
    f = schemas.scan(spark, d, "fixes", "id", "was", "now", "state").dropDuplicates(["id"])
    return consensus.denied(f.where("state = 'applied'"), f.where("state = 'reverted'")).select("id", "was", "now")


@query(
    "fixes_in_text",
    f"""WITH {B}, f AS (SELECT DISTINCT ON (id) * FROM fixes ORDER BY id) SELECT f.id, f.state, contains({TXT}, f.now) AS has_now, contains({TXT}, f.was) AS has_was
    FROM f JOIN b ON f.block = b.id WHERE f.was <> '' AND f.now <> ''""",
)
def fixes_in_text(spark, d):
    """Does the block still hold what a correction replaced, or what it put in?"""
    f = schemas.scan(spark, d, "fixes", "id", "block", "was", "now", "state").dropDuplicates(["id"]).where("was <> '' and now <> ''")
    b = _blocks(spark, d).withColumnRenamed("id", "block")
    return f.join(b, "block").select("id", "state", F.col("txt").contains(F.col("now")).alias("has_now"), F.col("txt").contains(F.col("was")).alias("has_was"))


@query(
    "run_statistics",
    f"""WITH {B} SELECT book, count(*) AS blocks, count(DISTINCT page) AS pages, count(*) FILTER (WHERE decision IN ('accept','arbiter')) AS decided, count(*) FILTER (WHERE decision = 'arbiter') AS arbitrated,
    round(CASE WHEN count(*) FILTER (WHERE decision IN ('accept','arbiter')) > 0 THEN count(*) FILTER (WHERE decision = 'arbiter') / count(*) FILTER (WHERE decision IN ('accept','arbiter')) ELSE 0.0 END, 4) AS arbitrated_share,
    count(*) FILTER (WHERE arbiter_status = 'rejected') AS rejected, count(*) FILTER (WHERE arbiter_status = 'failed') AS failed, count(*) FILTER (WHERE text_b IS NULL AND drafts_status = 'done') AS lost_drafts,
    coalesce(sum(len(arbiter_fixes)), 0)::BIGINT AS fixes, round(avg(cer_ab), 6) AS mean_cer FROM b GROUP BY book""",
)
def run_statistics(spark, d):
    """Quality figures of every book."""
    return evaluate.run_statistics(schemas.block_rows(spark, d, "book", "page", "decision", "arbiter_status", "text_b", "drafts_status", "arbiter_fixes", "cer_ab"))


@query(
    "category_scores",
    f"""WITH {B} SELECT category, final_source, round(avg(cer_ab), 6) AS cer, round(avg(b_seconds), 6) AS seconds, count(*) AS rows FROM b WHERE kind IS NOT NULL GROUP BY category, final_source""",
)
def category_scores(spark, d):
    """Means per category and source of the final text, NULLs left out."""
    b = schemas.block_rows(spark, d, "kind", "category", "final_source", F.col("cer_ab").alias("cer"), F.col("b_seconds").alias("seconds")).where("kind is not null")
    return evaluate.averages(b, ["category", "final_source"], ["cer", "seconds"])


@query(
    "best_book",
    f"""WITH {B}, s AS (SELECT category, book, round(count(*) FILTER (WHERE decision = 'accept') / count(*), 6) AS up, round(avg(cer_ab), 6) AS down FROM b WHERE kind IS NOT NULL GROUP BY category, book),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY coalesce(up, 0) DESC, coalesce(down, 1) ASC, book) AS rn FROM s) SELECT category, book AS best FROM r WHERE rn = 1""",
)
def best_book(spark, d):
    """Per category the book with the largest share of accepted drafts, then the smallest distance."""
    b = schemas.block_rows(spark, d, "kind", "category", "book", "decision", "cer_ab").where("kind is not null")
    s = b.groupBy("category", "book").agg(F.round(F.count_if(F.col("decision") == "accept") / F.count("*"), 6).alias("up"), F.round(F.avg("cer_ab"), 6).alias("down"))
    return evaluate.best(s, "category", "book", "up", "down")


@query(
    "number_scores",
    f"""WITH {B}, n AS (SELECT id, {sqlforms.numbers("coalesce(text_b, '')")} AS p, {sqlforms.numbers("final")} AS g FROM b WHERE final IS NOT NULL),
    h AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS hit FROM n),
    s AS (SELECT id, CASE WHEN len(p) + len(g) = 0 THEN 1.0::DOUBLE WHEN len(p) = 0 THEN 0.0 ELSE hit / len(p) END AS pr, CASE WHEN len(p) + len(g) = 0 THEN 1.0::DOUBLE WHEN len(g) = 0 THEN 0.0 ELSE hit / len(g) END AS re FROM h)
    SELECT id, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM s""",
)
def number_scores(spark, d):
    """Numbers of draft B against those of the final text: precision, recall and F1 of every block."""
    b = schemas.block_rows(spark, d, "text_b", "final", heavy=True).where("final is not null")
    return evaluate.number_scores(b, F.coalesce("text_b", F.lit("")), F.col("final"), "id")


@query("draft_errors")
def draft_errors(spark, d):
    """Character and word error of draft B against the final text, by category."""
    b = schemas.block_rows(spark, d, "category", "text_b", "final", heavy=True).where("final is not null and category <> 'Table' and category <> 'Page'")
    p, g = text.normal(F.coalesce("text_b", F.lit(""))), text.normal(F.col("final"))
    s = b.select("category", p.alias("p"), g.alias("g")).select("category", text.gold_distance(F.col("p"), F.col("g")).alias("cer"), evaluate.word_error("p", "g").alias("wer"))
    return evaluate.averages(s, ["category"], ["cer", "wer"])


@query(
    "masked_boxes",
    f"""WITH {B}, t AS (SELECT id, book, page, bbox FROM b WHERE kind IN ('text','title','caption','footnote','list','formula') AND bbox IS NOT NULL AND bbox.x2 >= bbox.x1 AND bbox.y2 >= bbox.y1), o AS (SELECT id, book, page, bbox FROM b WHERE category IN ('Table','Picture') AND parent IS NULL AND bbox IS NOT NULL AND bbox.x2 >= bbox.x1 AND bbox.y2 >= bbox.y1),
    x AS (SELECT t.id, o.id AS other, greatest(0, least(t.bbox.x2, o.bbox.x2) - greatest(t.bbox.x1, o.bbox.x1))::DOUBLE * greatest(0, least(t.bbox.y2, o.bbox.y2) - greatest(t.bbox.y1, o.bbox.y1)) / nullif((o.bbox.x2 - o.bbox.x1)::DOUBLE * (o.bbox.y2 - o.bbox.y1), 0) AS s
      FROM t JOIN o ON t.book = o.book AND t.page = o.page AND t.id <> o.id) SELECT id, other, round(s, 4) AS share FROM x WHERE s >= 0.5""",
)
def masked_boxes(spark, d):
    """Tables and pictures inside a block of text or formula."""
    return geometry.masked(schemas.block_rows(spark, d, "book", "page", "category", "kind", "parent", "bbox"))


@query(
    "boxes_in_tables",
    f"""WITH {B}, t AS (SELECT id, book, page, bbox FROM b WHERE category = 'Table' AND bbox IS NOT NULL AND bbox.x2 >= bbox.x1 AND bbox.y2 >= bbox.y1) SELECT b.id, t.id AS inside FROM b JOIN t ON b.book = t.book AND b.page = t.page AND b.id <> t.id
    WHERE b.bbox IS NOT NULL AND b.bbox.x2 >= b.bbox.x1 AND b.bbox.y2 >= b.bbox.y1 AND (b.bbox.x1 + b.bbox.x2) / 2.0 BETWEEN t.bbox.x1 AND t.bbox.x2 AND (b.bbox.y1 + b.bbox.y2) / 2.0 BETWEEN t.bbox.y1 AND t.bbox.y2""",
)
def boxes_in_tables(spark, d):
    """Blocks whose centre lies in a table of their page."""
    b = schemas.block_rows(spark, d, "book", "page", "category", "bbox")
    return geometry.centres_inside(b, b.where("category = 'Table'"))


@query(
    "box_overlaps",
    f"""WITH {B}, t AS (SELECT id, book, page, bbox FROM b WHERE bbox IS NOT NULL AND bbox.x2 >= bbox.x1 AND bbox.y2 >= bbox.y1),
    x AS (SELECT l.id AS l, r.id AS r, greatest(0, least(l.bbox.x2, r.bbox.x2) - greatest(l.bbox.x1, r.bbox.x1))::DOUBLE * greatest(0, least(l.bbox.y2, r.bbox.y2) - greatest(l.bbox.y1, r.bbox.y1)) AS i,
      (l.bbox.x2 - l.bbox.x1)::DOUBLE * (l.bbox.y2 - l.bbox.y1) + (r.bbox.x2 - r.bbox.x1)::DOUBLE * (r.bbox.y2 - r.bbox.y1) AS a FROM t l JOIN t r ON l.book = r.book AND l.page = r.page AND l.id < r.id)
    SELECT l, r, round(i / (a - i), 6) AS iou FROM x WHERE i > 0""",
)
def box_overlaps(spark, d):
    """Pairs of boxes of a page that overlap."""
    b = schemas.block_rows(spark, d, "book", "page", "bbox")
    p = geometry.page_pairs(b, b).where("l.id < r.id")
    v = geometry.iou(F.col("l.bbox"), F.col("r.bbox"))
    return p.select(F.col("l.id").alias("l"), F.col("r.id").alias("r"), F.round(v, 6).alias("iou")).where("iou > 0")


@query(
    "box_matches",
    f"""WITH RECURSIVE i AS (SELECT x.*, bl.book, bl.page FROM (SELECT l, r, iou_raw AS score FROM ({{IOU}}) WHERE iou_raw >= 0.05) x JOIN (SELECT DISTINCT id, book, page FROM blocks) bl ON bl.id = x.l),
    s AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY score DESC, l DESC, r DESC) AS k FROM i),
    g AS (SELECT book, page, l, r, score, k, true AS keep, [l] AS ls, [r] AS rs FROM s WHERE k = 1
      UNION ALL SELECT s.book, s.page, s.l, s.r, s.score, s.k, NOT list_contains(g.ls, s.l) AND NOT list_contains(g.rs, s.r),
        CASE WHEN NOT list_contains(g.ls, s.l) AND NOT list_contains(g.rs, s.r) THEN list_append(g.ls, s.l) ELSE g.ls END, CASE WHEN NOT list_contains(g.ls, s.l) AND NOT list_contains(g.rs, s.r) THEN list_append(g.rs, s.r) ELSE g.rs END
      FROM g JOIN s ON s.book = g.book AND s.page = g.page AND s.k = g.k + 1)
    SELECT book, page, l, r, score FROM g WHERE keep""".replace("{IOU}", SQL["box_overlaps"].replace("round(i / (a - i), 6) AS iou", "i / (a - i) AS iou_raw")),
)
def box_matches(spark, d):
    """Greedy one-to-one matching of overlapping boxes of a page."""
    b = schemas.block_rows(spark, d, "book", "page", "bbox")
    p = geometry.page_pairs(b, b).where("l.id < r.id")
    scored = p.select("book", "page", F.col("l.id").alias("l"), F.col("r.id").alias("r"), geometry.iou(F.col("l.bbox"), F.col("r.bbox")).alias("score"))
    return geometry.greedy(scored, ["book", "page"], 0.05)


@query(
    "reading_order",
    f"""WITH RECURSIVE {B}, s AS (SELECT book, page, id, bbox, row_number() OVER (PARTITION BY book, page ORDER BY bbox.y1, bbox.x1, id) AS k FROM b WHERE bbox IS NOT NULL),
    r AS (SELECT book, page, id, bbox.x1 AS x1, k, 1 AS line, bbox.y2 AS bottom FROM s WHERE k = 1
      UNION ALL SELECT s.book, s.page, s.id, s.bbox.x1, s.k, CASE WHEN (s.bbox.y1 + s.bbox.y2) / 2.0 < r.bottom THEN r.line ELSE r.line + 1 END, CASE WHEN (s.bbox.y1 + s.bbox.y2) / 2.0 < r.bottom THEN greatest(r.bottom, s.bbox.y2) ELSE s.bbox.y2 END
      FROM r JOIN s ON s.book IS NOT DISTINCT FROM r.book AND s.page IS NOT DISTINCT FROM r.page AND s.k = r.k + 1)
    SELECT book, page, id, row_number() OVER (PARTITION BY book, page ORDER BY line, x1, k) AS place FROM r""",
)
def reading_order(spark, d):
    """Place of every box in the reading order of its page."""
    return geometry.reading_order(schemas.block_rows(spark, d, "book", "page", "bbox"))


E_SQL = "e AS (SELECT DISTINCT ON (id) id, ts, book, lower(trim(level)) AS level, message FROM library_events ORDER BY id)"


def _events(spark, d):
    return events.cleaned(schemas.scan(spark, d, "library_events", "id", "ts", "book", "level", "message"))


@query("event_levels", f"WITH {E_SQL} SELECT book, level, count(*) AS n, min(ts) AS first, max(ts) AS last FROM e GROUP BY book, level")
def event_levels(spark, d):
    return _events(spark, d).groupBy("book", "level").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(
    "late_events",
    f"""WITH {E_SQL}, s AS (SELECT *, max(ts) OVER (PARTITION BY book ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e WHERE book IS NOT NULL)
    SELECT id, book, CAST(epoch(seen) AS BIGINT) - CAST(epoch(ts) AS BIGINT) AS behind_s FROM s WHERE CAST(epoch(seen) AS BIGINT) - CAST(epoch(ts) AS BIGINT) > 3600""",
)
def late_events(spark, d):
    """Events that arrived more than an hour behind their book."""
    return events.late(_events(spark, d)).select("id", "book", "behind_s")


@query("daily_events", f"WITH {E_SQL} SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, level, count(*) AS n FROM e WHERE ts IS NOT NULL GROUP BY 1, 2")
def daily_events(spark, d):
    return events.tumbling(_events(spark, d), "1 day")


@query(
    "sliding_events",
    f"""WITH {E_SQL}, w AS (SELECT level, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '12 hours' AS start FROM e, unnest([0, 1]) AS u(k) WHERE ts IS NOT NULL) SELECT start, level, count(*) AS n FROM w GROUP BY 1, 2""",
)
def sliding_events(spark, d):
    """Events per level in windows of a day, one every twelve hours."""
    return events.sliding(_events(spark, d), "1 day", "12 hours", "level")


@query(
    "event_sessions",
    f"""WITH {E_SQL}, g AS (SELECT *, CAST(epoch(ts) AS BIGINT) - CAST(epoch(lag(ts) OVER (PARTITION BY book ORDER BY ts, id)) AS BIGINT) AS gap FROM e WHERE book IS NOT NULL),
    n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
    SELECT book, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM n GROUP BY book, session""",
)
def event_sessions(spark, d):
    """Runs of a book's events with no gap over a day."""
    return events.sessions(_events(spark, d), 86_400, "book", ["id"])


@query(
    "error_streaks",
    f"""WITH {E_SQL}, x AS (SELECT book, id, coalesce(level = 'error', false) AS bad FROM e WHERE book IS NOT NULL), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY id ROWS UNBOUNDED PRECEDING) AS g FROM x)
    SELECT book, min(id) AS start, count(*) AS n FROM i WHERE bad GROUP BY book, g HAVING count(*) >= 2""",
)
def error_streaks(spark, d):
    """Errors of a book in a row."""
    return events.streaks(_events(spark, d), "book", F.coalesce(F.col("level") == "error", F.lit(False)), 2, "id")


@query(
    "rolling_events",
    f"""WITH {E_SQL} SELECT id, book, count(*) OVER (PARTITION BY book ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM e WHERE book IS NOT NULL AND ts IS NOT NULL""",
)
def rolling_events(spark, d):
    """Events of the book in the day before each event."""
    return events.rolling(_events(spark, d).where("ts is not null"), "book", 86_400).select("id", "book", "n")


@query("event_tail", f"WITH {E_SQL} SELECT id, book, level, message FROM e ORDER BY id DESC LIMIT 15")
def event_tail(spark, d):
    """The last fifteen events (a report)."""
    return events.tail(_events(spark, d), 15).select("id", "book", "level", "message")


@query(
    "pages_without_blocks",
    f"WITH {P} SELECT p.book, p.name AS page FROM p WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.book = p.book AND b.page = p.name)",
)
def pages_without_blocks(spark, d):
    """Pages still to be read."""
    pages = schemas.page_rows(spark, d).select("book", F.col("name").alias("page"))
    return tablediff.wanted(pages, schemas.scan(spark, d, "blocks", "book", "page"), ["book", "page"])


@query(
    "page_versions",
    """WITH k AS (SELECT book, name, count(*) AS versions, max(layout_seconds) AS hi, min(layout_seconds) AS lo FROM pages GROUP BY book, name) SELECT book, name, versions, hi IS DISTINCT FROM lo AS differs FROM k WHERE versions > 1""",
)
def page_versions(spark, d):
    """Pages delivered in several versions."""
    k = schemas.scan(spark, d, "pages", "book", "name", "layout_seconds").groupBy("book", "name").agg(F.count("*").alias("versions"), F.max("layout_seconds").alias("hi"), F.min("layout_seconds").alias("lo"))
    return k.where("versions > 1").select("book", "name", "versions", (~F.col("hi").eqNullSafe(F.col("lo"))).alias("differs"))


@query(
    "page_sync",
    f"""WITH {P}, o AS (SELECT book, name, width, height FROM p), n AS (SELECT DISTINCT book, page AS name FROM blocks)
    SELECT coalesce(o.book, n.book) AS book, coalesce(o.name, n.name) AS name, CASE WHEN o.book IS NULL THEN 'added' ELSE 'removed' END AS change FROM o FULL JOIN n ON o.book = n.book AND o.name = n.name WHERE o.book IS NULL OR n.book IS NULL""",
)
def page_sync(spark, d):
    """Pages known to one of the page table and the block table only."""
    old = schemas.page_rows(spark, d).select("book", "name", F.lit(1).alias("x"))
    new = schemas.scan(spark, d, "blocks", "book", F.col("page").alias("name")).distinct().withColumn("x", F.lit(1))
    return tablediff.sync(old, new, ["book", "name"], ["x"])


@query(
    "book_progress",
    f"""WITH {B} SELECT book, count(*) AS total, count(*) FILTER (WHERE consensus_status <> 'pending') AS done, median(b_seconds) AS median_s FROM b GROUP BY book HAVING count(b_seconds) >= 3""",
)
def book_progress(spark, d):
    """Compared blocks and median seconds per draft, where at least three were timed."""
    b = schemas.block_rows(spark, d, "book", "consensus_status", "b_seconds")
    g = b.groupBy("book").agg(F.count("*").alias("total"), F.count_if(F.col("consensus_status") != "pending").alias("done"), F.median("b_seconds").alias("median_s"), F.count("b_seconds").alias("timed"))
    return g.where("timed >= 3").drop("timed")


@query(
    "book_titles",
    r"""WITH t AS (SELECT DISTINCT name, regexp_extract(name, '(?:^|[_ -])((?:18|19|20)[0-9]{2})$', 1) AS y FROM books),
    r AS (SELECT name, y, CASE WHEN y <> '' THEN regexp_replace(name, '[_ -]?(?:18|19|20)[0-9]{2}$', '') ELSE name END AS rest FROM t)
    SELECT name, replace(CASE WHEN contains(rest, '_') THEN regexp_replace(rest, '^[^_]*_', '') ELSE rest END, '_', ' ') AS title, CASE WHEN contains(rest, '_') THEN split_part(rest, '_', 1) END AS author, CASE WHEN y <> '' THEN CAST(y AS INTEGER) END AS year FROM r""",
)
def book_titles(spark, d):
    """Title, author and year from the file name."""
    b = schemas.scan(spark, d, "books", "name").distinct().withColumn("s", text.stem_parts(F.col("name")))
    return b.select("name", "s.title", "s.author", "s.year")


@query("order_status_sets", "SELECT o_orderstatus, o_orderpriority FROM orders EXCEPT ALL SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def order_status_sets(spark, d):
    """Repeats of status and priority beyond the first."""
    o = schemas.scan(spark, d, "orders", "o_orderstatus", "o_orderpriority")
    return tablediff.multiset_difference(o, o.distinct())


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark, d):
    li = schemas.scan(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return li.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@query(
    "nation_revenue",
    """SELECT n.n_name, round(CAST(sum(l.l_extendedprice * (1 - l.l_discount)) AS DOUBLE), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_nationkey = c.c_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name""",
)
def nation_revenue(spark, d):
    li = schemas.scan(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    o, c = schemas.scan(spark, d, "orders", "o_orderkey", "o_custkey"), schemas.scan(spark, d, "customer", "c_custkey", "c_nationkey")
    s, n = schemas.scan(spark, d, "supplier", "s_suppkey", "s_nationkey"), schemas.scan(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = schemas.scan(spark, d, "region", "r_regionkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, (li.l_suppkey == s.s_suppkey) & (s.s_nationkey == c.c_nationkey))
    j = j.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"))


@query(
    "top_orders_per_segment",
    """SELECT c_mktsegment, o_orderkey, o_totalprice, rank FROM (SELECT c.c_mktsegment, o.o_orderkey, CAST(o.o_totalprice AS DOUBLE) AS o_totalprice, row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY o.o_totalprice DESC, o.o_orderkey) AS rank
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) WHERE rank <= 3""",
)
def top_orders_per_segment(spark, d):
    """The three largest orders of every segment (a report)."""
    o, c = schemas.scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), schemas.scan(spark, d, "customer", "c_custkey", "c_mktsegment")
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    j = o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("page_scores")
def page_scores(spark, d):
    """Draft pages against the final pages of every book: all scores, averaged."""
    b = schemas.block_rows(spark, d, "book", "page", "ord", "category", "parent", "text_a", "text_b", "final")
    ps = schemas.page_rows(spark, d)
    side = lambda c, name: layout.assemble(b.withColumn("txt", F.col(c)), ps).select("book", "page", F.col("markdown").alias(name))
    both = side("final", "gold").join(side("text_b", "pred"), ["book", "page"], "left")
    s = both.select("book", markdown.score_page("pred", "gold").alias("s")).select("book", "s.*")
    return evaluate.averages(s, ["book"], markdown.SCORES.names)


@query(
    "paragraph_chains",
    f"""WITH RECURSIVE j AS (SELECT * FROM ({SQL["page_stitches"]})), x AS (SELECT DISTINCT ON (id) id, trim({TXT}, ' ') AS txt FROM blocks ORDER BY id),
    r AS (SELECT j.book, j.join_to AS root, j.join_to AS last, 1 AS n, x.txt AS text FROM j JOIN x ON x.id = j.join_to WHERE j.join_to NOT IN (SELECT id FROM j)
      UNION ALL SELECT r.book, r.root, j.id, r.n + 1, CASE WHEN j.hyphen IS NOT NULL THEN regexp_replace(r.text, '-\\s*$', '') || x.txt ELSE r.text || ' ' || x.txt END FROM r JOIN j ON j.join_to = r.last JOIN x ON x.id = j.id)
    SELECT book, root AS id, CAST(max(n) AS INTEGER) AS blocks, arg_max(text, n) AS text FROM r GROUP BY book, root""",
)
def paragraph_chains(spark, d):
    """Paragraphs with their continuation over page ends put together."""
    b = _blocks(spark, d, "book", "page", "ord", "category", "parent").where("parent is null and txt is not null and category not in ('Page-header','Page-footer')")
    joins = layout.stitches(b, schemas.page_rows(spark, d), vocabulary.vocabulary(_blocks(spark, d, "book")))
    return layout.chains(b, joins, schemas.page_rows(spark, d))


_TOKEN_SQL = r"\$\$(?:.|\n)+?\$\$|\$[^$\n]+?\$|\\\((?:.|\n)+?\\\)|\\\[(?:.|\n)+?\\\]|<[^>]*>|[0-9A-Za-zА-Яа-яЁё]+(?:[.-][0-9A-Za-zА-Яа-яЁё]+)*"
_ASIDE_SQL = _TOKEN_SQL.rsplit("|", 1)[0]
_TWIN_SQL = f"translate(w, '{homoglyphs.LATIN_TWINS}', '{homoglyphs.CYRILLIC_TWINS}')"
_CHEM_SQL = f"regexp_full_match(p, '(?:(?:{'|'.join(sorted(homoglyphs.ELEMENTS, key=len, reverse=True))})[0-9]*)+')"


@query(
    "output_homoglyphs",
    f"""WITH {B}, x AS (SELECT id, {TXT} AS txt, regexp_replace({TXT}, '{_ASIDE_SQL}', '', 'g') AS plain FROM b WHERE {TXT} IS NOT NULL AND coalesce(kind, '') <> 'formula'),
    y AS (SELECT id, txt, len(regexp_extract_all(plain, '[А-Яа-яЁё]')) >= len(regexp_extract_all(plain, '[A-Za-z]')) AS cyr FROM x),
    z AS (SELECT id, txt, {sqlforms.words_apart("txt", _TOKEN_SQL, "w", f"CASE WHEN regexp_matches(w, '^[$<\\\\]') OR NOT regexp_matches(w, '[A-Za-z]') OR len(list_filter(regexp_extract_all(w, '[A-Za-z]'), lambda q: NOT contains('{homoglyphs.LATIN_TWINS}', q))) > 0 OR regexp_full_match(w, '(?:{'|'.join(homoglyphs.DESIGNATIONS)})[0-9]*') THEN w WHEN regexp_matches(w, '[А-Яа-яЁё]') OR (cyr AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Z]') AND len(list_filter(string_split_regex(w, '[.-]'), lambda p: {_CHEM_SQL})) = 0) THEN {_TWIN_SQL} ELSE w END")} AS fixed FROM y)
    SELECT id, fixed FROM z WHERE fixed <> txt""",
)
def output_homoglyphs(spark, d):
    """Final texts in which look-alike letters were put right for output."""
    b = _blocks(spark, d, "kind").where("txt is not null and coalesce(kind, '') <> 'formula'")
    return b.select("id", "txt", homoglyphs.fix_output("txt").alias("fixed")).where("txt <> fixed").select("id", "fixed")


@query("float_order")
def float_order(spark, d):
    """Blocks of every page with figures and tables moved to their place."""
    b = layout.with_pages(schemas.block_rows(spark, d, "book", "page", "ord", "category", "bbox"), schemas.page_rows(spark, d))
    return pages.reorder_floats(b)


@query(
    "promoted_footnotes",
    f"""WITH {B}, t AS (SELECT id, book, page, ord, category, {TXT} AS txt FROM b WHERE {TXT} IS NOT NULL AND book IS NOT NULL AND category NOT IN ('Page-header','Page-footer')),
    m AS (SELECT *, CASE WHEN category = 'Text' AND length(txt) <= 400 THEN nullif(regexp_extract(txt, '^\\s*(\\*{{1,3}}|[¹²³⁴⁵⁶⁷⁸⁹⁰]+)\\s+\\S', 1), '') END AS mark FROM t),
    w AS (SELECT *, coalesce(bool_and(mark IS NOT NULL OR category = 'Footnote') OVER (PARTITION BY book, page ORDER BY ord, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true) AS tail FROM m)
    SELECT id, book, page, mark, tail FROM w WHERE mark IS NOT NULL AND (tail OR EXISTS (SELECT 1 FROM w o WHERE o.book = w.book AND o.page = w.page AND (o.ord < w.ord OR (o.ord = w.ord AND o.id < w.id))
      AND o.category IN ('Text','List-item','Caption','Table') AND contains(regexp_replace(o.txt, '^\\s*(?:\\*{{1,3}}|[¹²³⁴⁵⁶⁷⁸⁹⁰]+)\\s+', ''), w.mark)))""",
)
def promoted_footnotes(spark, d):
    """Text blocks that are footnotes."""
    b = _blocks(spark, d, "book", "page", "ord", "category").where("txt is not null and book is not null and category not in ('Page-header','Page-footer')")
    return pages.promoted(b)


# A token that stands alone: no letter or digit goes on at its ends, nor a decimal part.
_ALONE_SQL = (
    "list_filter(range(1, length(txt) - length(tok) + 2), lambda i: substr(txt, i, length(tok)) = tok "
    "AND NOT (regexp_matches(tok, '^[\\p{L}\\p{N}_.,]') AND i > 1 AND regexp_matches(substr(txt, i - 1, 1), '[\\p{L}\\p{N}_]')) "
    "AND NOT (regexp_matches(tok, '^[\\p{L}\\p{N}_]') AND i > 2 AND regexp_matches(substr(txt, i - 2, 2), '^[0-9][.,]$')) "
    "AND NOT (regexp_matches(tok, '[\\p{L}\\p{N}_]$') AND regexp_matches(substr(txt, i + length(tok), 2), '^(?:[\\p{L}\\p{N}_]|[.,][0-9])')))"
)


@query(
    "fix_places",
    f"""WITH {B}, f AS (SELECT DISTINCT ON (id) * FROM fixes ORDER BY id), x AS (SELECT f.id, {TXT} AS txt, CASE WHEN f.state = 'applied' THEN f.now ELSE f.was END AS tok, coalesce(f.before, '') AS bef, coalesce(f.after, '') AS aft FROM f JOIN b ON f.block = b.id),
    y AS (SELECT *, concat(bef, tok, aft) AS whole FROM x WHERE txt IS NOT NULL AND tok IS NOT NULL),
    z AS (SELECT *, CASE WHEN tok <> '' AND bef || aft <> '' THEN list_filter(range(1, length(txt) + 1), lambda i: substr(txt, i, length(whole)) = whole) ELSE [] END AS exact, CASE WHEN tok <> '' THEN {_ALONE_SQL} ELSE [] END AS alone FROM y)
    SELECT id, CASE WHEN len(exact) = 1 THEN 'exact' WHEN len(alone) > 1 THEN 'ambiguous' WHEN len(alone) = 1 THEN 'token' ELSE 'absent' END AS status,
      CASE WHEN len(exact) = 1 THEN exact[1] - 1 + length(bef) WHEN len(alone) = 1 THEN alone[1] - 1 END AS "offset" FROM z""",
)
def fix_places(spark, d):
    """Where in its block each correction stands."""
    f = schemas.scan(spark, d, "fixes", "id", "block", "before", "was", "now", "after", "state").dropDuplicates(["id"])
    return pages.located(f, _blocks(spark, d))


@query("parsed_answers")
def parsed_answers(spark, d):
    """Text and corrections of every raw answer."""
    b = schemas.block_rows(spark, d, "arbiter_raw", "arbiter_text").where("arbiter_raw is not null")
    a = b.select("id", answers.parse_answer("arbiter_raw").alias("a"), "arbiter_text")
    return a.select("id", F.length("a.text").alias("chars"), F.size("a.fixes").alias("fixes"), "a.note", F.col("a.text").eqNullSafe(F.col("arbiter_text")).alias("as_stored"))


@query(
    "fix_sections",
    """WITH f AS (SELECT DISTINCT ON (id) * FROM fixes ORDER BY id), e AS (SELECT *, replace(replace(was, '|', chr(92) || '|'), chr(10), ' ') AS w, replace(replace(now, '|', chr(92) || '|'), chr(10), ' ') AS n FROM f),
    r AS (SELECT book, scan, id, '| ' || CASE WHEN page IS NOT NULL THEN scan || ' (p. ' || page || ')' ELSE scan END || ' | ' || w || ' | ' || CASE WHEN state = 'reverted' THEN '~~' || n || '~~ reverted' || coalesce(': ' || reason, '')
      WHEN state = 'not_found' THEN n || ' (not found in book.md)' WHEN suggested THEN n || ' (review: ' || coalesce(reason, '') || ')' ELSE n END || ' |' AS row FROM e)
    SELECT book, string_agg(row, chr(10) ORDER BY scan, id, row) AS section FROM r GROUP BY book""",
)
def fix_sections(spark, d):
    """The corrections of every book as a Markdown table."""
    return files.fixes_table(schemas.scan(spark, d, "fixes").dropDuplicates(["id"]))


@query(
    "sampled_pages",
    f"""WITH {P}, r AS (SELECT book, name, idx, row_number() OVER (PARTITION BY book ORDER BY idx, name) - 1 AS pos, count(*) OVER (PARTITION BY book) AS n FROM p)
    SELECT book, name FROM r WHERE n <= 5 OR pos IN (SELECT CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) FROM range(0, 5) t(i))""",
)
def sampled_pages(spark, d):
    """Five pages of every book, spread evenly (a sampling operator)."""
    return files.even_sample(schemas.page_rows(spark, d), 5).select("book", "name")


@query("streamed_daily_events", SQL["daily_events"])
def streamed_daily_events(spark, d):
    """Events per day and level, counted by a stream over the event files."""
    return live.run_once(live.counted(live.events_stream(spark, f"{d}/library_events.parquet").where("ts is not null")), "complete")


@query(
    "streamed_breaker",
    f"""WITH {E_SQL}, x AS (SELECT book, id, coalesce(level = 'error', false) AS bad FROM e WHERE book IS NOT NULL), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY id ROWS UNBOUNDED PRECEDING) AS g FROM x),
    r AS (SELECT book, id, row_number() OVER (PARTITION BY book, g ORDER BY id) AS k FROM i WHERE bad) SELECT book, id, 2::BIGINT AS n FROM r WHERE k % 2 = 0""",
)
def streamed_breaker(spark, d):
    """Books that failed twice in a row, told by a stream with state."""
    return live.run_once(live.breaker(live.events_stream(spark, f"{d}/library_events.parquet")), "append")


@query("placed_sketches")
def placed_sketches(spark, d):
    """Tables with their pictures put into their cells, and the pictures that go behind them."""
    b = schemas.block_rows(spark, d, "category", "final", "text_a", "text_b", "sketches").where((F.col("category") == "Table") & (F.size("sketches") > 0))
    s = b.select("id", sketches.placed(F.coalesce("final", "text_a"), F.transform("sketches", lambda x: x["path"]), F.col("text_b")).alias("s"))
    return s.select("id", "s.html", F.array_join("s.rest", ", ").alias("behind"), "s.note")


@query(
    "picture_texts",
    f"""WITH {B}, t AS (SELECT id, category, CASE WHEN category = 'Caption' AND trim({TXT}, ' ') <> '' THEN {TXT} END AS c, book, page, ord FROM b),
    w AS (SELECT id, category, regexp_replace(coalesce(lead(c) OVER o, lag(c) OVER o, ''), '^\\s+|\\s+$', '', 'g') AS alt FROM t WINDOW o AS (PARTITION BY book, page ORDER BY ord, id))
    SELECT id, left(regexp_replace(split_part(alt, chr(10), 1), '[\\[\\]]', '', 'g'), 200) AS alt FROM w WHERE category = 'Picture'""",
)
def picture_texts(spark, d):
    """What every picture shows, by the caption beside it."""
    return books.alt_texts(_blocks(spark, d, "book", "page", "ord", "category"))


@query("sanitized_answers")
def sanitized_answers(spark, d):
    """Answers whose corrections the rules judged: text with the refused ones taken back."""
    b = schemas.block_rows(spark, d, "book", "text_a", "text_b", "arbiter_text", "arbiter_fixes")
    out = consensus.sanitized(b.select("id", "text_a", "text_b", F.col("arbiter_text").alias("answer"), F.col("arbiter_fixes").alias("fixes")), vocabulary.vocabulary(_blocks(spark, d, "book")))
    return out.select("id", "text", F.size("kept").alias("kept"), F.array_join(F.transform("rejected", lambda f: f["reason"]), "; ").alias("reasons"))


@query(
    "spelling_report",
    f"""WITH {B}, {P}, x AS (SELECT b.book, b.page, p.idx, ord, b.id, regexp_replace({TXT}, '\\$\\$(?:.|\n)+?\\$\\$|\\$[^$\n]+?\\$|\\\\\\((?:.|\n)+?\\\\\\)|\\\\\\[(?:.|\n)+?\\\\\\]|<[^>]*>', ' ', 'g') AS t FROM b JOIN p ON b.book = p.book AND b.page = p.name WHERE {TXT} IS NOT NULL),
    l AS (SELECT *, regexp_extract_all(t, '[A-Za-zÄÖÜäöüßА-Яа-яЁё]+') AS ws FROM x), w AS (SELECT book, page, idx, ord, id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM l),
    dict AS (SELECT DISTINCT lower(unnest({WORDS_SQL.format(t='text')})) AS word FROM documents WHERE text IS NOT NULL),
    o AS (SELECT * FROM w WHERE length(word) >= 3 AND NOT (upper(word) = word AND length(word) <= 6) AND (lower(word) NOT IN (SELECT word FROM dict) OR (regexp_matches(word, '[А-Яа-яЁё]') AND regexp_matches(word, '[A-Za-zÄÖÜäöüß]')))),
    g AS (SELECT book, word, page, count(*) AS n, min((idx, ord, id, pos)) AS first FROM o GROUP BY ALL), h AS (SELECT book, word, sum(n)::BIGINT AS n, min(first) AS first, array_to_string(list(page ORDER BY first)[1:10], ', ') AS pages FROM g GROUP BY book, word),
    r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, first) AS rank FROM h) SELECT book, word, n, pages, rank FROM r WHERE rank <= 30""",
)
def spelling_report(spark, d):
    """Thirty unknown words of every book with the first pages they stand on (a report); the documents are the dictionary."""
    docs = schemas.scan(spark, d, "documents", F.col("text").alias("txt")).where("txt is not null")
    dictionary = docs.select(F.explode(vocabulary.whole_words(F.col("txt"))).alias("word"))
    return vocabulary.spelling(_blocks(spark, d, "book", "page", "ord"), schemas.page_rows(spark, d), dictionary)


@query("linked_footnotes")
def linked_footnotes(spark, d):
    """Texts with references to footnotes and the footnotes themselves, numbered through the book."""
    b = layout.with_pages(_blocks(spark, d, "book", "page", "ord", "category", "parent"), schemas.page_rows(spark, d))
    return pages.linked_footnotes(b.where("parent is null"))


@query(
    "quality_reports",
    f"""WITH {B}, s AS (SELECT book, count(*) AS blocks, count(DISTINCT page) AS pages, count(*) FILTER (WHERE decision IN ('accept','arbiter')) AS decided, count(*) FILTER (WHERE decision = 'arbiter') AS arb,
      count(*) FILTER (WHERE arbiter_status = 'rejected') AS rejected, count(*) FILTER (WHERE arbiter_status = 'failed') AS failed, count(*) FILTER (WHERE text_b IS NULL AND drafts_status = 'done') AS lost, coalesce(sum(len(arbiter_fixes)), 0)::BIGINT AS fixes FROM b GROUP BY book)
    SELECT book, concat_ws(chr(10), '# Recognition quality: ' || book, '', '| Metric | Value |', '|---|---|', '| Pages | ' || pages || ' |', '| Blocks | ' || blocks || ' |', '| Arbitrated share | ' || format('{{:.1f}}', round(CASE WHEN decided > 0 THEN arb / decided ELSE 0 END, 4) * 100) || ' % (' || arb || ' of ' || decided || ') |',
      '| Answers rejected | ' || rejected || ' |', '| Failures | ' || failed || ' |', '| Lost drafts | ' || lost || ' |', '| Misprint fixes | ' || fixes || ' |') AS report FROM s""",
)
def quality_reports(spark, d):
    """The figures of every book as a Markdown table."""
    b = schemas.block_rows(spark, d, "book", "page", "decision", "arbiter_status", "text_b", "drafts_status", "arbiter_fixes", "cer_ab")
    return evaluate.quality_report(evaluate.run_statistics(b))


@query(
    "comparison_reports",
    f"""WITH {B}, s AS (SELECT category, book, round(count(*) FILTER (WHERE decision = 'accept') / count(*), 4) AS accepted, round(avg(cer_ab), 4) AS distance FROM b WHERE kind IS NOT NULL GROUP BY category, book)
    SELECT category, '| book | accepted | distance |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || book || ' | ' || coalesce(format('{{:.4f}}', accepted), '—') || ' | ' || coalesce(format('{{:.4f}}', distance), '—') || ' |', chr(10) ORDER BY coalesce(accepted, 0) DESC, coalesce(distance, 1), book) AS report FROM s GROUP BY category""",
)
def comparison_reports(spark, d):
    """Books compared per category, best first, as Markdown tables."""
    b = schemas.block_rows(spark, d, "kind", "category", "book", "decision", "cer_ab").where("kind is not null")
    s = b.groupBy("category", "book").agg(F.round(F.count_if(F.col("decision") == "accept") / F.count("*"), 4).alias("accepted"), F.round(F.avg("cer_ab"), 4).alias("distance"))
    return evaluate.comparison_report(s, "category", "book", "accepted", "distance")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: both drafts of every block compared and decided, counted by kind and decision."""
    out = consensus_decisions(spark, d)
    return out.groupBy("kind", "decision").agg(F.count("*").alias("blocks"), F.round(F.avg("cer_ab"), 4).alias("mean_cer"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
