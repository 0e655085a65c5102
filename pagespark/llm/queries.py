"""The driver's queries of the ten training-text problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages, lines, markup, mixing, packing, repetition, scans, shape, skeleton, split, tokens
from .common import PROSE, cut_lineage, in_category, table, textual

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand on many pages of their book."""
    blocks = table(spark, d, "blocks", "id", F.col("book").alias("source"), "page", "category", F.col("final").alias("text"))
    rows = lines.line_table(lines.lines_of(blocks.where(textual())))
    return lines.found(rows, lines.repeated(rows, lines.page_counts(blocks)))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every text that holds a repeated line, without it."""
    blocks = table(spark, d, "blocks", "id", F.col("book").alias("source"), "page", "category", F.col("final").alias("text"))
    own = blocks.where(textual())
    rows = lines.line_table(lines.lines_of(own))
    return lines.rebuild(own, rows, cut_lineage(lines.repeated(rows, lines.page_counts(blocks))))


def _arrivals(spark: SparkSession, d: str) -> list[DataFrame]:
    """The blocks as two deliveries, which together are the whole table: later blocks are those of a hash."""
    blocks = table(spark, d, "blocks", "id", F.col("book").alias("source"), "page", "category", F.col("final").alias("text"))
    later = F.xxhash64("id") % 2 == 0
    return [blocks.where(~later), blocks.where(later)]


def _after_delta(spark: SparkSession, d: str) -> tuple[list[DataFrame], DataFrame, DataFrame, DataFrame, DataFrame]:
    """(deliveries, line table, that of the second, repeated lines, crossings) after the second delivery was merged into the tables of the first."""
    first, second = _arrivals(spark, d)
    state = lines.line_table(lines.lines_of(first.where(textual())))
    counts, pages = cut_lineage(lines.count_table(state)), cut_lineage(lines.page_table(first))
    before = cut_lineage(lines.repeated(state, lines.page_counts(pages), counts=counts))
    delta = lines.line_table(lines.lines_of(second.where(textual())))
    counts, pages = cut_lineage(lines.merge_counts(counts, state, delta)), lines.page_table(pages.unionByName(lines.page_table(second)))
    whole = lines.merge(state, delta)
    after = cut_lineage(lines.repeated(whole, cut_lineage(lines.page_counts(pages)), counts=counts))
    return [first, second], whole, delta, after, cut_lineage(lines.crossings(before, after))


def p1_delta(spark: SparkSession, d: str) -> DataFrame:
    """The lines of ``p1_found`` by way of two deliveries merged one after the other; ``late``: it took the second to see it."""
    _, whole, _, after, crossed = _after_delta(spark, d)
    late = lines.found(whole, crossed.where("crossed")).withColumn("late", F.lit(True))
    return lines.found(whole, after).join(late, ["id", "line_no"], "left").select("id", "line_no", F.coalesce("late", F.lit(False)).alias("late"))


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The texts to write after the second delivery: its own with a repeated line, and old ones with a line that it lifted over the threshold or left behind."""
    arrived, whole, delta, after, crossed = _after_delta(spark, d)
    own = arrived[0].unionByName(arrived[1]).where(textual())
    return lines.rebuild(own, whole, after, crossed, delta)


def _markup(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks", "id", "category", "final", "arbiter_text", "text_a").where(textual())
    return markup.clean_markup(blocks, w=markup.sample_weights(blocks, ("final", "arbiter_text"), "text_a"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text, constructs, content share and residue score of every value with markup."""
    return _markup(spark, d).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values whose residue of markup scores above 0."""
    return _markup(spark, d).select("id", "field").distinct()


def _limits(spark: SparkSession, d: str) -> DataFrame | list[tuple[str, int, int | None]]:
    """The limits per category as a list, or as the table it is where they are many."""
    limits = table(spark, d, "split_limits", "category", "max_chars", "overlap_chars").where("category is not null and max_chars is not null").distinct()
    rows = limits.limit(split.FEW + 1).collect()
    return limits if len(rows) > split.FEW else [tuple(r) for r in rows]


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every block with a limit."""
    blocks = table(spark, d, "blocks", "id", "category", "final").dropDuplicates(["id"])
    return split.split_items(blocks, _limits(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that had to be cut."""
    blocks = table(spark, d, "blocks", "id", "category", "final")
    return split.oversized(split.split_items(blocks, _limits(spark, d)))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of repeated content of every value."""
    blocks = table(spark, d, "blocks", "id", "category", "text_b", "arbiter_text", "arbiter_raw").where(textual())
    return repetition.measure(blocks).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of which at least half lies in lines labelled as repeating what the value has said."""
    blocks = table(spark, d, "blocks", "id", "category", "text_b", "arbiter_text", "arbiter_raw").where(textual())
    shares = repetition.measure(blocks)
    return shares.where(F.col("labelled_share") >= 0.5).select("id", "field").distinct()


SCAN_FIELDS = ("text_a", "text_b", "final")


def _scan_damage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(prose blocks, confirmed damage)."""
    blocks = table(spark, d, "blocks", "id", F.col("book").alias("source"), "page", "category", *SCAN_FIELDS)
    prose = blocks.where(in_category(PROSE))
    words = cut_lineage(scans.word_table(prose, SCAN_FIELDS))
    bad, good = scans.judge_words(words)
    bad, good = cut_lineage(bad), cut_lineage(good)
    known = scans.known_words(good)
    ev = cut_lineage(scans.evidence(prose, known, SCAN_FIELDS))
    running = scans.running_lines(blocks.withColumn("text", F.col("final")))
    return prose, scans.confirm(ev, words, bad, good, running)


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed damage of the prose values: (id, field, kind, item, fix)."""
    return _scan_damage(spark, d)[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with damage from scanning and page layout."""
    return p5_evidence(spark, d).select("id", "field").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every damaged value as continuous paragraphs."""
    prose, confirmed = _scan_damage(spark, d)
    return scans.repair_values(prose, confirmed, SCAN_FIELDS)


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document, block draft, final and book (passage NULL), and of every passage with its place.

    Junk documents, formulas and pictures have no language; a book speaks through its prose blocks.
    """
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    books = table(spark, d, "books", "name").where(F.col("name").isNotNull()).distinct()
    blocks = table(spark, d, "blocks", "id", "book", "category", "final", "text_a")
    spoken = ~F.coalesce("category", F.lit("")).isin("Formula", "Picture")
    blocks = blocks.withColumns({c: F.when(spoken, F.col(c)) for c in ("final", "text_a")})
    logp = languages.fit(docs)
    junk = shape.quality(docs, shape.common_words(docs)).where(F.col("shape") == "junk").select("doc_id", F.lit(True).alias("junk")).distinct()
    doc_rows = languages.passage_rows(docs, logp, "doc_id", ("text",)).join(junk, "doc_id", "left").where(F.col("passage").isNull() | F.col("junk").isNull())
    rows = languages.passage_rows(blocks, logp, "id", ("final", "text_a"), extra=("book", "category"))
    block_rows = cut_lineage(rows.dropDuplicates(["id", "field", "passage"]))
    own = block_rows.where(F.col("passage").isNull() & F.col("first") & in_category(PROSE))
    book_rows = books.withColumnRenamed("name", "book").join(languages.pooled(own, "book"), "book", "left")
    lang, words, confidence = languages.verdict()
    place = ["passage", "start", "end"]
    none = [F.lit(None).cast("long").alias(c) for c in place]
    head = lambda src, key, field: [F.lit(src).alias("src"), F.col(key).cast("string").alias("item"), field.alias("field")]
    quiet = lambda c, name, otherwise: F.when(F.col("junk").isNull(), c).otherwise(otherwise).alias(name)
    parts = [
        doc_rows.select(*head("documents", "doc_id", F.col("field")), *place, quiet(lang, "lang", F.lit(None)), words, quiet(confidence, "confidence", F.lit(0.0))),
        block_rows.select(*head("blocks", "id", F.col("field")), *place, lang, words, confidence),
        book_rows.select(*head("books", "book", F.lit(None).cast("string")), *none, lang, words, confidence),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Wrong labels of books and documents, and passages in another language."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    books = table(spark, d, "books", "name", "lang")
    blocks = table(spark, d, "blocks", "id", "book", "category", "final", "text_a").where(in_category(PROSE) & F.col("book").isNotNull())
    logp = languages.fit(docs)
    junk = shape.quality(docs, shape.common_words(docs)).where(F.col("shape") == "junk").select("doc_id")
    doc_rows = cut_lineage(languages.language_rows(docs.select("doc_id", "text"), logp, "doc_id").join(junk, "doc_id", "left_anti"))
    block_rows = cut_lineage(languages.language_rows(blocks.select("id", "book", F.coalesce("final", "text_a").alias("text")).dropDuplicates(["id"]), logp, "id", extra=("book",)))
    doc_main = languages.main_of(doc_rows, "doc_id")
    book_main = languages.main_of(block_rows, "book")
    label, segment = F.lit("label").alias("issue"), F.lit("segment").alias("issue")
    parts = [
        languages.wrong_labels(docs, doc_main, "doc_id").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("item"), label, "lang"),
        languages.wrong_labels(books.withColumnRenamed("name", "book"), book_main, "book").select(F.lit("books").alias("src"), F.col("book").alias("item"), label, "lang"),
        languages.foreign_passages(doc_rows, doc_main, "doc_id").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("item"), segment, "lang"),
        languages.foreign_passages(block_rows, book_main, "book").select(F.lit("blocks").alias("src"), F.col("id").cast("string").alias("item"), segment, "lang"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, cut only where it exceeds a container, with its container of 2,048 tokens."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return packing.fill(tokens.count_tokens(docs, "doc_id"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens in them and the share of unused space."""
    return packing.usage(p8_containers(spark, d))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    return mixing.mixture(tokens.count_tokens(docs, "doc_id", extra=("source",)), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the largest mixture with the target weights, and how often each is used."""
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixture(spark, d)[1]


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Quality statistics and label shares of every document."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return shape.quality(docs, shape.common_words(docs))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are as a whole list, table or junk."""
    docs = table(spark, d, "documents", "doc_id", "text")
    rows = shape.quality(docs, shape.common_words(docs))
    return rows.where(F.col("shape") != "prose").select("doc_id", "shape").distinct()


#: A list of this many designations is sent to all tasks; a longer one is joined.
FEW_CODES = 100_000


def _codes(spark: SparkSession, d: str) -> list[str] | DataFrame:
    """The reference list of designations, or the table it is where it is long."""
    codes = table(spark, d, "grades", "code")
    rows = codes.limit(FEW_CODES + 1).collect()
    return codes if len(rows) > FEW_CODES else sorted({r.code for r in rows if r.code})


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every value with characters other than they seem in its consistent form."""
    blocks = table(spark, d, "blocks", "id", "text_a", "final")
    return skeleton.canonicalise(blocks, _codes(spark, d)).select("id", "field", "clean", "faults").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with a token that its skeleton group spells otherwise."""
    blocks = table(spark, d, "blocks", "id", "text_a", "final")
    return skeleton.found_in(blocks, _codes(spark, d))[1].select("id", "field").distinct()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of several spellings that look the same, with the consistent one."""
    blocks = table(spark, d, "blocks", "id", "text_a", "final")
    return skeleton.skeleton_groups(skeleton.survey(blocks, ())[1]).where("n_spellings > 1")


def queries() -> dict[str, Query]:
    own = [
        p1_found, p1_clean, p1_delta, p1_rebuilt, p2_found, p2_clean, p3_found, p3_pieces, p4_found, p4_shares, p5_found, p5_repaired, p6_found, p6_canonical, p6_groups,
        p7_found, p7_languages, p8_containers, p8_usage, p9_mixture, p9_shares, p10_found, p10_statistics,
    ]
    return {f.__name__: f for f in own}


def _one_misreading_sql(a: str, b: str) -> str:
    """Two keys are equal but for one letter that was changed, lost, added or read as two, told letter by letter."""
    s, t = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    cut = f"len(list_filter(range(1, length({s}) + 2), lambda i: substr({s}, 1, i - 1) = substr({t}, 1, i - 1) AND (substr({s}, i) = substr({t}, i + 1) OR (i <= length({s}) AND substr({s}, i + 1) = substr({t}, i + 2))))) > 0"
    changed = f"len(list_filter(range(1, length({a}) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) <= 1"
    return f"({a} = {b} OR CASE WHEN length({a}) = length({b}) THEN {changed} ELSE {cut} END)"


def _repeated_sql(columns: str, late: str = "") -> str:
    """Every key against every frequent one of its book: what the joins by halves must find."""
    src, dst = lines._fold()
    rule = lines.Rule()
    key = f"regexp_replace(translate(replace(replace(replace(upper(line), 'ﬀ', 'FF'), 'ﬁ', 'FI'), 'ﬂ', 'FL'), '{src}', '{dst}'), '[^\\p{{L}}]+', '', 'g')"
    return f"""WITH b AS (SELECT DISTINCT id, book AS source, page, category, final AS text FROM blocks), p AS (SELECT source, greatest({rule.min_pages}, ceil(count(DISTINCT page) * {rule.min_share} - 1e-9)) AS need FROM b WHERE source IS NOT NULL AND page IS NOT NULL GROUP BY source),
    t AS (SELECT id, source, page, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM b WHERE text IS NOT NULL AND source IS NOT NULL AND page IS NOT NULL AND coalesce(category, '') NOT IN ('Table', 'Formula', 'Picture')),
    l AS (SELECT id, source, page, CAST(unnest(range(0, len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM t), k AS (SELECT id, source, page, line_no, {key} AS key FROM l),
    o AS (SELECT DISTINCT source, key, page FROM k WHERE length(key) >= {rule.min_letters}), r AS (SELECT source, key, count(*) AS pages FROM o GROUP BY ALL), c AS (SELECT r.source, r.key AS centre, p.need FROM r JOIN p ON p.source = r.source WHERE r.pages >= p.need * {rule.centre_share}),
    m AS (SELECT c.source, c.centre, c.need, r.key FROM c JOIN r ON r.source = c.source AND abs(length(r.key) - length(c.centre)) <= 1 AND {_one_misreading_sql("r.key", "c.centre")}),
    g AS (SELECT m.source, m.centre FROM m JOIN o ON o.source = m.source AND o.key = m.key GROUP BY m.source, m.centre, m.need HAVING count(DISTINCT o.page) >= m.need),
    f AS (SELECT DISTINCT m.source, m.key FROM m JOIN g ON g.source = m.source AND g.centre = m.centre), h AS (SELECT DISTINCT k.id, k.line_no FROM k JOIN f ON f.source = k.source AND f.key = k.key) {columns}"""


def _lookalikes_sql() -> str:
    """Tokens that don't stand as they look, by classes of characters, and designations by the letters they look like."""
    k = skeleton
    twins = "".join(map(chr, k.PROTO)), "".join(k.PROTO.values())
    letters = {"c": k._CYR, "l": k._LAT, "g": k._GRK}
    meet = "|".join(f"[{x}][{y}]" for m, x in letters.items() for n, y in letters.items() if m != n)
    token = f"[0-9{k._CYR}{k._LAT}{k._GRK}{k.INVISIBLE}{k.JOINED}{k.ACCENT}]+|[{k.ODD_SPACE}]+"
    values = " UNION ALL ".join(f"SELECT DISTINCT id, '{f}' AS field, {f} AS v FROM blocks WHERE {f} IS NOT NULL" for f in ("text_a", "final"))
    return f"""WITH x AS ({values}), t AS (SELECT id, field, unnest(list_distinct(regexp_extract_all(v, '{token}'))) AS w FROM x), codes AS (SELECT DISTINCT code FROM grades WHERE regexp_matches(code, '[^0-9][0-9]|[0-9][^0-9]')),
    looks AS (SELECT DISTINCT translate(code, '{twins[0]}', '{twins[1]}') AS form FROM codes)
    SELECT DISTINCT id, field FROM t WHERE w NOT IN (SELECT code FROM codes) AND (regexp_matches(w, '[{k.INVISIBLE}{k.ODD_SPACE}{k.JOINED}]') OR nfc_normalize(w) <> w OR regexp_matches(w, '{meet}') OR translate(w, '{twins[0]}', '{twins[1]}') IN (SELECT form FROM looks))"""


def _repetition_sql() -> str:
    """Values at least half of whose letters lie in a window of letters that the value has shown before."""
    w = repetition.WINDOW
    values = " UNION ALL ".join(f"SELECT DISTINCT id, '{f}' AS field, {f} AS v FROM blocks WHERE {f} IS NOT NULL AND coalesce(category, '') NOT IN ('Table', 'Formula', 'Picture')" for f in ("text_b", "arbiter_text", "arbiter_raw"))
    return f"""WITH x AS ({values}), t AS (SELECT id, field, regexp_replace(lower(replace(v, '\\n', chr(10))), '[\\p{{Nd}}\\s\\pZ]+', '', 'g') AS s FROM x), p AS (SELECT id, field, length(s) AS n, unnest(list_transform(range(1, length(s) - {w} + 2), lambda i: {{'pos': i, 'piece': substr(s, i, {w})}})) AS q FROM t WHERE length(s) > {w}),
    seen AS (SELECT id, field, n, q.pos AS pos FROM p QUALIFY row_number() OVER (PARTITION BY id, field, q.piece ORDER BY q.pos) > 1), c AS (SELECT DISTINCT id, field, n, unnest(range(pos, pos + {w})) AS letter FROM seen)
    SELECT id, field FROM c GROUP BY id, field, n HAVING count(*) >= 0.5 * n"""


def oracle_sql() -> dict[str, str]:
    kept = "array_to_string(list_transform(list_filter(list_zip(t.ls, range(0, len(t.ls))), lambda z: NOT list_contains(d.gone, z[2])), lambda z: z[1]), chr(10))"
    return {
        "p1_found": _repeated_sql("SELECT id, line_no FROM h"),
        "p1_clean": _repeated_sql(f", d AS (SELECT id, list(line_no) AS gone FROM h GROUP BY id) SELECT DISTINCT d.id, {kept} AS clean FROM d JOIN t ON t.id = d.id"),
        "p4_found": _repetition_sql(),
        "p6_found": _lookalikes_sql(),
        "p3_found": "SELECT DISTINCT b.id FROM blocks b JOIN split_limits l ON b.category = l.category WHERE length(b.final) > l.max_chars",
    }
