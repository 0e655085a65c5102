"""Text functions as column expressions: normal forms, numbers, distances, loops, language.

Everything here runs inside the JVM, but for entities and composition where a text has any.  Patterns carry ``(?U)`` where letters of any
script must count as letters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forms import BASE_DIGITS, CYRILLIC_TWINS, DASHES, LATIN_TWINS, PLAIN_QUOTES, QUOTES, SCRIPT_DIGITS, composed

# Inline elements that carry no content of their own.
INLINE_TAGS = "br|p|div|span|sup|sub|b|i|u|em|strong|small|big|code|a|img|hr|ul|ol|li|h[1-6]"
LETTER = "A-Za-zА-Яа-яЁё"


def strip_tags(c: Column) -> Column:
    """Known markup tags removed, line breaks to spaces; ``t < 500`` stays."""
    spaced = F.regexp_replace(c, r"(?i)<br\b[^>]*>", " ")
    return F.regexp_replace(spaced, rf"(?i)</?(?:{INLINE_TAGS})\b[^>]*>", "")


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else composed(t))


#: Only texts with one of these need composing: an entity, or a combining mark of any script.
_LOOSE = r"&[#A-Za-z]|\p{M}"


def compose(c: Column) -> Column:
    """Entities undone and accents composed.  Only texts that may need it are sent to Python, the others go as NULL."""
    return F.coalesce(_composed(F.when(c.rlike(_LOOSE), c)), c)


def _fix_word(w: Column) -> Column:
    return F.when(w.rlike("[А-Яа-яЁё]"), F.translate(w, LATIN_TWINS, CYRILLIC_TWINS)).otherwise(w)


def once(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` evaluated once, however often ``fn`` names it; nested forms would multiply it otherwise."""
    return F.get(F.transform(F.array(c), lambda x: fn(x)), F.lit(0))


def replaced(c: Column, pattern: str, fn) -> Column:
    """The text with every match of the pattern replaced by what ``fn`` makes of it."""

    def whole(x: Column) -> Column:
        made = F.transform(F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1)), fn)
        return F.array_join(F.zip_with(F.split(x, pattern, -1), made, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")

    return once(c, whole)


#: A word of two alphabets has a place where they meet.
MEETING = "[А-Яа-яЁё][A-Za-z]|[A-Za-z][А-Яа-яЁё]"


def homoglyph_words(c: Column) -> Column:
    """Latin look-alikes inside words that hold a Cyrillic letter become Cyrillic; texts without a mixed word stay as they are."""

    def apart(x: Column) -> Column:
        words = F.transform(F.regexp_extract_all(x, F.lit(f"([{LETTER}]+)"), F.lit(1)), lambda w: _fix_word(w))
        return F.array_join(F.zip_with(F.split(x, f"[{LETTER}]+", -1), words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

    return once(c, lambda x: F.when(x.rlike(MEETING), apart(x)).otherwise(x))


def normal(c: Column) -> Column:
    """Comparison form: entities, composition, script digits, look-alikes, dashes, quotes, decimal braces, × between numbers, spaces."""
    c = F.translate(compose(c), SCRIPT_DIGITS, BASE_DIGITS)
    c = F.translate(homoglyph_words(c), DASHES + QUOTES, "-" * len(DASHES) + PLAIN_QUOTES)
    c = F.replace(c, F.lit("{,}"), F.lit(","))
    c = F.regexp_replace(c, r"(?U)(?<![\w.,])(\d+(?:[.,]\d+)?\s*)[×хХ](?=\s*\d+(?:[.,]\d+)?(?!\w))", "$1x")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def base_scripts(c: Column) -> Column:
    """LaTeX sub- and superscripts unwrapped."""
    c = F.regexp_replace(c, r"[\^_]\{([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"\^([+-]?\d)", "$1"), r"_(\d)", "$1")


def numbers(c: Column) -> Column:
    """Numbers of a text as strings, in order: thousands groups joined, a minus only after a gap or bracket."""
    c = normal(base_scripts(c))
    c = F.regexp_replace(c, r"(?<!\d)(\d{1,3}) (?=\d{3}(?!\d))", "$1")
    c = F.regexp_replace(c, r"(?<=\d{4,6}) (?=\d{3}(?!\d))", "")
    return F.regexp_extract_all(c, F.lit(r"((?:(?<=^|[\s(])-)?\d+(?:[.,]\d+)?)"), F.lit(1))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def formula_form(c: Column) -> Column:
    """Canonical LaTeX: no delimiters, text wrappers, sizing, spaces, nor braces round one character."""
    c = F.trim(c)
    c = F.regexp_replace(c, r"(?s)\A(?:\$\$(.*)\$\$|\\\[(.*)\\\]|\\\((.*)\\\)|\$(.*)\$)\z", "$1$2$3$4")
    for _ in range(3):  # wrappers nest
        c = F.regexp_replace(c, r"\\(?:text|mathrm|mathit|mathbf|operatorname|textit|textbf)\s*\{([^{}]*)\}", "$1")
    for a, b in (("\\left", ""), ("\\right", ""), ("\\cdot", "·"), ("\\times", "×")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"\\qquad|\\quad|\\[,;:! ]|~", "")
    c = F.regexp_replace(c, r"\{(.)\}", "$1")
    return F.regexp_replace(normal(c), r"(?U)\s+", "")


def text_form(c: Column) -> Column:
    """Canonical prose: inline formulas in formula form, no tags, list marks, emphasis nor hyphens inside words.

    Inline formulas get the parts of the formula form that expressions can give in place: wrappers, sizing and spaces.
    """
    for _ in range(2):
        c = F.regexp_replace(c, r"\\(?:text|mathrm|mathit|mathbf|operatorname|textit|textbf)\s*\{([^{}]*)\}", "$1")
    c = F.regexp_replace(c, r"\$\$(.+?)\$\$|\$([^$]+?)\$", " $1$2 ")
    c = F.regexp_replace(c, r"\\left|\\right|\\qquad|\\quad|\\[,;:!]", "")
    c = F.regexp_replace(strip_tags(c), r"(?m)^\s{0,3}(?:#{1,6}\s+|[-*+•]\s+)", "")
    c = F.regexp_replace(c, r"\*\*(?=\S)(.+?)(?<=\S)\*\*", "$1")
    c = F.regexp_replace(c, r"\*(?=\S)(.+?)(?<=\S)\*", "$1")
    return F.regexp_replace(normal(c), r"(?<=[а-яёa-z])-\s*(?=[а-яёa-z])", "")


def distance_share(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((longer == 0) | (a == b), F.lit(0.0)).otherwise(F.levenshtein(a, b) / longer)


def gold_distance(pred: Column, gold: Column) -> Column:
    """Edit distance over the gold length, at most 1; an empty gold text gives 0 or 1."""
    return F.when(F.length(gold) == 0, (F.length(pred) > 0).cast("double")).when(pred == gold, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(pred, gold) / F.length(gold)))


def looping(c: Column, tail: int = 600, period: int = 200) -> Column:
    """Are the last ``tail`` characters one fragment of at most ``period`` characters over and over?"""
    t = F.substring(c, -tail, tail)
    hit = F.exists(F.sequence(F.lit(1), F.lit(period)), lambda p: F.substring(t, p + 1, F.lit(tail) - p) == F.substring(t, F.lit(1), F.lit(tail) - p))
    return F.when(F.length(c) < tail, F.lit(False)).otherwise(hit)


def signature(c: Column) -> Column:
    """Running-line signature: comparison form in lower case without digits."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(normal(c)), r"\d+", ""), r"\s+", " "))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


# The function words of the language vote.
GERMAN = "der|die|das|und|nicht|mit|für|wird|ist|ein|eine"
ENGLISH = "the|and|of|is|with|for|which|are|this"


def language_counts(c: Column) -> dict[str, Column]:
    """Letters by script and function-word hits; formulas don't count."""
    plain = F.regexp_replace(c, r"(?s)\$\$.+?\$\$|\$[^$\n]+?\$", " ")
    return {
        "cyr": count_matches(plain, "[А-Яа-яЁёІіЇїЄє]"),
        "lat": count_matches(plain, "[A-Za-zÄÖÜäöüß]"),
        "de": count_matches(plain, rf"(?iu)[äöüßÄÖÜ]|(?U)\b(?:{GERMAN})\b"),
        "en": count_matches(plain, rf"(?iu)\b(?:{ENGLISH})\b"),
    }


def vote(cyr: Column, lat: Column, de: Column, en: Column) -> Column:
    """ru if Cyrillic is not in the minority, else the language with more hits; ties and silence give ru."""
    return F.when(cyr >= lat, "ru").when(de > en, "de").when(en > de, "en").otherwise("ru")


def roman_chapter(part: Column) -> Column:
    """A chapter number with 1 read for I as a Roman numeral below 40; NULL if it has no 1 or is no numeral."""
    roman = F.replace(part, F.lit("1"), F.lit("I"))
    return F.when(part.contains("1") & roman.rlike("^X{0,3}(?:IX|IV|V?I{0,3})$") & (roman != ""), roman)


def slug(c: Column) -> Column:
    """Lower case, no punctuation, spaces to hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", ""), r"(?U)\s+", "-"), "^-+|-+$", "")


def stem_parts(stem: Column) -> Column:
    """struct(title, author, year) of ``Author_Title_Year``; a year is 1800 to 2099."""
    year = F.regexp_extract(stem, r"(?:^|[_ -])((?:18|19|20)\d{2})$", 1)
    rest = F.when(year != "", F.regexp_replace(stem, r"[_ -]?(?:18|19|20)\d{2}$", "")).otherwise(stem)
    author = F.when(rest.contains("_"), F.substring_index(rest, "_", 1))
    title = F.when(rest.contains("_"), F.regexp_replace(rest, r"^[^_]*_", "")).otherwise(rest)
    return F.struct(F.regexp_replace(title, "_", " ").alias("title"), author.alias("author"), F.when(year != "", year.cast("int")).alias("year"))


def plain_from_html(c: Column) -> Column:
    """Text of an HTML fragment: formulas to $, breaks and block ends to lines, list items to bullets, no tags, squeezed."""
    c = F.regexp_replace(c, r"(?is)<math[^>]*>(.*?)</math>", r"\$$1\$")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)<li[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|h[1-6]|ul|ol|table|tr)\s*>", "\n\n")
    c = compose(F.regexp_replace(c, r"<[^<>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
