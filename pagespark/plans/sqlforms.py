"""SQL expressions that say what the comparison form says, for the SQL side of the catalogue.  Written for an engine without lookaround."""

from __future__ import annotations

from ..functions import forms
from ..functions.text import INLINE_TAGS

# The entities that the texts use, in the order they are undone; the last one may hide others.
ENTITIES = [("&nbsp;", " "), ("&laquo;", "«"), ("&raquo;", "»"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&#8470;", "№"), ("&amp;", "&")]
_WORD = "[A-Za-zА-Яа-яЁё]+"
_NUM = "[0-9]+(?:[.,][0-9]+)?"
#: The same in digits of any script, with spaces of any kind.
_ANY_NUM, _GAP = r"\p{Nd}+(?:[.,]\p{Nd}+)?", r"[\s\pZ]*"
#: Stand for a sign between numbers while its neighbours are looked at, and for the place behind it.
_SIGNS = {"×": 1, "х": 2, "Х": 3}
_BEHIND = 4


def quoted(s: str) -> str:
    return s.replace("'", "''")


def bind(expr: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to the value of ``expr``, which is worked out once."""
    return f"list_transform([{expr}], lambda {name}: {body})[1]"


def words_apart(expr: str, pattern: str, var: str, word: str) -> str:
    """The text with every match of ``pattern``, named ``var``, replaced by the expression ``word``."""
    p = quoted(pattern)
    words = f"list_append(list_transform(regexp_extract_all(s0, '{p}'), lambda {var}: {word}), '')"
    return bind(expr, "s0", f"array_to_string(list_transform(list_zip(string_split_regex(s0, '{p}'), {words}), lambda z: concat(z[1], z[2])), '')")


def _composed(expr: str) -> str:
    """Entities, composition, script digits, look-alikes in Cyrillic words, dashes, quotes, decimal braces."""
    e = f"translate({unescaped(expr)}, '{forms.SCRIPT_DIGITS}', '{forms.BASE_DIGITS}')"
    e = words_apart(e, _WORD, "w", f"CASE WHEN regexp_matches(w, '[А-Яа-яЁё]') THEN translate(w, '{forms.LATIN_TWINS}', '{forms.CYRILLIC_TWINS}') ELSE w END")
    return f"replace(translate({e}, '{forms.DASHES}{forms.QUOTES}', '{'-' * len(forms.DASHES)}{quoted(forms.PLAIN_QUOTES)}'), '{{,}}', ',')"


def _squeezed(e: str) -> str:
    return rf"trim(regexp_replace({e}, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', ' ', 'g'))"


def unescaped(expr: str) -> str:
    """Entities undone and accents composed."""
    for entity, char in ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char}')"
    return f"nfc_normalize({expr})"


def plain(expr: str) -> str:
    """The comparison form without the rule for signs between numbers."""
    return _squeezed(_composed(expr))


def normal(expr: str) -> str:
    """The comparison form: ``plain``, and × between numbers as x."""
    e = _composed(expr)
    # a sign with a number behind it is marked, then those with a number before them become x, then the others go back
    for sign, k in _SIGNS.items():
        for _ in range(2):
            e = rf"regexp_replace({e}, '{sign}({_GAP}{_ANY_NUM}(?:[^\pL\pN_]|$))', chr({k}) || chr({_BEHIND}) || '\1', 'g')"
    e = rf"regexp_replace({e}, '(^|[^\pL\pN_.,])({_ANY_NUM}{_GAP})[' || chr(1) || chr(2) || chr(3) || ']', '\1\2x', 'g')"
    for sign, k in _SIGNS.items():
        e = f"replace({e}, chr({k}), '{sign}')"
    return _squeezed(f"replace({e}, chr({_BEHIND}), '')")


def chained(expr: str, *steps: tuple[str, str]) -> str:
    """Pattern replacements one after the other."""
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, '{quoted(pattern)}', '{by}', 'g')"
    return expr


_WRAPPED = (r"\\(?:text|mathrm|mathit|mathbf|operatorname|textit|textbf)\s*\{([^{}]*)\}", r"\1")
_IN_WORD = (r"([а-яёa-z])-\s*([а-яёa-z])", r"\1\2")


def formula_form(expr: str) -> str:
    """Canonical LaTeX: no delimiters, text wrappers, sizing, spaces, nor braces round one character."""
    e = chained(f"trim({expr}, ' ')", (r"(?s)^(?:\$\$(.*)\$\$|\\\[(.*)\\\]|\\\((.*)\\\)|\$(.*)\$)$", r"\1\2\3\4"), _WRAPPED, _WRAPPED, _WRAPPED)
    for a, b in (("\\left", ""), ("\\right", ""), ("\\cdot", "·"), ("\\times", "×")):
        e = f"replace({e}, '{a}', '{b}')"
    e = chained(e, (r"\\qquad|\\quad|\\[,;:! ]|~", ""), (r"\{([^\n])\}", r"\1"))
    return rf"regexp_replace({normal(e)}, '\s+', '', 'g')"


def text_form(expr: str) -> str:
    """Canonical prose: inline formulas unwrapped, no tags, list marks, emphasis nor hyphens inside words."""
    e = chained(
        expr, _WRAPPED, _WRAPPED, (r"\$\$(.+?)\$\$|\$([^$]+?)\$", r" \1\2 "), (r"\\left|\\right|\\qquad|\\quad|\\[,;:!]", ""), (r"(?i)<br\b[^>]*>", " "),
        (rf"(?i)</?(?:{INLINE_TAGS})\b[^>]*>", ""), (r"(?m)^\s{0,3}(?:#{1,6}\s+|[-*+•]\s+)", ""), (r"\*\*(\S(?:.*?\S)?)\*\*", r"\1"), (r"\*(\S(?:.*?\S)?)\*", r"\1"),
    )
    return chained(normal(e), _IN_WORD, _IN_WORD)


def table_form(expr: str) -> str:
    """Rows of ``rowspan x colspan : text`` cells of HTML tables that stand in one line; without a table the plain text."""
    cell = chained(plain(f"regexp_replace(regexp_replace(c, '(?i)<br[^>]*>', ' ', 'g'), '<[^<>]*>', '', 'g')"), _IN_WORD, _IN_WORD)
    span = lambda name: rf"coalesce(nullif(regexp_extract(c, '(?i)^<t[dh][^>]*\b{name}=\x22?([0-9]+)', 1), ''), '1')"
    images = "repeat(' [img]', len(regexp_extract_all(c, '(?i)<img')))"
    row = f"array_to_string(list_transform(regexp_extract_all(r, '(?i)<t[dh][^>]*>.*?</t[dh]>'), lambda c: concat({span('rowspan')}, 'x', {span('colspan')}, ':', trim(concat({cell}, {images})))), '|')"
    rows = f"array_to_string(list_transform(regexp_extract_all({expr}, '(?i)<tr[^>]*>.*?</tr>'), lambda r: {row}), chr(10))"
    bare = chained(plain(f"regexp_replace({expr}, '<[^<>]*>', '', 'g')"), _IN_WORD, _IN_WORD)
    return f"CASE WHEN {expr} IS NULL THEN NULL WHEN regexp_matches({expr}, '(?i)<table') THEN {rows} ELSE {bare} END"


def distance(a: str, b: str) -> str:
    """Edit distance by code points, where the engine counts bytes: the characters of both are numbered below 127 first."""
    coded = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(list_position(cs, c)::INTEGER)), '')"
    return bind(f"list_distinct(string_split(concat({a}, {b}), ''))", "cs", f"CASE WHEN {a} = '' THEN length({b}) WHEN {b} = '' THEN length({a}) ELSE levenshtein({coded(a)}, {coded(b)}) END")


def numbers(expr: str) -> str:
    """Numbers of a text in order: scripts unwrapped, thousands joined, a minus after a gap or bracket only."""
    e = f"regexp_replace(regexp_replace(regexp_replace({expr}, '[\\^_]\\{{([^{{}}]*)\\}}', '\\1', 'g'), '\\^([+-]?[0-9])', '\\1', 'g'), '_([0-9])', '\\1', 'g')"
    e = normal(e)
    e = f"regexp_replace({e}, '(^|[^0-9])([0-9]{{1,3}}) ([0-9]{{3}})([^0-9]|$)', '\\1\\2' || chr(1) || '\\3\\4', 'g')"
    e = f"regexp_replace({e}, '(^|[^0-9' || chr(1) || '])([0-9]{{1,3}}) ([0-9]{{3}})([^0-9]|$)', '\\1\\2' || chr(1) || '\\3\\4', 'g')"
    for _ in range(3):
        e = f"regexp_replace({e}, '(' || chr(1) || '[0-9]{{3}}) ([0-9]{{3}})([^0-9]|$)', '\\1' || chr(1) || '\\2\\3', 'g')"
    e = f"regexp_replace(replace({e}, chr(1), ''), '(^|[\\s(])-([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_transform(regexp_extract_all({e}, chr(1) || '?{_NUM}'), lambda x: replace(x, chr(1), '-'))"
