"""The comparison form of texts for functions that run inside Arrow batches; ``text.normal`` is the same form as expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable

# Look-alike letters (Latin, Cyrillic), script digits, dashes, quotes, and what stands for them.
LATIN_TWINS = "ABCEHKMOPTXaceopxy"
CYRILLIC_TWINS = "АВСЕНКМОРТХасеорху"
SCRIPT_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻₀₁₂₃₄₅₆₇₈₉₊₋"
BASE_DIGITS = "0123456789+-0123456789+-"
DASHES = "–—−‒‑"
QUOTES = "«»“”„‘’"
PLAIN_QUOTES = "\"\"\"\"\"''"

_SCRIPTS = str.maketrans(SCRIPT_DIGITS, BASE_DIGITS)
_SIGNS = str.maketrans(DASHES + QUOTES, "-" * len(DASHES) + PLAIN_QUOTES)
_TWINS = str.maketrans(LATIN_TWINS, CYRILLIC_TWINS)
_MIXED = re.compile("[A-Za-z]*(?:[A-Za-z][А-Яа-яЁё]|[А-Яа-яЁё][A-Za-z])[A-Za-zА-Яа-яЁё]*")
_WORD = re.compile("[A-Za-zА-Яа-яЁё]+")
#: A number, the sign between it and the next number, which no letter follows.
_BETWEEN = re.compile(r"(?<![\w.,])(\d+(?:[.,]\d+)?\s*)[×хХ](?=\s*\d+(?:[.,]\d+)?(?!\w))")
_GROUPS = re.compile(r"\d+(?: \d+)+")
_SIGNED = re.compile(r"(?:(?:(?<=[\s(])|\A)-)?\d+(?:[.,]\d+)?")
_SCRIPT_GROUP = re.compile(r"[\^_](?:\{([^{}]*)\}|(\d))|\^([+-]\d)")


def composed(s: str) -> str:
    """Composed characters, entities as the characters they name."""
    return unicodedata.normalize("NFC", html.unescape(s) if "&" in s else s)


def _cyrillic(m: re.Match) -> str:
    return m[0].translate(_TWINS) if re.search("[А-Яа-яЁё]", m[0]) else m[0]


def plain(s: str) -> str:
    """The form without the rule for signs between numbers."""
    s = composed(s).translate(_SCRIPTS)
    if _MIXED.search(s):
        s = _WORD.sub(_cyrillic, s)
    return " ".join(s.translate(_SIGNS).replace("{,}", ",").split())


def normal(s: str) -> str:
    """Entities, composition, script digits, look-alikes in Cyrillic words, dashes, quotes, decimal braces, × between numbers, spaces."""
    return _BETWEEN.sub(r"\1x", plain(s))


def joined_groups(m: re.Match) -> str:
    """Digit groups with the thousands put together: up to three digits, then groups of exactly three."""
    out: list[str] = []
    open_number = False
    for group in m[0].split(" "):
        if open_number and len(group) == 3:
            out[-1] += group
        else:
            out.append(group)
            open_number = len(group) <= 3
    return " ".join(out)


def numbers(s: str) -> list[str]:
    """Numbers in order; sub- and superscripts count as they stand, a minus only after a gap or bracket."""
    s = _SCRIPT_GROUP.sub(lambda m: m[1] or m[2] or m[3] or "", s)
    return _SIGNED.findall(_GROUPS.sub(joined_groups, normal(s)))


def numbers_of(texts: Iterable[str]) -> list[str]:
    return [n for t in texts for n in numbers(t)]
