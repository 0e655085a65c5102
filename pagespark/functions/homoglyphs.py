"""Look-alike letters put right for output, as column expressions: Cyrillic in Cyrillic words and in codes of Cyrillic text.

A text is taken apart into tokens and the gaps between them by one pattern; markup and formulas count as tokens that
stay.  Every token is judged by what it is made of, the gaps are put back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CYRILLIC_TWINS, LATIN_TWINS

# Symbols of the chemical elements that formulas of the texts use.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi U"
).split()
# Designations of materials science that stay Latin, with or without a number behind them.
DESIGNATIONS = "A0 A1 A2 A3 A4 Ac1 Ac3 Acm Ar1 Ar3 Arm Ms Mf Md HV HB HRC HRB HRA HSD KCU KCV AISI SAE DIN ASTM GOST".split()
_ASIDE = r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$|\\\([\s\S]+?\\\)|\\\[[\s\S]+?\\\]|<[^>]*>"
_CHARS = "0-9A-Za-zА-Яа-яЁё"
_CUT = rf"{_ASIDE}|[{_CHARS}]+(?:[.-][{_CHARS}]+)*"
_LATIN, _CYRILLIC = "[A-Za-z]", "[А-Яа-яЁё]"
_NO_TWIN = f"[A-Za-z&&[^{LATIN_TWINS}]]"
#: One part of a token between full stops and hyphens is made of element symbols and numbers.
_CHEMICAL = rf"(?:^|[.-])(?:(?:{'|'.join(sorted(ELEMENTS, key=len, reverse=True))})\d*)+(?:[.-]|$)"


def cyrillic_text(text: Column) -> Column:
    """At least half of the letters outside markup and formulas are Cyrillic."""
    plain = F.regexp_replace(text, _ASIDE, "")
    return F.regexp_count(plain, F.lit(_CYRILLIC)) >= F.regexp_count(plain, F.lit(_LATIN))


def twins(token: Column, cyrillic: Column) -> Column:
    """The token with its Latin twins as Cyrillic letters, if it is a Cyrillic word, or a code of a Cyrillic text."""
    only_twins = token.rlike(_LATIN) & ~token.rlike(_NO_TWIN) & ~token.rlike(rf"^(?:{'|'.join(DESIGNATIONS)})\d*$") & ~token.rlike(r"^[$<\\]")
    code = cyrillic & token.rlike(r"\d") & token.rlike("[A-Z]") & ~token.rlike(_CHEMICAL)
    return F.when(only_twins & (token.rlike(_CYRILLIC) | code), F.translate(token, LATIN_TWINS, CYRILLIC_TWINS)).otherwise(token)


def fix_output(text: Column | str) -> Column:
    """The text with look-alike letters put right; NULL stays NULL, a text without Latin letters is left as it is."""
    c = F.col(text) if isinstance(text, str) else text
    state = F.struct(c.alias("t"), cyrillic_text(c).alias("cyr"))

    def rebuilt(s: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(s["t"], F.lit(f"({_CUT})"), F.lit(1)), lambda w: twins(w, s["cyr"]))
        return F.array_join(F.zip_with(F.split(s["t"], _CUT, -1), tokens, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")

    whole = F.get(F.transform(F.array(state), rebuilt), F.lit(0))
    return F.when(c.rlike(f"[{LATIN_TWINS}]"), whole).otherwise(c)
