"""Problem 6: visually identical text with different characters.

Method: confusables skeleton.  A token is decomposed, every character is replaced
by the prototype of its look-alike class, and the result is decomposed again;
tokens with equal skeletons look the same and form a group.  ``survey`` reads every
text once: it counts the spellings of the corpus by skeleton and keeps the values
with a token that may not be spelled as it looks (characters that don't show, odd
spaces, loose accents, wide or joined forms, two alphabets in a word, a skeleton of
the reference list).  ``respell`` gives each such token the spelling of its group: the
listed designation; else its spelling in one alphabet if the corpus has it; else the
group's most frequent consistent spelling; else the spelling in one alphabet.  A value
is a case if a token's group spells it otherwise.

``Canonicaliser`` is the same for one text on its own, where no corpus is at hand.

Defined results: NULL stays NULL, the empty text stays empty, a text of any
length is treated whole; the reference list may be empty.  Ties between the two
alphabets of a word go to the alphabet of most letters of the text (Cyrillic if
there are as many of both); equally frequent spellings go to the greater string.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# Look-alike letters, prototype first (Latin), then its Cyrillic, Greek, Armenian and other twins.
LOOKALIKES = [
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "LԼ", "MМΜϺ", "NΝ", "OОΟՕ", "PРΡ", "QԚ", "SЅՏ", "TТΤ", "UՍ", "VѴ", "WԜ", "XХΧ", "YҮΥ", "ZΖ",
    "aаα", "cсϲ", "dԁ", "eе", "gց", "hһհ", "iіιı", "jјϳ", "kкκ", "lӏ", "nո", "oоοօσ", "pрρ", "qԛգ", "sѕ", "uυս", "vνѵ", "wԝω", "xхχ", "yуγү", "ÆӔ", "æӕ", "ÐĐ", "əә",
]

#: Every twin -> Latin prototype, and every letter of a class -> its member of one alphabet.
PROTO = {ord(t): g[0] for g in LOOKALIKES for t in g[1:]}


def _into(alphabet: str, rare: str = "ӀԌԼԚѴԜҮցհӏոօգսѵүӔӕ") -> dict[int, str]:
    """Letters a word may be rewritten with: those in use today, not every one that looks alike."""
    own = [(g, next((x for x in g if unicodedata.name(x).startswith(alphabet) and x not in rare), None)) for g in LOOKALIKES]
    return {ord(t): c for g, c in own if c for t in g if t != c}


TO_CYR, TO_LAT, TO_GRK = _into("CYRILLIC"), _into("LATIN"), _into("GREEK")

#: Characters that show nothing: soft hyphen, zero-width and direction marks, joiners, byte-order mark.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufe00-\ufe0f"
#: Spaces other than U+0020 (tabs and line ends are layout, not look-alikes).
ODD_SPACE = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Full-width forms and letters joined in one character.
JOINED = "\uff01-\uff5e\uffe0-\uffe6\ufb00-\ufb06\ufb13-\ufb17\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3"
ACCENT = "\u0300-\u036f\u0483-\u0487"

_INVIS_RE = re.compile(f"[{INVISIBLE}]+")
_SPACE_RE = re.compile(f"[{ODD_SPACE}]")
_JOINED_RE = re.compile(f"[{JOINED}]")
#: Quick test: anything outside this needs the slower rules.
_ODD_RE = re.compile(f"[{INVISIBLE}{ODD_SPACE}{JOINED}{ACCENT}]")
_CYR, _LAT, _GRK = "\u0400-\u052f", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff", "\u0370-\u03ff\u1f00-\u1fff"
_NON_LATIN_RE = re.compile(f"[{_CYR}{_GRK}]")
_LATIN_RE = re.compile("[A-Za-z]")
_WORD_RE = re.compile(f"[{_CYR}{_LAT}{_GRK}]+")
#: A word with letters of two alphabets side by side.
_MIX_RE = re.compile(f"[{_CYR}](?=[{_LAT}{_GRK}])|[{_LAT}](?=[{_CYR}{_GRK}])|[{_GRK}](?=[{_CYR}{_LAT}])")
_TOKEN_RE = re.compile(f"[0-9{_CYR}{_LAT}{_GRK}]+")
#: Designations have a digit beside a letter.
_CODE_RE = re.compile(f"[{_CYR}{_LAT}{_GRK}](?=[0-9])|[0-9](?=[{_CYR}{_LAT}{_GRK}])")
_CYR_RE, _LAT_RE, _GRK_RE = re.compile(f"[{_CYR}]"), re.compile(f"[{_LAT}]"), re.compile(f"[{_GRK}]")


def mixed(text: str) -> bool:
    """Has the text a word of two alphabets?  The two quick tests settle most texts."""
    if text.isascii() or not _NON_LATIN_RE.search(text):
        return False
    if not _LATIN_RE.search(text) and not _GRK_RE.search(text):
        return False
    return _MIX_RE.search(text) is not None


def skeleton(text: str) -> str:
    """Decompose, map to prototypes, decompose again; invisible characters vanish."""
    d = unicodedata.normalize("NFKD", _INVIS_RE.sub("", text)).translate(PROTO)
    return unicodedata.normalize("NFKD", d)


def _alphabet(word: str) -> tuple[int, int, int]:
    return len(_CYR_RE.findall(word)), len(_LAT_RE.findall(word)), len(_GRK_RE.findall(word))


def _one_alphabet(word: str, cyrillic_text: bool) -> str:
    """The word in the alphabet that can spell all of it, preferring the majority."""
    c, lat, g = _alphabet(word)
    order = sorted(((c, cyrillic_text, "c"), (lat, not cyrillic_text, "l"), (g, False, "g")), reverse=True)
    tables = {"c": (TO_CYR, _CYR_RE), "l": (TO_LAT, _LAT_RE), "g": (TO_GRK, _GRK_RE)}
    first = None
    for n, _, k in order:
        if not n:
            continue
        out = word.translate(tables[k][0])
        first = first or out
        if len(tables[k][1].findall(out)) == len(word):
            return out
    return first or word


class Canonicaliser:
    """Row function of the operator; ``codes`` are the designations in their right characters."""

    def __init__(self, codes: Iterable[str] = ()):
        self.codes = {c for c in codes if c}
        self.by_key: dict[str, str] = {}
        for c in sorted(self.codes):
            self.by_key.setdefault(skeleton(c), c)
        self.cores = {len(k) for k in self.by_key}

    def designation(self, token: str) -> str | None:
        """The listed spelling if the token only looks like it."""
        if len(token) not in self.cores or token in self.codes:
            return None
        hit = self.by_key.get(skeleton(token))
        return hit if hit != token else None

    def __call__(self, text: str) -> tuple[str, str]:
        """(canonical text, kinds of fault found, comma separated)."""
        faults: list[str] = []
        out = text
        if _ODD_RE.search(out):
            if _INVIS_RE.search(out):
                faults.append("invisible")
                out = _INVIS_RE.sub("", out)
            if _SPACE_RE.search(out):
                faults.append("space")
                out = _SPACE_RE.sub(" ", out)
            if _JOINED_RE.search(out):
                faults.append("joined")
                out = _JOINED_RE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), out)
            composed = unicodedata.normalize("NFC", out)
            if composed != out:
                faults.append("accent")
                out = composed
        mixed_word = coded = False

        def fix(m: re.Match) -> str:
            nonlocal coded
            tok = m[0]
            hit = self.designation(tok)
            if hit is not None:
                coded = True
                return hit
            if tok in self.codes or not _MIX_RE.search(tok):
                return tok

            def word(w: re.Match) -> str:
                nonlocal mixed_word
                if not _MIX_RE.search(w[0]):
                    return w[0]
                mixed_word = True
                return _one_alphabet(w[0], cyr)

            return _WORD_RE.sub(word, tok)

        if mixed(out) or (self.by_key and _CODE_RE.search(out)):
            n_cyr = len(_CYR_RE.findall(out))
            cyr = n_cyr * 2 >= len(_LAT_RE.findall(out)) and n_cyr > 0
            out = _TOKEN_RE.sub(fix, out)
        if mixed_word:
            faults.append("alphabet")
        if coded:
            faults.append("designation")
        return out, ",".join(faults)


#: A token: letters and digits with what may be hidden in or joined to them; or a run of odd spaces.
_SPELLED = re.compile(f"[0-9{_CYR}{_LAT}{_GRK}{INVISIBLE}{JOINED}{ACCENT}]+|[{ODD_SPACE}]+")


def alphabet_of(text: str) -> bool:
    """Is the text Cyrillic, for words that could be either?"""
    n = len(_CYR_RE.findall(text))
    return n > 0 and n * 2 >= len(_LAT_RE.findall(text))


def ruled(token: str, cyrillic_text: bool) -> tuple[str, str]:
    """(the token spelled consistently, kinds of fault) by the token alone: nothing hidden, composed, each word in one alphabet."""
    out, faults = token, []
    for name, pattern, fn in (("invisible", _INVIS_RE, ""), ("space", _SPACE_RE, " "), ("joined", _JOINED_RE, lambda m: unicodedata.normalize("NFKC", m[0]))):
        if pattern.search(out):
            faults.append(name)
            out = pattern.sub(fn, out)
    composed = unicodedata.normalize("NFC", out)
    if composed != out:
        faults.append("accent")
        out = composed
    if _MIX_RE.search(out):
        faults.append("alphabet")
        out = _WORD_RE.sub(lambda w: _one_alphabet(w[0], cyrillic_text) if _MIX_RE.search(w[0]) else w[0], out)
    return out, ",".join(faults)


class Surveyor:
    """What one task learns: the spellings of its texts, and the values with tokens to look up in their group."""

    def __init__(self, codes: Iterable[str] | None):
        self.joined = codes is None  # the list is too long to be here: every token that could be listed is looked up
        self.codes = {c for c in codes or () if c and _CODE_RE.search(c)}
        self.listed: dict[str, str] = {}
        for c in sorted(self.codes):
            self.listed.setdefault(skeleton(c), c)
        self.lengths = {len(k) for k in self.listed}
        self.counts: Counter[str] = Counter()
        self.keys: dict[str, str] = {}

    def key(self, token: str) -> str:
        """Skeleton of the token, remembered."""
        got = self.keys.get(token)
        if got is None:
            if len(self.keys) > 300_000:
                self.keys.clear()
            got = self.keys[token] = token if token.isascii() else skeleton(token)
        return got

    def tokens(self, text: str) -> list[dict]:
        """The tokens of the text to look up, each once, with its group and its spelling by rule."""
        found = _SPELLED.findall(text)
        self.counts.update(found)
        cyrillic: bool | None = None
        out = []
        for tok in dict.fromkeys(found):
            plain = tok.isascii()
            hit = self.listed.get(self.key(tok)) if len(tok) in self.lengths or not plain else None
            if hit is not None:
                if hit != tok and tok not in self.codes:
                    out.append({"was": tok, "skeleton": self.key(tok), "now": hit, "faults": "designation", "listed": True})
                continue
            odd = not plain and (_ODD_RE.search(tok) or _MIX_RE.search(tok))
            if not odd:
                if self.joined and _CODE_RE.search(tok):
                    out.append({"was": tok, "skeleton": self.key(tok), "now": tok, "faults": "designation", "listed": False})
                continue
            cyrillic = alphabet_of(text) if cyrillic is None else cyrillic
            now, faults = ruled(tok, cyrillic)
            if faults:
                out.append({"was": tok, "skeleton": self.key(tok), "now": now, "faults": faults, "listed": False})
        return out

    def spellings(self) -> list[tuple[str, str, int, bool]]:
        """(skeleton, spelling, n, consistent) counted so far; the count begins anew."""
        rows = [(self.key(t), t, n, t.isascii() or not (_ODD_RE.search(t) or _MIX_RE.search(t))) for t, n in self.counts.items() if not t.isspace()]
        self.counts.clear()
        return rows


TOKENS = "array<struct<was:string,skeleton:string,now:string,faults:string,listed:boolean>>"


def survey(blocks: DataFrame, codes: Sequence[str] | None, fields: Sequence[str] = ("text_a", "final"), key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(values with tokens to look up, spellings by skeleton), from one pass over the texts, written once.

    ``codes`` is the reference list where it is short enough to travel with the tasks, else None: then every token with
    a digit beside a letter is kept for ``respell`` to look up in the table.
    """
    codes = None if codes is None else tuple(codes)
    names = [key, "field", "value", "tokens", "skeleton", "spelling", "n", "consistent"]

    def words(s: Surveyor) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None, None, *row) for row in s.spellings()], columns=names, dtype=object)

    def run(it):
        s = Surveyor(codes)
        for pdf in it:
            rows, done = [], {}
            for k, *vals in zip(pdf[key], *[pdf[f] for f in fields]):
                for f, v in zip(fields, vals):
                    if v:
                        if v not in done:
                            done[v] = s.tokens(v)
                        if done[v]:
                            rows.append((k, f, v, done[v], None, None, None, None))
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)
            if len(s.counts) > 200_000:
                yield words(s)
        yield words(s)

    kind = dict(blocks.dtypes)[key]
    both = stored(blocks.select(key, *fields).mapInPandas(run, f"{key} {kind}, field string, value string, tokens {TOKENS}, skeleton string, spelling string, n long, consistent boolean"))
    return both.where("tokens is not null").select(key, "field", "value", "tokens"), both.where("spelling is not null").select("skeleton", "spelling", "n", "consistent")


def skeleton_groups(spellings: DataFrame) -> DataFrame:
    """(skeleton, n_spellings, n_rows, spelling): the groups, each with its most frequent consistent spelling (NULL if none is)."""
    counts = spellings.groupBy("skeleton", "spelling").agg(F.sum("n").alias("n"), F.bool_or("consistent").alias("consistent"))
    rank = F.when(F.col("consistent"), F.struct("n", "spelling"))
    return counts.groupBy("skeleton").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows"), F.max(rank)["spelling"].alias("spelling"))


def code_table(codes: DataFrame, col: str = "code") -> DataFrame:
    """(skeleton, code): the designations by skeleton, the first of those that look the same; and (code) all of them."""

    def run(it):
        for pdf in it:
            own = [c for c in pdf[col] if c and _CODE_RE.search(c)]
            yield pd.DataFrame({"skeleton": [skeleton(c) for c in own], "code": own}, dtype=object)

    return codes.select(col).mapInPandas(run, "skeleton string, code string").distinct()


def respell(values: DataFrame, spellings: DataFrame, key: str = "id", codes: DataFrame | None = None) -> DataFrame:
    """(key, field, was, now, faults): every token whose group spells it otherwise.

    ``codes`` is the table of designations where ``survey`` had no list of them.
    """
    asked = values.select(key, "field", F.explode("tokens").alias("t")).select(key, "field", "t.*").distinct()
    known = spellings.where("consistent").select(F.col("spelling").alias("now")).distinct().withColumn("_known", F.lit(True))
    groups = skeleton_groups(spellings.join(asked.select("skeleton").distinct(), "skeleton", "left_semi")).select("skeleton", "spelling")
    found = asked.join(known, "now", "left").join(groups, "skeleton", "left")
    if codes is not None:
        listed = code_table(codes)
        first = listed.groupBy("skeleton").agg(F.min("code").alias("_code"))
        right = listed.select(F.col("code").alias("was")).distinct().withColumn("_right", F.lit(True))
        found = found.join(first, "skeleton", "left").join(right, "was", "left")
        hit = F.col("_code").isNotNull()
        found = found.withColumn("now", F.when(F.col("_right"), F.col("was")).when(hit, F.col("_code")).otherwise(F.col("now")))
        found = found.withColumn("listed", hit | F.coalesce("_right", F.lit(False))).withColumn("faults", F.when(hit, "designation").otherwise(F.col("faults")))
    now = F.when(F.col("listed") | F.col("_known"), F.col("now")).otherwise(F.coalesce("spelling", "now"))
    return found.select(key, "field", "was", now.alias("now"), "faults").where("was <> now")


def found_in(blocks: DataFrame, codes: Sequence[str] | DataFrame, fields: Sequence[str] = ("text_a", "final"), key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(values with tokens to look up, respelled tokens), with the designations as a list or as a table of any length."""
    if isinstance(codes, DataFrame):
        values, spellings = survey(blocks, None, fields, key)
        return values, respell(values, spellings, key, codes)
    values, spellings = survey(blocks, codes, fields, key)
    return values, respell(values, spellings, key)


def canonicalise(blocks: DataFrame, codes: Sequence[str] | DataFrame, fields: Sequence[str] = ("text_a", "final"), key: str = "id") -> DataFrame:
    """(key, field, value, clean, faults): one row per value that had a fault, with every token as its group spells it."""
    values, fixes = found_in(blocks, codes, fields, key)
    fixes = fixes.groupBy(key, "field").agg(F.map_from_entries(F.collect_set(F.struct("was", "now"))).alias("map"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("faults", ","))))), ",").alias("faults"))

    def run(it):
        for pdf in it:
            pdf["clean"] = [_SPELLED.sub(lambda m: dict_.get(m[0], m[0]), v) for v, dict_ in zip(pdf["value"], map(dict, pdf["map"]))]
            yield pdf[[key, "field", "value", "clean", "faults"]]

    kind = dict(blocks.dtypes)[key]
    rows = values.select(key, "field", "value").distinct().join(fixes, [key, "field"])
    return rows.mapInPandas(run, f"{key} {kind}, field string, value string, clean string, faults string")
