"""Text of other blocks in a draft: a reader that saw more than its block copies lines and tables of the neighbours.

A line of draft B goes when its own draft A does not have it and another block of the page has it; a pipe table goes as
a whole when most of its words stand in other blocks and not in A.  Likeness is that of the best stretch, so misread
copies are seen as well.  A page is the group: its blocks are few whatever the size of the book.
"""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables, text

# Kinds that are guarded, shortest line that is compared, likeness (percent) by which a draft has a line, share of words of a copied table.
GUARDED = ("text", "title", "caption", "footnote", "list")
MIN_LINE, OWN, FOREIGN, TABLE_SHARE = 12, 85, 90, 0.6
_WORD = re.compile(r"\w+")


def likeness(line: str, hay: str) -> int:
    """Percent of the best match of the line with a stretch of ``hay`` as long as itself: twice their common subsequence over both lengths.

    Where one pass of edit distances already tells that no stretch can reach ``OWN``, 0 is returned.
    """
    if not line or not hay:
        return 0
    if len(line) > len(hay):
        line, hay = hay, line
    if line in hay:
        return 100
    n = len(line)
    ends = tables.edits(line, hay, anywhere=True)
    least = 2 * (1 - OWN / 100) * n + 1  # with more edits than that, too few letters are common
    near = sorted({s for e, d in enumerate(ends) if d <= least for s in range(max(0, e - n - 2), min(len(hay) - 1, e - n + 3))})
    windows = [hay[s : s + n] for s in near]
    edges = [hay[:k] for k in range(n // 2, n)] + [hay[-k:] for k in range(n // 2, n)] if near else []
    return max((round(200 * common(line, w) / (n + len(w))) for w in [*windows, *edges]), default=0)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


#: Letters of the pieces by which a line is looked up in other blocks before it is compared.
GRAM = 4


def grams(s: str) -> set[str]:
    return {s[i : i + GRAM] for i in range(len(s) - GRAM + 1)}


def may_stand_in(line: str, pieces: set[str]) -> bool:
    """Can a text with these pieces hold the line to ``FOREIGN`` percent?  Every edit spoils at most ``GRAM`` of its pieces."""
    n = len(line)
    least = n - GRAM + 1 - GRAM * 2 * (1 - FOREIGN / 100) * n
    return least <= 0 or sum(line[i : i + GRAM] in pieces for i in range(n - GRAM + 1)) >= least


def paragraphs(rows: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """(line, canonical form) pairs by paragraph; a run of pipe rows is a paragraph of its own."""
    def kind(row: tuple[str, str]) -> int:
        s = row[0].strip()
        return 0 if not s else 2 if s.startswith("|") and s.count("|") >= 2 else 1

    return [list(run) for k, run in groupby(rows, key=kind) if k]


def cleaned(rows: list[tuple[str, str]], own: str, others: list[tuple[str, set[str]]]) -> str | None:
    """The draft without foreign text, given the forms of the other blocks with their pieces; None where nothing is foreign."""
    words, own_words = {w for o, _ in others for w in _WORD.findall(o)}, set(_WORD.findall(own))
    kept, changed = [], False
    for par in paragraphs(rows):
        if par[0][0].strip().startswith("|") and len(par) >= 2 and par[0][0].count("|") >= 2:
            found = [w for ln, c in par if not tables.is_rule(ln) for w in _WORD.findall(c)]
            if found and sum(w in words for w in found) >= TABLE_SHARE * len(found) and sum(w in own_words for w in found) < TABLE_SHARE * len(found):
                changed = True
                continue
        held = lambda c, o, g: may_stand_in(c, g) if len(c) <= len(o) else may_stand_in(o, grams(c))
        foreign = lambda c: any(held(c, o, g) and likeness(c, o) >= FOREIGN for o, g in others)
        lines = [ln for ln, c in par if len(c) < MIN_LINE or c in own or not foreign(c) or likeness(c, own) >= OWN]
        changed |= len(lines) < len(par)
        if lines:
            kept.append("\n".join(lines))
    return "\n\n".join(kept).strip() if changed else None


def guarded(blocks: DataFrame) -> DataFrame:
    """(book, page, id, clean, lines): drafts B that held text of other blocks, without it, and how many lines went.

    Needs id, book, page, kind, parent, drafts_status, text_a, text_b.  A draft of which nothing is left is empty.
    """
    base = blocks.where(F.col("book").isNotNull() & F.col("page").isNotNull())
    own = text.text_form(F.coalesce("text_a", F.lit("")))
    source = (F.col("parent").isNull() & (F.trim(F.coalesce("text_a", F.lit(""))) != "")).alias("source")
    whole = base.select("book", "page", "id", own.alias("form"), source)
    asked = base.where(F.col("kind").isin(*GUARDED) & (F.col("drafts_status") == "done") & (F.trim("text_b") != ""))
    lines = asked.select("book", "page", "id", F.posexplode(F.split("text_b", "\n")).alias("line_no", "line")).withColumn("form", text.text_form(F.col("line")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = whole.select("book", "page", "id", none("int", "line_no"), none("string", "line"), "form", "source").unionByName(lines.withColumn("source", F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks_, parts = pdf[pdf["line_no"].isna()], pdf[pdf["line_no"].notna()].sort_values(["id", "line_no"])
        forms = dict(zip(blocks_["id"], blocks_["form"]))
        sources = {i: (f, grams(f)) for i, f, s in zip(blocks_["id"], blocks_["form"], blocks_["source"]) if s and f}
        out = []
        for i, p in parts.groupby("id"):
            others = [f for k, f in sources.items() if k != i]
            clean = cleaned(list(zip(p["line"], p["form"])), forms[i], others) if others else None
            if clean is not None:
                out.append((pdf["book"].iloc[0], pdf["page"].iloc[0], i, clean, len(p) - (clean.count("\n") + 1 - clean.count("\n\n") if clean else 0)))
        return pd.DataFrame(out, columns=["book", "page", "id", "clean", "lines"])

    return rows.groupBy("book", "page").applyInPandas(run, "book string, page string, id long, clean string, lines int")
