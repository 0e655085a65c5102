"""Pictures inside tables: which image goes into which empty ``<img>`` of a table, and which go behind it.

The markup is read as a row of image tags without a source, told apart by one pattern; deciding gives every tag a path or
nothing, writing replaces the tags.  Everything round the tags stays as it stands.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACED = T.StructType([T.StructField("html", T.StringType()), T.StructField("rest", T.ArrayType(T.StringType())), T.StructField("note", T.StringType())])
_IMG = re.compile(r"<img\b([^<>]*)>(?:\s*</img>)?", re.I)
_SOURCE = re.compile(r"""\bsrc\s*=\s*(?:"[^"]+"|'[^']+'|[^\s"'>]+)""", re.I)
_NUMBER = re.compile(r"""\bn\s*=\s*["']?(\d{1,4})["']?(?=[\s/]|$)""", re.I)
_CELL = re.compile(r"(<t[dh]\b[^>]*>)(.*?)(</t[dh]>)", re.S | re.I)
#: A figure's name at the beginning of a line of a cell.
_NAME = re.compile(r"(?:<t[dh][^>]*>|<br\s*/?>)\s*(?=(?:Рис|Fig|Abb)\.\s*\d+[^<]{0,8}?\s*(?:<br|</t[dh]>))", re.I)


def empty_images(markup: str) -> list[re.Match]:
    return [m for m in _IMG.finditer(markup) if not _SOURCE.search(m[1])]


def image(path: str) -> str:
    return f'<img src="{html.escape(path)}"/>'


def written(markup: str, tags: list[re.Match], paths: list[str | None]) -> str:
    """The markup with the k-th tag showing the k-th path; tags without one go."""
    out, at = [], 0
    for m, path in zip(tags, paths):
        out += [markup[at : m.start()], image(path) if path else ""]
        at = m.end()
    return "".join(out) + markup[at:]


def by_number(tags: list[re.Match], sketches: list[str]) -> list[str | None] | None:
    """Paths of tags that name the number of their sketch; the first tag of a number counts.  None without such a tag."""
    numbers = [int(n[1]) if (n := _NUMBER.search(m[1])) else 0 for m in tags]
    if not any(numbers) or not sketches:
        return None
    first = {k: i for i, k in reversed(list(enumerate(numbers)))}
    return [sketches[k - 1] or None if 1 <= k <= len(sketches) and first[k] == i else None for i, k in enumerate(numbers)]


def into_cells(markup: str, other: str | None, sketches: list[str]) -> str | None:
    """The table with the sketches at the end of the cells where another reading of it has its empty images."""
    cells = list(_CELL.finditer(other or ""))
    slots = [i for i, c in enumerate(cells) for _ in empty_images(c[2])]
    own = list(_CELL.finditer(markup))
    if len(slots) != len(sketches) or len(own) != len(cells):
        return None
    extra: dict[int, str] = {}
    for i, path in zip(slots, sketches):
        extra[i] = extra.get(i, "") + (image(path) if path else "")
    numbers = iter(range(len(own)))
    return _CELL.sub(lambda m: f"{m[1]}{m[2]}{extra.get(next(numbers), '')}{m[3]}", markup)


def place(markup: str, sketches: list[str], other: str | None = None) -> tuple[str, list[str], str | None]:
    """(markup, sketches that go behind it, remark): no empty image is left in the markup.

    In turn: tags that name their sketch; as many tags as sketches, in order; several tables, in order as far as either
    reaches; one table, by the cells of another reading, or before the figure names in its cells.
    """
    tags = empty_images(markup)
    n_tables = len(re.findall(r"<table\b", markup, re.I))
    numbered = by_number(tags, sketches)
    slots = f"{len(sketches)} sketches, {len(tags)} <img> slots: "
    if numbered is not None:
        used = {p for p in numbered if p}
        rest = [s for s in sketches if s not in used]
        return written(markup, tags, numbered), rest, f"{len(sketches)} sketches, {len(used)} placed by arbiter: the rest appended after the table" if rest else None
    if not n_tables:
        note = "table not parsed, sketches placed after it" if sketches else f"{slots}empty <img> removed" if tags else None
        return written(markup, tags, [None] * len(tags)), list(sketches), note
    if len(tags) == len(sketches):
        return written(markup, tags, list(sketches)), [], None
    if n_tables > 1:
        k = min(len(tags), len(sketches))
        paths = [*sketches[:k], *[None] * (len(tags) - k)]
        return written(markup, tags, paths), list(sketches[k:]), slots + ("extra sketches appended after tables" if len(sketches) > k else "extra empty <img> removed")
    bare = written(markup, tags, [None] * len(tags))
    if sketches:
        if (filled := into_cells(bare, other, sketches)) is not None:
            return filled, [], None
        names = list(_NAME.finditer(bare))
        if len(names) == len(sketches):
            out, at = [], 0
            for m, path in zip(names, sketches):
                out += [bare[at : m.end()], f"{image(path)}<br/>" if path else ""]
                at = m.end()
            return "".join(out) + bare[at:], [], None
    return bare, list(sketches), slots + ("sketches placed after the table" if sketches else "empty <img> removed")


@F.pandas_udf(PLACED)
def placed(markup: pd.Series, sketches: pd.Series, other: pd.Series) -> pd.DataFrame:
    """``place`` per row; a NULL table stays NULL with all its sketches behind it."""
    rows = []
    for m, s, o in zip(markup, sketches, other):
        paths = [p or "" for p in s] if isinstance(s, (list, np.ndarray)) else []
        rows.append((None, paths, None) if m is None else place(m, paths, o))
    return pd.DataFrame(rows, columns=["html", "rest", "note"])
