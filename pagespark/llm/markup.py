"""Problem 2: markup residue in text documents.

Method: maximum-scoring subsequence.  A text is cut into words and markup tokens;
words score positive, tags negative, words of menus, footers and scripts negative as
well; one linear scan finds the contiguous run with the highest sum, the content
region.  What lies outside the region is dropped with its words, tags inside are
converted: headings, list items, code and formulas keep a plain marking, cells of a
row are told apart, all other tags give way to their content.  The same scan with
the signs turned finds the region with most markup: its score says how much residue
a text holds, and a text is a case if it is positive.

The weights are a logistic regression on labelled pages: lines of at most ``SAMPLE``
values of the corpus, labelled as content if the page's other draft has most of
their words, on top of ``LABELLED``, a few lines for token kinds a corpus may lack.

Defined results: NULL and empty texts have no tokens, no region and no case; a
text of tags only has an empty region; equal sums prefer the earliest, longest
region; a text of any length is scanned once, whole; without labelled values the
weights come from ``LABELLED`` alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, melt_fields, memo

# Element names of HTML and of the wiki extensions seen in page text.
TAGS = (
    "a abbr aside b big blockquote body br caption center cite code col colgroup dd del div dl dt em figcaption figure font footer "
    "h1 h2 h3 h4 h5 h6 head header hr html i img ins kbd li link main math menu meta nav nobr nowiki ol p pre q ref s samp script section small "
    "span strike strong style sub sup table tbody td tfoot th thead title tr tt u ul var wbr"
)

_T = "|".join(sorted(TAGS.split(), key=len, reverse=True))
#: Kinds of token, first match wins.
TOKENS = [
    ("comment", r"<!--.*?(?:-->|\Z)"),
    ("fence", r"^[ \t]*(?:```|~~~)[^\n]*$"),
    ("math", r"\$\$[^$]+\$\$|(?<![\\$\w])\$(?=[^\s$])(?:\\.|[^$\n\\])*?[^\s$]?\$(?!\d)|\\\(.*?\\\)|\\\[.*?\\\]"),
    ("tag", rf"</?(?:{_T})(?:\s+[^<>\n]*|\s*/)?>|<(?:{_T})\s+[^<>\n]*(?=<)"),
    ("entity", r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"),
    ("image", r"!\[[^\]\n]*\]\([^()\n]*\)"),
    ("link", r"(?<!!)\[(?!\^)[^\[\]]*\]\((?:#|https?:|/|\.|www\.|mailto:|[\w./-]+\.\w)[^()\n]*\)"),
    ("wikilink", r"\[\[[^\[\]]*\]\]"),
    ("template", r"\{\{[^{}]*\}\}"),
    ("wikitable", r"^[ \t]*(?:\{\||\|\}|\|-)[^\n]*$"),
    ("wikirow", r"^[ \t]*[|!](?![-}|])[^\n]*$(?=\n[ \t]*(?:\|[-}]|[|!]))"),
    ("begin", r"\\(?:begin|end)\{[A-Za-z]+\*?\}?|\\en[d]?\{?\Z"),
    ("command", r"\\(?:section|subsection|subsubsection|chapter|paragraph|emph|textbf|textit|texttt|textsc|textrm|text|underline|cite|ref|label|footnote|item|url|href|caption|title|frac|sqrt|mathrm|mathbf|alpha|beta|gamma|delta|sigma|lambda|mu|omega|varphi|cdot|times|quad|left|right|ldots|dots|par|noindent|newline|linebreak|hspace|vspace|centering|small|large|bf|it|rm|tt)(?![A-Za-z])\*?"),
    ("escape", r"~(?=\\)|\\\\(?=\s|\Z)"),
    ("heading", r"^[ \t]*(?:>[ \t]*)*#{1,6}[ \t]+(?=\S)|^[ \t]*={2,6}[^=\n]+?={2,6}[ \t]*$|^(?:={4,}|-{4,})[ \t]*$"),
    ("quote", r"^[ \t]*>[ \t]+(?=\S)"),
    ("wikibold", r"'{2,5}(?=\S)[^'\n]*(?:'(?!')[^'\n]*)*'{2,5}"),
    ("bold", r"\*\*(?=[^\s*])(?:[^*\n]|\n(?!\n)|(?<!\*)\*(?!\*))+?(?<=\S)\*\*+|(?<![\w_])__(?=[^\s_])[^_\n]+?(?<=\S)__(?![\w_])|~~(?=\S)[^~\n]+~~"),
    ("italic", r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*(?:\n[^*\n]+)?[^\s*]\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]*?[^\s_]_(?![\w_])"),
    ("code", r"`[^`\n]+(?:\n[^`\n]+)?`"),
    ("note", r"\[\^\w+\]:?"),
    ("word", r"\w+"),
]
_LEX = re.compile("|".join(f"(?P<{n}>{p})" for n, p in TOKENS), re.M | re.S | re.I)
#: Only these characters can begin a construct; a text without them has none.
_MAY = re.compile(r"[<&\[\]{}\\$*_#`|~=>]|'{2}|^-{4,}", re.M)

#: Kinds that are markup; footnote marks stand for themselves.
MARKUP = tuple(n for n, _ in TOKENS if n not in ("word", "note"))
#: Kinds that hold text of their own: their words count as words of the content.
HOLDERS = ("wikirow", "link", "wikilink", "wikibold", "bold", "italic", "code", "heading")


#: Elements whose words are not content of the page; the text of the last three is never shown.
ASIDE = ("nav", "footer", "menu", "aside", "head", "script", "style")
_TAG_NAME = re.compile(r"<(/?)\s*(\w+)")
_WORDS = re.compile(r"\w+")


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    words: int


def tokens(text: str) -> list[Token]:
    """Words and markup tokens in order; words inside an element of ``ASIDE`` are of the kind aside."""
    out, inside = [], ""
    for m in _LEX.finditer(text):
        k = m.lastgroup
        if k == "tag":
            close, name = _TAG_NAME.match(m[0]).groups()
            if not inside and name.lower() in ASIDE and not close:
                inside = name.lower()
            elif close and name.lower() == inside:
                inside = ""
        words = len(_WORDS.findall(m[0])) if k in HOLDERS else 0
        out.append(Token("aside" if inside and (k == "word" or words) else k, m.start(), m.end(), 0 if inside else words))
    return out


# Labelled lines that every fit includes.  1 marks a content line, 0 a wrapper line.
LABELLED = [
    (0, '<html><head><title>x</title></head><body class="a">'), (0, '<div class="nav"><a href="#">1</a><a href="#">2</a></div>'),
    (1, "The casting cools slowly in the sand while the riser feeds it."), (1, "A <b>steel</b> ladle is dried before it is filled with metal."),
    (1, "# Heating"), (1, "At a low speed the *drill* leaves a clean bore in the plate."), (0, "{{nav|1}}{{toc}}"), (0, "\\begin{center}\\small"),
    (1, "The load $x_1$ on the shaft follows the speed of the gear."), (0, "</div></body></html>"), (0, "<!-- page: 3 -->"), (1, "== Forging =="),
    (1, "\\section{Moulds and cores}"), (1, "\\item the die is heated first"), (0, "\\end{center}"), (1, "The [[core]] is held by prints<ref>3</ref> in the mould."),
    (0, "<table><tr><td>"), (0, "</td></tr></table>"), (1, "Use `G1` to move the tool along the line of the cut."), (0, "<br/><br/><hr/>"),
    (1, "<li>sand</li><li>clay</li>"), (1, "<h2>Moulds</h2>"), (1, "<li>steel</li>"), (1, "<b>Note</b>"), (1, "<td>speed</td><td>load</td>"), (1, "<p>fit<br/>gap</p>"),
    (0, "<nav>Home | News | Contact</nav>"), (0, "<footer>Imprint, all rights</footer>"), (0, "<script>var x = 1;</script>"),
]


KINDS = [n for n, _ in TOKENS] + ["aside"]
#: Most values whose lines are used as labelled pages.
SAMPLE = 2_000


def line_features(line: str) -> np.ndarray:
    """How often each kind stands in a line; words inside a construct count as words."""
    x = np.zeros(len(KINDS))
    for t in tokens(line):
        x[KINDS.index(t.kind)] += 1
        x[KINDS.index("word")] += t.words
    return x


def labelled_lines(value: str, draft: str) -> list[tuple[int, str]]:
    """The lines of a value that hold markup, labelled by whether the other draft has most of their words."""
    known = set(_WORDS.findall(draft.lower()))
    out = []
    for line in value.split("\n"):
        if _MAY.search(line):
            plain = [w for w in _WORDS.findall(_strip(line).lower()) if not w.isdigit()]
            out.append((int(bool(plain) and sum(w in known for w in plain) * 2 >= len(plain)), line))
    return out


def fit(pages: list[tuple[int, str]], rounds: int = 60, rate: float = 0.1) -> dict[str, float]:
    """Weight of every token kind: logistic regression on labelled lines, words kept positive, markup and asides negative."""
    y, x = np.array([lab for lab, _ in LABELLED], float), np.array([line_features(line) for _, line in LABELLED])
    weight = np.ones(len(LABELLED))
    if pages:
        # the lines of the corpus count twice as much as the fixed ones, whatever their number
        y, x = np.concatenate([y, [lab for lab, _ in pages]]), np.concatenate([x, [line_features(line) for _, line in pages]])
        weight = np.concatenate([weight, np.full(len(pages), 2 * len(LABELLED) / len(pages))])
    x = np.minimum(x, 12)
    w = np.zeros(len(KINDS))
    for _ in range(rounds):
        w += rate * (x.T @ (weight * (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))) - 0.05 * w)
    out = dict(zip(KINDS, w.tolist()))
    for k in KINDS:
        out[k] = max(out[k], 0.3) if k in ("word", "note") else min(out[k], -0.1)
    # a word outweighs the tags of a cell or item, so that what lies beside a construct is not cut off
    out |= {k: max(v, -out["word"] / 8) for k, v in out.items() if k not in ("word", "note", "aside")}
    out["aside"] = min(out["aside"], -out["word"] / 2)
    return out


def sample_weights(df: DataFrame, fields: Sequence[str], draft: str, key: str = "id", sample: int = SAMPLE) -> dict[str, float]:
    """``fit`` on the values of at most ``sample`` rows with another draft, chosen by a hash of their key."""
    hint = r"[<&\[\]{}\\$*_#`|~=>]|''"
    rows = df.where(F.col(draft).isNotNull() & F.greatest(*[F.coalesce(F.col(f).rlike(hint), F.lit(False)) for f in fields]))
    got = bounded_sample(rows.select(key, draft, *fields), key, sample).collect()
    return fit([p for r in got for f in fields if r[f] for p in labelled_lines(r[f], r[draft])])


def region(toks: list[Token], w: dict[str, float]) -> tuple[int, int]:
    """Half-open token range with the highest sum of weights: one linear scan, earliest and longest on ties."""
    return best_run([w[t.kind] + t.words * w["word"] for t in toks])[:2]


def residue(toks: list[Token], w: dict[str, float]) -> float:
    """Score of the region with most markup: the same scan with the signs turned; the words a construct holds don't count."""
    return best_run([-w[t.kind] for t in toks])[2]


def best_run(scores: list[float]) -> tuple[int, int, float]:
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        run += s
        if run > best + 1e-12 or (run >= best - 1e-12 and best_at[0] == start and best > 0):
            best, best_at = max(best, run), (start, i + 1)
        if run < 0:
            run, start = 0.0, i + 1
    return *best_at, best


#: Stands between the cells of a row until the text is tidied.
CELL = "\x1f"
_LIST = {"li": "\n- ", "dt": "\n", "dd": "\n  ", "td": CELL, "th": CELL}
_BREAK = {"br", "menu", "nav", "aside", "p", "div", "tr", "ul", "ol", "table", "blockquote", "hr", "pre", "dl", "section", "header", "footer"}


def _strip(s: str) -> str:
    """Text of a construct that lies inside another."""
    return convert(s, 0, None) if _MAY.search(s) else s


def _render(kind: str, s: str) -> str:
    if kind == "wikirow":
        return CELL.join(c.strip(" \t") for c in re.split(r"\|\||!!", s.strip()[1:]))
    if kind in ("comment", "template", "wikitable", "begin", "escape", "quote"):
        return " " if kind == "template" else ""
    if kind == "tag":
        name = re.match(r"</?\s*(\w+)", s)[1].lower()
        if re.fullmatch(r"h[1-6]", name):
            return "\n" if s[1] == "/" else "\n" + "#" * int(name[1]) + " "
        if s[1] == "/":
            return "\n" if name in _BREAK or name == "li" else ("`" if name in ("code", "tt", "kbd", "samp") else "")
        return _LIST.get(name, "\n" if name in _BREAK else ("`" if name in ("code", "tt", "kbd", "samp") else ""))
    if kind == "entity":
        return html.unescape(s).replace("\u00a0", " ")
    if kind == "image":
        return s[2 : s.index("]")]
    if kind == "link":
        return _strip(s[1 : s.index("](")])
    if kind == "wikilink":
        return _strip(s[2:-2].rpartition("|")[2])
    if kind == "wikibold":
        return _strip(s.strip("'"))
    if kind == "bold":
        return _strip(s.strip("*_~"))
    if kind == "italic":
        return _strip(s[1:-1])
    if kind == "heading":
        t = s.strip()
        if t.startswith("="):
            body = t.strip("=").strip()
            return "#" * min(6, len(t) - len(t.lstrip("="))) + " " + body if body else ""
        return re.sub(r"^[>\s]+", "", s) if "#" in t else ""
    if kind == "command":
        name = s.strip("\\*")
        level = {"chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}.get(name)
        return "\n" + "#" * level + " " if level else ("\n- " if name == "item" else ("\n" if name in ("par", "newline", "linebreak") else ("" if name in _SILENT else s)))
    return s  # words, notes, code, fences, formulas


_SILENT = set("emph textbf textit texttt textsc textrm text underline cite ref label footnote url href caption noindent hspace vspace centering small large bf it rm tt".split())


def convert(text: str, lo: int, hi: int | None) -> str:
    """Clean text of a character range."""
    out, at = [], lo
    end = len(text) if hi is None else hi
    braces = skip = 0
    for m in _LEX.finditer(text, lo, end):
        if m.start() < skip:
            continue
        gap, k = text[at : m.start()], m.lastgroup
        if k == "tag" and (name := _TAG_NAME.match(m[0])) and not name[1] and name[2].lower() in ASIDE[-3:]:
            out.append(gap)  # what the page never shows
            close = re.compile(rf"</\s*{name[2]}\s*>", re.I).search(text, m.end(), end)
            at = skip = close.end() if close else m.end()
            continue
        if braces and gap:
            gap, braces = _close(gap, braces)
        at = m.end()
        if k == "command" and m[0].strip("\\*") in ("cite", "ref", "label", "hspace", "vspace") and text[at : at + 1] == "{":
            out.append(gap)  # the argument is a key or a length, not text
            at = (text.find("}", at, end) + 1) or end
            skip = at
            continue
        if k == "command" and text[at : at + 1] == "{":
            out += [gap, _render(k, m[0])]
            braces += 1
            at += 1
            continue
        out += [gap, m[0] if k == "word" else _render(k, m[0])]
    gap = text[at:end]
    out.append(_close(gap, braces)[0] if braces else gap)
    return "".join(out)


def _close(gap: str, braces: int) -> tuple[str, int]:
    """Drop as many closing braces as commands opened."""
    kept = []
    for c in gap:
        if c == "}" and braces:
            braces -= 1
        else:
            kept.append(c)
    return "".join(kept), braces


_CODE = re.compile(r"(^[ \t]*(?:```|~~~)[^\n]*\n.*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z))", re.M | re.S)
_ITEM = re.compile(r"([ \t]{2,}|)(?=(?:[-*+•]|\d+[.)]) )")


def tidy(s: str) -> str:
    """Spaces and blank lines squeezed; code blocks stay as they are, list items keep their indentation."""
    parts = _CODE.split(s)
    return re.sub(r"\n{3,}", "\n\n", "".join(p if k % 2 else _squeezed(p) for k, p in enumerate(parts))).strip("\n ")


def _squeezed(s: str) -> str:
    out = []
    for line in s.split("\n"):
        indent = m[1] if (m := _ITEM.match(line)) else ""
        cells = [c.strip() for c in re.sub(r"[ \t]+", " ", line).split(CELL)]
        out.append(indent + " | ".join(cells[0 if cells[0] else 1 :]).rstrip() if len(cells) > 1 else indent + cells[0])
    return "\n".join(out)


class Cleaner:
    """Row function of the operator: (clean text, constructs found, content share of the words, score of the residue)."""

    def __init__(self, w: dict[str, float]):
        self.w = w

    def __call__(self, text: str) -> tuple[str, str, float, float]:
        toks = tokens(text) if _MAY.search(text) else []
        score = residue(toks, self.w)
        if score <= 0:
            return text, "", 1.0, 0.0
        kinds = ",".join(sorted({t.kind for t in toks if t.kind in MARKUP}))
        a, b = region(toks, self.w)
        words = [i for i, t in enumerate(toks) if t.kind in ("word", "note", "aside") or t.words]
        if b <= a:
            return "", kinds, 0.0, score
        inside = sum(a <= i < b for i in words)
        lo = toks[a].start if any(i < a for i in words) else 0
        hi = next((t.start for t in toks[b:]), None) if any(i >= b for i in words) else None  # with the signs that end it
        return tidy(convert(text, lo, hi)), kinds, inside / max(1, len(words)), score


def clean_markup(df: DataFrame, fields: tuple[str, ...] = ("final", "arbiter_text"), key: str = "id", w: dict[str, float] | None = None) -> DataFrame:
    """(key, field, clean, constructs, content_share, residue): one row per value whose residue scores above 0."""
    w = w or fit([])
    names = ["clean", "constructs", "content_share", "residue"]

    def run(it):
        fn = memo(Cleaner(w))
        for pdf in it:
            res = [fn(v) for v in pdf["value"]]
            for k, name in enumerate(names):
                pdf[name] = [r[k] for r in res]
            yield pdf[pdf["residue"] > 0][[key, "field", *names]]

    kind = dict(df.dtypes)[key]
    return melt_fields(df.select(key, *fields), key, fields).mapInPandas(run, f"{key} {kind}, field string, clean string, constructs string, content_share double, residue double")
