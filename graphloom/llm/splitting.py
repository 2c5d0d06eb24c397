"""Oversized texts cut into overlapping pieces at natural boundaries, by packing a structure tree.

The tree has sections at the top, nested by the level of their headings, then paragraphs, list items nested by
their indentation, lines, sentences, clauses, words and characters. Only a node that is over the limit is
taken apart into its children; consecutive siblings that fit are merged as long as the limit holds, and what
is left of a node that was taken apart is not mixed with its siblings.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import clean
from graphloom.llm.sentences import ABBREVIATIONS

MAX_TOKENS, MAX_CHARS, OVERLAP_TOKENS, OVERLAP_CHARS = 550, 4000, 50, 300

_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)
_CLOSERS = "\"'”’“»)\\]）」』"
_LINE = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
_HEADING = re.compile(rf"(?:\A|{_LINE})([^\S\n\r]*)((?:=[^\S\n\r]*)+(?=[^=\n\r]*[^=\s])[^\n\r]*=|#{{1,6}}(?= )[^\n\r]*)[^\S\n\r]*(?=[\n\r]|\Z)")
_ITEM = re.compile(rf"(?:\A|{_LINE})([^\S\n\r]*)(?:[-*+•‣◦–]|\(?[0-9]{{1,3}}[.)]|\(?[^\W\d_][.)])[^\S\n\r]+")
_DEEPEST = 64  # what is nested deeper counts as if it were so deep
_HEADINGS, _PARAGRAPHS, _ITEMS, _LINES, _SENTENCES = range(5)
#: Of the other levels: the end of a match is a boundary; a boundary of one level may be one of a deeper level too.
_LEVELS = (
    None,
    re.compile(rf"{_LINE}(?:[^\S\n\r]*{_LINE})+\s*"),
    None,
    re.compile(rf"{_LINE}\s*"),
    re.compile(rf"[.!?…؟।॥][{_CLOSERS}]*\s+|[。！？][{_CLOSERS}]*\s*|(?<=[\u0e00-\u0e7f])\s+(?=[\u0e00-\u0e7f])"),
    re.compile(r"[;；]\s*|[:,،\u2014]\s+|[，、：]\s*"),
    re.compile(r"\s+"),
)
_ABBREVIATION = re.compile(rf"(?<!\w)(?:{'|'.join(' '.join(ABBREVIATIONS.values()).split())}|[^\W\d_])\.\s+", re.I)


class Tree:
    """One text with its boundaries, which are looked for only on the levels that are needed."""

    def __init__(self, text: str, max_tokens: int, max_chars: int):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        space = np.isin(codes, _SPACES)
        before = np.concatenate(([True], space[:-1]))
        self.text, self.space, self.max_tokens, self.max_chars = text, space, max_tokens, max_chars
        # tokens that begin, and characters with each run of white space as one, up to a position
        self.tokens = np.concatenate(([0], np.cumsum(~space & before)))
        self.chars = np.concatenate(([0], np.cumsum(~space | ~before)))
        self.cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def size(self, a: int, b: int) -> tuple[int, int]:
        inside = a > 0 and a < len(self.space) and not self.space[a] and not self.space[a - 1]
        return int(self.tokens[b] - self.tokens[a]) + inside, int(self.chars[b] - self.chars[a])

    def fits(self, a: int, b: int) -> bool:
        tokens, chars = self.size(a, b)
        return tokens <= self.max_tokens and chars <= self.max_chars

    def _found(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries of a level and how deep each lies: a heading's level, an item's indentation, else 0."""
        if level == _HEADINGS:
            marks = [(m.start(1), m[2].count("=", 0, len(m[2]) - len(m[2].lstrip("= \t"))) or len(m[2]) - len(m[2].lstrip("#"))) for m in _HEADING.finditer(self.text)]
        elif level == _ITEMS:
            marks = [(m.start(1), len(m[1].expandtabs(4))) for m in _ITEM.finditer(self.text)]
        else:
            marks = [(m.end(), 0) for m in _LEVELS[level].finditer(self.text)]
        at, depth = np.array([m[0] for m in marks], dtype=np.int64), np.array([min(m[1], _DEEPEST) for m in marks], dtype=np.int64)
        if level == _SENTENCES and len(at):  # a sentence goes on after these
            kept = ~np.isin(at, [m.end() for m in _ABBREVIATION.finditer(self.text)])
            at, depth = at[kept], depth[kept]
        return at, depth

    def boundaries(self, level: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries of a level strictly between two positions, and their depths."""
        if level not in self.cuts:
            self.cuts[level] = self._found(level)
        at, depth = self.cuts[level]
        inside = slice(np.searchsorted(at, a, "right"), np.searchsorted(at, b, "left"))
        return at[inside], depth[inside]

    def children(self, a: int, b: int, level: int) -> tuple[list[int], int]:
        """Where the children of a node begin and the last one ends, and their level; none below words."""
        for k in range(level, len(_LEVELS)):
            at, depth = self.boundaries(k, a, b)
            if len(at):  # the uppermost headings or items part siblings, deeper ones lie inside them
                return [a, *at[depth == depth.min()].tolist(), b], k
        return [], level

    def pack(self, a: int, b: int, level: int = 0) -> list[tuple[int, int]]:
        """Consecutive spans under the limits that make up the node from ``a`` to ``b``."""
        if self.fits(a, b):
            return [(a, b)]
        edges, level = self.children(a, b, level)
        if not edges:
            return self.characters(a, b)
        spans, whole = [], False
        for x, y in zip(edges, edges[1:]):
            if not self.fits(x, y):
                spans += self.pack(x, y, level)
                whole = False
            elif whole and self.fits(spans[-1][0], y):
                spans[-1] = (spans[-1][0], y)
            else:
                spans.append((x, y))
                whole = True
        return spans

    def characters(self, a: int, b: int) -> list[tuple[int, int]]:
        """A span without any boundary: cut by length, but not before a combining mark where that can be helped."""
        spans = []
        while b - a > self.max_chars:
            end = a + self.max_chars
            back = end
            while back > a + self.max_chars // 2 and not self.text[back].isalnum():
                back -= 1
            end = back if self.text[back].isalnum() else end
            spans.append((a, end))
            a = end
        return [*spans, (a, b)]

    def repeated(self, a: int, b: int, tokens: int, chars: int) -> int:
        """Where the stretch of a piece begins that the next one repeats: as much as the overlap allows, from a natural boundary if it holds one."""
        low = max(a, int(np.searchsorted(self.chars, self.chars[b] - chars, "left")), int(np.searchsorted(self.tokens, self.tokens[b] - tokens, "left")))
        natural = [int(c[0]) for k in range(_SENTENCES + 1) if len(c := self.boundaries(k, low - 1, b)[0])]
        if natural and min(natural) < b:
            return min(natural)
        words = self.boundaries(len(_LEVELS) - 1, low - 1, b)[0]
        return int(words[0]) if len(words) else low


def split_text(text: str, max_tokens: int, max_chars: int, overlap_tokens: int, overlap_chars: int) -> list[tuple[int, int, int]]:
    """``(start, end, overlap)`` of the pieces of a text.

    Pieces follow each other without a gap; ``overlap`` is the number of characters
    at the start of a piece that end the one before.
    """
    tree = Tree(text, max_tokens, max_chars)
    if tree.fits(0, len(text)):
        return [(0, len(text), 0)]
    tree.max_tokens, tree.max_chars = max_tokens - overlap_tokens - 1, max_chars - overlap_chars - 1
    spans = tree.pack(0, len(text))
    pieces = [(*spans[0], 0)]
    for (a, b), (c, d) in zip(spans, spans[1:]):
        start = tree.repeated(a, b, overlap_tokens, overlap_chars)
        pieces.append((start, d, c - start))
    return pieces


def oversized(text: Column, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS) -> Column:
    """Whether a text is over a limit once marks are joined and white space is collapsed."""
    cleaned = clean(text)
    over = (F.length(cleaned) > max_chars) | (F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "))) >= max_tokens)
    return (F.length(text) > min(max_chars, 2 * max_tokens)) & over


def pieces(df: DataFrame, keys: Sequence[str], text: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap_tokens: int = OVERLAP_TOKENS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``(keys..., piece, start, end, overlap, piece_text)`` of every oversized text.

    Offsets are code points of the text as it is. Texts within the limits, null and
    empty texts give no rows; repeated rows (same keys and text) count once; other columns
    of ``df`` are ignored, whatever their names. A piece is within both limits, with the
    stretch that it repeats.
    """
    if overlap_tokens * 2 > max_tokens or overlap_chars * 2 > max_chars:
        raise ValueError("the overlap must be at most half of a limit")

    @F.pandas_udf("array<struct<start:int,end:int,overlap:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        names = ("start", "end", "overlap")
        return pd.Series([[dict(zip(names, p)) for p in split_text(t, max_tokens, max_chars, overlap_tokens, overlap_chars)] for t in texts])

    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(text).alias("text"))
    rows = rows.filter(oversized(F.col("text"), max_tokens, max_chars)).distinct()
    rows = rows.select(*names, "text", F.posexplode(cut("text")).alias("piece", "p"))
    out = F.substring(F.col("text"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("piece_text")
    return rows.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "piece", "p.start", "p.end", "p.overlap", out)
