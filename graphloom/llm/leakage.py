"""Evaluation items that leaked into a corpus, by a prefix-filtered set join on word shingles.

Items and documents become sequences of units (words; single characters where a
script has no blanks). A passage that covers half of an item with one unit in ten
changed must keep some number k of the item's shingles, so of an item's shingles, ordered
from rare to common in the corpus, all but the k - 1 most common ones form a prefix
of which the passage holds at least one. A shared shingle sets the item against the document at one offset;
what is left of the item there must be long enough (length bound), and hold k shared shingles at that very offset
(positional bound). Only such (document, item, offset) are verified, by comparing item-sized windows unit by unit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.tables import materialise, small

SHINGLE = 5
#: Scripts written without blanks, of which each character is a unit.
SINGLE = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_UNIT = re.compile(rf"[{SINGLE}]|[^\W_{SINGLE}]+")
_ACCENT = re.compile("[̀-ͯ]+")
_FIRST = re.compile(r"^\s*(.+?(?:[.:?!。：？！](?=\s|[^\x00-\x7f])|\n))", re.S)


def units(text: str | None) -> list[str]:
    """Words or characters without letter case, accents, punctuation and mark-up."""
    if not text:
        return []
    if not text.isascii():
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", text)).casefold()
    return _UNIT.findall(text.lower())


def _openings(items: DataFrame) -> DataFrame:
    """Adds ``skip`` to ``(item_id, text)``: how many units belong to an instruction line, a first sentence of four units or more that opens several of all items."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = [units(m[1]) if t and (m := _FIRST.match(t)) else [] for t in batch["text"]]
            can = [len(f) if 3 < len(f) < len(units(t)) else 0 for f, t in zip(first, batch["text"], strict=True)]
            yield pd.DataFrame({"item_id": batch["item_id"], "text": batch["text"], "first": [" ".join(f) for f in first], "skip": can})

    rows = materialise(items.mapInPandas(read, "item_id long, text string, first string, skip int"), "leak-items")
    several = rows.groupBy("first").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(several, "first", "left").select("item_id", "text", F.when(F.col("n") > 1, F.col("skip")).otherwise(0).alias("skip"))


def kept_shingles(n_units: int, q: int, share: float, errors: float) -> int:
    """The fewest shingles that a passage of at least ``share`` of an item shares with it, none if that may be none."""
    least = max(1, math.ceil(share * n_units - 1e-9))
    return max(0, min(n - q + 1 - q * math.floor(errors * n + 1e-9) for n in range(least, n_units + 1)))


def shingle_length(n_units: int, share: float, errors: float) -> int:
    """The longest shingle, up to ``SHINGLE`` units, of which a passage of an item keeps at least one."""
    longest = min(SHINGLE, max(1, math.ceil(n_units * share)))
    return next(q for q in range(longest, 0, -1) if q == 1 or kept_shingles(n_units, q, share, errors))


class ItemIndex:
    """Units and shingles of a block of items, as arrays for the workers.

    An item too short for a shingle in half of it gets shorter shingles, and so does one whose passages may
    keep none of the longer ones.
    """

    def __init__(self, ids: list[int], texts: list[str | None], skips: list[int], share: float, errors: float):
        self.share, self.errors, self.vocabulary, self.items = share, errors, {}, {}
        table: dict[tuple[int, int], int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []  # item, shingle, place, prefix length, units
        for item, text, skip in zip(ids, texts, skips, strict=True):
            words = units(text)[skip:]
            if not words:
                continue
            q = shingle_length(len(words), share, errors)
            coded = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64)
            codes = [table.setdefault((q, int(h)), len(table)) for h in hashes(coded, q)]
            distinct = len(set(codes))
            kept = max(1, kept_shingles(len(words), q, share, errors))
            prefix = distinct - max(1, kept - (len(codes) - distinct)) + 1
            self.rows += [(item, c, p, prefix, len(words)) for p, c in enumerate(codes)]
            self.items[item] = (coded, q, kept)
        self.tables = {}
        for q in {q for q, _ in table}:
            pairs = sorted((h, c) for (k, h), c in table.items() if k == q)
            self.tables[q] = (np.array([h for h, _ in pairs], dtype=np.int64), np.array([c for _, c in pairs], dtype=np.int32))

    def code(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in units(text)), dtype=np.int64)

    def shingles(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The item shingles that a document holds, and where."""
        found, places = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for q, (table, codes) in self.tables.items():
            if len(coded) >= q:
                h = hashes(coded, q)
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                hit = np.flatnonzero(table[at] == h)
                found.append(codes[at[hit]])
                places.append(hit.astype(np.int32))
        return np.concatenate(found), np.concatenate(places)

    def holds(self, coded: np.ndarray, item: int, offset: int) -> bool:
        """Whether a document holds enough of an item at an offset: some window of it is long enough and has few enough other units."""
        words, q, kept = self.items[item]
        a, b = max(0, -offset), min(len(words), len(coded) - offset)
        least = max(1, math.ceil(self.share * len(words) - 1e-9))
        if b - a < least:
            return False
        wrong = coded[a + offset : b + offset] != words[a:b]
        before = np.concatenate(([0], np.cumsum(wrong)))
        whole = before[q:] == before[:-q]  # the shingles shared at this offset
        if whole.sum() < kept:
            return False
        # a window from i to j is good if what is wrong in it is at most the share of its length: this falls from i to j
        level = before - self.errors * np.arange(len(before))
        return bool((np.maximum.accumulate(level[: len(level) - least]) >= level[least:] - 1e-9).any())


def hashes(coded: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of ``q`` units; units that no item holds are 0 and spoil their runs' match."""
    n = len(coded) - q + 1
    h = np.zeros(max(n, 0), dtype=np.int64)
    for i in range(q if n > 0 else 0):
        h = h * 1_000_003 + coded[i : i + n]
    return h


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, errors: float = 0.1, block: int = 20_000) -> DataFrame:
    """``(doc_id, item_id)`` of every document with a continuous passage of at least ``share`` of an item's units.

    Up to ``errors`` of the passage's units may be others. An item's instruction line
    does not count. Null and empty texts hold nothing and leak nothing, rows without an id do not
    count; of items with the same id the last in letter order counts. The items are held against all documents in blocks of
    ``block``, which bounds what is sent to the workers.
    """
    if not (0 < share <= 1 and 0 <= errors < 1):
        raise ValueError("share must be above 0 and at most 1, errors at least 0 and below 1")
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and length(text) > 0")
    result = spark.createDataFrame([], "doc_id long, item_id long")
    once = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    read = materialise(_openings(once), "leak-openings")
    slices = max(1, math.ceil(read.count() / block))
    for k in range(slices):
        part = read.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).orderBy("item_id").toPandas()
        index = ItemIndex(part["item_id"].tolist(), part["text"].tolist(), part["skip"].tolist(), share, errors)
        if index.items:
            result = result.unionByName(_block(docs, index))
    return result


def _block(docs: DataFrame, index: ItemIndex) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = sent.value
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                coded = ix.code(text)
                found, places = ix.shingles(coded)
                if len(found):
                    out.append((doc, len(coded), found, places))
            yield pd.DataFrame(out, columns=["doc_id", "n", "shingles", "places"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = sent.value
        for batch in batches:
            out = []
            for doc, text, candidates in zip(batch["doc_id"], batch["text"], batch["candidates"], strict=True):
                coded, found = ix.code(text), set()
                for c in candidates:
                    if c["item_id"] not in found and ix.holds(coded, c["item_id"], c["offset"]):
                        found.add(c["item_id"])
                out += [(doc, item) for item in found]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    held = materialise(docs.mapInPandas(scan, "doc_id long, n int, shingles array<int>, places array<int>"), "leak-hits")
    own = spark.createDataFrame(pd.DataFrame(index.rows, columns=["item_id", "shingle", "place", "prefix", "units"]))
    rarity = held.select(F.explode(F.array_distinct("shingles")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("documents"))
    # shingles that no document holds are the rarest: they take their places in the prefix
    ranked = own.join(rarity, "shingle", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    order = Window.partitionBy("item_id").orderBy("documents", "shingle")
    prefixes = ranked.withColumn("rank", F.dense_rank().over(order)).filter("rank <= prefix and documents > 0")
    prefixes = prefixes.select("shingle", "item_id", F.col("place").alias("at"), "units")
    hits = held.select("doc_id", "n", F.explode(F.arrays_zip("shingles", "places")).alias("h"))
    hits = hits.select("doc_id", "n", F.col("h.shingles").alias("shingle"), (F.col("h.places")).alias("place"))
    # rows of four numbers, as many as the block has shingles at most
    pairs = hits.join(small(prefixes, 1_000_000), "shingle").select("doc_id", "item_id", "n", "units", (F.col("place") - F.col("at")).alias("offset"))
    overlap = F.least("units", F.col("n") - F.col("offset")) - F.greatest(F.lit(0), -F.col("offset"))
    pairs = pairs.filter(overlap >= F.ceil(index.share * F.col("units") - 1e-9)).select("doc_id", "item_id", "offset").distinct()
    candidates = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "offset")).alias("candidates"))
    # few documents have any: unless they are many, the texts of the rest stay where they are
    candidates = small(materialise(candidates, "leak-candidates"), 1_000_000, 32 << 20)
    return docs.join(candidates, "doc_id").mapInPandas(verify, "doc_id long, item_id long").distinct()
