"""How often terms occur, and in how many records.

Vertical layout: each term has a bitmap of the records that hold it and a counter of its
occurrences. A bitmap is compressed as a list of those 64-record words that have a bit, cut
into containers of 65,536 records, so that no term, however common, has to fit into one row. Bitmaps of parts
are merged by union (bitwise or), and the number of records is read from the cardinality of the merged bitmaps.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KEY = ("field", "term", "container")


def postings(occurrences: DataFrame, field: str = "field", term: str = "term", record: str = "record_id") -> DataFrame:
    """``(field, term, container, word, bits, occurrences)``, one word with one bit for each occurrence.

    ``record`` is a bigint. Rows with a null or empty term or a null record do not
    count. These are the bitmaps of single occurrences, the smallest parts of a collection; ``unite`` merges them.
    """
    rows = occurrences.select(F.col(field).alias("field"), F.col(term).alias("term"), F.col(record).cast("long").alias("record_id"))
    rows = rows.filter(F.col("record_id").isNotNull() & (F.length("term") > 0))
    word = F.expr("cast(shiftright(record_id, 6) & 1023L as smallint)").alias("word")
    bit = F.expr("shiftleft(1L, cast(record_id & 63L as int))").alias("bits")
    return rows.select("field", "term", F.shiftright("record_id", 16).alias("container"), word, bit, F.lit(1).cast("long").alias("occurrences"))


def unite(*parts: DataFrame) -> DataFrame:
    """``(field, term, container, bitmap, occurrences)``: the compressed bitmaps of the union of parts.

    A part is ``postings`` or what ``unite`` gave for another part of the collection. Words are merged where they lie
    before anything is sent; a container gathers 1,024 words at most.
    """
    rows = functools.reduce(DataFrame.unionByName, (_words(p) for p in parts))
    words = rows.groupBy(*KEY, "word").agg(F.bit_or("bits").alias("bits"), F.sum("occurrences").alias("occurrences"))
    bitmap = F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap")
    return words.groupBy(*KEY).agg(bitmap, F.sum("occurrences").alias("occurrences"))


def _words(part: DataFrame) -> DataFrame:
    """The words of a part; a container's occurrences stand beside its first word."""
    if "bitmap" not in part.columns:
        return part
    rows = part.select(*KEY, F.posexplode("bitmap").alias("at", "x"), "occurrences")
    return rows.select(*KEY, "x.word", "x.bits", F.when(F.col("at") == 0, F.col("occurrences")).otherwise(0).alias("occurrences"))


def cardinality(bitmap: Column) -> Column:
    return F.aggregate(bitmap, F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x["bits"]))


def frequencies(bitmaps: DataFrame) -> DataFrame:
    """``(field, term, occurrences, records, field_records)`` of each term.

    ``field_records`` is the number of records that hold any term of the field: the cardinality of the union of its bitmaps.
    """
    terms = bitmaps.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum(cardinality(F.col("bitmap"))).alias("records"))
    words = bitmaps.select("field", "container", F.explode("bitmap").alias("x")).groupBy("field", "container", "x.word").agg(F.bit_or("x.bits").alias("bits"))
    whole = words.groupBy("field").agg(F.sum(F.bit_count("bits").cast("long")).alias("field_records"))
    return terms.join(whole, "field")


def mark(max_rare: int = 2, common_percent: int = 15) -> Column:
    """``rare``, ``common`` or null. A term both rare and common (few records in all) is ``rare``."""
    common = F.col("records") * 100 > F.col("field_records") * common_percent
    return F.when(F.col("records") <= max_rare, "rare").when(common, "common")
