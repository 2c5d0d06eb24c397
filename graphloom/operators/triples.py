"""Triples: obtained from text or from answers, validated, deduplicated, looked up by name.

A triple table has ``doc_id, pos, subject, relation, object``; ``pos`` is its place in the
article, on which every "first" below depends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.json_repair import parsed
from graphloom.functions.text import sentences, strip, tokens

FIELDS = ("subject", "relation", "object")


def _fact() -> Column:
    return F.struct(*FIELDS)


def rule_triples(chunks: DataFrame) -> DataFrame:
    """Triples by a rule that stands in for a model: a sentence of three words or more gives first word, second word, rest.

    It makes test runs deterministic; its facts are not those a model would find.
    """
    rows = chunks.select("doc_id", "chunk_index", F.posexplode(sentences(F.col("chunk_text"))).alias("k", "sentence"))
    rows = rows.select("doc_id", "chunk_index", "k", tokens(F.col("sentence")).alias("w")).filter(F.size("w") >= 3)
    rest = F.regexp_replace(F.array_join(F.slice("w", 3, 1 << 30), " "), r"[.!?]+$", "")
    rows = rows.select("doc_id", "chunk_index", "k", F.get("w", F.lit(0)).alias("subject"), F.get("w", F.lit(1)).alias("relation"), rest.alias("object"))
    return number(rows.filter("object <> ''"), "chunk_index", "k")


def number(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``pos``, the place in the article, from the columns of ``order``."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return rows.select("doc_id", place.cast("long").alias("pos"), *FIELDS)


def valid(triples: DataFrame) -> DataFrame:
    """Triples with three fields that are not blank, stripped. Null fields and null articles are dropped."""
    rows = triples.select("doc_id", "pos", *(strip(F.col(c)).alias(c) for c in FIELDS))
    return rows.filter("doc_id is not null and length(subject) > 0 and length(relation) > 0 and length(object) > 0")


def answered_triples(answers: DataFrame) -> DataFrame:
    """Valid triples from ``(doc_id, chunk_index, response)``.

    An element counts if it is an object whose three fields are strings and not blank; numbers
    are not turned into strings, further fields are dropped, and an answer that cannot be parsed as
    a list has no triples.
    """
    rows = answers.select("doc_id", "chunk_index", F.try_parse_json(parsed(F.col("response"), "list")).alias("v"))
    rows = rows.select("doc_id", "chunk_index", F.posexplode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("k", "t"))
    for c in FIELDS:
        field = F.expr(f"try_variant_get(t, '$.{c}', 'variant')")
        text = F.expr(f"try_variant_get(t, '$.{c}', 'string')")
        rows = rows.withColumn(c, F.when(F.schema_of_variant(field) == "STRING", strip(text)))
    rows = rows.filter("length(subject) > 0 and length(relation) > 0 and length(object) > 0")
    return number(rows, "chunk_index", "k")


def dedup(triples: DataFrame) -> DataFrame:
    """Each distinct triple of an article once, at its first place; letter case counts."""
    return triples.groupBy("doc_id", *FIELDS).agg(F.min("pos").alias("pos")).select("doc_id", "pos", *FIELDS)


def dedup_stats(triples: DataFrame) -> DataFrame:
    """``(doc_id, n_in, n_out, n_removed)``."""
    each = triples.groupBy("doc_id", *FIELDS).agg(F.count("*").alias("n"))
    rows = each.groupBy("doc_id").agg(F.sum("n").alias("n_in"), F.count("*").alias("n_out"))
    return rows.withColumn("n_removed", F.col("n_in") - F.col("n_out"))


def context(triples: DataFrame, limit: int = 3) -> DataFrame:
    """``(doc_id, name, rank, pos, subject, relation, object)``: the first triples that hold each name as subject or object.

    An equi join on the names of each triple instead of an OR; a triple from a name to itself
    counts once.
    """
    rows = triples.select("doc_id", "pos", *FIELDS, F.explode(F.array_distinct(F.array("subject", "object"))).alias("name"))
    order = Window.partitionBy("doc_id", "name").orderBy("pos", *FIELDS)
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return rows.select("doc_id", "name", "rank", "pos", *FIELDS)


def context_lists(triples: DataFrame, limit: int = 3) -> DataFrame:
    """``(doc_id, name, context)`` with the context as an ordered array."""
    rows = context(triples, limit).groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct("rank", *FIELDS))).alias("c"))
    return rows.select("doc_id", "name", F.transform("c", lambda x: F.struct(*(x[f].alias(f) for f in FIELDS))).alias("context"))


def relation_examples(triples: DataFrame) -> DataFrame:
    """``(doc_id, relation, ord, frequency, subject, object)``: each relation with its first triple, in order of first use."""
    rows = triples.groupBy("doc_id", "relation").agg(F.count("*").alias("frequency"), F.min(F.struct("pos", "subject", "object")).alias("first"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first.pos", "relation")) - 1
    return rows.select("doc_id", "relation", place.alias("ord"), "frequency", F.col("first.subject").alias("subject"), F.col("first.object").alias("object"))


def relation_order(triples: DataFrame, defined: DataFrame | None = None) -> DataFrame:
    """``(doc_id, relation, frequency, ord)`` by falling frequency, then first use.

    With ``defined`` (``doc_id, relation, ord``) those relations only, in its order where
    frequencies are equal; one that no triple uses has frequency 0.
    """
    used = relation_examples(triples).select("doc_id", "relation", "frequency", F.col("ord").alias("seen"))
    if defined is not None:
        used = defined.select("doc_id", "relation", F.col("ord").alias("seen")).join(used.drop("seen"), ["doc_id", "relation"], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("frequency"), "seen", "relation")) - 1
    return used.select("doc_id", "relation", "frequency", place.alias("ord"))


def entity_order(triples: DataFrame) -> DataFrame:
    """``(doc_id, name, ord)``: the subjects of an article, the longest first, equal lengths by name."""
    rows = triples.select("doc_id", F.col("subject").alias("name")).distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("name")), "name")) - 1
    return rows.select("doc_id", "name", place.alias("ord"))


def batches(ordered: DataFrame, size: int) -> DataFrame:
    """Adds ``batch``: consecutive groups of ``size`` in the order of ``ord``."""
    return ordered.withColumn("batch", F.floor(F.col("ord") / size).cast("int"))
