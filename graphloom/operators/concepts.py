"""Definitions and concepts, from answers about batches of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.json_repair import parsed
from graphloom.functions.text import strip


def _values(answers: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """``(doc_id, ord, name, value variant)`` of every asked name that its batch's answer holds."""
    rows = answers.select("doc_id", "batch", F.from_json(parsed(F.col("response"), "dict"), "map<string,variant>").alias("m"))
    return asked.join(rows, ["doc_id", "batch"]).select("doc_id", "ord", name, F.try_element_at("m", F.col(name)).alias("v")).filter("v is not null")


def definitions(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """``(doc_id, relation, definition, ord)`` from ``(doc_id, batch, response)`` and ``(doc_id, batch, ord, relation)``.

    Only strings that are not blank count, stripped; a relation without one is undefined.
    """
    rows = _values(answers, asked, "relation").filter(F.schema_of_variant("v") == "STRING")
    rows = rows.select("doc_id", "relation", strip(F.expr("try_variant_get(v, '$', 'string')")).alias("definition"), "ord")
    return rows.filter("definition <> ''")


def concepts(answers: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """``(doc_id, name, concepts)``: the non-blank strings of a list, stripped; names without any are left out."""
    rows = _values(answers, asked, name).select("doc_id", F.col(name).alias("name"), F.expr("try_variant_get(v, '$', 'array<variant>')").alias("a"))
    texts = F.expr("transform(filter(a, x -> schema_of_variant(x) = 'STRING'), x -> try_variant_get(x, '$', 'string'))")
    kept = F.filter(F.transform(texts, strip), lambda c: c != "")
    return rows.select("doc_id", "name", kept.alias("concepts")).filter(F.size("concepts") > 0)
