"""Prompts as expressions over the columns that they need. The wording is free; answers are parsed by shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = {
    "extract": 'You turn text into facts. Answer with a JSON array of {"subject", "relation", "object"}, all non-empty strings.',
    "entities": 'You decide which names mean the same thing. Answer with JSON {"matches": [...], "canonical_name": "...", "reasoning": "..."}.',
    "relations": 'You decide which relation names mean the same. Answer with JSON {"matches": [...], "canonical_name": "...", "reasoning": "..."}.',
    "definitions": "You define relations. Answer with a JSON object from each relation to one sentence.",
    "singletons": "You shorten relation names without changing what they mean. Answer with a JSON object from each name to its short form.",
    "entity_concepts": "You name the kinds of things that entities are. Answer with a JSON object from each entity to a list of at least three kinds.",
    "relation_concepts": "You name the kinds of relations that relations are. Answer with a JSON object from each relation to a list of at least three kinds.",
}


def fact(t: Column) -> Column:
    return F.concat(F.lit("("), t["subject"], F.lit(", "), t["relation"], F.lit(", "), t["object"], F.lit(")"))


def facts(context: Column, limit: int = 3) -> Column:
    """The first facts on one line, or ``none``."""
    text = F.array_join(F.transform(F.slice(context, 1, limit), fact), " | ")
    return F.when(context.isNull() | (F.size(context) == 0), "none").otherwise(text)


def fact_lines(context: Column) -> Column:
    """One fact a line, or a note that there is none."""
    text = F.array_join(F.transform(context, lambda t: F.to_json(F.struct(t["subject"], t["relation"], t["object"]))), "\n")
    return F.when(context.isNull() | (F.size(context) == 0), "(nothing is said about it)").otherwise(text)


def example(t: Column) -> Column:
    return F.concat(F.lit("["), t["subject"], F.lit(", "), t["relation"], F.lit(", "), t["object"], F.lit("]"))


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def extract(title: Column, section: Column, chunk: Column) -> Column:
    return _text("Article: ", title, "\nSection: ", section, "\nText:\n", chunk)


def same_entity(title: Column, target: Column, context: Column, candidates: Column) -> Column:
    """``candidates``: array of ``struct(name, context)``."""
    listed = F.array_join(F.transform(candidates, lambda c: _text('- "', c["name"], '" in ', facts(c["context"]))), "\n")
    return _text("Article: ", title, '\nName: "', target, '" in ', facts(context), "\nWhich of these mean the same?\n", listed)


def same_relation(title: Column, target: Column, definition: Column, shown: Column, candidates: Column) -> Column:
    """``candidates``: array of ``struct(name, definition, example)``, lettered from A."""
    row = lambda c, i: _text(F.char(i + 65), '. "', c["name"], '": ', c["definition"], " e.g. ", example(c["example"]))
    return _text("Article: ", title, '\nRelation: "', target, '": ', definition, " e.g. ", example(shown), "\nWhich of these mean the same?\n", F.array_join(F.transform(candidates, row), "\n"))


def define(title: Column, batch: Column) -> Column:
    """``batch``: array of ``struct(relation, example)``."""
    return _text("Article: ", title, "\nDefine:\n", F.array_join(F.transform(batch, lambda r: _text('- "', r["relation"], '" e.g. ', fact(r["example"]))), "\n"))


def shorten(title: Column, batch: Column) -> Column:
    """``batch``: array of ``struct(relation, example)``."""
    return _text("Article: ", title, "\nShorten where needed, leave none out:\n", F.array_join(F.transform(batch, lambda r: _text('- "', r["relation"], '" e.g. ', fact(r["example"]))), "\n"))


def entity_kinds(title: Column, batch: Column) -> Column:
    """``batch``: array of ``struct(name, context)``."""
    return _text("Article: ", title, "\nEntities:\n", F.array_join(F.transform(batch, lambda e: _text('"', e["name"], '":\n', fact_lines(e["context"]))), "\n"))


def relation_kinds(title: Column, batch: Column) -> Column:
    """``batch``: array of ``struct(relation, definition, example)``."""
    row = lambda r: _text('"', r["relation"], '": ', r["definition"], " e.g. ", fact(r["example"]))
    return _text("Article: ", title, "\nRelations:\n", F.array_join(F.transform(batch, row), "\n"))
