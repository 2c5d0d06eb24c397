"""From records to graphs: all steps for all articles in one plan, keyed by article."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.functions import prompts as P
from graphloom.functions.vectors import embedder
from graphloom.operators import chunking, concepts, graph, resolution, similarity, triples
from graphloom.plans.backends import Backend, Store, ask
from graphloom.tables import materialise


class Asking:
    """Puts prompts to a backend and remembers whose calls failed, in any step."""

    def __init__(self, backend: Backend, store: Store | None = None):
        self.backend, self.store, self._failed = backend, store, []

    def __call__(self, rows: DataFrame, step: str, user: Column) -> DataFrame:
        answers = ask(rows, step, P.SYSTEM[step], user, self.backend, self.store)
        self._failed.append(answers.filter("error is not null").select("doc_id", F.concat(F.lit(f"{step}: "), "error").alias("error")))
        return answers

    def failed(self) -> DataFrame:
        """``(doc_id, error)`` of every article with a failed call so far, with one of its errors."""
        return functools.reduce(DataFrame.unionByName, self._failed).groupBy("doc_id").agg(F.min("error").alias("error"))


@dataclass(frozen=True)
class Graphs:
    """The tables of a run; ``status`` has one row for every record."""

    chunks: DataFrame
    triples: DataFrame
    nodes: DataFrame
    relations: DataFrame
    entity_map: DataFrame
    relation_map: DataFrame
    documents: DataFrame
    status: DataFrame


def _example(rows: DataFrame, examples: DataFrame, name: str = "relation") -> DataFrame:
    """Adds ``example``, the first triple of a relation, or one of question marks."""
    keyed = examples.select("doc_id", F.col("relation").alias(name), F.struct("subject", "relation", "object").alias("found"))
    unknown = F.struct(F.lit("?").alias("subject"), F.col(name).alias("relation"), F.lit("?").alias("object"))
    return rows.join(keyed, ["doc_id", name], "left").withColumn("example", F.coalesce("found", unknown)).drop("found")


def _list(rows: DataFrame, keys: list[str], item, name: str, order: str) -> DataFrame:
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, item.alias("item")))).alias("l"))
    return got.select(*keys, F.col("l.item").alias(name))


def resolve_entities(facts: DataFrame, titles: DataFrame, ask: Asking, cfg: Config, embed) -> DataFrame:
    """``(doc_id, variant, canonical)`` for the subjects of each article."""
    ordered = materialise(triples.entity_order(facts), "entity-order")
    seen = materialise(triples.context_lists(facts, cfg.context_triples), "entity-context")
    text = ordered.join(seen, ["doc_id", "name"], "left")
    shown = F.array_join(F.transform("context", P.fact), " | ")
    text = text.withColumn("text", F.when(F.size("context") > 0, F.concat("name", F.lit(" "), shown)).otherwise(F.col("name")))
    vectors = text.select("doc_id", "name", "ord", embed(F.col("text")).alias("vec"))
    found = similarity.candidates(vectors, cfg.entity_threshold, cfg.entity_top_k)
    found = found.join(seen.select("doc_id", F.col("name").alias("candidate"), "context"), ["doc_id", "candidate"], "left")
    listed = _list(found, ["doc_id", "target"], F.struct(F.col("candidate").alias("name"), "context"), "candidates", "rank")
    listed = listed.join(seen.select("doc_id", F.col("name").alias("target"), "context"), ["doc_id", "target"], "left").join(titles, "doc_id", "left")
    answers = ask(listed, "entities", P.same_entity(F.col("article_title"), F.col("target"), F.col("context"), F.col("candidates")))
    return resolution.entity_map(ordered, resolution.decisions(answers))


def define_relations(facts: DataFrame, titles: DataFrame, ask: Asking, cfg: Config) -> DataFrame:
    """``(doc_id, relation, definition, ord)`` of the relations that got one."""
    used = triples.batches(triples.relation_examples(facts), cfg.definition_batch)
    item = F.struct("relation", F.struct("subject", "relation", "object").alias("example"))
    listed = _list(used, ["doc_id", "batch"], item, "asked", "ord").join(titles, "doc_id", "left")
    answers = ask(listed, "definitions", P.define(F.col("article_title"), F.col("asked")))
    return concepts.definitions(answers, used.select("doc_id", "batch", "ord", "relation"))


def canonicalize_relations(facts: DataFrame, defined: DataFrame, titles: DataFrame, ask: Asking, cfg: Config, embed) -> DataFrame:
    """``(doc_id, variant, canonical)`` for the defined relations of each article."""
    ordered = materialise(triples.relation_order(facts, defined), "relation-order")
    examples = triples.relation_examples(facts)
    known = materialise(_example(ordered.join(defined.drop("ord"), ["doc_id", "relation"]), examples), "relations-known")
    vectors = known.select("doc_id", F.col("relation").alias("name"), "ord", embed(F.concat_ws(" ", "relation", "definition")).alias("vec"))
    found = similarity.candidates(vectors, cfg.relation_threshold, cfg.relation_top_k)
    about = known.select("doc_id", "relation", "definition", "example")
    found = found.join(about.withColumnRenamed("relation", "candidate"), ["doc_id", "candidate"])
    listed = _list(found, ["doc_id", "target"], F.struct(F.col("candidate").alias("name"), "definition", "example"), "candidates", "rank")
    listed = listed.join(about.withColumnRenamed("relation", "target"), ["doc_id", "target"]).join(titles, "doc_id", "left")
    text = P.same_relation(F.col("article_title"), F.col("target"), F.col("definition"), F.col("example"), F.col("candidates"))
    answers = ask(listed, "relations", text)
    groups = materialise(resolution.relation_groups(ordered, resolution.decisions(answers)), "relation-groups")

    single = triples.batches(groups.filter("ord is not null").select("doc_id", F.col("variant").alias("relation"), "ord"), cfg.singleton_batch)
    shown = _list(_example(single, examples), ["doc_id", "batch"], F.struct("relation", "example"), "asked", "ord").join(titles, "doc_id", "left")
    short = ask(shown, "singletons", P.shorten(F.col("article_title"), F.col("asked")))
    short = concepts.definitions(short, single).select("doc_id", "relation", F.col("definition").alias("short"))
    return resolution.relation_map(ordered, groups, short)


def induce_schema(facts: DataFrame, defined: DataFrame, titles: DataFrame, ask: Asking, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, name, concepts)`` of the entities, and of the relations as they were defined."""
    ordered = triples.batches(triples.entity_order(facts), cfg.concept_batch)
    rows = ordered.join(triples.context_lists(facts, cfg.context_triples), ["doc_id", "name"], "left")
    listed = _list(rows, ["doc_id", "batch"], F.struct("name", "context"), "asked", "ord").join(titles, "doc_id", "left")
    answers = ask(listed, "entity_concepts", P.entity_kinds(F.col("article_title"), F.col("asked")))
    entities = concepts.concepts(answers, ordered, "name")

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    asked = triples.batches(defined.withColumn("ord", place), cfg.concept_batch)
    rows = _example(asked, triples.relation_examples(facts))
    listed = _list(rows, ["doc_id", "batch"], F.struct("relation", "definition", "example"), "asked", "ord").join(titles, "doc_id", "left")
    answers = ask(listed, "relation_concepts", P.relation_kinds(F.col("article_title"), F.col("asked")))
    return entities, concepts.concepts(answers, asked, "relation")


def build_graphs(records: DataFrame, backend: Backend, cfg: Config = Config(), strategy: str = "sections", embed=None, store: Store | None = None) -> Graphs:
    """Graphs of ``(doc_id, title, text)`` records.

    A record without chunks, or with a call that failed in any step, is ``failed`` in ``status`` with its
    error and in no other table but ``chunks``; the others are not affected. An article with two
    records is an error of its own: keys must be unique and not null. With ``store`` answers are kept, and
    a run after a failure asks only what was not answered.
    """
    embed, ask = embed or embedder(), Asking(backend, store)
    repeated = records.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if not repeated.isEmpty():
        raise ValueError("records need a doc_id that is unique and not null")
    chunks = materialise(chunking.chunk(records, cfg, strategy), "chunks")
    titles = materialise(chunks.groupBy("doc_id").agg(F.min_by("article_title", "chunk_index").alias("article_title")), "titles")

    answers = ask(chunks, "extract", P.extract(F.col("article_title"), F.col("section_path"), F.col("chunk_text")))
    # an article that failed asks nothing more
    raw = triples.answered_triples(answers.join(ask.failed(), "doc_id", "left_anti"))
    facts = materialise(triples.dedup(raw), "triples")

    entity_map = materialise(resolve_entities(facts, titles, ask, cfg, embed), "entity-map")
    facts = materialise(resolution.apply_map(facts, entity_map, "subject", "object"), "resolved")
    defined = materialise(define_relations(facts, titles, ask, cfg), "definitions")
    relation_map = materialise(canonicalize_relations(facts, defined, titles, ask, cfg, embed), "relation-map")
    facts = materialise(resolution.apply_map(facts, relation_map, "relation"), "canonical")
    entity_concepts, relation_concepts = induce_schema(facts, defined, titles, ask, cfg)

    failed = materialise(ask.failed(), "failed")
    whole = lambda rows: rows.join(failed, "doc_id", "left_anti")
    facts, entity_map, relation_map = whole(facts), whole(entity_map), whole(relation_map)
    nodes = materialise(graph.nodes(facts, entity_concepts), "nodes")
    relations = materialise(graph.relations(facts, defined, relation_concepts), "relations")
    documents = graph.document(titles, facts, nodes, relations, entity_map, relation_map)
    return Graphs(chunks, facts, nodes, relations, entity_map, relation_map, documents, run_summary(records, titles, facts, failed))


def run_summary(records: DataFrame, titles: DataFrame, facts: DataFrame, failed: DataFrame) -> DataFrame:
    """``(doc_id, article, nodes, relations, triples, status, error)``, one row a record."""
    rows = records.select("doc_id", "title").join(titles, "doc_id", "left").join(graph.counts(facts), "doc_id", "left").join(failed, "doc_id", "left")
    error = F.coalesce("error", F.when(F.col("article_title").isNull() & F.col("n_triples").isNull(), "no chunks"))
    rows = rows.withColumn("error", error)
    number = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(F.col("error").isNull(), "success").otherwise("failed")
    return rows.select("doc_id", F.coalesce("article_title", "title").alias("article"), number("n_nodes").alias("nodes"), number("n_relations").alias("relations"), number("n_triples").alias("triples"), status.alias("status"), "error")
