"""The graph of an article: node and relation tables, one nested document, property-graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import relation_type

NO_CONCEPTS = "array<string>"


def nodes(triples: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(doc_id, name, concepts)``: every subject and object once; without concepts the list is empty."""
    names = triples.select("doc_id", F.explode(F.array("subject", "object")).alias("name")).distinct()
    rows = names.join(concepts.select("doc_id", "name", "concepts"), ["doc_id", "name"], "left")
    return rows.select("doc_id", "name", F.coalesce("concepts", F.array().cast(NO_CONCEPTS)).alias("concepts"))


def relations(triples: DataFrame, definitions: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(doc_id, relation, definition, concepts)`` of every relation in use; looked up by its own name, also where canonicalisation made it up."""
    rows = triples.select("doc_id", "relation").distinct().join(definitions.select("doc_id", "relation", "definition"), ["doc_id", "relation"], "left")
    rows = rows.join(concepts.select("doc_id", F.col("name").alias("relation"), "concepts"), ["doc_id", "relation"], "left")
    return rows.select("doc_id", "relation", F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("concepts", F.array().cast(NO_CONCEPTS)).alias("concepts"))


def counts(triples: DataFrame) -> DataFrame:
    """``(doc_id, n_nodes, n_relations, n_triples)``."""
    names = triples.select("doc_id", F.explode(F.array("subject", "object")).alias("name")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    rest = triples.groupBy("doc_id", "relation").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("n_relations"), F.sum("n").alias("n_triples"))
    return names.join(rest, "doc_id")


def document(titles: DataFrame, triples: DataFrame, node_table: DataFrame, relation_table: DataFrame, entity_map: DataFrame, relation_map: DataFrame) -> DataFrame:
    """One row an article: ``doc_id, article_title, nodes, relations, triples, entity_map, relation_map``.

    An article's graph is one value by definition; nothing larger than an article is gathered.
    """
    n = node_table.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("concepts"))))).alias("nodes"))
    r = relation_table.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", F.struct("definition", "concepts"))))).alias("relations"))
    t = triples.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "subject", "relation", "object"))).alias("t"))
    t = t.select("doc_id", F.transform("t", lambda x: F.struct(x["subject"], x["relation"], x["object"])).alias("triples"))
    as_map = lambda m, name: m.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "canonical")))).alias(name))
    rows = titles.select("doc_id", "article_title").join(t, "doc_id").join(n, "doc_id").join(r, "doc_id")
    rows = rows.join(as_map(entity_map, "entity_map"), "doc_id", "left").join(as_map(relation_map, "relation_map"), "doc_id", "left")
    none = F.create_map().cast("map<string,string>")
    return rows.select("doc_id", "article_title", "nodes", "relations", "triples", F.coalesce("entity_map", none).alias("entity_map"), F.coalesce("relation_map", none).alias("relation_map"))


def concept_triples(node_table: DataFrame, relation_table: DataFrame) -> DataFrame:
    """``(doc_id, subject, relation, object)``: ``type`` triples of nodes and ``category`` triples of relations."""
    a = node_table.select("doc_id", F.col("name").alias("subject"), F.lit("type").alias("relation"), F.explode("concepts").alias("object"))
    b = relation_table.select("doc_id", F.col("relation").alias("subject"), F.lit("category").alias("relation"), F.explode("concepts").alias("object"))
    return a.unionByName(b)


def property_nodes(node_table: DataFrame) -> DataFrame:
    """``(label, name, concepts)``, one for each label and name; of several articles the last one's concepts stay."""
    label = F.when(F.size("concepts") > 0, "Entity").otherwise("Literal")
    rows = node_table.select(label.alias("label"), "name", "doc_id", "concepts")
    return rows.groupBy("label", "name").agg(F.max(F.struct("doc_id", "concepts")).alias("last")).select("label", "name", "last.concepts")


def property_edges(triples: DataFrame, relation_table: DataFrame) -> DataFrame:
    """``(src, rel_type, dst, relation_name, definition, concepts)``, one for each pair and type; the last one's properties stay."""
    rows = triples.select("doc_id", "pos", "subject", "relation", "object").join(relation_table.select("doc_id", "relation", "definition", "concepts"), ["doc_id", "relation"], "left")
    last = F.max(F.struct("doc_id", "pos", "relation", "definition", "concepts")).alias("last")
    rows = rows.groupBy(F.col("subject").alias("src"), relation_type(F.col("relation")).alias("rel_type"), F.col("object").alias("dst")).agg(last)
    return rows.select("src", "rel_type", "dst", F.col("last.relation").alias("relation_name"), F.coalesce("last.definition", F.lit("")).alias("definition"), F.coalesce("last.concepts", F.array().cast(NO_CONCEPTS)).alias("concepts"))


def has_entity(node_table: DataFrame) -> DataFrame:
    """``(doc_id, name)``: edges from an article to the entities that it holds itself."""
    return node_table.filter(F.size("concepts") > 0).select("doc_id", "name").distinct()
