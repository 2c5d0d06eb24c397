import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import concepts, graph, resolution, similarity, triples

T = "doc_id long, pos long, subject string, relation string, object string"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), T)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def test_dedup_keeps_the_first(spark):
    rows = table(spark, (1, 3, "a", "r", "b"), (1, 0, "a", "r", "b"), (1, 1, "A", "r", "b"), (2, 5, "a", "r", "b"))
    assert got(triples.dedup(rows)) == [(1, 0, "a", "r", "b"), (1, 1, "A", "r", "b"), (2, 5, "a", "r", "b")]
    assert got(triples.dedup_stats(rows)) == [(1, 3, 2, 1), (2, 1, 1, 0)]


def test_valid(spark):
    rows = table(spark, (1, 0, " a ", "r", "b\n"), (1, 1, None, "r", "b"), (1, 2, "a", "  ", "b"), (None, 3, "a", "r", "b"))
    assert got(triples.valid(rows)) == [(1, 0, "a", "r", "b")]


def test_context_takes_three_and_counts_a_self_loop_once(spark):
    rows = table(spark, *((1, i, "x", f"r{i}", "y") for i in range(5)), (1, 9, "z", "is", "z"))
    assert got(triples.context(rows), "name", "rank", "pos") == [("x", 1, 0), ("x", 2, 1), ("x", 3, 2), ("y", 1, 0), ("y", 2, 1), ("y", 3, 2), ("z", 1, 9)]


def test_orders(spark):
    rows = table(spark, (1, 0, "bb", "r", "q"), (1, 1, "aa", "s", "q"), (1, 2, "ccc", "s", "q"))
    assert got(triples.entity_order(rows), "ord", "name") == [(0, "ccc"), (1, "aa"), (2, "bb")]
    assert got(triples.relation_order(rows), "ord", "relation", "frequency") == [(0, "s", 2), (1, "r", 1)]
    assert got(triples.relation_examples(rows), "ord", "relation", "subject") == [(0, "r", "bb"), (1, "s", "aa")]
    wanted = spark.createDataFrame([(1, "unused", 0), (1, "s", 1)], "doc_id long, relation string, ord int")
    assert got(triples.relation_order(rows, wanted), "ord", "relation", "frequency") == [(0, "s", 2), (1, "unused", 0)]
    many = spark.createDataFrame([(1, i) for i in range(17)], "doc_id long, ord int")
    assert [r[0] for r in triples.batches(many, 8).groupBy("batch").count().orderBy("batch").select("count").collect()] == [8, 8, 1]


def test_answered_triples(spark):
    good = {"subject": " a ", "relation": "r", "object": "b", "more": 1}
    bad = [{"subject": 1, "relation": "r", "object": "b"}, {"subject": "", "relation": "r", "object": "b"}, {"subject": "a", "object": "b"}, "text", None]
    rows = [(1, 0, "```json\n" + json.dumps([*bad, good]) + "\n```"), (1, 1, json.dumps([good])), (2, 0, "no"), (3, 0, json.dumps(good)), (4, 0, None)]
    found = triples.answered_triples(spark.createDataFrame(rows, "doc_id long, chunk_index int, response string"))
    assert got(found) == [(1, 0, "a", "r", "b"), (1, 1, "a", "r", "b")]


def test_candidates_of_a_crowded_article(spark, monkeypatch):
    rows = [(1 + (i % 5 == 0), f"n{i}", i, [float(i % 7), 1.0, float(i % 3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, name string, ord int, vec array<double>")
    whole = got(similarity.candidates(df, 0.9, 3))
    monkeypatch.setattr(similarity, "PART_NAMES", 7)
    assert got(similarity.candidates(df, 0.9, 3)) == whole and len(whole) > 300


def test_candidates(spark):
    rows = [(1, "a", 0, [1.0, 0.0]), (1, "b", 1, [0.8, 0.6]), (1, "c", 2, [1.0, 0.0]), (1, "zero", 3, [0.0, 0.0]), (1, "null", 4, None), (2, "d", 0, [1.0, 0.0])]
    found = similarity.candidates(spark.createDataFrame(rows, "doc_id long, name string, ord int, vec array<double>"), 0.8, 1)
    assert got(found, "target", "candidate", "rank") == [("a", "c", 1), ("b", "a", 1), ("c", "a", 1)]


ORDER = ["long name", "name", "n", "other"]


@pytest.mark.parametrize(
    ("answers", "want"),
    [
        ({}, {n: n for n in ORDER}),
        ({"long name": (True, "N", ["name"]), "name": (True, "X", ["n"])}, {"long name": "N", "name": "N", "n": "n", "other": "other"}),
        ({"long name": (True, "N", ["unknown"])}, {"long name": "N", "name": "name", "n": "n", "other": "other"}),
        ({"long name": (False, "", [])}, {n: n for n in ORDER}),
        ({"long name": (True, "N", ["n"]), "name": (True, "M", ["n"])}, {"long name": "N", "n": "N", "name": "N", "other": "other"}),
        ({"long name": (True, "N", []), "name": (True, "M", ["n"])}, {"long name": "N", "name": "M", "n": "M", "other": "other"}),
        ({"other": (True, "O", ["long name"])}, {"long name": "long name", "name": "name", "n": "n", "other": "long name"}),
    ],
)
def test_entity_fold(answers, want):
    assert resolution.fold_entities(ORDER, answers) == want


def test_fold_of_few_names():
    assert resolution.fold_entities(["a"], {}) == {} == resolution.fold_entities([], {})
    assert resolution.fold_relations(["a"], {}) == ({}, [])


def test_relation_fold():
    canon, single = resolution.fold_relations(["a", "b", "c", "d"], {"a": (True, "A", ["b"]), "c": (False, "", [])})
    assert (canon, single) == ({"a": "A", "b": "A"}, ["c", "d"])


def test_maps_end_to_end(spark):
    rows = table(spark, (1, 0, "Ann Lee", "knows", "Bo"), (1, 1, "A. Lee", "met", "Ann Lee"), (2, 0, "Solo", "is", "x"))
    answers = spark.createDataFrame([(1, "Ann Lee", '{"matches": ["A. Lee", 3], "canonical_name": " Ann Lee "}'), (1, "A. Lee", '{"matches": [], "canonical_name": null}')], "doc_id long, target string, response string")
    decided = resolution.decisions(answers)
    assert got(decided, "target", "ok") == [("A. Lee", False), ("Ann Lee", True)]
    mapping = resolution.entity_map(triples.entity_order(rows), decided)
    assert got(mapping) == [(1, "A. Lee", "Ann Lee"), (1, "Ann Lee", "Ann Lee")]
    assert got(resolution.apply_map(rows, mapping, "subject", "object"), "doc_id", "subject", "object") == [(1, "Ann Lee", "Ann Lee"), (1, "Ann Lee", "Bo"), (2, "Solo", "x")]
    assert got(resolution.merge_stats(mapping)) == [(1, 2, 1)]


def test_relation_map(spark):
    ordered = spark.createDataFrame([(1, "was born in", 0), (1, "born in", 1), (1, "is the longest of", 2), (2, "one", 0)], "doc_id long, relation string, ord int")
    answers = spark.createDataFrame([(1, "was born in", '{"matches": ["born in"], "canonical_name": "born in"}')], "doc_id long, target string, response string")
    groups = resolution.relation_groups(ordered, resolution.decisions(answers))
    short = spark.createDataFrame([(1, "is the longest of", "longest of")], "doc_id long, relation string, short string")
    assert got(resolution.relation_map(ordered, groups, short)) == [(1, "born in", "born in"), (1, "is the longest of", "longest of"), (1, "was born in", "born in")]


def test_definitions_and_concepts(spark):
    asked = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 2, "c")], "doc_id long, batch int, ord int, relation string")
    answers = spark.createDataFrame([(1, 0, '{"a": " x ", "b": 3, "z": "y"}'), (1, 1, "broken")], "doc_id long, batch int, response string")
    assert got(concepts.definitions(answers, asked)) == [(1, "a", "x", 0)]
    answers = spark.createDataFrame([(1, 0, '{"a": [" x ", "", 3], "b": "no list"}'), (1, 1, '{"c": []}')], "doc_id long, batch int, response string")
    assert got(concepts.concepts(answers, asked, "relation")) == [(1, "a", ["x"])]


def test_graph_tables(spark):
    rows = table(spark, (1, 0, "a", "a b", "c"), (1, 1, "a", "a-b", "c"), (1, 2, "c", "is", "c"), (2, 0, "a", "is", "d"))
    kinds = spark.createDataFrame([(1, "a", ["K"])], "doc_id long, name string, concepts array<string>")
    defs = spark.createDataFrame([(1, "is", "D", 0)], "doc_id long, relation string, definition string, ord int")
    nodes, relations = graph.nodes(rows, kinds), graph.relations(rows, defs, kinds)
    assert got(nodes) == [(1, "a", ["K"]), (1, "c", []), (2, "a", []), (2, "d", [])]
    assert got(relations, "doc_id", "relation", "definition") == [(1, "a b", ""), (1, "a-b", ""), (1, "is", "D"), (2, "is", "")]
    assert got(graph.counts(rows)) == [(1, 2, 3, 3), (2, 2, 1, 1)]
    assert got(graph.concept_triples(nodes, relations)) == [(1, "a", "type", "K")]
    assert got(graph.property_nodes(nodes), "label", "name") == [("Entity", "a"), ("Literal", "a"), ("Literal", "c"), ("Literal", "d")]
    assert got(graph.property_edges(rows, relations), "src", "rel_type", "dst", "relation_name") == [("a", "A_B", "c", "a-b"), ("a", "IS", "d", "is"), ("c", "IS", "c", "is")]
    assert got(graph.has_entity(nodes)) == [(1, "a")]
    none = spark.createDataFrame([], "doc_id long, variant string, canonical string")
    titles = spark.createDataFrame([(1, "One"), (2, None)], "doc_id long, article_title string")
    docs = {r["doc_id"]: r for r in graph.document(titles, rows, nodes, relations, none, none).collect()}
    assert [t["relation"] for t in docs[1]["triples"]] == ["a b", "a-b", "is"] and docs[1]["nodes"]["a"]["concepts"] == ["K"] and docs[2]["entity_map"] == {}


@pytest.mark.parametrize("parts", [1, 7])
def test_empty_tables(spark, parts):
    rows = table(spark).repartition(parts)
    kinds = spark.createDataFrame([], "doc_id long, name string, concepts array<string>")
    for df in (triples.dedup(rows), triples.context(rows), triples.entity_order(rows), graph.nodes(rows, kinds), graph.counts(rows), triples.rule_triples(spark.createDataFrame([], "doc_id long, chunk_index int, chunk_text string"))):
        assert df.filter(F.lit(True)).count() == 0


def test_partitions_do_not_matter(spark):
    base = spark.range(400).select(
        (F.col("id") % 7).alias("doc_id"), F.col("id").alias("pos"), F.concat(F.lit("s"), F.col("id") % 11).alias("subject"), F.concat(F.lit("r"), F.col("id") % 5).alias("relation"),
        F.concat(F.lit("s"), F.col("id") % 13).alias("object"), F.lit("x").alias("context"),
    )
    for f in (triples.dedup, triples.dedup_stats, triples.context, triples.relation_examples, triples.entity_order, graph.counts):
        assert len({tuple(got(f(base.repartition(n)))) for n in (1, 7, 40)}) == 1
