"""The registered core queries, each over whole tables. Their SQL counterparts are in ``sql``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.functions import json_repair, prompts, text
from graphloom.operators import chunking, concepts, graph, resolution, similarity, triples
from graphloom.plans.backends import RuleBackend
from graphloom.plans.pipeline import build_graphs
from graphloom.plans.sql import SQL  # noqa: F401
from graphloom.sources import readers, sinks
from graphloom.sources.readers import remaining
from graphloom.streaming.resume import append_chunks, process_new
from graphloom.tables import materialise, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONFIG = Config()


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "title", "text")


def essays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "essay").select(F.col("essay_id").alias("doc_id"), F.col("essay_title").alias("title"), F.col("essay_content").alias("text"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """The valid triples, each delivery once."""
    rows = table(spark, d, "triples").select("doc_id", F.col("pos").cast("long").alias("pos"), "subject", "relation", "object").distinct()
    return triples.valid(rows)


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relations").select("doc_id", text.strip(F.col("relation")).alias("relation"), text.strip(F.col("definition")).alias("definition"), "ord")
    return rows.filter("doc_id is not null and length(relation) > 0 and length(definition) > 0")


def defined(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, relation, definition, ord)``; of a relation's definitions that are not blank the last in letter order."""
    return _definitions(spark, d).groupBy("doc_id", "relation").agg(F.max("definition").alias("definition"), F.min("ord").alias("ord"))


def _node_concepts(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(F.transform("concepts", text.strip), lambda c: F.length(c) > 0)
    rows = table(spark, d, "nodes").select("doc_id", text.strip(F.col("name")).alias("name"), kept.alias("concepts"))
    return rows.filter("doc_id is not null and length(name) > 0 and size(concepts) > 0")


def known_concepts(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, name, concepts)`` of nodes that have any concept that is not blank."""
    return _node_concepts(spark, d).groupBy("doc_id", "name").agg(F.max("concepts").alias("concepts"))


def _map_entries(spark: SparkSession, d: str, column: str) -> DataFrame:
    rows = table(spark, d, "kg").select("doc_id", F.explode(column).alias("variant", "canonical"))
    return rows.filter("doc_id is not null and variant is not null and length(canonical) > 0")


def mapping(spark: SparkSession, d: str, column: str) -> DataFrame:
    """``(doc_id, variant, canonical)`` of a map column of ``kg``; of several values the first in letter order."""
    return _map_entries(spark, d, column).groupBy("doc_id", "variant").agg(F.min("canonical").alias("canonical"))


# ---------------------------------------------------------------- text and chunks


@query
def token_count(spark, d):
    return documents(spark, d).select("doc_id", text.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query
def heading_parse(spark, d):
    return chunking.section_headings(documents(spark, d)).select("doc_id", F.col("line_index").cast("long").alias("line_index"), F.col("level").cast("long").alias("level"), "name")


@query
def sentence_split(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("k", "sentence"))
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), "sentence")


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "article_title", "section_path", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text", F.col("token_approx").cast("long").alias("token_approx"))


@query
def section_chunks(spark, d):
    return _chunks(chunking.chunk(documents(spark, d), CONFIG, "sections"))


@query
def file_chunks(spark, d):
    return _chunks(chunking.chunk(documents(spark, d), CONFIG, "file"))


@query
def packed_chunks(spark, d):
    return _chunks(chunking.chunk(essays(spark, d), CONFIG, "packed"))


@query
def paragraph_chunks(spark, d):
    return _chunks(chunking.chunk(essays(spark, d), CONFIG, "paragraph"))


@query
def whole_chunks(spark, d):
    return _chunks(chunking.chunk(essays(spark, d), CONFIG, "whole"))


@query
def sampler(spark, d):
    return chunking.sample(documents(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "article")


@query
def corpus_sampler(spark, d):
    """The same over all documents joined to one corpus."""
    return chunking.sample_corpus(documents(spark, d)).select("article")


@query
def resume_anti(spark, d):
    done = table(spark, d, "kg").select(F.col("doc_id").alias("key")).filter("key is not null").distinct()
    return remaining(documents(spark, d), done).select("doc_id", "title")


@query
def stream_chunks(spark, d):
    """Two runs over the same folder of records: the second finds nothing new."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    documents(spark, d).withColumnRenamed("doc_id", "id").write.json(f"{out}/records")
    for _ in range(2):
        run = append_chunks(f"{out}/chunks", lambda rows: chunking.chunk(rows, CONFIG))
        process_new(spark, f"{out}/records", f"{out}/state", run).awaitTermination()
    return _chunks(spark.read.parquet(f"{out}/chunks")).select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_index", "token_approx")


# ---------------------------------------------------------------- triples


def _chunk_rows(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "doc_id", "chunk_index", "chunk_text").distinct().filter("chunk_text is not null and doc_id is not null")


@query
def rule_triples(spark, d):
    rows = _chunk_rows(spark, d).select("doc_id", F.struct("chunk_index", "chunk_id").alias("chunk_index"), "chunk_text")
    return triples.rule_triples(rows)


@query
def validate_triples(spark, d):
    return facts(spark, d)


@query
def answered_triples(spark, d):
    """Triples written as a model would answer, in a fence and with a loose comma, and read back."""
    rows = table(spark, d, "triples").select("doc_id", "triple_id", "subject", "relation", "object").distinct().filter("doc_id is not null")
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("triple_id", "subject", "relation", "object"))).alias("t"))
    body = F.array_join(F.transform("t", lambda t: F.to_json(F.struct(t["subject"], t["relation"], t["object"]))), ",\n")
    answers = listed.select("doc_id", F.lit(0).alias("chunk_index"), F.concat(F.lit("Here it is:\n```json\n["), body, F.lit(",\n]\n```")).alias("response"))
    return triples.answered_triples(answers)


@query
def dedup_triples(spark, d):
    return triples.dedup(facts(spark, d))


@query
def dedup_stats(spark, d):
    return triples.dedup_stats(facts(spark, d))


@query
def context_triples(spark, d):
    rows = triples.context(triples.dedup(facts(spark, d)))
    return rows.select("doc_id", "name", F.col("rank").cast("long").alias("rank"), "pos", "subject", "relation", "object")


@query
def embed_strings(spark, d):
    rows = triples.context_lists(triples.dedup(facts(spark, d)))
    return rows.select("doc_id", "name", F.concat("name", F.lit(" "), prompts.facts(F.col("context"))).alias("embedded"))


@query
def extract_prompts(spark, d):
    rows = table(spark, d, "chunks").select("chunk_id", "article_title", "section_path", "chunk_text").distinct()
    return rows.select("chunk_id", prompts.extract(F.col("article_title"), F.col("section_path"), F.col("chunk_text")).alias("prompt"))


def _titles(spark, d):
    return table(spark, d, "kg").filter("doc_id is not null").groupBy("doc_id").agg(F.max("article_title").alias("article_title"))


def _asked(spark, d, size):
    """Batches of the relations of each article with their first triples, as a model would be asked about them."""
    rows = triples.batches(triples.relation_examples(triples.dedup(facts(spark, d))), size)
    rows = rows.join(defined(spark, d).select("doc_id", "relation", "definition"), ["doc_id", "relation"], "left")
    item = F.struct("ord", "relation", F.coalesce("definition", F.lit("")).alias("definition"), F.struct("subject", "relation", "object").alias("example"))
    rows = rows.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("asked")).join(_titles(spark, d), "doc_id")
    return rows.withColumn("batch", F.col("batch").cast("long"))


@query
def definition_prompts(spark, d):
    return _asked(spark, d, CONFIG.definition_batch).select("doc_id", "batch", prompts.define(F.col("article_title"), F.col("asked")).alias("prompt"))


@query
def singleton_prompts(spark, d):
    return _asked(spark, d, CONFIG.singleton_batch).select("doc_id", "batch", prompts.shorten(F.col("article_title"), F.col("asked")).alias("prompt"))


@query
def relation_kind_prompts(spark, d):
    return _asked(spark, d, CONFIG.concept_batch).select("doc_id", "batch", prompts.relation_kinds(F.col("article_title"), F.col("asked")).alias("prompt"))


@query
def relation_strings(spark, d):
    return defined(spark, d).select("doc_id", "relation", F.concat_ws(" ", "relation", "definition").alias("embedded"))


@query
def entity_prompts(spark, d):
    """For every name of an article, whether the names that begin with the same letter mean the same; those stand in for candidates by similarity."""
    lists = materialise(triples.context_lists(triples.dedup(facts(spark, d))), "contexts")
    first = F.substring("name", 1, 1)
    names = lists.select("doc_id", first.alias("letter"), "name", "context")
    place = F.row_number().over(Window.partitionBy("doc_id", "letter").orderBy("name"))
    few = names.withColumn("n", place).filter(F.col("n") <= CONFIG.entity_top_k + 1)  # one of them may be the name itself
    groups = few.groupBy("doc_id", "letter").agg(F.array_sort(F.collect_list(F.struct("name", "context"))).alias("all"))
    rows = lists.withColumn("letter", first).join(groups, ["doc_id", "letter"]).join(_titles(spark, d), "doc_id")
    others = F.slice(F.filter("all", lambda c: c["name"] != F.col("name")), 1, CONFIG.entity_top_k)
    rows = rows.withColumn("others", others).filter(F.size("others") > 0)
    return rows.select("doc_id", "name", prompts.same_entity(F.col("article_title"), F.col("name"), F.col("context"), F.col("others")).alias("prompt"))


@query
def relation_examples(spark, d):
    rows = triples.relation_examples(triples.dedup(facts(spark, d)))
    return rows.select("doc_id", "relation", F.col("ord").cast("long").alias("ord"), "frequency", "subject", "object")


@query
def relation_order(spark, d):
    rows = triples.relation_order(triples.dedup(facts(spark, d)), defined(spark, d))
    return rows.select("doc_id", "relation", "frequency", F.col("ord").cast("long").alias("ord"))


@query
def entity_batches(spark, d):
    rows = triples.batches(triples.entity_order(facts(spark, d)), CONFIG.concept_batch)
    return rows.select("doc_id", "name", F.col("ord").cast("long").alias("ord"), F.col("batch").cast("long").alias("batch"))


# ---------------------------------------------------------------- resolution


def _named_vectors(spark, d, kind):
    rows = table(spark, d, "name_vectors").filter(F.col("kind") == kind).select("doc_id", F.concat_ws("#", "name", "vec_id").alias("name"), "vec_id", "vec", F.length("name").alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "vec_id"))
    return rows.filter("doc_id is not null").select("doc_id", "name", place.alias("ord"), "vec")


# The invented relations of one article are hardly alike: with the default threshold of 0.8 none would be a candidate.
THRESHOLD = {"entity": CONFIG.entity_threshold, "relation": 0.3}
MATCHES = {"entity": 0.9, "relation": 0.32}


def _candidates(spark, d, kind):
    rows = similarity.candidates(_named_vectors(spark, d, kind), THRESHOLD[kind], CONFIG.entity_top_k)
    return rows.select("doc_id", "target", "candidate", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def entity_candidates(spark, d):
    return _candidates(spark, d, "entity")


@query
def relation_candidates(spark, d):
    return _candidates(spark, d, "relation")


def _decided(spark, d, kind):
    """A rule in the verifier's place: what is as similar as ``MATCHES`` says matches, the longest name is canonical."""
    rows = _candidates(spark, d, kind).groupBy("doc_id", "target").agg(F.array_sort(F.collect_list(F.when(F.col("score") >= MATCHES[kind], F.struct("rank", "candidate")))).alias("c"))
    names = F.transform("c", lambda c: c["candidate"])
    longest = F.array_max(F.transform(F.concat(F.array("target"), names), lambda n: F.struct(F.length(n).alias("a"), n.alias("b"))))["b"]
    answer = F.to_json(F.struct(names.alias("matches"), longest.alias("canonical_name")))
    return resolution.decisions(rows.select("doc_id", "target", answer.alias("response")))


@query
def entity_map_fold(spark, d):
    return resolution.entity_map(_named_vectors(spark, d, "entity").drop("vec"), _decided(spark, d, "entity"))


@query
def relation_map_fold(spark, d):
    ordered = _named_vectors(spark, d, "relation").select("doc_id", F.col("name").alias("relation"), "ord")
    groups = resolution.relation_groups(ordered, _decided(spark, d, "relation"))
    short = groups.filter("ord is not null").select("doc_id", F.col("variant").alias("relation"), F.substring_index("variant", "#", 1).alias("short"))
    return resolution.relation_map(ordered, groups, short)


@query
def apply_entity_map(spark, d):
    return resolution.apply_map(facts(spark, d), mapping(spark, d, "entity_map"), "subject", "object")


@query
def apply_relation_map(spark, d):
    return resolution.apply_map(facts(spark, d), mapping(spark, d, "relation_map"), "relation")


@query
def merge_stats(spark, d):
    return resolution.merge_stats(mapping(spark, d, "entity_map"))


# ---------------------------------------------------------------- definitions, concepts, graph


def _no_concepts(spark):
    return spark.createDataFrame([], "doc_id long, name string, concepts array<string>")


def _nodes(spark, d):
    return graph.nodes(facts(spark, d), known_concepts(spark, d))


def _relations(spark, d):
    """Concepts of a relation: the words of its name of four letters or more, which stand in for a model's."""
    words = F.array_distinct(F.filter(text.tokens(F.lower("relation")), lambda w: F.length(w) >= 4))
    rows = defined(spark, d).select("doc_id", F.col("relation").alias("name"), words.alias("concepts")).filter(F.size("concepts") > 0)
    return graph.relations(facts(spark, d), defined(spark, d), rows)


@query
def definition_answers(spark, d):
    """Definitions asked for in batches of ten, answered as JSON objects and read back."""
    used = triples.batches(triples.relation_order(triples.dedup(facts(spark, d)), defined(spark, d)).drop("frequency"), CONFIG.definition_batch)
    told = used.join(table(spark, d, "relations").select("doc_id", text.strip(F.col("relation")).alias("relation"), "definition").filter("definition is not null").groupBy("doc_id", "relation").agg(F.max("definition").alias("definition")), ["doc_id", "relation"])
    answers = told.groupBy("doc_id", "batch").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("relation", "definition")))).alias("response"))
    rows = concepts.definitions(answers, used)
    return rows.select("doc_id", "relation", "definition", F.col("ord").cast("long").alias("ord"))


@query
def concept_answers(spark, d):
    """Concepts of the subjects asked for in batches of eight, answered as JSON objects and read back."""
    asked = triples.batches(triples.entity_order(facts(spark, d)), CONFIG.concept_batch)
    told = table(spark, d, "nodes").filter("concepts is not null and name is not null").groupBy("doc_id", "name").agg(F.max("concepts").alias("concepts"))
    told = asked.join(told, ["doc_id", "name"]).groupBy("doc_id", "batch").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "concepts")))).alias("response"))
    return concepts.concepts(told, asked, "name")


@query
def graph_nodes(spark, d):
    return _nodes(spark, d)


@query
def graph_relations(spark, d):
    return _relations(spark, d)


@query
def kg_counts(spark, d):
    return graph.counts(facts(spark, d))


@query
def concept_triples(spark, d):
    return graph.concept_triples(_nodes(spark, d), _relations(spark, d))


@query
def property_nodes(spark, d):
    return graph.property_nodes(_nodes(spark, d))


@query
def property_edges(spark, d):
    return graph.property_edges(facts(spark, d), _relations(spark, d))


@query
def has_entity(spark, d):
    return graph.has_entity(_nodes(spark, d))


_PART = {"a": "string", "b": "string", "c": "string", "pos": "long", "concepts": "array<string>", "words": "string"}


def _part(kind, **values):
    return F.struct(F.lit(kind).alias("kind"), *(values.get(c, F.lit(None)).cast(t).alias(c) for c, t in _PART.items()))


def _documents(spark, d):
    """The nested documents of all articles of ``kg``.

    All that they hold is one table of parts, shuffled once, by article: names and relations are taken from the
    triples after it, and a part that is named but not in use has no ``pos``.
    """
    c = F.col
    rows = triples.valid(table(spark, d, "triples")).select("doc_id", _part("triple", a=c("subject"), b=c("relation"), c=c("object"), pos=c("pos")).alias("p"))
    rows = rows.unionByName(_node_concepts(spark, d).select("doc_id", _part("node", a=c("name"), concepts=c("concepts")).alias("p")))
    rows = rows.unionByName(_definitions(spark, d).select("doc_id", _part("relation", a=c("relation"), words=c("definition")).alias("p")))
    rows = rows.unionByName(table(spark, d, "kg").filter("doc_id is not null").select("doc_id", _part("title", words=c("article_title")).alias("p")))
    for m in ("entity_map", "relation_map"):
        rows = rows.unionByName(_map_entries(spark, d, m).select("doc_id", _part(m, a=c("variant"), words=c("canonical")).alias("p")))
    rows = rows.select("doc_id", "p.*").repartition("doc_id").select("doc_id", F.struct("kind", *_PART).alias("p"))
    used = [_part("node", a=c("p.a"), pos=F.lit(0)), _part("node", a=c("p.c"), pos=F.lit(0)), _part("relation", a=c("p.b"), pos=F.lit(0))]
    rows = rows.select("doc_id", F.explode(F.when(c("p.kind") == "triple", F.array("p", *used)).otherwise(F.array("p"))).alias("p")).select("doc_id", "p.*")
    rows = rows.groupBy("doc_id", "kind", "a", "b", "c").agg(F.min("pos").alias("pos"), F.max("concepts").alias("concepts"), F.max("words").alias("last"), F.min("words").alias("first"))
    none = F.array().cast(graph.NO_CONCEPTS)
    gathered = lambda kind, *fields, where=F.lit(True): F.array_sort(F.collect_list(F.when((c("kind") == kind) & where, F.struct(*fields))))
    in_use = c("pos").isNotNull()
    rows = rows.groupBy("doc_id").agg(
        F.max(c("kind") == "title").alias("titled"),
        F.max(F.when(c("kind") == "title", c("last"))).alias("article_title"),
        F.map_from_entries(gathered("node", "a", F.struct(F.coalesce("concepts", none).alias("concepts")), where=in_use)).alias("nodes"),
        F.map_from_entries(gathered("relation", "a", F.struct(F.coalesce("last", F.lit("")).alias("definition"), none.alias("concepts")), where=in_use)).alias("relations"),
        gathered("triple", "pos", "a", "b", "c").alias("t"),
        *(F.map_from_entries(gathered(m, "a", "first")).alias(m) for m in ("entity_map", "relation_map")),
    )
    facts_ = F.transform("t", lambda x: F.struct(x["a"].alias("subject"), x["b"].alias("relation"), x["c"].alias("object"))).alias("triples")
    return rows.filter("titled and size(t) > 0").select("doc_id", "article_title", "nodes", "relations", facts_, "entity_map", "relation_map")


@query
def kg_documents(spark, d):
    """All that the nested documents hold: one row for each node, relation, triple and entry of a map."""
    entry = lambda part, key, value: F.struct(F.lit(part).alias("part"), key.alias("key"), value.alias("value"))
    joined = lambda *parts: F.concat_ws("|", *parts)
    parts = [
        F.transform(F.map_entries("nodes"), lambda e: entry("node", e["key"], F.array_join(e["value"]["concepts"], "|"))),
        F.transform(F.map_entries("relations"), lambda e: entry("relation", e["key"], joined(e["value"]["definition"], F.array_join(e["value"]["concepts"], "|")))),
        F.transform("triples", lambda t, i: entry("triple", i.cast("string"), joined(t["subject"], t["relation"], t["object"]))),
        F.transform(F.map_entries("entity_map"), lambda e: entry("entity_map", e["key"], e["value"])),
        F.transform(F.map_entries("relation_map"), lambda e: entry("relation_map", e["key"], e["value"])),
    ]
    rows = _documents(spark, d).select("doc_id", "article_title", F.explode(F.concat(*parts)).alias("e"))
    return rows.select("doc_id", "article_title", "e.part", "e.key", "e.value")


# ---------------------------------------------------------------- sources and sinks, there and back


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def wiki_records(spark, d):
    """All documents written as JSON lines and read as wiki records."""
    path = _folder(spark, "wiki")
    documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "title", "text").write.json(path)
    return readers.wiki_records(spark, path)


@query
def essay_records(spark, d):
    """All essays written as JSON lines and read as essay records; the title is the key."""
    path = _folder(spark, "essays")
    table(spark, d, "essay").select("essay_title", "essay_content").write.json(path)
    return readers.essay_records(spark, path)


@query
def article_files(spark, d):
    """All essays written as a file each and read with the name of the file as their title."""
    path = _folder(spark, "articles")
    rows = essays(spark, d).filter("text is not null").groupBy("doc_id").agg(F.max("text").alias("value"))
    sinks.write_named_files(rows.select(F.concat(F.lit("essay_"), "doc_id", F.lit(".v1.txt")).alias("file"), "value"), path)
    return readers.article_files(spark, f"{path}/*.txt")


def _triples_of(graphs):
    rows = graphs.select("article_title", F.posexplode("triples").alias("place", "t"))
    return rows.select("article_title", F.col("place").cast("long").alias("place"), "t.subject", "t.relation", "t.object")


@query
def graph_lines(spark, d):
    """All graphs appended as JSON lines in two runs, the second for what the first left, and read back."""
    path, rows = _folder(spark, "graphs"), materialise(_documents(spark, d), "documents")
    for part in (rows.filter("doc_id % 2 = 0"), rows):
        keyed = part.withColumn("key", F.col("doc_id").cast("string"))
        sinks.append_graphs(remaining(keyed, readers.progress(spark, path), "key").drop("key"), path)
    return _triples_of(readers.graphs(spark, path, lines=True))


@query
def graph_files(spark, d):
    """All graphs written as a JSON file each, of one title the last, with a broken file among them that stops no other."""
    path = _folder(spark, "graph-files")
    sinks.write_json_files(_documents(spark, d), path)
    sinks.write_named_files(spark.createDataFrame([("broken.json", '{"article_title": ')], "file string, value string"), path, "append")
    good, broken = readers.graph_files(spark, f"{path}/*.json")
    return _triples_of(good).drop("place").unionByName(broken.select(F.col("file").alias("article_title"), *(F.lit("").alias(c) for c in triples.FIELDS)))


@query
def progress_keys(spark, d):
    """The keys of the graphs appended twice: what is left to do is every document without one."""
    path = _folder(spark, "progress")
    done = table(spark, d, "kg").select("doc_id")
    for _ in range(2):
        sinks.write_progress(done, path)
    left = remaining(documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_id")), readers.progress(spark, path))
    return left.select("doc_id", F.lit(False).alias("done")).unionByName(readers.progress(spark, path).select(F.col("key").alias("doc_id"), F.lit(True).alias("done")))


# ---------------------------------------------------------------- answers and the whole pipeline


@query
def json_answers(spark, d):
    """The ladder of JSON repairs over a fenced, a prosaic and a broken answer about every chunk."""
    rows = _chunk_rows(spark, d).select("chunk_id", F.to_json(F.struct(F.col("chunk_text").alias("a"))).alias("j"))
    forms = {"fenced": ("```json\n[", "]\n```"), "prose": ("Sure: [", "] I hope so."), "comma": ("[", ", ,]"), "two": ("[", "] [2]"), "object": ("", "")}
    raw = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), F.concat(F.lit(a), F.col("j"), F.lit(b)).alias("raw")) for k, (a, b) in forms.items())))
    rows = rows.select("chunk_id", raw.alias("x")).select("chunk_id", "x.form", "x.raw")
    return rows.select("chunk_id", "form", json_repair.parsed(F.col("raw"), "list").isNotNull().alias("parsed"))


def rule_answers(step: Column, system: Column, user: Column) -> Column:
    """Answers by rule to every prompt of the pipeline: facts from the first words of sentences, no merges, plain definitions."""
    words = F.transform(text.sentences(text.clean(F.substring_index(user, "Text:\n", -1))), text.tokens)
    fact = lambda w: F.struct(F.get(w, F.lit(0)).alias("subject"), F.get(w, F.lit(1)).alias("relation"), F.array_join(F.slice(w, 3, 1 << 30), " ").alias("object"))
    found = F.to_json(F.transform(F.filter(words, lambda w: F.size(w) >= 3), fact))
    names = F.array_distinct(F.regexp_extract_all(user, F.lit(r'(?m)^(?:- )?"([^"\n]*)"'), F.lit(1)))
    about = lambda value: F.to_json(F.map_from_arrays(names, F.transform(names, value)))
    kinds = about(lambda n: F.array(F.lit("thing"), F.lower(n)))
    none = F.to_json(F.struct(F.array().cast("array<string>").alias("matches"), F.regexp_extract(user, r'(?m)^(?:Name|Relation): "(.*?)"(?: in |: )', 1).alias("canonical_name")))
    plain = about(lambda n: F.concat(F.lit("relates by: "), n))
    return F.when(step == "extract", found).when(step.isin("entities", "relations"), none).when(step == "definitions", plain).when(step == "singletons", about(lambda n: n)).otherwise(kinds)


@query
def pipeline_status(spark, d):
    """All steps for all essays, with answers by rule: one status row an essay."""
    rows = essays(spark, d).groupBy("doc_id").agg(F.max(F.struct("title", "text")).alias("e")).select("doc_id", "e.title", "e.text")
    return build_graphs(rows, RuleBackend(rule_answers), CONFIG, "packed").status
