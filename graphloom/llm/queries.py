"""The registered queries of these operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import fold
from graphloom.llm import dedup, leakage, mixing, names, neighbours, sentences, splitting, termstats
from graphloom.tables import materialise, table

TRIPLE = dedup.Node((dedup.Leaf("relation"), dedup.Node((dedup.Leaf("subject"), dedup.Leaf("object")), ordered=False)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(neighbours.neighbours(table(spark, d, "name_vectors")), 0.85)


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "name_vectors")
    return neighbours.search(vectors, vectors.filter("vec_id % 50 = 0"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("src"), F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))
    essays = table(spark, d, "essay").select(F.lit("essay").alias("src"), F.col("essay_id").alias("item_id"), F.col("essay_content").alias("text"))
    return splitting.pieces(chunks.unionByName(essays), ["src", "item_id"], "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).filter("piece > 0").select("src", "item_id").distinct()


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Names linked within their article; ``kg.entity_map`` gives names and hints."""
    triples = table(spark, d, "triples").select(F.col("doc_id").alias("scope"), F.col("subject").alias("raw"))
    known = table(spark, d, "kg").select(F.col("doc_id").alias("scope"), F.explode("entity_map").alias("raw", "meant"))
    mentions = triples.unionByName(known.select("scope", "raw")).unionByName(known.select("scope", F.col("meant").alias("raw")))
    return names.variants(mentions, known)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(_names(spark, d)).select(F.col("scope").alias("doc_id"), "name_a", "name_b")


def p3_variants(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select(F.col("scope").alias("doc_id"), "name", F.col("label").alias("entity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copies(table(spark, d, "triples"), "triple_id", ["doc_id"], TRIPLE)


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return dedup.collapse(table(spark, d, "triples"), "triple_id", ["doc_id"], TRIPLE)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """One row per occurrence; a row delivered again (same id) counts once."""
    triples = table(spark, d, "triples").select("triple_id", "doc_id", "relation").distinct()
    nodes = table(spark, d, "nodes").select("node_id", "doc_id", "concepts").distinct()
    relations = triples.select(F.lit("relation").alias("field"), fold(F.col("relation")).alias("term"), F.col("doc_id").alias("record_id"))
    concepts = nodes.select(F.col("doc_id").alias("record_id"), F.explode("concepts").alias("concept"))
    concepts = concepts.select(F.lit("concept").alias("field"), fold(F.col("concept")).alias("term"), "record_id")
    return termstats.frequencies(termstats.unite(termstats.postings(relations), termstats.postings(concepts)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter(termstats.mark().isNotNull()).select("field", "term")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field", "term", "occurrences", F.col("records").alias("articles"), termstats.mark().alias("mark"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    tokens = mixing.document_tokens(table(spark, d, "documents"))
    return mixing.rates(tokens, table(spark, d, "source_targets")).filter("short").select("source")


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tokens = materialise(mixing.document_tokens(table(spark, d, "documents")), "tokens")
    return tokens, materialise(mixing.rates(tokens, table(spark, d, "source_targets"), fit="shares"), "rates")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.emit(table(spark, d, "documents"), _rated(spark, d)[1]).select("doc_id", "copy")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    tokens, rated = _rated(spark, d)
    return mixing.report(mixing.mixture(tokens, rated), rated)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = sentences.sentences(table(spark, d, "documents"))
    return found.select("doc_id", F.col("start").alias("sent_start"), F.col("end").alias("sent_end"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_nearest, p2_found, p2_pieces, p3_found, p3_variants, p4_found, p4_collapsed, p5_found, p5_frequencies, p6_found, p7_found, p7_mixture, p7_report, p8_found)
}


def _fold_sql(x: str) -> str:
    pair = "'([0-9])([^\\p{L}\\p{N}\\p{Z}\\s'||chr(57344)||chr(57345)||'])([0-9])'"
    to = "'\\1'||chr(57344)||'\\2'||chr(57345)||'\\3'"
    twice = f"regexp_replace(regexp_replace(lower({x}), {pair}, {to}, 'g'), {pair}, {to}, 'g')"
    return f"regexp_replace({twice}, chr(57344)||'(.)'||chr(57345)||'|[^\\p{{L}}\\p{{N}}]', '\\1', 'g')"


_TRIPLES_SQL = f"""
WITH f AS (SELECT DISTINCT triple_id, doc_id, {_fold_sql('relation')} AS r, {_fold_sql('subject')} AS s, {_fold_sql('object')} AS o FROM triples WHERE doc_id IS NOT NULL),
k AS (SELECT triple_id, doc_id, r, least(s, o) AS a, greatest(s, o) AS b FROM f WHERE r <> '' AND s <> '' AND o <> '')"""

_TERMS_SQL = f"""
WITH r AS (SELECT DISTINCT triple_id, doc_id, relation FROM triples), n AS (SELECT DISTINCT node_id, doc_id, concepts FROM nodes),
c AS (SELECT doc_id, unnest(concepts) AS concept FROM n),
t AS (SELECT 'relation' AS field, {_fold_sql('relation')} AS term, doc_id FROM r UNION ALL SELECT 'concept', {_fold_sql('concept')}, doc_id FROM c),
u AS (SELECT * FROM t WHERE term <> '' AND doc_id IS NOT NULL), w AS (SELECT field, count(DISTINCT doc_id) AS whole FROM u GROUP BY field),
g AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT doc_id) AS articles, any_value(whole) AS whole FROM u JOIN w USING (field) GROUP BY field, term),
m AS (SELECT *, CASE WHEN articles <= 2 THEN 'rare' WHEN articles * 100 > whole * 15 THEN 'common' END AS mark FROM g)"""

_CLEAN_SQL = "trim(regexp_replace(replace(replace({}, ' @-@ ', '-'), ' @,@ ', ','), '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'))"

SQL: dict[str, str] = {
    "p1_found": """
WITH v AS (SELECT vec_id, CAST(vec AS DOUBLE[]) AS v FROM name_vectors WHERE vec IS NOT NULL), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE list_dot_product(v, v) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_dot_product(a.v, b.v) / (a.n * b.n) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
SELECT DISTINCT least(x, y) AS vec_a, greatest(x, y) AS vec_b FROM k WHERE c >= 0.85""",
    "p2_found": f"""
WITH t AS (SELECT 'chunks' AS src, chunk_id AS item_id, {_CLEAN_SQL.format('chunk_text')} AS t FROM chunks UNION ALL SELECT 'essay', essay_id, {_CLEAN_SQL.format('essay_content')} FROM essay)
SELECT DISTINCT src, item_id FROM t WHERE length(t) > 4000 OR len(string_split(t, ' ')) > 550""",
    "p4_found": _TRIPLES_SQL + " SELECT first_id, triple_id AS copy_id FROM (SELECT triple_id, min(triple_id) OVER (PARTITION BY doc_id, r, a, b) AS first_id FROM k) WHERE triple_id > first_id",
    "p4_collapsed": _TRIPLES_SQL + " SELECT doc_id, min(triple_id) AS first_id, count(DISTINCT triple_id) AS n_copies FROM k GROUP BY doc_id, r, a, b",
    "p5_found": _TERMS_SQL + " SELECT field, term FROM m WHERE mark IS NOT NULL",
    # the answer is the same for tokens of any tokenizer: bytes will do
    "p7_found": r"""
WITH t AS (SELECT source, lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS key, target_share, max_repeats FROM source_targets),
d AS (SELECT lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS key, sum(strlen(text)) AS tokens FROM documents WHERE source IS NOT NULL GROUP BY ALL),
s AS (SELECT t.*, coalesce(tokens, 0) AS tokens FROM t LEFT JOIN d USING (key))
SELECT source FROM s WHERE max_repeats * tokens < target_share * (SELECT sum(tokens) FROM s)""",
    "p5_frequencies": _TERMS_SQL + " SELECT field, term, occurrences, articles, mark FROM m",
}
