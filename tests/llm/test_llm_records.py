import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import dedup, mixing, termstats

TREE = dedup.Node((dedup.Leaf("relation"), dedup.Node((dedup.Leaf("subject"), dedup.Leaf("object")), ordered=False)))
SCHEMA = "triple_id long, doc_id long, subject string, relation string, object string, root string, form string, s0 string"


def triples(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_copies(spark):
    df = triples(
        spark, (5, 1, "Port X", "is in", "3.84 km"), (3, 1, "port-x!", "IS IN", "3.84 KM"), (9, 1, "3.84km", "is in", "Port X"), (4, 1, "Port X", "is in", "384 km"), (3, 1, "port-x!", "IS IN", "3.84 KM"),
        (7, 2, "Port X", "is in", "3.84 km"), (8, None, "Port X", "is in", "3.84 km"), (10, 1, None, "is in", "x"), (11, 1, "–", "is in", "x"), (None, 1, "Port X", "is in", "3.84 km"),
    )
    assert sorted(tuple(r) for r in dedup.copies(df, "triple_id", ["doc_id"], TREE).collect()) == [(3, 5), (3, 9)]
    assert sorted(tuple(r) for r in dedup.collapse(df, "triple_id", ["doc_id"], TREE).collect()) == [(1, 3, 3), (1, 4, 1), (2, 7, 1)]
    assert dedup.copies(df.limit(0), "triple_id", ["doc_id"], TREE).count() == 0
    kept = dedup.collapse(df, "triple_id", ["doc_id"], TREE, require_leaves=False)
    assert kept.count() == 5


def test_forms_are_compared_in_full(spark, monkeypatch):
    same = F.lit(1).cast("long")
    monkeypatch.setattr(dedup, "digest", lambda tree: same)
    df = triples(spark, (1, 1, "a", "r", "b"), (2, 1, "b", "r", "a"), (3, 1, "a", "r", "c"), (4, 1, "C", "r", "a"), (5, 1, "d", "r", "e"))
    for _ in range(2):  # the second time the other digest says nothing either
        assert sorted(tuple(r) for r in dedup.copies(df, "triple_id", ["doc_id"], TREE).collect()) == [(1, 2), (3, 4)]
        monkeypatch.setattr(dedup, "second_digest", lambda form: same)


def test_form_is_unambiguous(spark):
    df = spark.createDataFrame([(1, ["a", "bc"], "d"), (2, ["ab", "c"], "d"), (3, ["A", "b c"], "D!"), (4, None, "d"), (5, [], "d")], "id long, a array<string>, b string")
    tree = dedup.Node((dedup.Leaf("a", is_list=True), dedup.Leaf("b")))
    assert [tuple(r) for r in dedup.copies(df, "id", [], tree, require_leaves=False).collect()] == [(1, 3)]


def test_one_group_of_most_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("triple_id"), F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("subject"), F.lit("r").alias("relation"), F.lit("o").alias("object"))
    assert dedup.copies(df, "triple_id", ["doc_id"], TREE).count() == 1666


def test_frequencies_like_counting(spark):
    random.seed(6)
    rows = [(random.choice("fg"), random.choice(["hot"] * 6 + list("abcdefgh")), random.choice([None, -5, *range(300), 10**12])) for _ in range(3000)] + [("f", "", 1), ("f", None, 1)]
    post = termstats.postings(spark.createDataFrame(rows, "field string, term string, record_id long"))
    occurrences, records, fields = Counter(), defaultdict(set), defaultdict(set)
    for f, t, r in rows:
        if t and r is not None:
            occurrences[f, t] += 1
            records[f, t].add(r)
            fields[f].add(r)
    want = {(f, t, n, len(records[f, t]), len(fields[f])) for (f, t), n in occurrences.items()}
    got = termstats.frequencies(termstats.unite(post)).select("field", "term", "occurrences", "records", "field_records")
    assert {tuple(r) for r in got.collect()} == want
    parts = [termstats.postings(spark.createDataFrame(rows[i::3], "field string, term string, record_id long")) for i in (0, 1, 2)]
    for several in (parts, [termstats.unite(*parts[:2]), parts[2]], [termstats.unite(p) for p in parts]):  # bitmaps of parts can be merged again
        assert {tuple(r) for r in termstats.frequencies(termstats.unite(*several)).select(got.columns).collect()} == want
    assert termstats.unite(*parts).agg(F.max(F.size("bitmap"))).head()[0] <= 300 // 64 + 1
    assert termstats.frequencies(termstats.unite(termstats.postings(spark.createDataFrame([], "field string, term string, record_id long")))).count() == 0


def test_marks(spark):
    df = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (15, 100), (16, 100), (1, 2)], "records long, field_records long")
    assert [r[0] for r in df.select(termstats.mark()).collect()] == ["rare", "rare", None, None, "common", "rare"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (5 + i % 7), "  BIG " if i % 3 else "small", 9, "c") for i in range(3000)] + [(9001, None, "big", 0, ""), (9002, "lost", None, 0, ""), (9003, "x", "unlisted", 0, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, mixed_id string")


def test_mixture(spark, docs):
    targets = spark.createDataFrame([("Big", 0.25, 1), ("small", 0.7, 3), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    tokens = mixing.document_tokens(docs).cache()
    for fit in ("size", "shares"):
        rated = mixing.rates(tokens, targets, fit)
        mixed = mixing.mixture(tokens, rated)
        rows = {r["source"]: r for r in mixing.report(mixed, rated).collect()}
        assert rows["none"]["short"] and not rows["Big"]["short"] and rows["none"]["tokens"] == 0 and rows["Big"]["most_copies"] <= 1 and rows["small"]["most_copies"] <= 3
        assert abs(rows["small"]["actual_share"] - 0.7 / 0.95) < 0.03
        again = mixing.mixture(tokens.repartition(7), rated)
        assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
        emitted = mixing.emit(docs, rated)
        assert emitted.count() == mixed.agg(F.sum("copies")).head()[0] and emitted.columns == [*docs.columns, "copy"]
    few = targets.withColumn("max_repeats", F.lit(1))
    rows = {r["source"]: r for r in mixing.rates(tokens, few).collect()}
    assert rows["small"]["short"] and rows["small"]["rate"] == 1.0


def test_mixture_of_nothing(spark, docs):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    tokens = mixing.document_tokens(docs.limit(0))
    rated = mixing.rates(tokens, targets)
    assert [tuple(r) for r in mixing.report(mixing.mixture(tokens, rated), rated).select("tokens", "mixed_tokens", "actual_share").collect()] == [(0, 0, 0.0)]
    assert mixing.rates(mixing.document_tokens(docs), targets.limit(0)).count() == 0


def test_token_counts(spark):
    rows = spark.createDataFrame([("Hello world, 12345!",), ("",), (None,), ("<|endoftext|> é字",)], "t string")
    got = [r[0] for r in rows.select(mixing.token_counter()("t")).collect()]
    enc = mixing.encoding(mixing.VOCABULARY)
    assert got == [len(enc.encode_ordinary("Hello world, 12345!")), 0, 0, len(enc.encode_ordinary("<|endoftext|> é字"))]
    assert enc.decode(enc.encode_ordinary("<|endoftext|> é字")) == "<|endoftext|> é字"


def test_the_vocabulary_is_sent_with_the_job(spark, tmp_path):
    import shutil

    own = str(tmp_path / "own.tiktoken")
    shutil.copy(mixing.VOCABULARY, own)
    count = mixing.token_counter(own)
    rows = spark.createDataFrame([("Hello world",)], "t string")
    assert rows.select(count("t")).head()[0] == 2

    @F.udf("boolean")
    def there(name):
        import os

        from pyspark import SparkFiles

        return os.path.exists(SparkFiles.get(name))

    assert rows.select(there(F.lit("own.tiktoken"))).head()[0]
