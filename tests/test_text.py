import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import json_repair, text
from graphloom.functions.vectors import cosine, embed_texts, embedder, model_embedder


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).head()[0]


@pytest.mark.parametrize(
    ("line", "level", "name"),
    [
        ("= A =", 1, "A"), ("= = A = =", 2, "A"), ("==A==", None, None), ("= = A =", None, None), ("= = =", None, None), ("=", None, None), ("= a", None, None),
        ("plain", None, None), ("= A = B =", 1, "A = B"), (" = = = X  Y = = = ", 3, "X Y"), ("", None, None), (None, None, None), (" = A =", 1, "A"),
    ],
)
def test_heading(spark, line, level, name):
    got = one(spark, text.heading, line)
    assert (got and (got["level"], got["name"])) == (level and (level, name))


@pytest.mark.parametrize(("raw", "n"), [("", 0), (None, 0), ("  ", 0), ("a b", 2), ("a b c", 3), ("a\x1cb", 2), (" a\n\nb ", 2)])
def test_token_count(spark, raw, n):
    assert one(spark, text.token_count, raw) == n


@pytest.mark.parametrize(("raw", "want"), [("role @-@ playing", "role-playing"), ("1 @,@ 000", "1,000"), ("1 @.@ 1", "1 @.@ 1"), (" a \n b ", "a b"), (None, None)])
def test_clean(spark, raw, want):
    assert one(spark, text.clean, raw) == want


def test_strip_and_lines(spark):
    assert one(spark, text.strip, "  a b \n") == "a b"
    assert one(spark, text.lines, "a\r\nb\rc\nd e\x85f") == list("abcdef")
    assert one(spark, text.sentences, "One. Two! Three?  four") == ["One.", "Two!", "Three?", "four"]


def test_relation_type_and_file_name(spark):
    assert one(spark, text.relation_type, "women's a-b/c") == "WOMENS_A_B_C"
    assert one(spark, text.file_name, "A b/c") == "A_b_c.json"


@pytest.mark.parametrize(("raw", "want"), [("Port  Kababy!", "portkababy"), ("3.84 KM", "3.84km"), ("17-118", "17-118"), ("1 - 2", "12"), ("1--2", "12"), ("--", ""), (None, None), ("P​ort", "port")])
def test_fold(spark, raw, want):
    assert one(spark, text.fold, raw) == want


@pytest.mark.parametrize(
    ("raw", "kind", "want"),
    [
        ('```json\n[1]\n```', "list", [1]), ("Here: [1] ok", "list", [1]), ('{"a": 1,}', "dict", {"a": 1}), ("[1] [2]", "list", None), ("[1]", "dict", None), ("[1, 2", "list", None),
        ('{"a": 1, "a": 2}', "dict", {"a": 2}), ("", "list", None), (None, "list", None), ("[1,,]", "list", [1]), ("```JSON\n{}\n```", "dict", {}), ("[1, ,\n]", "list", [1]),
    ],
)
def test_json(spark, raw, kind, want):
    assert json_repair.parse(raw, kind) == want
    got = one(spark, lambda c: json_repair.parsed(c, kind), raw)
    assert (got is None) == (want is None)


def test_odd_answers_give_null_and_no_error(spark):
    deep, nan = "[" * 100_000, '[{"a": NaN, "b": -Infinity, "c": [1e999]}]'
    assert json_repair.parse(deep, "list") is None and one(spark, lambda c: json_repair.parsed(c, "list"), deep) is None
    assert one(spark, lambda c: json_repair.parsed(c, "list"), "[" * 3000 + "]" * 3000) is None
    assert json.loads(one(spark, lambda c: json_repair.parsed(c, "list"), nan)) == [{"a": None, "b": None, "c": [None]}]


@pytest.mark.parametrize("raw", ['[{"a": "b"}]', "```json\n[1]\n```", "[1] [2]", "[1], [2]", "[]", '{"a": 1}', "[1] x"])
def test_strict_answers_stay_in_the_jvm(spark, raw):
    want = json_repair.parse(raw, "list")
    got = one(spark, lambda c: json_repair.parsed(c, "list"), raw)
    assert (None if got is None else json.loads(got)) == want


def test_json_in_the_jvm(spark):
    assert one(spark, json_repair.repaired, '[1, , ]{"a": 2,\n}') == '[1]{"a": 2\n}'.replace("\n", "")
    assert one(spark, json_repair.block, 'so {"a": 1} it is') == '{"a": 1}'
    assert one(spark, json_repair.unfenced, "```json\n[1]\n```") == "[1]"


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [0.0, None]


def test_embedder(spark):
    same = embed_texts(["Port X", "Port X", "", "other"])
    assert (same[0] == same[1]).all() and not same[2].any() and abs((same[0] ** 2).sum() - 1) < 1e-5
    rows = spark.createDataFrame([("a b",), (None,)], "x string").select(embedder()("x").alias("v")).collect()
    assert all(len(r["v"]) == 64 for r in rows)


def test_strip_takes_what_the_pattern_takes(spark):
    for code in range(0x3100):
        if chr(code).isspace():
            assert chr(code) in text.SPACES, hex(code)
    assert all(c.isspace() for c in text.SPACES)
    assert one(spark, text.strip, f"{text.SPACES}a {text.SPACES[::-1]} b{text.SPACES}") == f"a {text.SPACES[::-1]} b"


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write("x")
        return lambda texts: [[float(len(t))] for t in texts]

    rows = spark.range(100).repartition(1).select(F.when(F.col("id") > 0, F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    embed = model_embedder(load)
    for _ in range(2):
        got = [r[0][0] for r in rows.select("x", embed("x").alias("v")).select("v").collect()]
        assert sorted(got) == [float(i) for i in range(100)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(open(log).read()) <= 2  # once in each of the processes that ran it, not once a batch
