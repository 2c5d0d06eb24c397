import json

import pytest
from pyspark.sql import functions as F

from graphloom.config import Config, Service
from graphloom.functions import prompts
from graphloom.operators.chunking import chunk
from graphloom.plans.backends import AsyncBackend, CallableBackend, ReplayBackend, RuleBackend, Store, ask, backend, chat, prompt_key
from graphloom.plans.pipeline import build_graphs
from graphloom.plans.queries import rule_answers
from graphloom.sources import readers, sinks
from graphloom.streaming.resume import append_chunks, process_new

CFG = Config(max_tokens=20, min_tokens=3, model_delay_s=0)
RECORDS = "doc_id string, title string, text string"
TEXT = "= Top =\nAnn likes the old tower. Bo visits the old mill.\n= = More = =\nAnn likes the old tower. Ann sees Bo often."


@pytest.fixture(scope="module")
def built(spark):
    records = spark.createDataFrame([("a", "A", TEXT), ("b", "B", ""), ("c", "C", TEXT.replace("Ann", "Zoe"))], RECORDS)
    return build_graphs(records, RuleBackend(rule_answers), CFG)


def test_status(built):
    got = {r["doc_id"]: r for r in built.status.collect()}
    assert (got["a"]["status"], got["b"]["status"], got["b"]["error"]) == ("success", "failed", "no chunks")
    assert got["a"]["triples"] == 3 and got["b"]["triples"] == 0


def test_invariants(built):
    for r in built.documents.collect():
        ends = {x for t in r["triples"] for x in (t["subject"], t["object"])}
        assert set(r["nodes"]) == ends and set(r["relations"]) == {t["relation"] for t in r["triples"]}
        assert {n for n, v in r["nodes"].items() if v["concepts"]} <= {t["subject"] for t in r["triples"]}
        assert set(r["relation_map"].values()) >= set(r["relations"])


def test_replay_gives_the_same_graph(spark, built):
    calls = []

    def recorded(prompts_):
        rows = RuleBackend(rule_answers).answer(prompts_)
        calls.append([tuple(r) for r in rows.select("key", "response").collect()])
        return rows

    class Recorder:
        answer = staticmethod(recorded)

    records = spark.createDataFrame([("a", "A", TEXT)], RECORDS)
    first = build_graphs(records, Recorder(), CFG)
    answers = spark.createDataFrame([x for c in calls for x in c], "key string, response string")
    again = build_graphs(records, ReplayBackend(answers), CFG)
    assert first.documents.collect() == again.documents.collect()


def test_a_failed_call_fails_its_article_only(spark):
    def call(system, user):
        if "Zoe" in user:
            raise RuntimeError("down")
        return json.dumps([{"subject": "s", "relation": "r", "object": "o"}]) if system == prompts.SYSTEM["extract"] else "{}"

    records = spark.createDataFrame([("a", "A", TEXT), ("c", "C", TEXT.replace("Ann", "Zoe"))], RECORDS)
    got = {r["doc_id"]: r["status"] for r in build_graphs(records, CallableBackend(call, 2, 0), CFG).status.collect()}
    assert got == {"a": "success", "c": "failed"}


ALIKE = Config(max_tokens=20, min_tokens=3, entity_threshold=0.5, relation_threshold=0.5)


def replies(down=False, asked=None):
    """Answers of every step by shape; with ``down``, the calls of an article fail in the step that its title names."""
    import re

    steps = {v: k for k, v in prompts.SYSTEM.items()}

    def call(system, user):
        step, title = steps[system], re.match("Article: (.*)", user)[1]
        if asked is not None:
            asked.add(1)
        if down and step == title:
            raise RuntimeError("down")
        names = list(dict.fromkeys(re.findall(r'(?m)^(?:- |[A-Z]\. )?"([^"\n]*)"', user)))
        if step == "extract":
            facts = [("Ann Smith", "likes to see", "tower"), ("Ann Smith", "likes to seek", "mill"), ("Ann Smithe", "owns", "mill")]
            return json.dumps([dict(zip(("subject", "relation", "object"), f)) for f in facts])
        if step in ("entities", "relations"):
            return json.dumps({"matches": names, "canonical_name": re.search(r'(?:Name|Relation): "([^"\n]*)"', user)[1]})
        return json.dumps({n: [n, "thing"] if "concepts" in step else f"{n}." for n in names})

    return call


def test_a_failed_call_in_any_step_fails_its_article_only(spark, tmp_path):
    records = spark.createDataFrame([(t, t, TEXT) for t in ("fine", *prompts.SYSTEM)], RECORDS)
    store, asked = Store(str(tmp_path / "answers")), spark.sparkContext.accumulator(0)
    got = build_graphs(records, CallableBackend(replies(down=True), 1, 0), ALIKE, store=store)
    status = {r["doc_id"]: (r["status"], r["error"]) for r in got.status.collect()}
    assert status == {"fine": ("success", None)} | {s: ("failed", f"{s}: RuntimeError: down") for s in prompts.SYSTEM}
    for rows in (got.triples, got.nodes, got.relations, got.entity_map, got.relation_map, got.documents):
        assert {r["doc_id"] for r in rows.select("doc_id").collect()} == {"fine"}
    assert got.entity_map.filter("variant <> canonical").count() == 1 and got.relation_map.filter("variant <> canonical").count() >= 1
    before = store.read(spark).count()
    again = build_graphs(records, CallableBackend(replies(asked=asked), 1, 0), ALIKE, store=store)
    assert {r["status"] for r in again.status.collect()} == {"success"}
    assert 0 < asked.value == store.read(spark).count() - before  # only what was not answered


def test_backends_by_name(spark, tmp_path):
    assert isinstance(backend(spark, Config(), rule=rule_answers), RuleBackend)
    assert type(backend(spark, Config(service=Service("http")))) is CallableBackend
    assert isinstance(backend(spark, Config(service=Service("http-async"))), AsyncBackend)
    spark.createDataFrame([("k", "r")], "key string, response string").write.parquet(str(tmp_path / "a"))
    assert isinstance(backend(spark, Config(service=Service("replay")), str(tmp_path / "a")), ReplayBackend)
    with pytest.raises(ValueError, match="no backend"):
        backend(spark, Config(service=Service("x")))


def test_http_service():
    import http.server
    import threading

    class Service_(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = "|".join(m["content"] for m in got["messages"]) + f"|{got['model']}|{got['temperature']}"
            body = json.dumps({"choices": [{"message": {"content": text}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service_)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = chat(Service("http", f"http://127.0.0.1:{server.server_port}/", "m"))
    assert call("s", "u") == "s|u|m|0.0"
    server.shutdown()


def test_broken_graph_files_stop_no_other(spark, built, tmp_path):
    sinks.write_json_files(built.documents, str(tmp_path / "g"))
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.suffix == ".json") == ["A.json", "C.json"]
    (tmp_path / "g" / "bad.json").write_text('{"article_title": ')
    good, broken = readers.graph_files(spark, str(tmp_path / "g/*.json"))
    assert sorted(r["article_title"] for r in good.collect()) == ["A", "C"]
    assert [r["file"] for r in broken.collect()] == ["bad.json"]


def test_files_of_any_title_are_read_back_by_few_tasks(spark, tmp_path):
    path, graph = str(tmp_path / "g"), '{"article_title": "%s", "triples": [{"subject": "s", "relation": "r", "object": "o"}]}'
    names = ["", "_hidden", ".dot", "A: b", "a*?[x]{y}", "ü %41", *map(str, range(300))]
    sinks.write_named_files(spark.createDataFrame([(f"{n}.json", "old") for n in (*names, "gone")], "file string, value string"), path)
    sinks.write_named_files(spark.createDataFrame([(f"{n}.json", graph % n) for n in names], "file string, value string"), path)
    sinks.write_named_files(spark.createDataFrame([("broken.json", "{"), ("note.txt", "{}")], "file string, value string"), path, "append")
    assert sorted(p.name for p in (tmp_path / "g").iterdir()) == sorted([*(f"{n}.json" for n in names), "broken.json", "note.txt"])
    assert [p.name for p in tmp_path.iterdir()] == ["g"]
    (tmp_path / "g" / "bytes.json").write_bytes(b"\xff{")
    (tmp_path / "g" / "empty.json").write_bytes(b"")
    spark.sparkContext.setJobGroup("few", "")
    good, broken = readers.graph_files(spark, f"{path}/*.json")
    assert sorted((r["file"], r["article_title"]) for r in good.collect()) == sorted((f"{n}.json", n) for n in names)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r["file"], r["value"]) for r in broken.select("file", F.hex("value").alias("value")).collect()) == [("broken.json", "7B0A"), ("bytes.json", "FF7B"), ("empty.json", "")]
    tracker = spark.sparkContext.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup("few") for i in tracker.getJobInfo(job).stageIds}
    assert 0 < sum(x.numTasks for i in stages if (x := tracker.getStageInfo(i))) <= 2 + 2 * spark.sparkContext.defaultParallelism
    with pytest.raises(Exception, match="no name of a file"):
        sinks.write_named_files(spark.createDataFrame([("../x", "")], "file string, value string"), path)
    assert (tmp_path / "g" / "1.json").exists() and [p.name for p in tmp_path.iterdir()] == ["g"]


def test_keys_must_be_unique(spark):
    for rows in ([("a", "A", TEXT)] * 2, [(None, "A", TEXT)]):
        with pytest.raises(ValueError, match="unique"):
            build_graphs(spark.createDataFrame(rows, RECORDS), RuleBackend(rule_answers), CFG)


def test_backends(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, q string")

    def call(system, user):
        if user == "y":
            raise ValueError("no")
        return user.upper()

    async def later(system, user):
        return call(system, user)

    for backend in (CallableBackend(call, 2, 0), AsyncBackend(later, 2, 0)):
        got = {r["id"]: (r["response"], r["error"]) for r in ask(rows, "s", "sys", F.col("q"), backend).collect()}
        assert got == {1: ("X", None), 2: ("X", None), 3: (None, "ValueError: no")}
    assert rows.select(prompt_key(F.lit("a"), F.col("q"))).distinct().count() == 2


def test_records_and_resume(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"id": "1", "title": "T", "text": "x"}\n\n{"id": "2", "title": "U", "text": null}\n')
    rows = readers.wiki_records(spark, str(path))
    assert sorted(r[0] for r in rows.select("doc_id").collect()) == ["1", "2"]
    assert readers.wiki_records(spark, str(tmp_path / "none")).count() == 0
    done = str(tmp_path / "progress")
    assert readers.remaining(rows, readers.progress(spark, done)).count() == 2
    sinks.write_progress(rows.filter("doc_id = '1'"), done)
    sinks.write_progress(rows.filter("doc_id = '1'"), done)
    assert [r[0] for r in readers.remaining(rows, readers.progress(spark, done)).select("doc_id").collect()] == ["2"]
    path.write_text('{"id": "1", "title"\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.wiki_records(spark, str(path)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "my.essay.txt").write_bytes("one\r\ntwo".encode())
    assert [tuple(r) for r in readers.article_files(spark, str(tmp_path / "*.txt")).collect()] == [("my.essay", "my.essay", "one\ntwo")]
    (tmp_path / "e.jsonl").write_text('{"essay_title": "E", "essay_content": "c"}\n')
    assert [tuple(r) for r in readers.essay_records(spark, str(tmp_path / "e.jsonl")).collect()] == [("E", "E", "c")]


def test_graph_round_trip(spark, built, tmp_path):
    lines, files = str(tmp_path / "lines"), str(tmp_path / "files")
    sinks.write_json_lines(built.documents, lines)
    got = readers.graphs(spark, lines, lines=True)
    assert sorted(r["article_title"] for r in got.collect()) == ["A", "C"]
    assert got.filter("article_title = 'A'").select("triples").head() == built.documents.filter("doc_id = 'a'").select("triples").head()
    sinks.write_json_files(built.documents, files)
    assert readers.graphs(spark, f"{files}/*.json").count() == 2
    sinks.write_property_graph(built.triples, built.nodes, built.relations, str(tmp_path / "pg"))
    ends = spark.read.parquet(str(tmp_path / "pg/edges")).select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    assert ends.join(spark.read.parquet(str(tmp_path / "pg/nodes")), "name", "left_anti").count() == 0
    sinks.write_tables(str(tmp_path / "t"), nodes=built.nodes)
    assert spark.read.parquet(str(tmp_path / "t/nodes")).count() == built.nodes.count()


def test_stream_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = append_chunks(out, lambda rows: chunk(rows, CFG))
    for i in (1, 2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"id": str(i), "title": "T", "text": "a b c d"}) + "\n")
        process_new(spark, str(tmp_path / "in"), state, run).awaitTermination()
    process_new(spark, str(tmp_path / "in"), state, run).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_prompts(spark):
    row = spark.createDataFrame([("T", "n")], "title string, name string").withColumn("context", F.array().cast("array<struct<subject:string,relation:string,object:string>>"))
    assert row.select(prompts.facts(F.col("context"))).head()[0] == "none"
    assert "nothing is said" in row.select(prompts.fact_lines(F.col("context"))).head()[0]
    t = F.struct(F.lit("s").alias("subject"), F.lit("r").alias("relation"), F.lit("o").alias("object"))
    assert row.select(prompts.example(t)).head()[0] == "[s, r, o]"
    listed = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(F.lit("c").alias("name"), F.lit("d").alias("definition"), t.alias("example")))
    text = row.select(prompts.same_relation(F.col("title"), F.col("name"), F.lit(None).cast("string"), t, listed)).head()[0]
    assert "\nA. " in text and "\nL. " in text


def test_command_line(spark, tmp_path, capsys):
    from graphloom.__main__ import main

    (tmp_path / "in.jsonl").write_text(json.dumps({"id": "1", "title": "T", "text": "Ann likes the tower. " * 20}) + "\n")
    for _ in range(2):
        main(["wiki", str(tmp_path / "in.jsonl"), str(tmp_path / "out")])
    assert readers.graphs(spark, str(tmp_path / "out/graphs"), lines=True).count() == 1
    assert "nothing to do" in capsys.readouterr().out
