"""``python -m graphloom KIND INPUT OUTPUT [--backend NAME] [--answers PATH] [--url URL --model MODEL]``: graphs of what is not done yet.

KIND is ``wiki``, ``essays`` or ``files``. NAME is ``rule`` (shows the flow but knows nothing), ``replay`` of a parquet
table ``(key, response)``, ``http`` or ``http-async`` for a chat service. Answers are kept in OUTPUT/answers, so that a run
after a failure asks only what was not answered.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.config import Config, Service
from graphloom.plans.backends import Store, backend
from graphloom.plans.pipeline import build_graphs
from graphloom.plans.queries import rule_answers
from graphloom.sources import readers, sinks
from graphloom.tables import forget

KINDS = {"wiki": (readers.wiki_records, "sections"), "essays": (readers.essay_records, "paragraph"), "files": (readers.article_files, "file")}


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    args.add_argument("kind", choices=KINDS)
    args.add_argument("input")
    args.add_argument("output")
    args.add_argument("--answers")
    args.add_argument("--backend", choices=("rule", "replay", "http", "http-async"))
    args.add_argument("--url", default=Service.url)
    args.add_argument("--model", default=Service.model)
    a = args.parse_args(argv)
    cfg = Config(service=Service(a.backend or ("replay" if a.answers else "rule"), a.url, a.model))
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    read, strategy = KINDS[a.kind]
    todo = readers.remaining(read(spark, a.input), readers.progress(spark, f"{a.output}/graphs"))
    if todo.isEmpty():
        print("nothing to do")
        return
    # what a service answered is kept; the other answers cost nothing
    store = Store(f"{a.output}/answers") if cfg.service.kind.startswith("http") else None
    graphs = build_graphs(todo, backend(spark, cfg, a.answers, rule_answers), cfg, strategy, store=store)
    sinks.append_graphs(graphs.documents, f"{a.output}/graphs")
    graphs.status.orderBy("doc_id").show(1000, truncate=60)
    forget(spark)


if __name__ == "__main__":
    main()
