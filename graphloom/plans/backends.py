"""Models behind prompts: replayed answers, rules, or a function that calls a service.

A step's prompts are made distinct, answered once and written down; the answers are joined back by
the hash of the prompt. So a plan that is evaluated again does not ask again, and the
same answers give the same graph. With a ``Store`` the answers outlive the run: a later one asks only
what was not answered before.
"""

from __future__ import annotations

import asyncio
import json
import os
import time
import urllib.request
from collections.abc import Awaitable, Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import Config, Service
from graphloom.tables import materialise, written

ANSWERS = "key string, response string, error string"


class Backend(Protocol):
    """``answer`` takes ``(key, step, system, user)`` and gives ``(key, response, error)``."""

    def answer(self, prompts: DataFrame) -> DataFrame: ...


def prompt_key(system: Column, user: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", system, user), 256)


class ReplayBackend:
    """Answers from a table ``(key, response)``; a prompt without one fails."""

    def __init__(self, answers: DataFrame):
        self.answers = answers.select("key", "response").dropDuplicates(["key"])

    def answer(self, prompts: DataFrame) -> DataFrame:
        rows = prompts.select("key").join(self.answers, "key", "left")
        return rows.select("key", "response", F.when(F.col("response").isNull(), "no recorded answer").alias("error"))


class RuleBackend:
    """Answers from an expression over ``step``, ``system`` and ``user``; for tests and dry runs."""

    def __init__(self, rule: Callable[[Column, Column, Column], Column]):
        self.rule = rule

    def answer(self, prompts: DataFrame) -> DataFrame:
        response = self.rule(F.col("step"), F.col("system"), F.col("user"))
        return prompts.select("key", response.alias("response"), F.lit(None).cast("string").alias("error"))


class CallableBackend:
    """Answers from ``call(system, user)``, which may be slow and may fail.

    A call is tried ``attempts`` times with ``delay`` seconds between; then its error is the answer's
    error, and only the articles that needed it fail.
    """

    def __init__(self, call: Callable[[str, str], str], attempts: int = 3, delay: float = 5.0):
        self.call, self.attempts, self.delay = call, attempts, delay

    def answer(self, prompts: DataFrame) -> DataFrame:
        call, attempts, delay = self.call, self.attempts, self.delay

        def one(system: str, user: str) -> tuple[str | None, str | None]:
            for left in reversed(range(attempts)):
                try:
                    return call(system, user), None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                    if left:
                        time.sleep(delay)
            return None, error

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                got = [one(s, u) for s, u in zip(batch["system"], batch["user"])]
                yield pd.DataFrame({"key": batch["key"], "response": [g[0] for g in got], "error": [g[1] for g in got]})

        return prompts.select("key", "system", "user").mapInPandas(run, ANSWERS)


class AsyncBackend(CallableBackend):
    """The same with a coroutine function, ``width`` calls at a time in each task."""

    def __init__(self, call: Callable[[str, str], Awaitable[str]], attempts: int = 3, delay: float = 5.0, width: int = 8):
        super().__init__(call, attempts, delay)
        self.width = width

    def answer(self, prompts: DataFrame) -> DataFrame:
        call, attempts, delay, width = self.call, self.attempts, self.delay, self.width

        async def one(gate: asyncio.Semaphore, system: str, user: str) -> tuple[str | None, str | None]:
            error = None
            for left in reversed(range(attempts)):
                try:
                    async with gate:
                        return await call(system, user), None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                    if left:
                        await asyncio.sleep(delay)
            return None, error

        async def all_of(batch: pd.DataFrame) -> list:
            gate = asyncio.Semaphore(width)
            return await asyncio.gather(*(one(gate, s, u) for s, u in zip(batch["system"], batch["user"])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                got = asyncio.run(all_of(batch))
                yield pd.DataFrame({"key": batch["key"], "response": [g[0] for g in got], "error": [g[1] for g in got]})

        return prompts.select("key", "system", "user").mapInPandas(run, ANSWERS)


def chat(service: Service) -> Callable[[str, str], str]:
    """``call(system, user)`` to a chat service that speaks the usual HTTP form; a key is read from the environment of the worker."""

    def call(system: str, user: str) -> str:
        body = {"model": service.model, "temperature": service.temperature, "max_tokens": service.max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        key = os.environ.get(service.key_variable, "")
        request = urllib.request.Request(service.url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        with urllib.request.urlopen(request, timeout=service.timeout_s) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    return call


def backend(spark: SparkSession, cfg: Config, answers: str | None = None, rule=None) -> Backend:
    """The backend that the settings name: ``replay`` of a table, ``rule``, or a service, one call or ``width`` at a time."""
    kind = cfg.service.kind
    if kind == "replay":
        return ReplayBackend(spark.read.parquet(answers))
    if kind == "rule":
        return RuleBackend(rule)
    call = chat(cfg.service)
    if kind == "http":
        return CallableBackend(call, cfg.model_attempts, cfg.model_delay_s)
    if kind == "http-async":

        async def later(system: str, user: str) -> str:
            return await asyncio.to_thread(call, system, user)

        return AsyncBackend(later, cfg.model_attempts, cfg.model_delay_s, cfg.service.width)
    raise ValueError(f"no backend {kind}")


class Store:
    """Answers kept in a parquet folder ``(key, step, response)``, from which a later run takes them.

    Only answers are kept, not failures, which are tried again. A key that was written twice by runs that were
    broken off counts once.
    """

    def __init__(self, path: str):
        self.path = path

    def read(self, spark: SparkSession) -> DataFrame:
        rows = written(spark, self.path, "key string, step string, response string")
        return rows.groupBy("key").agg(F.max("response").alias("response"))

    def append(self, answers: DataFrame, step: str) -> None:
        answers.filter("error is null and response is not null").select("key", F.lit(step).alias("step"), "response").write.mode("append").parquet(self.path)


def ask(rows: DataFrame, step: str, system: str, user: Column, backend: Backend, store: Store | None = None) -> DataFrame:
    """``rows`` with ``response`` and ``error``; equal prompts are asked once, and those in the store not at all."""
    rows = rows.withColumn("user", user)
    keyed = materialise(rows.withColumn("key", prompt_key(F.lit(system), F.col("user"))), f"prompts-{step}")
    prompts = keyed.select("key", "user").dropDuplicates(["key"]).select("key", F.lit(step).alias("step"), F.lit(system).alias("system"), "user")
    if store is None:
        answers = materialise(backend.answer(prompts).select("key", "response", "error"), f"answers-{step}")
    else:
        known = materialise(prompts.select("key").join(store.read(rows.sparkSession), "key"), f"known-{step}")
        new = materialise(backend.answer(prompts.join(known, "key", "left_anti")).select("key", "response", "error"), f"answers-{step}")
        store.append(new, step)
        answers = new.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    return keyed.join(answers, "key", "left").drop("key", "user")
