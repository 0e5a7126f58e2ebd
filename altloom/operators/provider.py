"""Calls to caption providers: one per content, in order of a chain.

A provider is a callable ``(image_hash, prompt) -> dict`` with ``status`` (ok,
degraded or fail), ``text`` and optional ``reason``, ``status_code``,
``seconds``, ``cost``, ``tokens``, ``model``. A factory makes it once per task,
so clients and connections are opened where they are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from altloom.session import materialize

Provider = Callable[[str, str], dict]

ATTEMPT = (
    "array<struct<provider:string,model:string,success:boolean,status_code:int,error:string,seconds:double,cost:double,tokens:int>>"
)
RESULT = f"content_key string, text string, status string, provider string, attempts {ATTEMPT}"
MOST_ATTEMPTS = 3


def call_chain(chain: list[tuple[str, Provider]], image_hash: str, prompt: str, most: int) -> dict:
    """Try the chain until a usable answer; keep a record of every try."""
    attempts = []
    for name, provider in chain[:most]:
        try:
            answer = provider(image_hash, prompt) or {}
        except Exception as problem:  # a provider may fail in any way
            answer = {"status": "fail", "reason": str(problem)}
        status = answer.get("status", "fail")
        usable = status in ("ok", "degraded")
        attempts.append(
            {
                "provider": name, "model": answer.get("model", "unknown"), "success": status == "ok",
                "status_code": answer.get("status_code"), "error": None if usable else answer.get("reason", "No result returned"),
                "seconds": float(answer.get("seconds", 0.0)), "cost": float(answer.get("cost", 0.0)), "tokens": int(answer.get("tokens", 0)),
            }
        )
        if usable:
            return {"text": answer.get("text", ""), "status": status, "provider": name, "attempts": attempts}
    return {"text": None, "status": "fail", "provider": None, "attempts": attempts}


def generate_chain(
    requests: DataFrame, factories: list[tuple[str, Callable[[], Provider]]], most: int = MOST_ATTEMPTS
) -> DataFrame:
    """One result per content key, with its attempts, stored once.

    ``requests``: content_key, image_hash, prompt. Of several requests for one
    content the first by prompt is sent. Results are written out before use,
    so that no later step repeats a paid call.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = [(name, make()) for name, make in factories]
        for batch in batches:
            for key, image, prompt in zip(batch["content_key"], batch["image_hash"], batch["prompt"]):
                row = {"content_key": key, **call_chain(chain, image, prompt, most)}
                yield pd.DataFrame([row], columns=["content_key", "text", "status", "provider", "attempts"])

    single = requests.groupBy("content_key").agg(F.min(F.struct("prompt", "image_hash")).alias("r")).select(
        "content_key", "r.image_hash", "r.prompt"
    )
    return materialize(single.repartition("content_key").mapInPandas(call, RESULT))


def generate(requests: DataFrame, name: str, factory: Callable[[], Provider]) -> DataFrame:
    return generate_chain(requests, [(name, factory)], 1)


def recorded_chain(attempts: DataFrame, key: str, order: list[str], most: int = MOST_ATTEMPTS) -> DataFrame:
    """The chain of each content over recorded attempts, as a set operation.

    ``attempts`` holds ``key``, the columns of ``order``, ``provider``,
    ``success`` and ``cost``. A chain is its attempts in order up to the first
    success, ``most`` at most; only ``most`` rows of a content leave their task.
    A chain that had further attempts and no success within ``most`` is marked
    as cut.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    seen = attempts.select(key, "provider", "success", "cost", turn.alias("turn")).filter(F.col("turn") <= most + 1)
    first = F.min(F.when(F.col("success") & (F.col("turn") <= most), F.col("turn")))
    ended = seen.groupBy(key).agg(first.alias("won"), F.max("turn").alias("last"), F.array_sort(F.collect_list(F.struct("turn", "provider", "cost"))).alias("tried"))
    used = F.slice("tried", 1, F.coalesce("won", F.least("last", F.lit(most))))
    return ended.select(
        key, F.when(F.col("won").isNotNull(), F.element_at(used, -1)["provider"]).alias("provider"),
        F.when(F.col("won").isNotNull(), "ok").otherwise("fail").alias("status"), F.size(used).alias("attempts"),
        F.aggregate(used, F.lit(0.0), lambda total, t: total + t["cost"]).alias("cost"),
        (F.col("won").isNull() & (F.col("last") > most)).alias("cut"),
    )


def recorded_attempts(chains: DataFrame, attempts: DataFrame, key: str, order: list[str], most: int = MOST_ATTEMPTS) -> DataFrame:
    """The attempts that belong to a chain, those after its end left out."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ends = chains.select(key, F.col("attempts").alias("__ends"))
    return attempts.withColumn("turn", turn).filter(F.col("turn") <= most).join(ends, key).filter(F.col("turn") <= F.col("__ends")).drop("__ends")


def attempt_rows(results: DataFrame) -> DataFrame:
    """Attempts as a table of their own."""
    return results.select("content_key", F.posexplode("attempts").alias("attempt", "a")).select("content_key", "attempt", "a.*")


def with_results(elements: DataFrame, results: DataFrame) -> DataFrame:
    """Results back on every element with the content."""
    return elements.join(results.select("content_key", "text", "status", "provider"), "content_key", "left")
