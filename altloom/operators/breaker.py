"""Circuit breakers in set form: every change of state of every provider without a loop over its calls.

A closed breaker opens when ``threshold`` calls in a row fail. An open one lets
no call count until ``recovery`` seconds after the failure that opened it. The
first call that counts finds it half open: ``good`` successes in a row close
it, a failure opens it again.

What follows an opening depends on the opening alone: the first call that
counts, the first failure from there on, and else the close and the first
streak after it. So each failure has one successor, the opening that would come
next if it were one itself, and the true openings are those that successors
lead to from a provider's first one. They are found by doubling: after k rounds
the first 2 ** k openings are known. Everything is joins and running values on
(provider, number of the call), so a provider with a third of all calls is
spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altloom.operators.ordered import streaks
from altloom.operators.prefix import numbered, with_running
from altloom.session import materialize

CALL = ["provider", "idx"]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def calls_in_order(attempts: DataFrame, threshold: int) -> DataFrame:
    """Numbered calls, each with the next failure and the next full streak at or after it."""
    base = numbered(streaks(attempts), ["provider"], ["ts", "attempt_id"], "idx").withColumn("__back", -F.col("idx"))
    nearest = {
        "next_failure": ("last", F.when(~F.col("success"), F.col("idx"))),
        "next_streak": ("last", F.when(F.col("streak") == threshold, F.col("idx"))),
    }
    return materialize(with_running(base, ["provider"], ["__back"], nearest).drop("__back"))


def first_counted(calls: DataFrame, recovery: float) -> DataFrame:
    """(provider, idx, counted): of every failure the first call that would count after it, null if none has come."""
    wait = int(recovery * 1_000_000)
    seen = calls.select("provider", (-micros(F.col("ts"))).alias("__at"), F.lit(0).alias("side"), (-F.col("idx")).alias("__back"), F.col("idx").alias("call"))
    asked = calls.filter("NOT success").select(
        "provider", (-micros(F.col("ts")) - wait).alias("__at"), F.lit(1).alias("side"), (-F.col("idx")).alias("__back"), F.lit(None).cast("bigint").alias("call")
    )
    both = with_running(seen.unionByName(asked), ["provider"], ["__at", "side", "__back"], {"counted": ("last", F.col("call"))})
    found = both.filter("side = 1").select("provider", (-F.col("__back")).alias("idx"), "counted")
    return found.withColumn("counted", F.greatest("counted", F.when(F.col("counted").isNotNull(), F.col("idx") + 1)))


def successors(calls: DataFrame, recovery: float, good: int) -> DataFrame:
    """Of every failure, if it opened the breaker: the first counted call, the close or else the opening in half-open state, and the next opening."""
    def at(name: str, *columns: str) -> DataFrame:
        return calls.select("provider", F.col("idx").alias(name), *columns)

    met = first_counted(calls, recovery).join(at("counted", "next_failure"), ["provider", "counted"], "left")
    again = F.when(F.col("next_failure") < F.col("counted") + good, F.col("next_failure"))
    met = met.withColumn("again", again).withColumn("close", F.when(F.col("again").isNull(), F.col("counted") + good - 1)).drop("next_failure")
    met = met.join(at("close", "next_streak").withColumn("__closed", F.lit(True)), ["provider", "close"], "left")
    close = F.when(F.col("__closed"), F.col("close"))
    return met.select("provider", "idx", "counted", "again", close.alias("close"), F.coalesce("again", "next_streak").alias("next"))


def openings(calls: DataFrame, following: DataFrame) -> DataFrame:
    """(provider, idx) of the true openings, by doubling."""
    jump = materialize(following.filter("next IS NOT NULL").select("provider", "idx", "next"))
    reached = materialize(calls.filter("idx = 1 AND next_streak IS NOT NULL").select("provider", F.col("next_streak").alias("idx")))
    while True:
        more = materialize(reached.join(jump, CALL).select("provider", F.col("next").alias("idx")))
        if more.isEmpty():
            return reached
        reached = materialize(reached.unionByName(more))
        onward = jump.select("provider", F.col("idx").alias("next"), F.col("next").alias("__then"))
        jump = materialize(jump.join(onward, ["provider", "next"]).select("provider", "idx", F.col("__then").alias("next")))


def histories(attempts: DataFrame, threshold: int, recovery: float, good: int) -> tuple[DataFrame, DataFrame]:
    """(calls in order, true openings with what follows each)."""
    calls = calls_in_order(attempts.select("provider", "ts", "attempt_id", "success"), threshold)
    following = materialize(successors(calls, recovery, good))
    return calls, materialize(openings(calls, following).join(following, CALL))


def changes(calls: DataFrame, opened: DataFrame, good: int) -> DataFrame:
    """provider, ts, attempt_id, state and reason of every change of state."""
    def row(at: str, state: str, reason: str) -> list[Column]:
        return ["provider", F.col(at).alias("idx"), F.lit(state).alias("state"), F.lit(reason).alias("reason")]

    first = calls.filter("idx = 1 AND next_streak IS NOT NULL")
    told = first.select(*row("next_streak", "open", "closed to open"))
    for part, at, state, reason in (
        ("close IS NOT NULL AND next IS NOT NULL", "next", "open", "closed to open"),
        ("again > counted", "again", "open", "half_open to open"),
        (f"counted IS NOT NULL AND (again IS NULL OR again > counted) AND {good} > 1", "counted", "half_open", "open to half_open"),
        ("close IS NOT NULL", "close", "closed", "half_open to closed" if good > 1 else "open to closed"),
    ):
        told = told.unionByName(opened.filter(part).select(*row(at, state, reason)))
    return calls.select(*CALL, "ts", "attempt_id").join(told, CALL).select("provider", "ts", "attempt_id", "state", "reason")


def breaker_changes(attempts: DataFrame, threshold: int = 5, recovery: float = 60.0, good: int = 2) -> DataFrame:
    """Every change of state of every provider's breaker, by the time of its calls."""
    calls, opened = histories(attempts, threshold, recovery, good)
    return changes(calls, opened, good)


def state_after(calls: DataFrame, opened: DataFrame) -> DataFrame:
    """provider, state, failures, successes, since (of the failure that opened it) and at (the last call), a row per provider."""
    last_opening = opened.groupBy("provider").agg(F.max_by(F.struct("idx", "counted", "close"), "idx").alias("o"))
    ends = calls.groupBy("provider").agg(F.max_by(F.struct("idx", "ts", "streak"), "idx").alias("e"))
    since = calls.select("provider", F.col("idx").alias("__idx"), F.col("ts").alias("since"))
    met = ends.join(last_opening, "provider", "left").withColumn("__idx", F.col("o.idx")).join(since, ["provider", "__idx"], "left")
    closed = F.col("o").isNull() | F.col("o.close").isNotNull()
    state = F.when(closed, "closed").when(F.col("o.counted").isNull(), "open").otherwise("half_open")
    return met.select(
        "provider", state.alias("state"), F.when(closed, F.col("e.streak")).otherwise(0).alias("failures"),
        F.when(state == "half_open", F.col("e.idx") - F.col("o.counted") + 1).otherwise(0).alias("successes"),
        F.when(~closed, F.col("since")).alias("since"), F.col("e.ts").alias("at"),
    )


def recalled(states: DataFrame, threshold: int, recovery: float) -> DataFrame:
    """Calls that bring a new breaker into each provider's state; their ids are below zero."""
    failed = F.when(F.col("state") == "closed", F.col("failures")).otherwise(threshold).cast("int")
    total = (failed + F.col("successes")).cast("int")
    each = states.filter(total > 0).withColumn("__total", total).withColumn("__failed", failed).withColumn("__k", F.explode(F.sequence(F.lit(1), "__total")))
    success = F.col("__k") > F.col("__failed")
    start = F.coalesce("since", "at")
    after = F.timestamp_micros(micros(start) + int(recovery * 1_000_000)).cast(states.schema["at"].dataType)
    return each.select("provider", F.when(success, after).otherwise(start).alias("ts"), (F.col("__k") - F.col("__total") - 1).cast("bigint").alias("attempt_id"), success.alias("success"))
