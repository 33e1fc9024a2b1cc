"""Queue messages, leases and sessions as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.session import scratch

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: What a queue message must hold.
TASKS = ("paper_parse", "chart_only_run")


def event_stream(spark: SparkSession, sf_dir: str, files: int = 100) -> DataFrame:
    """The events table as a stream; watermarks need a zoned timestamp."""
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(out: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all that is there, into Parquet in the shared folder, and read it."""
    spark = out.sparkSession
    path = scratch(spark, "stream")
    q = out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def split_messages(messages: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good, dead): messages that are valid JSON of a known task and version, and the others with the reason."""
    m = messages.withColumn("json", F.try_parse_json(payload))
    get = lambda p, t: F.try_variant_get("json", p, t)
    reason = (
        F.when(F.col("json").isNull(), "bad_json")
        .when(~F.coalesce(get("$.task_type", "string").isin(*TASKS), F.lit(False)), "unknown_task")
        .when(~F.coalesce(get("$.schema_version", "int").isin(1, 2), F.lit(False)), "unknown_version")
        .when(get("$.job_id", "bigint").isNull() & get("$.paper_id", "bigint").isNull(), "no_target")
    )
    m = m.withColumn("reason", reason)
    good = m.filter("reason is null").withColumns({"task_type": get("$.task_type", "string"), "job_id": get("$.job_id", "bigint"), "paper_id": get("$.paper_id", "bigint")}).drop("json", "reason")
    return good, m.filter("reason is not null").drop("json")


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Closed sessions per user: events no further apart than the gap; late ones are dropped after the watermark."""
    w = F.session_window("ts", gap)
    g = events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", "first_event")


LEASE_OUT = "user_id bigint, event_id bigint, generation bigint, outcome string"


def lease(events: DataFrame, seconds: int = 900, claim: str = "view", done: str = "purchase") -> DataFrame:
    """One lease for each user: a claim succeeds if none is held or the last one ran out, and raises the generation.

    Other events renew a held lease; `done` releases it; without one they are fenced off. A group's rows
    are taken in the order of their times, so a replay gives the same outcomes.
    """

    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until, generation = state.get if state.exists else (-1, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["us", "event_id"]).itertuples():
            held = until > r.us
            if r.event_type == claim:
                outcome = "busy" if held else "claimed"
                if not held:
                    generation, until = generation + 1, r.us + seconds * 1_000_000
            elif not held:
                outcome = "fenced"
            elif r.event_type == done:
                outcome, until = "released", -1
            else:
                outcome, until = "renewed", r.us + seconds * 1_000_000
            out.append((key[0], r.event_id, generation, outcome))
        state.update((until, generation))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "generation", "outcome"])

    e = events.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("us"))
    return e.groupBy("user_id").applyInPandasWithState(run, LEASE_OUT, "until bigint, generation bigint", "append", GroupStateTimeout.NoTimeout)


COMMANDS = "job_id bigint, seq bigint, us bigint, op string, worker string, generation bigint"
COMMAND_OUT = "job_id bigint, seq bigint, op string, ok boolean, status string, generation bigint"


def job_commands(commands: DataFrame, seconds: int = 900) -> DataFrame:
    """claim, renew, complete, fail and retry commands on jobs, fenced by owner and generation.

    A claim needs a pending job, or one whose lease ran out; it raises the generation. Renewals and
    terminal writes need the claim's worker and generation. retry reopens a failed job. What a stale
    worker sends changes nothing.
    """

    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, owner, generation, until = state.get if state.exists else ("pending", "", 0, -1)
        out = []
        for c in pd.concat(list(rows)).sort_values(["us", "seq"]).itertuples():
            owns = status == "processing" and owner == c.worker and generation == c.generation
            if c.op == "claim":
                ok = status == "pending" or (status == "processing" and until <= c.us)
                if ok:
                    status, owner, generation, until = "processing", c.worker, generation + 1, c.us + seconds * 1_000_000
            elif c.op == "renew":
                ok = owns
                until = c.us + seconds * 1_000_000 if ok else until
            elif c.op in ("complete", "fail"):
                ok = owns
                status = {"complete": "succeeded", "fail": "failed"}[c.op] if ok else status
            else:
                ok = c.op == "retry" and status == "failed"
                status = "pending" if ok else status
            out.append((key[0], c.seq, c.op, ok, status, generation))
        state.update((status, owner, generation, until))
        yield pd.DataFrame(out, columns=["job_id", "seq", "op", "ok", "status", "generation"])

    return commands.groupBy("job_id").applyInPandasWithState(run, COMMAND_OUT, "status string, owner string, generation bigint, until bigint", "append", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame) -> DataFrame:
    """Running counts per user."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
