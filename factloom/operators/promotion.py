"""Promotion of pending facts: the latest of a key wins, observed and stated facts at once, inferences after a session has been quiet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config


def promote(pending: DataFrame, now: float, ttl: float = Config.promotion_ttl) -> DataFrame:
    """The pending rows with their new status.

    Of provisional rows with the same (type, target, session) all but the latest are retracted, whatever their source; then observed and
    user-stated ones are promoted, and inferences of sessions whose last provisional inference is older than ``ttl``.
    Passing the result in again with the same clock changes nothing.
    """
    open_ = F.col("status") == "provisional"
    key = ["_type", "_target", "_session"]  # null keys are equal to each other
    named = {k: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit("n")) for k, c in zip(key, ("type", "target", "session_id"))}
    marked = pending.withColumns(named)
    moment = F.struct("updated_at", "row_seq")
    best = marked.where(open_).groupBy(*key).agg(F.max(moment).alias("_best"))  # combined before the shuffle: no hot session
    x = marked.join(best, key, "left")
    x = x.withColumn("status", F.when(open_ & (moment < F.col("_best")), "retracted").otherwise(F.col("status"))).drop("_best")
    inferred = open_ & (F.col("source") == "agent_inference")
    last = x.where(inferred).groupBy("_session").agg(F.max("updated_at").alias("_last"))
    x = x.join(last, "_session", "left")
    due = open_ & (F.col("source").isin("observed", "user_stated") | (inferred & (F.col("_last") < now - ttl)))
    return x.withColumn("status", F.when(due, "promoted").otherwise(F.col("status"))).drop("_last").select(*pending.columns)


def promoted_facts(pending: DataFrame) -> DataFrame:
    """Facts made of promoted rows; ids are hashes of the rows' ids, so a repeated batch makes the same facts."""
    x = pending.where("status = 'promoted'")
    return x.select(F.sha2(F.col("id").cast("string"), 256).alias("id"), "content", "type", "target", F.lit(1.0).alias("metabolic_rate"), F.lit(0.5).alias("importance"), F.col("updated_at").alias("created_at"))


def metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counters of a pass by (session, source): promoted and retracted rows."""
    x = before.select("id", F.col("status").alias("was")).join(after, "id").where("was <> status")
    return x.groupBy("session_id", "source").agg(*[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("promoted", "retracted")])


def add_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("session_id", "source").agg(F.sum("promoted").alias("promoted"), F.sum("retracted").alias("retracted"))


def listing(pending: DataFrame, session=None, source=None, status=None, limit: int = 50) -> DataFrame:
    x = pending
    for name, value in (("session_id", session), ("source", source), ("status", status)):
        if value is not None:
            x = x.where(F.col(name) == value)
    return x.orderBy("session_id", F.desc("updated_at"), "row_seq").limit(limit)


def as_json(pending: DataFrame, **options) -> DataFrame:
    """(json): the rows of :func:`listing` as one object with their number."""
    rows = listing(pending, **options)
    place = F.struct("session_id", (-F.col("updated_at")).alias("at"), "row_seq", F.struct(*[F.col(c) for c in pending.columns]).alias("row"))
    return rows.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(place)), lambda p: p["row"]).alias("pending"), F.count("*").alias("count"))).alias("json"))  # as many as the limit


def summary(pending: DataFrame) -> DataFrame:
    return pending.groupBy("status", "source").agg(F.count("*").alias("n"))


def decide(pending: DataFrame, row_id, status: str) -> DataFrame:
    """Retract or promote one provisional row by hand."""
    return pending.withColumn("status", F.when((F.col("id") == row_id) & (F.col("status") == "provisional"), status).otherwise(F.col("status")))
