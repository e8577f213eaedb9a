"""Import and export: training pairs, chat records, import of conversation memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def training_pairs(facts: DataFrame, interactions: DataFrame, q_threshold: float = 0.0, access_threshold: int = 1, limit: int | None = 1000) -> DataFrame:
    """(place, pair_type, input, output): a cross-context row for facts recalled in two scopes or more, a recall row for each interaction, and a
    completion row where a store followed; in order of facts, then of interactions. ``limit`` is the export's size."""
    f = facts.where((F.col("q_value") >= q_threshold) & (F.col("access_count") >= access_threshold)).select(F.col("id").alias("fid"), "content", F.col("row_seq").alias("fact_seq"))
    x = interactions.select("ix", "query", "scope", "followed_by_store", F.posexplode("recalled_ids").alias("pos", "fid")).join(f, "fid")
    named = F.col("scope").isNotNull() & (F.col("scope") != "")
    parts = F.transform(F.array_sort(F.collect_list(F.when(named, F.struct("ix", "pos", F.concat(F.lit("["), F.col("scope"), F.lit("] "), F.col("query"), F.lit(" → "), F.col("content")).alias("text"))))), lambda s: s["text"])
    cross = x.groupBy("fid", "fact_seq", "content").agg(F.count_distinct(F.when(named, F.col("scope"))).alias("n"), F.array_join(parts, " | ").alias("input")).where("n >= 2")
    cross = cross.select("fact_seq", F.lit(-1).cast("long").alias("ix"), F.lit(0).alias("pos"), F.lit(0).alias("part"), F.lit("cross_context").alias("pair_type"), "input", F.col("content").alias("output"))
    recall = x.select("fact_seq", "ix", "pos", F.lit(1).alias("part"), F.lit("fact_recall").alias("pair_type"), F.col("query").alias("input"), F.col("content").alias("output"))
    done = x.where("followed_by_store").select("fact_seq", "ix", "pos", F.lit(2).alias("part"), F.lit("task_completion").alias("pair_type"), F.col("query").alias("input"), F.col("content").alias("output"))
    out = cross.union(recall).union(done)
    order = ["fact_seq", "ix", "pos", "part"]
    return out.orderBy(*order).limit(limit) if limit is not None else out.orderBy(*order)


def chat_records(pairs: DataFrame, system: str = "You are a helpful assistant with long-term memory.") -> DataFrame:
    """(messages): the pairs as chat messages, ready for ``write.json``."""
    def say(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return pairs.select(F.array(say("system", F.lit(system)), say("user", F.col("input")), say("assistant", F.col("output"))).alias("messages"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def import_conclusions(conclusions: DataFrame, limit: int = 2000) -> DataFrame:
    """Facts of (row_seq, content, session_id): the first ``limit`` rows, without blank ones. The limit is part of the import."""
    x = conclusions.orderBy("row_seq").limit(limit).withColumn("content", T.strip(F.col("content"))).where("content <> ''")
    return x.select("row_seq", "content", T.safe_scope(F.col("session_id")).alias("scope"), F.lit("factual").alias("category"), F.lit(0.8).alias("importance"))


def import_messages(messages: DataFrame, user: str, with_assistant: bool = False, limit: int | None = 2000) -> DataFrame:
    """Facts of (row_seq, content, peer_id, session_id): each (peer, content, session) once, the user's or everyone's."""
    x = messages.orderBy("row_seq").limit(limit) if limit is not None else messages
    x = x.withColumn("content", T.strip(F.col("content"))).where("content <> ''")
    if not with_assistant:
        x = x.where(F.col("peer_id") == user)
    first = Window.partitionBy(F.coalesce("peer_id", F.lit("")), "content", "session_id").orderBy("row_seq")
    x = x.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    text = F.when(F.col("peer_id") == user, F.col("content")).otherwise(F.concat(F.lit("Assistant memory from imported session: "), F.col("content")))
    return x.select("row_seq", text.alias("content"), T.safe_scope(F.col("session_id")).alias("scope"), F.lit("factual").alias("category"), F.lit(0.45).alias("importance"))


def source_config(raw: DataFrame, host: str, fallback: dict[str, str]) -> DataFrame:
    """Settings from (json): the host's own block, then the common ones, then the fallback."""
    block = F.from_json("json", f"base_url string, api_key string, hosts map<string,struct<base_url:string,api_key:string>>")
    x = raw.withColumn("j", block)
    own = F.try_element_at(F.col("j.hosts"), F.lit(host))
    return x.select(*[F.coalesce(own[n], F.col(f"j.{n}"), F.lit(fallback.get(n))).alias(n) for n in ("base_url", "api_key")])
