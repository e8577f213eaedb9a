"""TF-IDF vectors with a frozen vocabulary, as long rows (id, token, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def tfidf(docs: DataFrame) -> DataFrame:
    """Weights (1 + ln tf) * ln(1 + N / df) with unit length, of (id, text) rows."""
    counts = docs.select("id", F.explode(T.vector_tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    raw = counts.join(df, "token").crossJoin(n).withColumn("w", (1.0 + F.ln("tf")) * F.ln(1.0 + F.col("n") / F.col("df")))
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, "id").select("id", "token", (F.col("w") / F.col("length")).alias("weight"))


def embed_text(target: str = "target", content: str = "content"):
    """What is embedded of a fact: its target's words, then its content."""
    return F.concat_ws(" ", F.when(F.col(target) != "general", F.translate(F.col(target), "._-", "   ")), F.col(content))
