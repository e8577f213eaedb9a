"""Contextual bandit: sufficient statistics by aggregation, the 8 x 8 solve on a row per arm."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statistics(x: DataFrame, features: list[str]) -> DataFrame:
    """(arm, i, j, a) of the sums of products and, with j = -1, of the rewards; sums of parts add up."""
    n = len(features)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(features[i]) * F.col(features[j])).alias("v")) for i in range(n) for j in range(n)]
    cells += [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), (F.col(features[i]) * F.col("reward")).alias("v")) for i in range(n)]
    return x.select("arm", F.inline(F.array(*cells))).groupBy("arm", "i", "j").agg(F.sum("v").alias("a"))


def solve(stats: DataFrame, n: int, alpha: float = 1.0) -> DataFrame:
    """(arm, theta, bonus): weights of each arm and the exploration bonus of a vector of ones."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        a, b = np.eye(n), np.zeros(n)
        for i, j, v in zip(g.i, g.j, g.a):
            if j < 0:
                b[i] += v
            else:
                a[i, j] += v
        x = np.ones(n)
        return pd.DataFrame({"arm": [g.arm.iloc[0]], "theta": [np.linalg.solve(a, b).tolist()], "bonus": [float(alpha * np.sqrt(x @ np.linalg.solve(a, x)))]})

    return stats.groupBy("arm").applyInPandas(one, "arm string, theta array<double>, bonus double")


def decide(x: DataFrame, solved: DataFrame, features: list[str], run: str, skip: str) -> DataFrame:
    """Rows of features with ``runs``: whether the arm ``run`` promises at least what ``skip`` does. ``solved`` has a row per arm."""
    arms = {r["arm"]: r["theta"] for r in solved.where(F.col("arm").isin(run, skip)).select("arm", "theta").collect()}  # two rows
    def promise(arm: str):
        return sum((F.col(f) * w for f, w in zip(features, arms.get(arm, [0.0] * len(features)))), F.lit(0.0))

    return x.withColumn("runs", promise(run) >= promise(skip))
