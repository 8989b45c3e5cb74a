"""Reranking: a pool of the best rows, a scorer over (query, text) pairs in Arrow batches, and new ranks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.fusion import reranked


def overlap_scorer(query: str) -> Callable[[pd.Series], pd.Series]:
    """A stand-in for a cross-encoder: the logit grows with the share of query words in the first 512 characters."""
    wanted = set(re.findall(r"\w+", query.lower()))

    def score(texts: pd.Series) -> pd.Series:
        shares = [len(wanted & set(re.findall(r"\w+", (t or "")[:512].lower()))) / max(1, len(wanted)) for t in texts]
        return pd.Series(8.0 * np.array(shares) - 4.0)

    return score


def rerank(results: DataFrame, scorer: Callable[[pd.Series], pd.Series], pool: int = 50, k: int = 5, least: float = 0.0, id_col: str = "id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The k rows of highest confidence, sigmoid of the scorer's logit, among the pool of best rows."""
    best = results.orderBy(F.desc(score_col), id_col).limit(pool)
    scored = best.withColumn("confidence", 1.0 / (1.0 + F.exp(-F.pandas_udf(scorer, "double")(F.col(text_col)))))
    top = scored.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), id_col).limit(k)
    return reranked(top, F.desc("confidence"), F.col(id_col))
