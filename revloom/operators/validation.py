"""A second opinion on links of medium confidence, by a function the caller gives."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


def answer_of(raw: str | None) -> bool | None:
    """What a judge's text says: ``addresses`` of the JSON object in it; None if there is none."""
    text = raw or ""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        return None
    try:
        found = json.loads(text[start : end + 1])
    except ValueError:
        return None
    said = found.get("addresses") if isinstance(found, dict) else None
    return said if isinstance(said, bool) else None


def validate_medium(episodes: DataFrame, scorer: Callable[[str, str, str], str | bool | None]) -> DataFrame:
    """``episodes`` with medium links raised to high or lowered to low by ``scorer(comment, rejected, accepted)``.

    The scorer returns a truth value or a text with a JSON answer. Only medium links with accepted
    code are asked; one that fails or says nothing leaves its link as it was.
    """

    @F.pandas_udf(T.BooleanType())
    def judge(comment: pd.Series, rejected: pd.Series, accepted: pd.Series) -> pd.Series:
        out = []
        for row in zip(comment, rejected, accepted):
            try:
                said = scorer(*row)
                out.append(said if isinstance(said, bool) or said is None else answer_of(said))
            except Exception:  # noqa: BLE001
                out.append(None)
        return pd.Series(out, dtype="object")

    asked = (F.col("link_confidence") == "medium") & F.col("accepted").isNotNull()
    rest = episodes.filter(~F.coalesce(asked, F.lit(False)))
    judged = episodes.filter(asked).withColumn("__said", judge("comment_body", "rejected.text", "accepted.text"))
    label = F.when(F.col("__said"), "high").when(~F.col("__said"), "low").otherwise(F.col("link_confidence"))
    suffix = F.when(F.col("__said"), "+validated").when(~F.col("__said"), "+rejected_by_validation").otherwise("")
    changed = judged.withColumn("link_confidence", label).withColumn("link_reason", F.concat("link_reason", suffix)).drop("__said")
    return rest.unionByName(changed)
