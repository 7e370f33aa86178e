"""One spelling for the identifiers of review messages.

A message is named by its node id or by its decimal id, with stray white space around either.
``pull_review_comments`` pairs the two, one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Java pattern of outer white space, Unicode spaces included.
OUTER_SPACE = r"(?U)^\s+|\s+$"
DECIMAL = r"^[0-9]+$"


def trimmed(c: Column) -> Column:
    """``c`` without outer white space; null where nothing is left."""
    t = F.regexp_replace(c.cast("string"), OUTER_SPACE, "")
    return F.when(t != "", t)


def id_pairs(raw_comments: DataFrame) -> DataFrame:
    """(decimal_id, paired_node_id): one row per decimal id that the raw messages pair."""
    return (
        raw_comments.select(F.col("id").cast("string").alias("decimal_id"), trimmed(F.col("node_id")).alias("node"))
        .filter("decimal_id is not null and node is not null")
        .groupBy("decimal_id")
        .agg(F.min("node").alias("paired_node_id"))
    )


def with_message_key(df: DataFrame, id_col: str, pairs: DataFrame, out: str = "message_key") -> DataFrame:
    """Add ``out``: the node id of the message that ``id_col`` names.

    Decimal ids are looked up in ``pairs``; one that has no pair stays as it is, without leading
    zeros. Null or blank ids give null. Only the rows with a decimal id take part in the join.
    """
    clean = trimmed(F.col(id_col))
    base = df.withColumn("__clean", clean)
    is_dec = F.col("__clean").rlike(DECIMAL)
    dec = (
        base.filter(is_dec)
        .withColumn("__dec", F.regexp_replace("__clean", "^0+(?=[0-9])", ""))
        .join(pairs.select(F.col("decimal_id").alias("__dec"), F.col("paired_node_id").alias("__node")), "__dec", "left")
        .withColumn(out, F.coalesce("__node", "__dec"))
        .drop("__dec", "__node", "__clean")
    )
    rest = base.filter(~F.coalesce(is_dec, F.lit(False))).withColumn(out, F.col("__clean")).drop("__clean")
    return rest.unionByName(dec)
