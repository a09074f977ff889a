"""Token quality of extracted text against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    token = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("token")
    return df.select(key, token).groupBy(key, "token").agg(F.count("*").alias(name))


def token_quality(found: DataFrame, truth: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, found, expected, common, recall, precision, f1) over case-folded words as multisets.

    Words are runs of letters and digits. A share of nothing is null. Keys of
    either side are kept; null texts have no words.
    """
    both = _counts(found, key, text, "a").join(_counts(truth, key, text, "b"), [key, "token"], "full")
    out = both.groupBy(key).agg(F.sum(F.coalesce("a", F.lit(0))).alias("found"), F.sum(F.coalesce("b", F.lit(0))).alias("expected"), F.sum(F.coalesce(F.least("a", F.when(F.col("b").isNotNull() & F.col("a").isNotNull(), F.col("b")).otherwise(F.lit(0))), F.lit(0))).alias("common"))
    share = lambda n, d: F.when(d > 0, n / d)
    return out.select(key, "found", "expected", "common", share(F.col("common"), F.col("expected")).alias("recall"), share(F.col("common"), F.col("found")).alias("precision"), share(2 * F.col("common"), F.col("found") + F.col("expected")).alias("f1"))
