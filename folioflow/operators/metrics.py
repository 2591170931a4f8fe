"""What extraction saves: tokens of the raw bytes in base64 against tokens of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def savings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, base64_tokens, text_tokens, saved_pct.  Base64 is ASCII of known length: it is never built."""
    b = F.floor(4 * F.ceil(F.octet_length(text) / F.lit(3.0)) / 4 + 1).cast("long")
    t = X.est_tokens(F.col(text))
    sized = df.select(key, b.alias("base64_tokens"), t.alias("text_tokens"))
    saved = F.round(F.lit(100.0) * (F.col("base64_tokens") - F.col("text_tokens")) / F.greatest("base64_tokens", F.lit(1)), 1)
    return sized.withColumn("saved_pct", saved)
