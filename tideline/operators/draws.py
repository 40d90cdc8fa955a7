"""Random draws that any engine repeats: numbers from a digest of their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """A number of 32 bits from the digest of the parts' texts, joined by bars."""
    texts = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The same in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"
