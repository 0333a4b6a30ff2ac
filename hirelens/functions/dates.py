"""Mixed release dates to DATE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE_FORMATS = ["yyyy-MM-dd", "yyyy/M/d", "yyyy年M月d日", "MMMM d yyyy", "MMMM d, yyyy"]


def parse_dates(
    df: DataFrame, col: str, formats: list[str] | None = None, default_year: int | None = None, out: str = "released",
) -> DataFrame:
    """Add a DATE column; the first format that reads the text wins, an unread text gives NULL.

    "released on" and the ordinal ending of a day are removed first. A text without a year
    ("October 1st") is read only when `default_year` is given.
    """
    bare = F.regexp_replace(F.trim(F.col(col)), r"(?i)^released\s+on\s+", "")
    text = F.regexp_replace(bare, r"([0-9])(st|nd|rd|th)\b", "$1")
    tries: list[Column] = [F.try_to_date(F.col("_date_text"), f) for f in (formats or DATE_FORMATS)]
    if default_year is not None:
        tries.append(F.try_to_date(F.concat_ws(" ", F.col("_date_text"), F.lit(str(default_year))), "MMMM d yyyy"))
    return df.withColumn("_date_text", text).select(*df.columns, F.coalesce(*tries).alias(out))
