"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of characters that are not ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII letters, digits and everything beyond ASCII, before lower-casing A-Z.
ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is: lower() serves where the text is ASCII, translate() elsewhere."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, pattern: str) -> Column:
    """Array of the pattern's matches; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def text_bytes(docs: DataFrame, *keys: str) -> DataFrame:
    """`keys` and the UTF-8 bytes of text (null stays null), in Arrow batches of bounded row count."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs.select(*keys, F.col("text").cast("binary").alias("text"))
