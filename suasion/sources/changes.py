"""The page-change source: mutation records of pages as a stream over files.

Files of records (JSON lines or Parquet) are put into a folder whole; Spark's file source lists them, keeps which ones
each batch took in the query's checkpoint, and reads a lost batch again. A record says what became of one element:

* ``insert``, ``remove``, ``show``, ``hide``, ``text``: element at ``path``, with its text and whether it looks like a
  modal (``modal``: it shows and is a dialog, or covers the page; ``dialog``: by attributes alone; ``empty``: nothing in
  it to read or press, so a mere backdrop);
* ``gesture``, ``exit``: what the shopper did;
* ``recording``: from here on, texts and insertions may be kept (the page is a shop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("insert", "remove", "show", "hide", "text", "gesture", "exit", "recording")
CHANGES = "page_id long, ts timestamp, seq long, kind string, path string, text string, modal boolean, dialog boolean, empty boolean"


def page_changes(spark: SparkSession, folder: str, form: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """The stream of well-formed records of all files in ``folder``, of those there now and of those to come."""
    reader = spark.readStream.schema(CHANGES).format(form)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return well_formed(reader.load(folder))


def well_formed(records: DataFrame) -> DataFrame:
    """Records with a page, a time and a known kind; flags that are not said are false, and so is a path that is not said empty."""
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("modal", "dialog", "empty")]
    known = F.col("page_id").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*KINDS)
    return records.filter(known).select("page_id", "ts", F.coalesce("seq", F.lit(0)).alias("seq"), "kind", F.coalesce("path", F.lit("")).alias("path"), "text", *flags)
