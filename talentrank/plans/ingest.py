"""The ingestion batch: files to searchable records. The stream runs the same function per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_broken, prepare_hebrew
from ..operators import dedup, extraction
from ..operators.quality_report import next_status
from ..sources import files


def ingest_batch(found: DataFrame, known: DataFrame, now: Column, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """New files (one record per content hash that is not known) with text, deterministic extraction, master and status.

    A record whose first e-mail, else first phone, an earlier one of the batch or of ``known`` has is its duplicate; ``known``
    needs ``id``, ``created_at``, ``emails`` and ``phones`` beside ``content_hash`` for that. ``parsers``: text of bytes by extension.
    """
    once = found.groupBy("content_hash").agg(F.min_by(F.struct(*[c for c in found.columns if c != "content_hash"]), "file_path").alias("f")).select("content_hash", "f.*")
    new = once.join(known.select("content_hash"), "content_hash", "left_anti")
    parsed = prepare_hebrew(files.parse(new, parsers).drop("content"), "parsed_text").withColumn("id", F.col("content_hash"))
    facts = extraction.extract(parsed)
    rows = parsed.join(facts, "id")
    valid = F.col("name").isNotNull() & (F.size(F.concat("emails", "phones")) > 0)
    error = F.when(is_broken(F.col("parsed_text")), "broken text").cast("string")
    rows = rows.withColumn("error", error).withColumn("created_at", now)
    people = rows.where("error is null").select("id", "created_at", "emails", "phones")
    if {"id", "created_at", "emails", "phones"} <= set(known.columns):
        people = people.unionByName(known.where("status <> 'error'").select(*people.columns) if "status" in known.columns else known.select(*people.columns))
    rows = rows.join(dedup.duplicate_masters(people).select("id", "master"), "id", "left")
    status = next_status(F.col("parsed_text"), F.col("master").isNotNull(), F.lit(False), valid, F.col("error"))
    return rows.withColumn("status", status).withColumn("error", F.coalesce("error", F.when(F.col("status") == "duplicate", F.concat(F.lit("Duplicate of Master ID "), "master"))))
