"""Duplicates: content hash, contact components, newest-wins merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_content(resumes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per content hash (earliest, ties by id), without hashes already known."""
    once = resumes.groupBy("content_hash").agg(F.min_by(F.struct(*resumes.columns), F.struct("created_at", "id")).alias("r")).select("r.*")
    return once.join(known.select("content_hash"), "content_hash", "left_anti") if known is not None else once


def contact_links(contacts: DataFrame, key: str = "id") -> DataFrame:
    """Links (a, b) from each holder of a contact value (kind, value) to its least holder: a star per value, never all pairs."""
    least = contacts.groupBy("kind", "value").agg(F.min(key).alias("b"), F.count("*").alias("n")).where("n > 1")
    return contacts.join(least, ["kind", "value"]).where(F.col(key) != F.col("b")).select(F.col(key).alias("a"), "b").distinct()


def duplicate_masters(people: DataFrame) -> DataFrame:
    """id, master, matched_by of rows whose first e-mail, else first phone, an earlier row has among its own.

    ``people``: id, created_at, emails, phones (arrays of exact values). Earlier: by created_at, ties by id. The earliest
    holder of each value is found first, with sums combined in the map tasks, so a value that very many rows have stays cheap.
    """
    kinds = (("email", "emails"), ("phone", "phones"))
    held = [people.select("id", "created_at", F.lit(k).alias("kind"), F.explode(c).alias("value")) for k, c in kinds]
    first = held[0].unionByName(held[1]).where("value <> ''").groupBy("kind", "value").agg(F.min(F.struct("created_at", "id")).alias("first"))
    asked = people.select("id", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"))
    for k, _ in kinds:
        found = first.where(F.col("kind") == k).select(F.col("value").alias(k), F.col("first.id").alias(f"{k}_master"))
        asked = asked.join(found, k, "left")
    other = lambda k: F.when(F.col(f"{k}_master") != F.col("id"), F.col(f"{k}_master"))
    out = asked.select("id", F.coalesce(other("email"), other("phone")).alias("master"), F.when(other("email").isNotNull(), "email").otherwise("phone").alias("matched_by"))
    return out.where("master is not null")


def components(links: DataFrame, write) -> DataFrame:
    """(node, master): the least reachable node of each linked one. ``write`` stores a round's table in a shared folder and rereads it.

    Rounds go on until none changes a label; labels only fall, so that comes.
    """
    both = write(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = write(both.select(F.col("a").alias("node")).distinct().withColumn("master", F.col("node")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("master").alias("m"))
        hooked = labels.join(near, labels.node == near.a, "left").select("node", F.least("master", F.coalesce("m", "master")).alias("master"))
        up = labels.select(F.col("node").alias("master"), F.col("master").alias("up"))
        jumped = write(hooked.join(up, "master", "left").select("node", F.least("master", F.coalesce("up", "master")).alias("master"), F.col("master").alias("before")))
        moved = jumped.join(labels.withColumnRenamed("master", "old"), "node").where("master <> old").limit(1).count()
        labels = jumped.select("node", "master")
        if not moved:
            return labels


def merge_into_masters(resumes: DataFrame, masters: DataFrame) -> DataFrame:
    """Masters take the newest extraction and text of their component that has a name and a contact, and revive from error; the others become duplicates."""
    rows = resumes.join(masters.withColumnRenamed("node", "id"), "id", "left").withColumn("master", F.coalesce("master", "id"))
    usable = F.col("name").isNotNull() & (F.size(F.coalesce("contacts", F.array().cast("array<string>"))) > 0)
    newest = rows.where(usable).groupBy("master").agg(F.max_by(F.struct("extraction", "parsed_text"), F.struct("created_at", "id")).alias("new"))
    out = rows.join(newest, "master", "left")
    is_master = F.col("id") == F.col("master")
    take = lambda c: F.when(is_master & F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    keep = [c for c in resumes.columns if c not in ("extraction", "parsed_text", "status")]
    status = F.when(~is_master, "duplicate").when((F.col("status") == "error") & F.col("new").isNotNull(), "ready").otherwise(F.col("status")).alias("status")
    return out.select(*keep, take("extraction"), take("parsed_text"), status)
