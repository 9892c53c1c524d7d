"""Detail of one line: linked records, citations, covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.shared import shares


def linked_records(values: DataFrame, generations: DataFrame, active: DataFrame) -> DataFrame:
    """Values of a line seen only through the active generation of their document."""
    live = generations.join(active.select("document_id", "generation"), ["document_id", "generation"], "left_semi")
    return values.join(live.select("document_id", "generation"), ["document_id", "generation"], "left_semi")


def citation_census(records: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: linked records, those whose page resolves, and those whose span is on that page."""
    seen = records.join(pages.select("document_id", "page", "body"), ["document_id", "page"], "left")
    resolved = F.col("body").isNotNull()
    on_page = F.coalesce(F.expr("instr(body, span) > 0"), F.lit(False))
    return seen.agg(F.count("*").alias("records"), F.sum(resolved.cast("long")).alias("resolved"), F.sum(on_page.cast("long")).alias("on_page"))


def identity_state(lines: DataFrame, entities: DataFrame, members: DataFrame) -> DataFrame:
    """(line_id, state): no_entity, entity_without_documents or linked.

    Entities meet the members before the lines do, so lines without one are never gathered under a null key; all sides
    are dealt in shares of a bounded number of rows.  ``lines`` and ``entities`` are counted: give them as written tables where they are dear.
    """
    named = entities.select("line_id", "entity_id")
    of_lines, of_entities = shares(lines), shares(named)
    known = named.where("entity_id is not null").repartition(of_entities, "entity_id")
    held = members.where("entity_id is not null").select("entity_id").repartition(of_entities, "entity_id").distinct().withColumn("state", F.lit("linked"))
    settled = known.join(held, "entity_id", "left").select("line_id", F.coalesce("state", F.lit("entity_without_documents")).alias("state"))
    settled = settled.unionByName(named.where("entity_id is null").select("line_id", F.lit("no_entity").alias("state")))
    joined = lines.select("line_id").repartition(of_lines, "line_id").join(settled.repartition(of_lines, "line_id"), "line_id", "left")
    return joined.select("line_id", F.coalesce("state", F.lit("no_entity")).alias("state"))


def reconciled(rows: DataFrame, fitted: str, derived: str) -> DataFrame:
    """``rows`` with a covariate shown only where the derived value is the one the fit used."""
    same = F.col(fitted).eqNullSafe(F.col(derived))
    return rows.withColumn("shown", F.when(same, F.col(fitted))).withColumn("covariate_state", F.when(same, "agrees").otherwise("withheld"))
