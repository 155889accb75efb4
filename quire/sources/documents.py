"""Facts of a document as one JSON text and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_SCHEMA = (
    "doc_id bigint, fields array<struct<role:string,ord:bigint,value:string,confidence:double,evidence:string,extractor:string>>"
)
_FIELDS = ("role", "ord", "value", "confidence", "evidence", "extractor")


def facts_json(facts: DataFrame) -> DataFrame:
    """doc_id, json: one document per row. Give it one fact per role; a document's roles are few."""
    packed = facts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*_FIELDS))).alias("fields"))
    return packed.select("doc_id", F.to_json(F.struct("doc_id", "fields")).alias("json"))


def read_facts_json(documents: DataFrame) -> DataFrame:
    """Facts of the JSON texts; parts that are missing get their defaults."""
    parsed = documents.select(F.from_json("json", _SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    rows = parsed.select("d.doc_id", F.explode("d.fields").alias("f")).select("doc_id", "f.*")
    return rows.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(0.0)), "evidence": F.coalesce("evidence", F.lit("")),
            "extractor": F.coalesce("extractor", F.lit("outside")),
        }
    )
