"""Candidate facts, fill instructions, write records and live nodes derived from events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quire.operators.policy import decide
from quire.sources.tables import table


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, role, ord, value, confidence, evidence, extractor: many candidates and many ties per role."""
    key = F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("role"), key.alias("ord"), F.col("value").cast("string").alias("value"),
        F.round((key % 17) / 17.0, 3).alias("confidence"), F.when(key % 3 != 0, F.col("props")).alias("evidence"),
        F.when(key % 2 == 0, "rules").otherwise("narrative").alias("extractor"),
    )


def collections(spark: SparkSession, folder: str) -> DataFrame:
    """The same keys with lists of 0 to 4 items."""
    item = lambda i: F.map_from_arrays(
        F.array(F.lit("task"), F.lit("owner")), F.array(F.concat("value", F.lit("/"), i.cast("string")), F.concat(F.lit("user "), F.col("doc_id")))
    )
    count = (F.col("ord") % 5).cast("int")
    items = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), item)).otherwise(F.array().cast("array<map<string,string>>"))
    return facts(spark, folder).select(
        "doc_id", "role", "ord", items.alias("items"), "confidence", "evidence", "extractor"
    )


_ROLE_OF = {"click": "location", "purchase": "amount", "error": "summary", "signup": "attendees", "view": "meeting_date"}


def document_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One fact per document and vocabulary role."""
    roles = F.create_map(*[F.lit(x) for kv in _ROLE_OF.items() for x in kv])
    raw = facts(spark, folder).where("role <> 'signup' and evidence is not null")
    value = (
        F.when(F.col("role") == "view", F.concat(F.lit("2024-01-"), F.lpad((F.col("ord") % 28 + 1).cast("string"), 2, "0")))
        .when(F.col("role") == "click", F.concat(F.lit("Room "), F.col("ord") % 7)).when(F.col("role") == "error", F.concat(F.lit("About "), "value"))
        .otherwise(F.concat(F.lit("$"), "value"))
    )
    return raw.select("doc_id", roles[F.col("role")].alias("role"), "ord", value.alias("value"), (0.6 + 0.4 * F.col("confidence")).alias("confidence"),
                      "evidence", "extractor")


def document_collections(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(F.lit("Ada Adler"), F.lit("Emil Frank"), F.concat(F.lit("Guest "), F.col("doc_id")))
    raw = facts(spark, folder).where("role = 'signup' and ord % 3 <> 0")
    return raw.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "attendees").otherwise("action_items").alias("role"), "ord",
        F.transform(
            names,
            lambda n: F.map_from_arrays(
                F.array(F.when(F.col("doc_id") % 2 == 0, "name").otherwise("task"), F.when(F.col("doc_id") % 2 == 0, "organisation").otherwise("responsible")),
                F.array(n, F.lit("Team Nord")),
            ),
        ).alias("items"),
        (0.6 + 0.4 * F.col("confidence")).alias("confidence"), "evidence", "extractor",
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document fills one of five templates."""
    return table(spark, folder, "events").select("user_id").distinct().select(
        F.col("user_id").alias("job"), (F.col("user_id") % 5).alias("template_id"), F.col("user_id").alias("doc_id")
    )


# role, label, value format, editable, confidence, critical, multiline
_FIELDS = [
    ("meeting_date", "Meeting date", "date", True, 0.97, True, False),
    ("x_meeting_place", "Location of meeting", "text", True, 0.80, False, False),
    ("amount", "Total", "date", True, 0.90, True, False),
    ("x_attendees_vendor", "Attendees (Vendor)", "text", True, 0.75, False, True),
    ("attendees", "Attendees", "text", True, 0.90, False, False),
    ("summary", "Summary", "text", False, 0.90, False, True),
    ("approver", "Approved by", "text", True, 0.85, True, False),
]


def spec_fields(spark: SparkSession) -> DataFrame:
    """Field specs of the five templates; template 4 has every field, the others leave some out."""
    rows = [
        (t, role, f"n{i}", label, fmt, editable, conf - 0.02 * t, critical, "Header", multi)
        for t in range(5) for i, (role, label, fmt, editable, conf, critical, multi) in enumerate(_FIELDS) if t == 4 or i != t + 2
    ]
    return spark.createDataFrame(
        rows, "template_id bigint, role string, node_id string, label string, value_format string, editable boolean, confidence double, "
        "critical boolean, section string, multiline boolean",
    )


def spec_tables(spark: SparkSession) -> DataFrame:
    columns = "array<struct<name:string,header:string,format:string,editable:boolean>>"
    people = [("name", "Name", "text", True), ("department", "Team / organisation", "text", True), ("email", "E-mail", "text", True)]
    tasks = [("task", "Task", "text", True), ("owner", "Responsible person", "text", True), ("due_date", "Due", "date", True)]
    points = [("point", "Point", "text", True)]
    rows = [(t, "attendees", "t0", "Attendees", people, True, 0.8) for t in (0, 1, 2)]
    rows += [(t, "x_open_work", "t1", "Action items", tasks, True, 0.7) for t in (2, 3)]
    rows += [(4, "attendees__2", "t2", "Guests", people, True, 0.75), (4, "discussion_points", "t3", "Meeting summary", points, True, 0.9)]
    return spark.createDataFrame(
        rows, f"template_id bigint, role string, node_id string, section string, columns {columns}, editable boolean, confidence double"
    )


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their number inside the order (orders are short)."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, folder, "lineitem").withColumn("rn", F.row_number().over(order))


def plan(spark: SparkSession, folder: str) -> DataFrame:
    """One instruction per line item."""
    rn = F.col("rn")
    evidence = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("line "), rn)).otherwise("")
    rows = numbered_lines(spark, folder).select(
        F.col("l_orderkey").alias("job"), (F.col("l_orderkey") % 10).alias("template_id"), rn.cast("string").alias("node_id"),
        F.concat(F.lit("role"), rn % 4).alias("role"), F.concat(F.lit("Label "), rn).alias("label"),
        F.when(rn % 5 == 0, "table").otherwise("field").alias("kind"),
        F.when(rn % 3 == 0, F.col("l_returnflag")).otherwise(F.col("l_partkey").cast("string")).alias("value"),
        F.when(rn % 3 == 2, "text").otherwise("number").alias("value_format"),
        F.round(0.6 + 4 * F.col("l_discount"), 3).alias("confidence"), (F.col("l_returnflag") == "R").alias("critical"),
        evidence.alias("evidence"), F.when(rn % 5 == 0, F.col("l_suppkey") % 4).otherwise(0).cast("bigint").alias("n_rows"),
        F.concat(F.lit("Lines!A"), rn).alias("target"),
    )
    return rows.withColumn("decision", decide(F.col("confidence"), F.col("critical"), F.col("evidence") != ""))


def writes(spark: SparkSession, folder: str) -> DataFrame:
    node = F.col("node_id").cast("bigint")
    return plan(spark, folder).where(node % 3 != 0).select(
        "job", "node_id", F.when(node % 7 == 0, "failed").when(node % 7 == 1, "skipped").otherwise("written").alias("status"),
        (node % 4).alias("rows_written"), "target",
    )


def live_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the templates the plan addresses; every eleventh is gone."""
    mix = F.col("template_id") * 7 + F.col("node_id").cast("bigint")
    return plan(spark, folder).select("template_id", "node_id").distinct().where(mix % 11 != 0).select(
        "template_id", "node_id", F.when(mix % 13 == 0, "label").otherwise("value_region").alias("node_type"),
        (mix % 5 != 1).alias("editable"), (mix % 17 == 3).alias("is_protected"), (mix % 19 == 4).alias("has_formula"),
        (mix % 6 == 0).alias("merged"), (mix % 4 != 0).alias("is_anchor"), (mix % 3 != 0).alias("is_empty"),
        F.when(mix % 9 == 0, "{{x}}").otherwise("").alias("placeholder"), F.concat(F.lit("cell "), mix).alias("text"),
    )


PLAN_CTES = {
    "nlines": "select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as rn from lineitem",
    "fact": "select user_id as doc_id, event_type as role, event_id as ord, value, round((event_id % 17) / 17.0, 3) as confidence, event_id % 5 as n from events",
    "plan0": "select l_orderkey as job, l_orderkey % 10 as template_id, cast(rn as varchar) as node_id, rn, concat('role', rn % 4) as role, concat('Label ', rn) as label, "
    "case when rn % 5 = 0 then 'table' else 'field' end as kind, case when rn % 3 = 0 then l_returnflag else cast(l_partkey as varchar) end as value, "
    "case when rn % 3 = 2 then 'text' else 'number' end as value_format, round(0.6 + 4 * l_discount, 3) as confidence, l_returnflag = 'R' as critical, "
    "case when l_linestatus = 'O' then concat('line ', rn) else '' end as evidence, cast(case when rn % 5 = 0 then l_suppkey % 4 else 0 end as bigint) as n_rows, "
    "concat('Lines!A', rn) as target, case when l_returnflag = 'R' then 0.05::double else 0::double end as b from nlines",
    "plan": "select *, case when evidence = '' then 'skipped_no_evidence' when confidence >= least(0.99::double, 0.95::double + b) then 'fill' "
    "when confidence >= 0.85::double + b then 'fill_with_audit' when confidence >= 0.7::double + b then 'needs_review' else 'skipped_low_confidence' end as decision from plan0",
    "writes": "select job, node_id, case rn % 7 when 0 then 'failed' when 1 then 'skipped' else 'written' end as status, rn % 4 as rows_written, target from plan where rn % 3 <> 0",
    "nodes": "select template_id, node_id, case when mix % 13 = 0 then 'label' else 'value_region' end as node_type, mix % 5 <> 1 as editable, mix % 17 = 3 as is_protected, "
    "mix % 19 = 4 as has_formula, mix % 6 = 0 as merged, mix % 4 <> 0 as is_anchor, mix % 3 <> 0 as is_empty, case when mix % 9 = 0 then '{{x}}' else '' end as placeholder, "
    "concat('cell ', mix) as text from (select distinct template_id, node_id, template_id * 7 + rn as mix from plan) where mix % 11 <> 0",
}
PLAN_NEEDS = {"plan0": ("nlines",), "plan": ("plan0",), "writes": ("plan",), "nodes": ("plan",)}
