"""Decision policy, fill plans, gate, review, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import roles as R
from quire.bridge import plans as B
from quire.bridge.sql import with_views
from quire.checks import check
from quire.operators import gate as G, policy as P
from quire.plans import audit as A, extract as X, fill
from quire.sources.tables import table
from quire.streaming.replay import new_root


@check("fn30_decide", with_views("plan", "select job, node_id, decision from plan"))
def _(spark, folder):
    return B.plan(spark, folder).select("job", "node_id", "decision")


@check("ag09_decision_summary", with_views("plan", "select decision, count(*) as n from plan group by 1"))
def _(spark, folder):
    return P.decision_summary(B.plan(spark, folder))


_GEO = "select job, round(coalesce(exp(avg(ln(case when confidence is not null then greatest(1e-6, confidence) end))), 0), 6) as mean from (select job, case when rn % 4 <> 0 then case when rn % 5 = 0 then 0 else confidence end end as confidence from plan) group by 1"


@check("ag12_geo_mean", with_views("plan", _GEO))
def _(spark, folder):
    rn = F.col("node_id").cast("bigint")
    value = F.when(rn % 4 != 0, F.when(rn % 5 == 0, 0.0).otherwise(F.col("confidence")))
    return B.plan(spark, folder).groupBy("job").agg(F.round(P.geo_mean(value), 6).alias("mean"))


@check(
    "ud04_geo_mean",
    with_views("plan", "select decision, round(exp(avg(ln(greatest(1e-6, confidence)))), 6) as mean from plan group by 1"),
)
def _(spark, folder):
    return B.plan(spark, folder).groupBy("decision").agg(F.round(P.geo_mean(F.col("confidence")), 6).alias("mean"))


@check(
    "fn31_format_compat",
    with_views(
        "plan",
        "select job, node_id, case when e = 'unknown' or o = 'unknown' then 0.5 when e = o then 1 when e in ('number', 'currency') and o in ('number', 'currency') then 0.7 when e = 'text' then 0.45 else 0.1 end::double as compat "
        "from (select *, value_format as e, case rn % 5 when 0 then 'currency' when 1 then 'unknown' when 2 then 'number' when 3 then 'date' else 'text' end as o from plan)",
    ),
)
def _(spark, folder):
    observed = F.element_at(F.array(*[F.lit(x) for x in ("currency", "unknown", "number", "date", "text")]), (F.col("node_id").cast("int") % 5) + 1)
    return B.plan(spark, folder).select("job", "node_id", P.format_compat(F.col("value_format"), observed).cast("double").alias("compat"))


_OVER = "select l_orderkey as job, concat('role', max(rn) % 4) as role, concat('fixed ', max(rn)) as value from nlines where l_orderkey % 3 = 0 group by 1"


@check(
    "jn23_apply_overrides",
    with_views(
        "plan nlines",
        "select p.job, p.node_id, coalesce(o.value, p.value) as value, case when o.value is not null then 1.0::double else p.confidence end as confidence, case when o.value is not null then 'fill' else p.decision end as decision "
        "from plan p left join ov o on o.job = p.job and o.role = p.role",
        ov=_OVER,
    ),
)
def _(spark, folder):
    over = B.numbered_lines(spark, folder).where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("job")).agg(F.max("rn").alias("top")).select(
        "job", F.concat(F.lit("role"), F.col("top") % 4).alias("role"), F.concat(F.lit("fixed "), "top").alias("value")
    )
    return P.apply_overrides(B.plan(spark, folder), over).select("job", "node_id", "value", "confidence", "decision")


_STATUS = "case w.status when 'written' then 'filled' when 'skipped' then 'skipped_by_renderer' when 'failed' then 'render_failed' else p.decision end"
_JOINED = f"select p.*, {_STATUS} as status, w.rows_written, case when p.template_id % 2 = 0 then 'rules' else '' end as decided_by from plan p left join writes w using (job, node_id)"


def spec_roles(spark, folder):
    return B.plan(spark, folder).where("template_id % 2 = 0").select("template_id", "role").distinct().withColumn("decided_by", F.lit("rules"))


@check("jn15_audit_join", with_views("plan writes", "select job, node_id, status, decided_by from j", j=_JOINED))
def _(spark, folder):
    return A.audit_join(B.plan(spark, folder), B.writes(spark, folder), spec_roles(spark, folder)).select("job", "node_id", "status", "decided_by")


_SUMMARY = (
    "select job, count(*) as planned, count(*) filter (status = 'filled') as written, cast(coalesce(sum(rows_written), 0) as bigint) as rows_added, count(*) filter (status = 'render_failed') as failed, "
    "count(*) filter (decision = 'needs_review') as needs_review, count(*) filter (decision = 'skipped_no_evidence') as no_evidence, 0::bigint as not_found, 0::bigint as blocked from j group by 1"
)


@check("ag10_audit_summary", with_views("plan writes", _SUMMARY, j=_JOINED))
def _(spark, folder):
    return A.audit_summary(A.audit_join(B.plan(spark, folder), B.writes(spark, folder)))


@check(
    "cq11_audit_log",
    with_views(
        "plan writes",
        "select job, role as field, target, case when kind = 'table' then concat(n_rows, ' row(s)') else value end as value, status, confidence, evidence, decided_by from j",
        j=_JOINED,
    ),
)
def _(spark, folder):
    return A.audit_entries(A.audit_join(B.plan(spark, folder), B.writes(spark, folder), spec_roles(spark, folder)))


_FITS = "(value_format = 'text' or regexp_matches(value, '[0-9]'))"
_TARGET = (
    "select p.job, p.node_id, p.role, v.c as \"check\", v.s as severity from plan p left join nodes n using (template_id, node_id), "
    "lateral (select unnest([struct_pack(c := 'target_exists', s := 'error', t := n.text is null), struct_pack(c := 'editable', s := 'error', t := n.is_protected or not n.editable), "
    "struct_pack(c := 'region_type', s := 'error', t := n.node_type <> 'value_region'), struct_pack(c := 'no_formula_overwrite', s := 'error', t := n.has_formula), "
    "struct_pack(c := 'merge_anchor', s := 'error', t := n.merged and not n.is_anchor), struct_pack(c := 'type_fit', s := 'error', t := n.text is not null and not "
    "(p.value_format = 'text' or regexp_matches(p.value, '[0-9]'))), struct_pack(c := 'overwrite', s := 'warning', t := not n.is_empty and n.placeholder = '')]) as v) where p.kind = 'field' and coalesce(v.t, false)"
)


@check("jn17_target_check", with_views("plan nodes", _TARGET))
def _(spark, folder):
    return G.target_check(B.plan(spark, folder), B.live_nodes(spark, folder)).select("job", "node_id", "role", "check", "severity")


_TABLES = "select distinct template_id, node_id, role from plan where kind = 'table'"


def spec_of(spark, folder):
    """Spec tables of the plan: three headers each."""
    cols = F.array(
        *[F.struct(F.lit(n).alias("name"), F.concat(F.lit(h), F.col("node_id")).alias("header"), F.lit(f).alias("format"), F.lit(e).alias("editable"))
          for n, h, f, e in (("task", " Task ", "text", True), ("qty", "Qty ", "number", True), ("code", "Code ", "text", False))]
    )
    return B.plan(spark, folder).where("kind = 'table'").select("template_id", "node_id", "role").distinct().withColumn("columns", cols)


@check(
    "jn16_header_drift",
    with_views(
        "plan",
        "select template_id, node_id, role, concat('Qty ', node_id) as header from t where (template_id + cast(node_id as bigint)) % 3 = 0 union all select template_id, node_id, role, concat('Code ', node_id) from t",
        t=_TABLES,
    ),
)
def _(spark, folder):
    tables = spec_of(spark, folder)
    third = (F.col("template_id") + F.col("node_id").cast("bigint")) % 3
    live = tables.select(
        "template_id", "node_id",
        F.explode(F.array(F.concat(F.lit("TASK "), "node_id"), F.when(third != 0, F.concat(F.lit("qty "), "node_id")).otherwise("other"))).alias("header"),
    )
    return G.header_drift(tables, live)


def planned_cells(spark, folder):
    rn = F.col("node_id").cast("bigint")
    return B.plan(spark, folder).where("kind = 'table' and n_rows > 0").select(
        "job", "template_id", "node_id", "role", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))).alias("row"), "value", rn.alias("rn")
    ).withColumn(
        "column", F.element_at(F.array(F.lit("task"), F.lit("qty"), F.lit("code"), F.lit("extra")), (F.col("row") % 4 + 1).cast("int"))
    )


@check(
    "jn18_row_type_check",
    with_views(
        "plan",
        "select job, node_id, role, case row % 4 when 3 then 'unknown_column' when 2 then 'editable' else 'type_fit' end as \"check\", case when row % 4 = 2 then 'error' else 'warning' end as severity, row from "
        "(select *, unnest(range(1, n_rows + 1)) as row from plan where kind = 'table') where row % 4 in (2, 3) or (row % 4 = 1 and not regexp_matches(value, '[0-9]'))",
    ),
)
def _(spark, folder):
    cells = planned_cells(spark, folder)
    columns = spec_of(spark, folder).select("template_id", "node_id", F.explode("columns").alias("c")).select(
        "template_id", "node_id", F.col("c.name").alias("column"), F.col("c.format").alias("format"), F.col("c.editable").alias("editable")
    )
    out = G.row_type_check(cells, columns)
    return out.select("job", "node_id", "role", "check", "severity", F.regexp_extract("message", r"row (\d+)", 1).cast("bigint").alias("row"))


_WRITABLE = "select * from plan where decision in ('fill', 'fill_with_audit')"
_VIOLATIONS = "select t.* from target t join w using (job, node_id)"


def gate(spark, folder):
    plan = B.plan(spark, folder)
    return G.validate_plan(plan, [G.target_check(plan, B.live_nodes(spark, folder))])


@check(
    "cq09_validate_plan",
    with_views(
        "plan nodes",
        "select job, node_id, case when decision in ('fill', 'fill_with_audit') and exists (select 1 from target t where t.job = p.job and t.node_id = p.node_id and severity = 'error') then 'blocked_by_validation' else decision end as decision from plan p",
        target=_TARGET,
    ),
)
def _(spark, folder):
    return gate(spark, folder)[0].select("job", "node_id", "decision")


@check(
    "ag11_report_ok",
    with_views(
        "plan nodes",
        "select job, bool_and(severity <> 'error') as ok, count(*) filter (severity = 'error') as errors, count(*) filter (severity <> 'error') as warnings, "
        "count(distinct node_id) filter (severity = 'error') as blocked from v group by 1",
        target=_TARGET, w=_WRITABLE, v=_VIOLATIONS,
    ),
)
def _(spark, folder):
    return G.report(gate(spark, folder)[1])


_CHECKED = (
    "select p.* replace (case when decision in ('fill', 'fill_with_audit') and exists (select 1 from target t where t.job = p.job and t.node_id = p.node_id and severity = 'error') "
    "then 'blocked_by_validation' else decision end as decision) from plan p"
)
_QUEUE = (
    "select job, role, label, value, confidence, decision, evidence from checked where decision in ('needs_review', 'fill_with_audit', 'skipped_type_mismatch', 'blocked_by_validation') "
    "union all select job, null, label, null, null, 'unmapped_region', 'no candidate' from plan where rn = 6"
)


def queue(spark, folder):
    checked, _ = gate(spark, folder)
    unresolved = B.plan(spark, folder).where("node_id = '6'").select("job", "label", F.lit("no candidate").alias("reason"))
    return A.review_queue(checked, unresolved)


@check("cq10_review_queue", with_views("plan nodes", _QUEUE, target=_TARGET, checked=_CHECKED))
def _(spark, folder):
    return queue(spark, folder)


@check(
    "ag25_job_summary",
    with_views(
        "plan nodes writes",
        "select s.job, planned, written, rows_added, coalesce(r.n, 0) as review_items, coalesce(v.ok, true) as validation_ok, coalesce(v.ok, true) and failed = 0 as ok from s left join (select job, count(*) as n from q group by 1) r using (job) "
        "left join (select job, bool_and(severity <> 'error') as ok from v group by 1) v using (job)",
        j=_JOINED, s=_SUMMARY, target=_TARGET, w=_WRITABLE, v=_VIOLATIONS, checked=_CHECKED, q=_QUEUE,
    ),
)
def _(spark, folder):
    summary = A.audit_summary(A.audit_join(B.plan(spark, folder), B.writes(spark, folder)))
    return A.job_summary(summary, queue(spark, folder), G.report(gate(spark, folder)[1]))


@check(
    "fn47_target_text",
    with_views(
        "plan",
        "select job, node_id, case rn % 5 when 0 then concat('Lines!A', rn) when 1 then concat('slide[', job, ']/shape[', rn, ']') when 2 then concat('table[', job, ']!r', rn, 'c', template_id) "
        "when 3 then concat('table[', job, ']') else concat('paragraph[', job, ']') end as target from plan",
    ),
)
def _(spark, folder):
    rn = F.col("node_id").cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("sheet", "slide", "table_cell", "table", "paragraph")]), rn % 5 + 1)
    text = A.target_text(kind, F.lit("Lines"), F.concat(F.lit("A"), rn), F.col("job"), rn, F.col("template_id"), rn)
    return B.plan(spark, folder).select("job", "node_id", text.alias("target"))


def one_each(spark, folder):
    return X.best_fact(B.document_facts(spark, folder)), X.best_collection(B.document_collections(spark, folder))


@check("jn10_match_facts")
def _(spark, folder):
    facts, lists = one_each(spark, folder)
    out = fill.match_facts(B.jobs(spark, folder), B.spec_fields(spark), facts, lists)
    return out.select("job", "node_id", "role", "value", F.round("fact_conf", 6).alias("fact_conf"), F.round("match_conf", 6).alias("match_conf"), "step")


@check("jn11_match_collections")
def _(spark, folder):
    facts, lists = one_each(spark, folder)
    out = fill.match_collections(B.jobs(spark, folder), B.spec_tables(spark), facts, lists)
    return out.select("job", "node_id", "role", "src_role", F.size("items").alias("n"), F.round("match_conf", 6).alias("match_conf"), "step")


@check(
    "ag15_flatten_collection",
    with_views(
        "fact",
        "select doc_id, role, ord, case when n = 0 then '' when doc_id % 2 = 0 and length(lead_item) > 40 then array_to_string(list_transform(range(1, n + 1), lambda i: concat('• ', lead_item, i, ' (owner: user ', doc_id, ')')), chr(10)) "
        "else array_to_string(list_transform(range(1, n + 1), lambda i: concat(lead_item, i)), ', ') end as text from (select *, case when doc_id % 3 = 0 then concat(repeat('long words ', 4), ord, '/') else concat(ord, '/') end as lead_item from fact)",
    ),
)
def _(spark, folder):
    rows = B.collections(spark, folder)
    lead = F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("long words "), 4), "ord", F.lit("/"))).otherwise(F.concat("ord", F.lit("/")))
    items = F.transform("items", lambda m, i: F.map_from_arrays(F.array(F.lit("task"), F.lit("owner")), F.array(F.concat(lead, (i + 1).cast("string")), m["owner"])))
    return rows.select("doc_id", "role", "ord", fill.flatten_collection(items, F.col("doc_id") % 2 == 0).alias("text"))


@check("ag14_coverage")
def _(spark, folder):
    facts, lists = one_each(spark, folder)
    plan, _ = fill.plan_tables(fill.match_collections(B.jobs(spark, folder), B.spec_tables(spark), facts, lists))
    return plan.select("job", "node_id", "coverage", "columns_used", "n_rows")


@check("cq08_fill_plan")
def _(spark, folder):
    facts, lists = one_each(spark, folder)
    plan = fill.fill_plan(B.jobs(spark, folder), B.spec_fields(spark), B.spec_tables(spark), facts, lists)
    return plan.select("job", "kind", "node_id", "role", "value", "n_rows", "confidence", "decision", "note")


@check(
    "sc15_facts_json",
    with_views(
        "fact",
        "select doc_id, role, ord, value as number from (select *, row_number() over (partition by doc_id, role order by confidence desc, ord) as k from fact) where k = 1",
    ),
)
def _(spark, folder):
    from quire.sources.documents import facts_json, read_facts_json

    best = X.best_fact(B.facts(spark, folder))
    back = read_facts_json(facts_json(best))
    return back.select("doc_id", "role", "ord", F.col("value").cast("double").alias("number"))


@check(
    "sc13_run_artifacts",
    with_views(
        "plan writes",
        # every third job ran again: with fewer instructions, and every sixth without any write
        "select 'plan' as made, job, node_id, decision as state from plan where job % 3 <> 0 or rn % 2 = 0 union all "
        "select 'writes', job, node_id, status from writes where job % 3 <> 0 or (cast(node_id as int) % 2 = 0 and job % 6 <> 0)",
    ),
)
def _(spark, folder):
    root = new_root(spark, "artifacts")
    plan, writes = B.plan(spark, folder), B.writes(spark, folder)
    A.run_artifacts_sink({"plan": plan, "writes": writes}, root)
    even = "job % 3 = 0 and cast(node_id as int) % 2 = 0"
    A.run_artifacts_sink({"plan": plan.where(even), "writes": writes.where(f"{even} and job % 6 <> 0")}, root, jobs=plan.where("job % 3 = 0"))
    shape = lambda name, df, state: A.run_artifacts(spark, root, name, df.schema).select(F.lit(name).alias("made"), "job", "node_id", F.col(state).alias("state"))
    return shape("plan", plan, "decision").unionByName(shape("writes", writes, "status"))
