"""Template fields and tables against the facts of a document: match, value, confidence, decision.

``jobs`` (job, template_id, doc_id) says which document fills which template. Exact matches are equi
joins and are taken out first; what is left is compared with the roles of its document, which come
as arrays of bounded size, so no pair of (field, role) ever becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire import roles as R
from quire.functions import similarity as S, values as X
from quire.operators.policy import NOT_FOUND, PROTECTED, TYPE_MISMATCH, Policy, decide, geo_mean_of

ROLES_PER_ARRAY = 256
_STRICT = ("date", "time", "number", "currency")


def _spoken(role: Column) -> Column:
    return F.translate(role, "_", " ")


def role_arrays(rows: DataFrame, *extra: str, size: int = ROLES_PER_ARRAY) -> DataFrame:
    """Roles of each document as arrays of about ``size``, in order of appearance."""
    distinct = rows.groupBy("doc_id", "role").agg(F.min("ord").alias("ord"), *[F.any_value(e).alias(e) for e in extra])
    counts = distinct.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__cuts"))
    cut = distinct.join(counts, "doc_id").withColumn("__cut", F.pmod(F.xxhash64("role"), F.col("__cuts")))
    packed = F.sort_array(F.collect_list(F.struct("ord", "role", *extra)))
    return cut.groupBy("doc_id", "__cut").agg(packed.alias("options")).drop("__cut")


# --- text of a list in a single region ------------------------------------------------------------
def item_text(item: Column) -> Column:
    named = [F.nullif(item[k], F.lit("")) for k in ("text", "task", "item", "name", "description", "point")]
    spelled = F.array_join(
        F.transform(F.map_entries(item), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "; "
    )
    return F.coalesce(*named, spelled)


def flatten_collection(items: Column, multiline: Column) -> Column:
    """Short lists as one comma line, long ones as bullets with owner, date and status if lines are allowed."""
    primaries = F.transform(items, item_text)
    bullets = multiline & (F.exists(primaries, lambda p: F.length(p) > 40) | (F.size(items) > 6))

    def line(item: Column) -> Column:
        shown = item_text(item)
        extras = F.filter(
            F.map_entries(item),
            lambda e: e["key"].isin("owner", "due_date", "status") & (F.coalesce(e["value"], F.lit("")) != "") & (e["value"] != shown),
        )
        tail = F.array_join(F.transform(extras, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
        return F.concat(F.lit("• "), shown, F.when(tail == "", "").otherwise(F.concat(F.lit(" ("), tail, F.lit(")"))))

    return F.when(bullets, F.array_join(F.transform(items, line), "\n")).otherwise(F.array_join(primaries, ", "))


# --- fields ---------------------------------------------------------------------------------------
def _best_of_arrays(rows: DataFrame, arrays: DataFrame, open_: Column, name: str, floor: float) -> DataFrame:
    """Adds ``name`` (role, score) of the best role among the arrays of a row's document, where ``open_``.

    A document has one array unless it has very many roles, so the join rarely repeats a row; the
    aggregate brings the repeats together again.
    """
    carried = [c for c in rows.columns if c not in ("job", "node_id")]
    keyed = rows.withColumn("__open", open_).withColumn("__doc", F.when(F.col("__open"), F.col("doc_id")))
    joined = keyed.join(arrays.withColumnRenamed("doc_id", "__doc"), "__doc", "left")
    spoken = F.transform("options", lambda o: _spoken(o["role"]))
    hit = joined.withColumn("__hit", S.best_of(_spoken(F.col("role")), F.col("label"), spoken))
    found = F.get("options", F.col("__hit.pos"))
    candidate = F.when(
        F.col("__hit.score") >= floor,
        F.struct(F.col("__hit.score").alias("score"), (-found["ord"]).alias("before"), found["role"].alias("role")),
    )
    return (
        hit.withColumn("__candidate", candidate)
        .groupBy("job", "node_id")
        .agg(F.first(F.struct(*carried)).alias("__row"), F.max("__candidate").alias(name))
        .select("job", "node_id", *[F.col("__row")[c].alias(c) for c in carried], name)
    )


def match_facts(
    jobs: DataFrame, fields: DataFrame, facts: DataFrame, collections: DataFrame, floor: float = 0.72
) -> DataFrame:
    """Each (job, field) with the fact it takes: value, fact_conf, evidence, extractor, match_conf, step.

    The first hit counts: exact role, list of the same role as text, similar list, similar fact. One
    chain of left joins; a row that is settled carries a null key and takes no part in later steps.
    """
    wanted = jobs.join(fields, "template_id")
    columns = wanted.columns
    fact = F.struct("value", F.col("confidence").alias("conf"), "evidence", "extractor")
    listing = F.struct("items", F.col("confidence").alias("conf"), "evidence", "extractor")
    f = facts.select("doc_id", "role", fact.alias("fact"))
    c = collections.where(F.size("items") > 0).select("doc_id", "role", listing.alias("list"))

    def as_text(items: str) -> Column:
        return F.nullif(flatten_collection(F.col(items), F.col("multiline")), F.lit(""))

    exact = wanted.join(f.withColumnRenamed("fact", "f1"), ["doc_id", "role"], "left").join(
        c.withColumnRenamed("list", "c1"), ["doc_id", "role"], "left"
    )
    exact = exact.withColumn("t1", F.when(F.col("f1").isNull() & F.col("c1").isNotNull(), as_text("c1.items")))
    opened = F.col("f1").isNull() & F.col("t1").isNull()
    listed = _best_of_arrays(exact, role_arrays(collections.where(F.size("items") > 0)), opened, "m2", floor)
    listed = listed.withColumn("__src", F.col("m2.role")).join(
        c.select("doc_id", F.col("role").alias("__src"), F.col("list").alias("c2")), ["doc_id", "__src"], "left"
    ).drop("__src")
    listed = listed.withColumn("t2", F.when(F.col("c2").isNotNull(), as_text("c2.items")))
    still = opened & F.col("t2").isNull()
    near = _best_of_arrays(listed, role_arrays(facts), still, "m3", floor)
    near = near.withColumn("__src", F.col("m3.role")).join(
        f.select("doc_id", F.col("role").alias("__src"), F.col("fact").alias("f3")), ["doc_id", "__src"], "left"
    ).drop("__src")
    guess = F.col("role").startswith("x_") & ~F.col("m2.role").startswith("x_")
    share = 0.85 * F.col("m2.score") * F.when(guess, 0.55).otherwise(1.0)
    by = [
        (F.col("f1").isNotNull(), F.col("f1.value"), F.col("f1.conf"), "f1", F.lit(1.0), "exact role"),
        (F.col("t1").isNotNull(), F.col("t1"), F.col("c1.conf") * 0.95, "c1", F.lit(0.95), "list of the role"),
        (F.col("t2").isNotNull(), F.col("t2"), F.col("c2.conf") * share, "c2", share, "similar list"),
        (F.col("f3").isNotNull(), F.col("f3.value"), F.col("f3.conf"), "f3", 0.90 * F.col("m3.score"), "similar fact"),
    ]

    def first(pick) -> Column:
        return F.coalesce(*[F.when(row[0], pick(row)) for row in by])

    return near.select(
        *columns,
        first(lambda r: r[1]).alias("value"), first(lambda r: r[2]).alias("fact_conf"),
        first(lambda r: F.col(f"{r[3]}.evidence")).alias("evidence"), first(lambda r: F.col(f"{r[3]}.extractor")).alias("extractor"),
        first(lambda r: r[4]).alias("match_conf"), F.coalesce(first(lambda r: F.lit(r[5])), F.lit("not found")).alias("step"),
    )


def plan_fields(matched: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One instruction per field: value, confidence, evidence, decision."""
    fmt = F.col("value_format")
    typed = X.coerce(F.col("value"), fmt)
    conf = F.least(F.lit(0.99), geo_mean_of(F.col("confidence"), F.col("fact_conf"), F.col("match_conf")))
    staged = matched.withColumns({"__typed": typed, "__conf": conf})
    found = F.col("value").isNotNull()
    mismatch = found & ~F.col("__typed.ok") & fmt.isin(*_STRICT)
    editable = F.coalesce("editable", F.lit(True))
    shown = F.coalesce(
        F.col("__typed.v_date").cast("string"), F.when(F.col("__typed.v_minutes").isNotNull(), X.display_minutes(F.col("__typed.v_minutes"))),
        X.display_double(F.col("__typed.v_double")), F.col("__typed.v_string"), F.col("value"),
    )
    decision = decide(F.col("__conf"), F.col("critical"), F.coalesce("evidence", F.lit("")) != "", policy)
    return staged.select(
        "job", "template_id", F.lit("field").alias("kind"), "node_id", "role", "label", "value_format", "critical",
        F.when(editable & found, F.when(mismatch, F.col("value")).otherwise(shown)).alias("value"),
        F.lit(0).cast("bigint").alias("n_rows"),
        F.when(~editable | ~found, 0.0).when(mismatch, F.round(F.col("fact_conf") * 0.5, 3))
        .otherwise(F.round(F.col("__conf"), 3)).alias("confidence"),
        F.when(editable & found, F.coalesce("evidence", F.lit(""))).otherwise("").alias("evidence"),
        F.when(editable & found, F.col("extractor")).alias("extractor"),
        F.when(~editable, PROTECTED).when(~found, NOT_FOUND).when(mismatch, TYPE_MISMATCH).otherwise(decision).alias("decision"),
        F.when(~editable, "target is not editable").otherwise(F.col("step")).alias("note"),
    )


# --- tables ---------------------------------------------------------------------------------------
def match_collections(
    jobs: DataFrame, tables: DataFrame, facts: DataFrame, collections: DataFrame, floor: float = 0.5
) -> DataFrame:
    """Each (job, table) with its list: exact role, base role, alike by name and columns, one fact as a row.

    ``tables`` has template_id, role, node_id, section, columns (array of name, header, format, editable).
    One chain of left joins, as in ``match_facts``.
    """
    wanted = jobs.join(tables, "template_id")
    columns = wanted.columns
    carried = lambda df: [x for x in df.columns if x not in ("job", "node_id")]
    listing = F.struct(F.col("role").alias("src"), "items", F.col("confidence").alias("conf"), "evidence", "extractor")
    c = collections.select("doc_id", "role", listing.alias("list"))

    def joined(df: DataFrame, role: Column, out: str) -> DataFrame:
        other = c.select("doc_id", F.col("role").alias("__src"), F.col("list").alias(out))
        return df.withColumn("__src", role).join(other, ["doc_id", "__src"], "left").drop("__src")

    base = F.regexp_replace("role", r"__.*$", "")
    rows = joined(wanted, F.col("role"), "c1")
    rows = joined(rows, F.when(F.col("c1").isNull() & (base != F.col("role")), base), "c2")
    rows = rows.withColumn("c2", F.when(F.size("c2.items") > 0, F.col("c2")))
    fields = F.array_distinct(F.flatten(F.transform("items", lambda m: F.map_keys(m))))
    arrays = role_arrays(collections.withColumn("fields", fields), "fields", size=64).withColumnRenamed("doc_id", "__doc")
    opened = F.col("c1").isNull() & F.col("c2").isNull()
    keyed = rows.withColumn("__doc", F.when(opened, F.col("doc_id"))).join(arrays, "__doc", "left")
    keyed = keyed.withColumns(
        {
            "__sims": S.each_of(_spoken(F.col("role")), F.col("section"), F.transform("options", lambda o: _spoken(o["role"]))),
            "__names": F.transform("columns", lambda col: col["name"]),
        }
    )
    rated = F.transform(
        "options",
        lambda o, i: F.struct(
            (
                0.5 * F.get("__sims", i)
                + 0.5 * F.size(F.array_intersect(F.col("__names"), o["fields"])) / F.greatest(F.lit(1), F.size("__names"))
            ).alias("score"),
            (-o["ord"]).alias("before"), o["role"].alias("role"),
        ),
    )
    held = carried(rows)
    best = (
        keyed.withColumn("__best", F.array_max(rated))
        .groupBy("job", "node_id").agg(F.first(F.struct(*held)).alias("__row"), F.max("__best").alias("m3"))
        .select("job", "node_id", *[F.col("__row")[x].alias(x) for x in held], F.when(F.col("m3.score") >= floor, F.col("m3")).alias("m3"))
    )
    rows = joined(best, F.col("m3.role"), "c3")
    # what is still open may take one fact of its role, of its singular, or a general text
    singular = F.when(F.col("role").endswith("s"), F.expr("substring(role, 1, length(role) - 1)"))
    tries = F.array_compact(F.array(F.col("role"), singular, F.lit("discussion"), F.lit("summary")))
    single = facts.where("coalesce(evidence, '') <> ''").select(
        "doc_id", F.col("role").alias("__src"),
        F.struct(F.col("role").alias("src"), "value", F.col("confidence").alias("conf"), "evidence", "extractor").alias("__fact"),
    )
    last = F.coalesce("c1", "c2", "c3").isNull()
    held = carried(rows)
    tried = rows.withColumn("__tries", F.when(last, tries)).select("*", F.posexplode_outer("__tries").alias("__try", "__src"))
    rows = (
        tried.drop("__tries").join(single, ["doc_id", "__src"], "left")
        .groupBy("job", "node_id")
        .agg(
            F.first(F.struct(*held)).alias("__row"),
            F.min_by("__fact", F.when(F.col("__fact").isNotNull(), F.col("__try"))).alias("f4"),
        )
        .select("job", "node_id", *[F.col("__row")[x].alias(x) for x in held], "f4")
    )
    primary = F.coalesce(F.get(F.transform("columns", lambda col: col["name"]), F.lit(0)), F.lit("text"))
    wrapped = F.array(F.map_from_arrays(F.array(primary), F.array("f4.value")))
    by = [
        (F.col("c1").isNotNull(), "c1", F.col("c1.items"), F.col("c1.conf"), F.lit(1.0), "exact role"),
        (F.col("c2").isNotNull(), "c2", F.col("c2.items"), F.col("c2.conf"), F.lit(0.95), "base role"),
        (F.col("c3").isNotNull(), "c3", F.col("c3.items"), F.col("c3.conf"), F.least(F.lit(1.0), 0.85 + 0.15 * F.col("m3.score")), "alike"),
        (F.col("f4").isNotNull(), "f4", wrapped, F.col("f4.conf") * 0.85, F.lit(0.80), "one fact as a row"),
    ]

    def first(pick) -> Column:
        return F.coalesce(*[F.when(row[0], pick(row)) for row in by])

    return rows.select(
        *columns, first(lambda r: F.col(f"{r[1]}.src")).alias("src_role"), first(lambda r: r[2]).alias("items"),
        first(lambda r: r[3]).alias("coll_conf"), first(lambda r: F.col(f"{r[1]}.evidence")).alias("evidence"),
        first(lambda r: F.col(f"{r[1]}.extractor")).alias("extractor"), first(lambda r: r[4]).alias("match_conf"),
        F.coalesce(first(lambda r: F.lit(r[5])), F.lit("not found")).alias("step"),
    )


def _with_cells(matched: DataFrame, policy: Policy) -> DataFrame:
    """Adds the placed cells of each table and the counts its confidence needs; nothing leaves the row."""
    limited = F.slice("items", 1, policy.max_rows_per_table) if policy.max_rows_per_table else F.col("items")
    staged = matched.withColumn("__open", F.filter("columns", lambda c: F.coalesce(c["editable"], F.lit(True)))).withColumn(
        "__items", F.coalesce(limited, F.array().cast("array<map<string,string>>"))
    )
    staged = staged.withColumn("__fields", F.array_distinct(F.flatten(F.transform("__items", lambda m: F.map_keys(m)))))
    staged = staged.withColumn(
        "__target",
        S.nearest_columns(
            F.col("__fields"), F.transform("__open", lambda c: c["name"]),
            F.transform("__open", lambda c: F.coalesce(c["header"], F.lit(""))),
        ),
    )

    def cells_of(item: Column, row: Column) -> Column:
        def cell(e: Column) -> Column:
            column = F.get("__target", (F.array_position("__fields", e["key"]) - 1).cast("int"))
            return F.struct(row.cast("bigint").alias("row"), column.alias("column"), e["value"].alias("raw"))

        return F.filter(F.transform(F.map_entries(item), cell), lambda x: x["column"].isNotNull())

    staged = staged.withColumn("__cells", F.flatten(F.transform("__items", cells_of)))
    return staged.withColumns(
        {
            "offered": F.aggregate("__items", F.lit(0), lambda n, m: n + F.size(m)),
            "placed": F.size("__cells"),
            "n_rows": F.size(F.array_distinct(F.transform("__cells", lambda x: x["row"]))).cast("bigint"),
            "used": F.size(F.array_distinct(F.transform("__cells", lambda x: x["column"]))),
        }
    )


def plan_tables(matched: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(one instruction per table, its cells as job, template_id, node_id, role, row, column, value, format, ok)."""
    staged = _with_cells(matched, policy)
    coverage = F.col("placed") / F.greatest(F.lit(1), F.col("offered"))
    conf = F.least(F.lit(0.99), geo_mean_of(F.col("confidence"), F.col("coll_conf"), F.col("match_conf")) * (0.85 + 0.15 * coverage))
    rated = staged.withColumn("__conf", conf)
    editable = F.coalesce("editable", F.lit(True))
    filled = editable & (F.col("n_rows") > 0)
    critical = R.is_critical(F.col("role"))
    instructions = rated.select(
        "job", "template_id", F.lit("table").alias("kind"), "node_id", "role", F.coalesce("section", "role").alias("label"),
        F.lit("text").alias("value_format"), critical.alias("critical"),
        F.when(filled, F.concat(F.col("n_rows").cast("string"), F.lit(" row(s)"))).alias("value"),
        F.when(filled, F.col("n_rows")).otherwise(0).cast("bigint").alias("n_rows"),
        F.when(filled, F.round("__conf", 3)).otherwise(0.0).alias("confidence"),
        F.when(filled, F.coalesce("evidence", F.lit(""))).otherwise("").alias("evidence"),
        F.when(filled, F.col("extractor")).alias("extractor"),
        F.when(~editable, PROTECTED).when(~filled, NOT_FOUND)
        .otherwise(decide(F.col("__conf"), critical, F.coalesce("evidence", F.lit("")) != "", policy)).alias("decision"),
        F.col("step").alias("note"),
        F.round(coverage, 6).alias("coverage"),
        F.round(F.col("used") / F.greatest(F.lit(1), F.size("__open")), 6).alias("columns_used"),
    )
    fmt = F.get(F.filter("__open", lambda c: c["name"] == F.col("column")), F.lit(0))["format"]
    cells = staged.select("job", "template_id", "node_id", "role", "__open", F.explode("__cells").alias("x")).select(
        "job", "template_id", "node_id", "role", "__open", "x.row", "x.column", "x.raw"
    ).withColumn("format", F.coalesce(fmt, F.lit("text")))
    typed = cells.withColumn("__typed", X.coerce(F.col("raw"), F.col("format")))
    return instructions, typed.select(
        "job", "template_id", "node_id", "role", "row", "column",
        F.when(F.col("__typed.ok"), X.to_display(F.col("__typed"))).otherwise(F.col("raw")).alias("value"),
        "format", F.col("__typed.ok").alias("ok"),
    )


def fill_plan(
    jobs: DataFrame, fields: DataFrame, tables: DataFrame, facts: DataFrame, collections: DataFrame, policy: Policy = Policy()
) -> DataFrame:
    """All instructions of all jobs."""
    first = plan_fields(match_facts(jobs, fields, facts, collections), policy)
    second, _ = plan_tables(match_collections(jobs, tables, facts, collections), policy)
    return first.unionByName(second.drop("coverage", "columns_used"))
