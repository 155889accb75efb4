"""Items of a requirements document out of a knowledge base: sections, notes and steps of every code, put together per scope.

A code's passages are as many as they are, so nothing gathers them. A section is found passage by passage and only the
passages that it runs over are joined; notes and steps are the first few of a code by an aggregate and a rank that keeps
a few rows per code in each map task. Items are built once per scope, not per query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import passages as P, text as T
from quire.operators.knowledge import features, kb_group_chunks, kb_scope, kb_score
from quire.sources.staged import staged

# --- fixed values: lengths of lists and texts -----------------------------------------------------
NOTES, FLOW, REQUIREMENTS, BORROWED, OVERVIEW = 6, 8, 12, 3, 800
# --------------------------------------------------------------------------------------------------
CODE = ("root", "code")


def _first(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], n: int, out: str, distinct: bool = True) -> DataFrame:
    """The first ``n`` values of each key as an array, equal values once."""
    if distinct:
        rows = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("__o"))
    else:
        rows = rows.select(*keys, value, F.struct(*order).alias("__o"))
    ranked = rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy("__o", value))).where(F.col("__k") <= n)
    # at most n values a key
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", value))).alias("__v")).select(*keys, F.col("__v")[value].alias(out))


def kb_sections(blobs: DataFrame, heading: str, out: str) -> DataFrame:
    """The section under the first ``heading`` of each code, over passages (root, code, slide_number, blob) in slide order.

    It ends at the next of the fixed headings at the start of a line, however many passages later; it is one cell.
    """
    headed = blobs.where(F.col("blob").rlike(f"(?i){heading}")).select(
        *CODE, "slide_number", F.struct(P.after_heading(F.col("blob"), heading).alias("body"), P.ends_section(F.col("blob"), heading).alias("closed")).alias("h")
    )
    start = headed.groupBy(*CODE).agg(F.min(F.struct("slide_number", "h")).alias("s")).select(
        *CODE, F.col("s.slide_number").alias("from"), "s.h.body", "s.h.closed"
    )
    later = blobs.join(start.where("not closed"), list(CODE)).where(F.col("slide_number") > F.col("from"))
    following = later.groupBy(*CODE).agg(F.min("slide_number").alias("next"))
    inside = (T.strip(F.col("body")) == "") & (F.col("slide_number") == F.col("next"))
    read = later.join(following, list(CODE)).withColumns(
        {
            "lead": F.when(inside, P.before_stop(F.col("blob"), True)).otherwise(P.before_stop(F.col("blob"))),
            "stops": F.when(inside, P.has_stop(F.col("blob"), True)).otherwise(P.has_stop(F.col("blob"))),
        }
    )
    end = read.groupBy(*CODE).agg(F.min(F.when(F.col("stops"), F.col("slide_number"))).alias("to"))
    run = read.join(end, list(CODE)).where(F.col("to").isNull() | (F.col("slide_number") <= F.col("to")))
    more = run.groupBy(*CODE).agg(F.array_join(F.array_sort(F.collect_list(F.struct("slide_number", "lead")))["lead"], "\n").alias("more"))
    return start.join(more, list(CODE), "left").select(*CODE, P.section_body(F.concat_ws("\n", "body", "more")).alias(out))


def kb_requirements(chunks: DataFrame, n: int = REQUIREMENTS) -> DataFrame:
    """First ``n`` numbered requirements of each root, by slide and line: root, requirements."""
    rows = chunks.where("category = 'hq_requirement'").select("root", "slide_number", F.posexplode(P.requirements(F.col("content"))).alias("line", "text"))
    return _first(rows, ["root"], "text", ["slide_number", "line"], n, "requirements", distinct=False)


def kb_codes(chunks: DataFrame) -> DataFrame:
    """What the passages of each code say: root, code, description, preconditions, notes, flow (null or empty where they don't).

    The description is the overview section, else the longest line of the first passage that has one of forty
    characters, else the start of the first passage.
    """
    lines = P.useful_lines(F.col("title"), F.col("content"))
    read = kb_group_chunks(chunks).select(*CODE, "slide_number", lines.alias("lines"))
    blobs = staged(read.withColumn("blob", F.array_join("lines", "\n")).where("blob <> ''"), "passages")
    long = P.longest(F.col("lines"))
    plain = blobs.select(*CODE, "slide_number", F.when(F.length(long) >= P.PARAGRAPH, long).alias("para"), F.substring(P.squeeze(F.col("blob")), 1, P.SHORT_TEXT).alias("short"))
    spoken = plain.groupBy(*CODE).agg(
        F.min(F.when(F.col("para").isNotNull(), F.struct("slide_number", "para")))["para"].alias("para"), F.min(F.struct("slide_number", "short"))["short"].alias("short")
    )
    notes = _first(blobs.select(*CODE, "slide_number", F.posexplode(P.note_lines(F.col("lines"))).alias("line", "note")), CODE, "note", ["slide_number", "line"], NOTES, "notes")
    flow = _first(blobs.select(*CODE, "slide_number", F.posexplode(P.step_lines(F.col("lines"))).alias("line", "step")), CODE, "step", ["slide_number", "line"], FLOW, "flow")
    whole = spoken
    for part in (kb_sections(blobs, "Overview", "overview"), kb_sections(blobs, "Preconditions", "preconditions"), notes, flow):
        whole = whole.join(part, list(CODE), "left")
    none = F.array().cast("array<string>")
    return whole.select(
        *CODE, F.coalesce(F.nullif("overview", F.lit("")), "para", "short").alias("description"), F.nullif("preconditions", F.lit("")).alias("preconditions"),
        F.coalesce("notes", none).alias("notes"), F.coalesce("flow", none).alias("flow"),
    )


def _acceptance(borrowed: Column) -> Column:
    """Preconditions and notes, the borrowed requirements where there are none, as one text."""
    own = F.concat(F.array_compact(F.array("preconditions")), F.coalesce("notes", F.array().cast("array<string>")))
    taken = F.when(F.size(own) > 0, own).otherwise(borrowed)
    return F.array_join(F.slice(F.array_distinct(taken), 1, NOTES), " ; ")


def kb_items(scopes: DataFrame, steps: DataFrame, chunks: DataFrame, domains: DataFrame, covered: str) -> DataFrame:
    """The items of each scope (root, scope): an array of (type, name, description, acceptance, flow), the scope's own first.

    Below it come the steps one level down; without any, the further steps of the scope's own code. ``covered`` is the acceptance of a
    scope of which nothing else is known.
    """
    wanted = scopes.select("root", "scope").distinct()
    prefixes = steps.select("root", "pos", "code", "name", F.explode(F.sequence(F.lit(2), F.length("code"))).alias("n")).select(
        "root", "pos", "name", (F.col("n") < F.length("code")).alias("longer"), F.substring("code", F.lit(1), F.col("n")).alias("scope")
    )
    named = prefixes.groupBy("root", "scope").agg(F.min(F.struct("longer", "pos", "name")).alias("s")).select("root", "scope", F.col("s.name").alias("name"))
    # a step of the scope's own code names it, else the first step whose code begins like it, else the code itself
    epics = wanted.join(named, ["root", "scope"], "left").select(
        "root", "scope", F.lit(0).alias("k"), F.col("scope").alias("code"), F.coalesce("name", "scope").alias("name"), F.lit("Epic").alias("type")
    )
    below = features(steps, wanted).select("root", "scope", "k", "code", "name", F.lit("Feature").alias("type"))
    # a code that stands twice in the map is its own list of features
    own = steps.join(wanted.select("root", F.col("scope").alias("code")), ["root", "code"], "left_semi").withColumn(
        "k", F.row_number().over(W.partitionBy("root", "code").orderBy("pos"))
    ).where("k <= 16")
    twice = own.groupBy("root", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(below.select("root", F.col("scope").alias("code")).distinct(), ["root", "code"], "left_anti")
    repeated = own.join(twice.select("root", "code"), ["root", "code"], "left_semi").select("root", F.col("code").alias("scope"), "k", "code", "name", F.lit("Feature").alias("type"))
    rows = epics.unionByName(below).unionByName(repeated)
    children = _first(
        steps.where(T.code_depth(F.col("code")) > 1).select("root", T.code_parent(F.col("code")).alias("code"), "pos", F.concat_ws(" ", F.col("code"), "name").alias("step")),
        CODE, "step", ["pos"], FLOW, "children", distinct=False,
    )
    known = staged(kb_codes(chunks), "codes")
    about = domains.select("root", P.clean(F.col("overview")).alias("about"))
    joined = rows.join(known, list(CODE), "left").join(children, list(CODE), "left").join(kb_requirements(chunks), "root", "left").join(about, "root", "left")
    name = T.strip(F.concat_ws(" ", "code", "name"))
    none = F.array().cast("array<string>")
    epic = F.col("type") == "Epic"
    fallback = F.when(epic, F.coalesce(F.nullif("about", F.lit("")), name)).otherwise(F.concat(F.lit("Process step "), "code", F.lit(" "), "name", F.lit(".")))
    borrowed = F.when(epic, F.slice(F.coalesce("requirements", none), 1, BORROWED)).otherwise(none)
    item = F.struct(
        "k", "type", name.alias("name"), F.coalesce("description", fallback).alias("description"),
        F.when(epic, F.coalesce(F.nullif(_acceptance(borrowed), F.lit("")), F.lit(covered))).otherwise(_acceptance(borrowed)).alias("acceptance"),
        F.coalesce("children", "flow", none).alias("flow"),
    )
    made = joined.select("root", "scope", item.alias("item")).groupBy("root", "scope").agg(F.array_sort(F.collect_list("item")).alias("items"))
    drop_k = lambda i: F.struct(i["type"].alias("type"), i["name"].alias("name"), i["description"].alias("description"), i["acceptance"].alias("acceptance"), i["flow"].alias("flow"))
    return made.select("root", "scope", F.transform("items", drop_k).alias("items"))


def kb_retrieve(
    queries: DataFrame, domains: DataFrame, chunks: DataFrame, area_path: str = "", prepared_by: str = "", doc_code: str = "",
    covered: str = "The stages of the process map are covered.",
) -> DataFrame:
    """What the knowledge base suggests for each query (qid, text) that a domain fits; one row per such query.

    Domains are (ord, root, business_process, process_map, source_file, overview), one a root; chunks (root,
    slide_number, title, content, category, process_codes). Result: qid, root, scope, score, process_name, overview,
    area_path, prepared_by, doc_code, items. A null text fits nothing; empty tables give no rows.
    """
    steps = staged(domains.select("root", F.inline(P.map_steps(F.col("process_map")))), "steps")
    hay = F.concat(P.clean(F.col("business_process")), F.lit("\n"), F.coalesce("process_map", F.lit("")), F.lit("\n"), F.coalesce("source_file", F.lit("")))
    best = kb_score(queries, domains.select("ord", "root", hay.alias("hay")))
    picked = staged(best.join(queries, "qid"), "picked")
    scoped = staged(kb_scope(picked, steps).join(picked.select("qid", "score"), "qid"), "scopes")
    items = kb_items(scoped, steps, chunks, domains, covered)
    head = P.clean(F.get(T.lines(F.coalesce("process_map", F.lit(""))), F.lit(0)))
    process = P.clean(F.col("business_process"))
    about = domains.select(
        "root", F.when(process != "", F.concat(F.lit("Cycle: "), process, F.lit("."))).alias("cycle"), F.when(head != "", F.concat(F.lit("Process map: "), head, F.lit("."))).alias("map")
    )
    epic = F.get("items", F.lit(0))
    overview = F.substring(P.squeeze(F.concat_ws(" ", F.nullif(T.strip(epic["description"]), F.lit("")), "cycle", "map")), 1, OVERVIEW)
    suggested = items.join(about, "root").select(
        "root", "scope", epic["name"].alias("process_name"), overview.alias("overview"), F.lit(area_path).alias("area_path"), F.lit(prepared_by).alias("prepared_by"),
        F.lit(doc_code).alias("doc_code"), "items",
    )
    return scoped.join(staged(suggested, "suggested"), ["root", "scope"]).select("qid", "root", "scope", "score", *suggested.columns[2:])
