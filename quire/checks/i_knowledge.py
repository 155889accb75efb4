"""Knowledge base, line tables, sessions, audit feed, mail merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.bridge import kb as K, notes as N, views as V
from quire.bridge.sql import with_views
from quire.checks import check
from quire.functions import passages as P, text as T
from quire.operators import knowledge as KB, lines as LN
from quire.plans import merge as M, retrieve as R
from quire.sources.tables import spread, table

@check(
    "jn14_under",
    with_views("ksteps", "select code, concat(split_part(code, '.', 1), '.', split_part(code, '.', 2)) as scope from ksteps where cast(split_part(code, '.', 2) as int) % 2 = 0"),
)
def _(spark, folder):
    rows = K.step_rows(spark, folder)
    two = F.array_join(F.slice(T.code_parts(F.col("code")), 1, 2), ".")
    scopes = rows.where(T.code_parts(F.col("code"))[1].cast("int") % 2 == 0).select(two.alias("scope")).distinct()
    return KB.under(rows, scopes).select("code", "scope")


def map_steps(spark, folder):
    return K.domains(spark, folder).select("root", F.inline(P.map_steps(F.col("process_map"))))


@check(
    "jn14_features",
    with_views("ksteps", "select root, scope, code, name, k::int as k from (select root, array_to_string(string_split(code, '.')[1:len(string_split(code, '.')) - 1], '.') as scope, code, name, "
               "row_number() over (partition by root, array_to_string(string_split(code, '.')[1:len(string_split(code, '.')) - 1], '.') order by pos) as k from ksteps) where k <= 16"),
)
def _(spark, folder):
    steps = map_steps(spark, folder)
    scopes = steps.select("root", T.code_parent(F.col("code")).alias("scope")).unionByName(steps.select("root", F.col("code").alias("scope")))
    return KB.features(steps, scopes).select("root", "scope", "k", "code", "name")


@check("ag18_kb_group_chunks", with_views("kgroup", "select root, slide_number, code from kgroup"))
def _(spark, folder):
    return KB.kb_group_chunks(K.chunks(spark, folder)).select("root", "slide_number", "code")


@check("fn36_useful_text", with_views("kuse", "select slide_number, array_to_string(ls, chr(10)) as body from kuse"))
def _(spark, folder):
    rows = KB.kb_group_chunks(K.chunks(spark, folder))
    return rows.select("slide_number", P.useful_text(F.col("title"), F.col("content")).alias("body"))


@check("fn36_kb_codes", with_views("kcodes", "select root, code, description, pre as preconditions, array_to_string(notes, ' ; ') as notes, array_to_string(flow, ' > ') as flow from kcodes"))
def _(spark, folder):
    made = R.kb_codes(K.chunks(spark, folder))
    return made.select("root", "code", "description", "preconditions", F.array_join("notes", " ; ").alias("notes"), F.array_join("flow", " > ").alias("flow"))


@check("fn36_kb_requirements", with_views("khq", "select root, array_to_string(hq, chr(10)) as requirements from khq"))
def _(spark, folder):
    return R.kb_requirements(K.chunks(spark, folder)).select("root", F.array_join("requirements", "\n").alias("requirements"))


@check(
    "tk07_kb_passages",
    with_views(
        "kuse",
        "select qid, slide_number, body from (select q.qid, slide_number, body, row_number() over (partition by q.qid order by slide_number) as k from "
        "(select *, array_to_string(ls, chr(10)) as body from kuse where category <> 'document_control' and length(array_to_string(ls, chr(10))) >= 20) g "
        "join (select n_nationkey as qid, root, case when n_nationkey % 3 = 0 then root when n_nationkey % 3 = 1 then code else code || '.001' end as scope from kn) q on g.root = q.root "
        "and (g.code = q.scope or starts_with(g.code, q.scope || '.') or starts_with(q.scope, g.code || '.'))) where k <= 12",
    ),
)
def _(spark, folder):
    key = F.col("n_nationkey")
    scope = F.when(key % 3 == 0, F.col("root")).when(key % 3 == 1, F.col("code")).otherwise(F.concat("code", F.lit(".001")))
    scopes = K.nations(spark, folder).select(key.alias("qid"), "root", scope.alias("scope"))
    return KB.kb_passages(K.chunks(spark, folder), scopes).select("qid", "slide_number", "body")


def scored(spark, folder):
    hay = F.concat("business_process", F.lit("\n"), "process_map", F.lit("\n"), "source_file")
    return KB.kb_score(K.queries(spark, folder), K.domains(spark, folder).select("ord", "root", hay.alias("hay")))


@check("jn13_kb_score", with_views("kbest", "select qid, root, cast(score as bigint) as score from kbest join kdom using (ord)"))
def _(spark, folder):
    return scored(spark, folder).select("qid", "root", "score")


@check("tk06_kb_scope", with_views("kscope", "select qid, root, scope from kscope"))
def _(spark, folder):
    return KB.kb_scope(scored(spark, folder).join(K.queries(spark, folder), "qid"), map_steps(spark, folder))


def suggestions(spark, folder):
    return R.kb_retrieve(K.queries(spark, folder), K.domains(spark, folder), K.chunks(spark, folder), "area", "the desk", "form 7")


_OVERVIEW = "left(trim(regexp_replace(concat_ws(' ', nullif(trim(description), ''), 'Cycle: ' || bp || '.', 'Process map: ' || head || '.'), '\\s+', ' ', 'g')), 800)"


@check(
    "cq23_kb_retrieve",
    with_views("kitems", f"select qid, s.root, s.scope, cast(score as bigint) as score, e.name as process_name, e.overview, i.k::int as k, i.type, i.name, i.description, i.acceptance, i.flow from kscope s "
               f"join (select root, scope, name, {_OVERVIEW} as overview from kitems join kdom using (root) where k = 0) e on e.root = s.root and e.scope = s.scope join kitems i on i.root = s.root and i.scope = s.scope"),
)
def _(spark, folder):
    made = suggestions(spark, folder)
    rows = made.select("qid", "root", "scope", "score", "process_name", "overview", F.posexplode("items").alias("k", "i"))
    return rows.select(*rows.columns[:-1], "i.type", "i.name", "i.description", "i.acceptance", F.array_join("i.flow", " > ").alias("flow"))


_ITEM = "struct<type:string,name:string,description:string,acceptance:string,flow:array<string>>"


def contexts(spark, folder):
    """A context a customer: fields written, blank or missing; no items, thin ones, one that names a code, full ones."""
    joined = table(spark, folder, "customer").join(K.nations(spark, folder), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("qid"),
        F.expr("case when c_custkey % 3 = 0 then 'Own process' when c_custkey % 3 = 1 then ' ' end").alias("process_name"), F.expr("case when c_custkey % 2 = 0 then 'brief' else 'long enough' end").alias("overview"),
        F.expr("cast(null as string)").alias("area_path"), F.lit("me").alias("prepared_by"), F.expr("case when c_custkey % 5 = 0 then '' else 'mine' end").alias("doc_code"),
        F.expr(
            f"cast(case c_custkey % 6 when 0 then array() when 1 then array(named_struct('type', 'Feature', 'name', name, 'description', 'thin', 'acceptance', cast(null as string), 'flow', cast(array() as array<string>))) "
            "when 2 then array(named_struct('type', 'Feature', 'name', concat('see ', code), 'description', 'A description that is long enough', 'acceptance', '', 'flow', array('one'))) "
            f"when 3 then cast(null as array<{_ITEM}>) else array(named_struct('type', 'Epic', 'name', 'zzz', 'description', 'A description that is long enough', 'acceptance', 'accepted by all', 'flow', array('one'))) end as array<{_ITEM}>)"
        ).alias("items"),
    )


@check(
    "jn25_enrich_context",
    with_views(
        "kitems",
        "select c.qid, case when e.scope is not null and trim(coalesce(c.process_name, '')) = '' then e.name else c.process_name end as process_name, case when e.scope is not null and length(c.overview) < 8 then e.overview else c.overview end as overview, "
        "case when e.scope is not null then 'area' end as area_path, 'me' as prepared_by, case when e.scope is not null and doc_code = '' then 'form 7' else doc_code end as doc_code, "
        # lists that become the suggested ones; else the one item with the acceptance of its best suggestion
        "case when n_items = 0 then (case when e.scope is null then '' else e.every end) when e.scope is null then own when kind = 1 and e.n > 1 then e.every "
        "when kind = 1 and b.points >= 2 then c.name || '|' || coalesce(nullif(b.description, ''), 'thin') || '|' || coalesce(nullif(b.acceptance, ''), '') || '|' || b.flow "
        "when kind = 2 and b.points >= 2 then 'see ' || c.code || '|A description that is long enough|' || b.acceptance || '|one' else own end as items, "
        "concat_ws(',', case when e.scope is not null and trim(coalesce(c.process_name, '')) = '' then 'process_name' end, case when e.scope is not null and length(c.overview) < 8 then 'overview' end, case when e.scope is not null then 'area_path' end, "
        "case when e.scope is not null and doc_code = '' then 'doc_code' end, case when e.scope is not null and (n_items = 0 or (kind = 1 and e.n > 1) or (kind = 1 and b.points >= 2 and (coalesce(nullif(b.description, ''), 'thin') <> 'thin' or b.acceptance <> '' or b.flow <> '')) "
        "or (kind = 2 and b.points >= 2 and b.acceptance <> '')) then 'items' end) as filled "
        "from c left join kscope s on s.qid = c.qid left join e on e.root = s.root and e.scope = s.scope left join (select qid, arg_max({'points': points, 'description': description, 'acceptance': acceptance, 'flow': flow}, {'p': points, 'k': -k}) as b from rated group by 1) r on r.qid = c.qid",
        c="select c_custkey as qid, code, name, c_custkey % 6 as kind, case when c_custkey % 6 in (0, 3) then 0 else 1 end as n_items, case when c_custkey % 3 = 0 then 'Own process' when c_custkey % 3 = 1 then ' ' end as process_name, "
        "case when c_custkey % 2 = 0 then 'brief' else 'long enough' end as overview, case when c_custkey % 5 = 0 then '' else 'mine' end as doc_code, "
        "case c_custkey % 6 when 1 then name || '|thin||' when 2 then 'see ' || code || '|A description that is long enough||one' else 'zzz|A description that is long enough|accepted by all|one' end as own from customer join kn on n_nationkey = c_nationkey",
        e=f"select i.root, scope, max(i.name) filter (k = 0) as name, max({_OVERVIEW}) filter (k = 0) as overview, count(*) as n, string_agg(i.name || '|' || description || '|' || acceptance || '|' || flow, ' && ' order by k) as every from kitems i join kdom using (root) group by 1, 2",
        rated="select c.qid, k, description, acceptance, flow, case when kind = 2 and contains(lower(i.name || ' ' || description), c.code) then 10 else 0 end + (select count(*) from (select distinct unnest(regexp_extract_all(lower(case when kind = 1 then c.name else 'see ' || c.code end), '[a-z0-9]{4,}')) as t) a "
        "where list_contains(regexp_extract_all(lower(i.name || ' ' || description), '[a-z0-9]{4,}'), a.t) and a.t not in ('with', 'from', 'that', 'this', 'process')) as points "
        "from c join kscope s on s.qid = c.qid join kitems i on i.root = s.root and i.scope = s.scope where kind in (1, 2)",
    ),
)
def _(spark, folder):
    rich = KB.enrich_context(contexts(spark, folder), suggestions(spark, folder), ["qid"])
    flat = F.transform(F.coalesce("items", F.expr(f"cast(array() as array<{_ITEM}>)")), lambda i: F.concat_ws("|", i["name"], i["description"], F.coalesce(i["acceptance"], F.lit("")), F.array_join(i["flow"], " > ")))
    return rich.select("qid", "process_name", "overview", "area_path", "prepared_by", "doc_code", F.array_join(flat, " && ").alias("items"), F.array_join("filled", ",").alias("filled"))


@check(
    "jn24_enrich_items",
    "select p_partkey as doc_id, 0 as ord, case when p_size % 2 = 0 then concat('From the knowledge base on ', p_type) else 'A description that is long enough' end as description, "
    "case when p_size % 2 = 0 then 'kb acceptance' else 'user acceptance text' end as acceptance from part",
)
def _(spark, folder):
    # every item is compared with all suggestions of its scope: the short rows are dealt over all tasks before that
    parts = spread(table(spark, folder, "part"), "p_partkey")
    own = F.col("p_size") % 2 == 0
    items = parts.select(
        F.col("p_partkey").alias("doc_id"), F.lit(0).alias("ord"), (F.col("p_partkey") % 3).alias("scope"), F.lit("Feature").alias("type"), F.concat(F.lower("p_type"), F.lit(" handling steps")).alias("name"),
        F.when(own, "short").otherwise("A description that is long enough").alias("description"),
        F.when(own, "").otherwise("user acceptance text").alias("acceptance"), F.array().cast("array<string>").alias("flow"),
    )
    # the types are suggested to each of three scopes, in another order each
    named = parts.select((F.col("p_partkey") % 3).alias("scope"), "p_type").distinct()
    every = named.select("scope").distinct().join(named.select("p_type").distinct(), F.lit(True))
    row = F.struct(
        F.lit("Feature").alias("type"), F.concat(F.lower("p_type"), F.lit(" handling")).alias("name"), F.concat(F.lit("From the knowledge base on "), "p_type").alias("description"),
        F.lit("kb acceptance").alias("acceptance"), F.array(F.lit("one"), F.lit("two")).alias("flow"),
    )
    suggested = every.select("scope", F.struct(F.hash("scope", "p_type").alias("o"), row.alias("row")).alias("r")).groupBy("scope").agg(F.array_sort(F.collect_list("r"))["row"].alias("suggested"))
    # three rows go to the items; items moved to three scopes would stand in three tasks
    return KB.enrich_items(items, F.broadcast(suggested), ["scope"]).select("doc_id", "ord", "description", "acceptance")


def note_lines(spark, folder):
    return T.line_table(N.general_notes(spark, folder).select("doc_id", "text"), ["doc_id"], "text")


_LINES = "select doc_id, unnest(range(len(a))) as line_no, trim(unnest(a)) as line from (select doc_id, string_split(text, chr(10)) as a from notes)"


@check(
    "wn05_carry_heading",
    with_views(
        "notes",
        "select doc_id, line_no, last_value(case when line in ('Action items:', 'Items:', 'Summary:') then replace(line, ':', '') end ignore nulls) over (partition by doc_id order by line_no) as heading from lns",
        lns=_LINES,
    ),
)
def _(spark, folder):
    return LN.carry_heading(note_lines(spark, folder)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "heading")


_CLASS = "case when line = '' then 'blank' when regexp_matches(line, '^[-*] ') then 'bullet' when contains(line, '|') then 'table' when line in ('Action items:', 'Items:', 'Summary:') then 'heading' else 'text' end"


@check(
    "wn06_block_runs",
    with_views(
        "notes",
        "select doc_id, class, min(line_no) as first, max(line_no) as last, count(*) as n from (select *, sum(s) over (partition by doc_id order by line_no) as block from "
        "(select *, case when class is not distinct from lag(class) over (partition by doc_id order by line_no) then 0 else 1 end as s from c)) where class <> 'blank' group by doc_id, block, class",
        lns=_LINES, c=f"select doc_id, line_no, {_CLASS} as class from lns",
    ),
)
def _(spark, folder):
    runs = LN.block_runs(note_lines(spark, folder))
    return runs.select("doc_id", "class", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "n")


@check(
    "wn14_label_block_pairs",
    "select unnest([p_partkey, p_partkey]) as doc_id, unnest([0, 2]) as line_no, unnest([p_name, p_brand]) as label, unnest(['block', 'inline']) as mode from part",
)
def _(spark, folder):
    text = F.concat("p_name", F.lit(":\n\n"), "p_brand", F.lit(": ____\n"), "p_type", F.lit(": filled\nLast:"))
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return LN.label_block_pairs(T.line_table(rows, ["doc_id"], "text"))


@check("tk09_audit_feed", "select event_id, user_id as template_id, event_type as action from events where user_id = 3")
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("user_id").alias("template_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    return LN.audit_feed(events, 3).drop("created_at")


@check(
    "cq12_mail_merge",
    with_views("tpl", "select p_partkey as template_id, trim(concat('Dear Mr ', p_brand, ', your  for ', p_type, '.')) as text from part"),
)
def _(spark, folder):
    rows = spread(table(spark, folder, "part"), "p_partkey").select(
        F.col("p_partkey").alias("template_id"), F.lit("Dear {{ name }}, your {{missing}} for [Item Kind].").alias("text"),
        F.create_map(F.lit("Name"), F.concat(F.lit("Mr "), "p_brand"), F.lit("Item Kind"), F.col("p_type")).alias("answers"),
    )
    return rows.select("template_id", T.clear_unresolved(T.fill_text(F.col("text"), F.col("answers"))).alias("text"))


@check(
    "cq12_merged_cells",
    "with p as (select p_partkey as doc, p_brand, p_type, p_size from part) "
    "select doc, 'S' as sheet, unnest([1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 5]) as r, unnest([1, 2, 1, 2, 3, 1, 2, 1, 2, 1, 2]) as c, "
    "unnest(['Customer Name:', 'Mr ' || p_brand, 'Item Kind', p_type, 'left', 'Status', '-', 'Dear Mr ' || p_brand, '', 'Kind of Mr ' || p_brand, 'of ' || p_type]) as text, "
    "unnest([null, 'neighbour', null, 'neighbour', null, null, null, 'placeholder', null, 'placeholder', 'placeholder']) as filled from p",
)
def _(spark, folder):
    made = ((1, 1, "Customer Name:"), (1, 2, "  "), (2, 1, "Item Kind"), (2, 2, "[fill in]"), (2, 3, "left"), (3, 1, "Status"), (3, 2, "-"), (4, 1, "Dear {{ Customer Name }}"), (4, 2, ""), (5, 1, "Kind of <<customer_name>>"), (5, 2, "of [Item Kind]"))
    grid = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(t).alias("text")) for r, c, t in made])
    parts = table(spark, folder, "part")
    cells = parts.select((F.col("p_size") % 2).alias("template_id")).distinct().select("template_id", F.lit("S").alias("sheet"), F.explode(grid).alias("x")).select("template_id", "sheet", "x.*")
    answers = F.create_map(F.lit("Customer Name"), F.concat(F.lit("Mr "), "p_brand"), F.lit("Item Kind"), F.col("p_type"), F.lit("status"), F.lit(""))
    return M.merged_cells(cells, parts.select(F.col("p_partkey").alias("doc"), (F.col("p_size") % 2).alias("template_id"), answers.alias("answers")))


@check(
    "cq12_generated_files",
    with_views(
        "vers",
        "select part as doc, name as stem, concat('documents/generated/', strftime(created_at, '%Y/%m/%d'), '/', name) as x from (select part, created_at, concat(regexp_replace(split_part(s3_key, '/', -1), '\\.[^.]*$', ''), '_', strftime(created_at, '%Y%m%d_%H%M%S'), "
        "regexp_extract(s3_key, '(\\.[^./]*)$', 1)) as name from vers)",
    ),
)
def _(spark, folder):
    docs = V.versions(spark, folder).select(
        F.col("part").alias("doc"), F.col("s3_key").alias("key"), F.col("created_at").alias("at"), F.lit("").alias("generated_by"), F.lit("").alias("template_id"), F.lit("").alias("template_name"), F.lit(None).cast("string").alias("template_version")
    )
    return M.generated_files(docs, "documents/generated/").select("doc", F.col("name").alias("stem"), F.col("s3_key").alias("x"))
