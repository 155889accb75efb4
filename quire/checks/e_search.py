"""Search, profile choice, slots, answers, slides."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import profiles as P
from quire.bridge import notes as N, sqlfn as Q, views as V
from quire.bridge.sql import with_views
from quire.checks import check
from quire.checks.a_inventory import inv1
from quire.checks.b_catalog import ver_versions
from quire.checks.d_forms import head_sql
from quire.functions import keys as K, text as T
from quire.operators import answers as A, catalog as C, search as S
from quire.plans import forms, slides
from quire.sources.tables import table

_POOL = (
    f"select key, name, lower(concat(key, ' ', name)) as hay from inv1 where {Q.area('key')} = 'templates' and {Q.ext('name')} in ('docx', 'pptx', 'xlsx')"
)


@check(
    "tk03_keyword_search",
    with_views(
        "inv1",
        "select key, score from (select *, case when contains(hay, 'red_widget v2.1') then 8 else 0 end + case when contains(hay, 'red_widget') then 3 else 0 end "
        "+ case when contains(hay, 'v2.1') then 3 else 0 end as score from p) where score > 0 order by score desc, lower(name), key limit 25",
        p=_POOL,
    ),
)
def _(spark, folder):
    return S.keyword_search(C.office_objects(inv1(spark, folder)), " Red_Widget V2.1").select("key", "score")


@check(
    "tk03_keyword_search_pages",
    "select page_id, score from (select *, case when contains(hay, 'the data of') then 8 else 0 end + case when contains(hay, 'the') then 3 else 0 end "
    "+ case when contains(hay, 'data') then 3 else 0 end + case when contains(hay, 'of') then 3 else 0 end as score from "
    "(select page_id, url, lower(concat(html, ' ', url)) as hay from pages)) where score > 0 order by score desc, lower(url), page_id limit 25",
)
def _(spark, folder):
    pool = table(spark, folder, "pages").select("page_id", F.col("html").alias("key"), F.col("url").alias("name"))
    found = S.keyword_search(pool.withColumn("text", F.col("key")), "the data of", 10**6)
    return found.orderBy(F.desc("score"), F.lower("name"), "page_id").limit(25).select("page_id", "score")


@check(
    "pf14_contains_search",
    with_views(
        "vers",
        "select template_id, version from vers where contains(lower(concat_ws(' ', template_id, changelog, concat('v', version), case when status = 'published' then 'active' end)), 'v1.1')",
    ),
)
def _(spark, folder):
    columns = [
        F.col("template_id"), F.col("changelog"), F.concat(F.lit("v"), "version"), F.when(F.col("status") == "published", "active"),
    ]
    return S.contains_search(V.versions(spark, folder), columns, " V1.1 ").select("template_id", "version")


_NAMES = (
    "case p_partkey % 8 when 0 then 'MOM Sample.xlsx' when 1 then 'bfl_template.xlsx' when 2 then concat('POC List sample ', p_name, '.xlsx') when 3 then concat('BRD Sample.', lower(p_type)) "
    "when 4 then 'Sample_ppt.pptx' when 5 then concat('meeting minutes ', p_name, '.xlsx') when 6 then concat(replace(p_name, ' ', '_'), '.docx') else concat('business requirement ', p_name, '.docx') end"
)


def named_files(spark, folder):
    return table(spark, folder, "part").select(
        F.concat(F.lit("f"), F.col("p_partkey")).alias("id"), F.expr(_NAMES).alias("filename"), F.col("p_name").alias("name"),
        F.col("p_partkey").alias("ord"),
    )


def _score_sql(p: P.Profile, name: str) -> str:
    hay = f"lower(trim(regexp_replace(concat(filename, ' ', {name}, ' ', id), '[\\s._-]+', ' ', 'g')))"
    sample = p.sample_file.rsplit(".", 1)[0].replace("_", " ").lower()
    parts = [
        f"case when contains({hay}, '{sample}') then 100 else 0 end", f"case when contains({hay}, 'sample') then 25 else 0 end",
        f"case when contains({hay}, 'template') and not contains({hay}, 'sample') then -8 else 0 end",
        *[f"case when contains({hay}, '{h}') then 20 else 0 end" for h in p.hints],
        *[f"case when contains(concat(' ', {hay}, ' '), ' {t} ') then 12 else 0 end" for t in p.tokens],
    ]
    exts = ", ".join(f"'{e}'" for e in p.extensions)
    return f"case when {Q.ext('filename')} in ({exts}) then {' + '.join(parts)} else 0 end"


_SCORED = " union all ".join(
    f"select id, filename, name, ord, {i} as porder, '{p.id}' as profile_id, '{p.name}' as pname, {_score_sql(p, 'name')} as score, {_score_sql(p, repr(p.name))} as pscore from files"
    for i, p in enumerate(P.PROFILES)
)
_PROF = dict(
    files=f"select concat('f', p_partkey) as id, {_NAMES} as filename, p_name as name, p_partkey as ord from part",
    scored=_SCORED,
    best="select * from (select *, row_number() over (partition by id order by score desc, porder) as k from scored) where k = 1",
    top="select * from (select *, row_number() over (partition by profile_id order by pscore desc, ord) as t from best where score >= 12) where t = 1",
)


@check("tk04_best_profile", with_views("", "select id, case when score >= 12 then profile_id end as profile_id, case when score >= 12 then score end as match_score from best", **_PROF))
def _(spark, folder):
    return S.best_profile(named_files(spark, folder)).select("id", "profile_id", "match_score")


@check("tk05_best_file_per_profile", with_views("", "select profile_id, id, pscore as profile_score from top", **_PROF))
def _(spark, folder):
    return S.best_file_per_profile(S.annotate(named_files(spark, folder))).select("profile_id", "id", "profile_score")


_EXTRA = f"select id, {Q.pretty('filename')} as shown_name from best where id not in (select id from top)"


@check("jn22_guided_extras", with_views("", _EXTRA, **_PROF))
def _(spark, folder):
    annotated = S.annotate(named_files(spark, folder))
    return S.guided_extras(annotated, S.best_file_per_profile(annotated)).select("id", "shown_name")


@check(
    "cq24_profile_catalog",
    with_views(
        "",
        "select id, pname as shown_name, profile_id, true as guided, porder as section from top union all "
        f"select id, {Q.pretty('filename')}, case when score >= 12 then profile_id end, false, 5 from best where id not in (select id from top)",
        **_PROF,
    ),
)
def _(spark, folder):
    return S.profile_catalog(named_files(spark, folder))


@check(
    "ud05_profile_registry",
    with_views(
        "",
        "select id, name, format, entry_mode, coalesce(n, 0) as files from (select * from (values "
        + ", ".join(
            f"('{p.id}', '{p.name}', '{p.format}', '{'form' if p.id in P.FORM_PROFILES else 'chat'}')" for p in P.PROFILES
        )
        + ", ('extra', 'Extra', 'docx', 'chat')) as r(id, name, format, entry_mode)) left join (select profile_id, count(*) as n from best where score >= 12 group by 1) on profile_id = id",
        **_PROF,
    ),
)
def _(spark, folder):
    extra = P.Profile("extra", "Extra", "Extra.docx", "docx", ("never so named",), ("neverso",), ("docx",))
    registry = P.profile_table(spark, [*P.PROFILES, extra])
    used = S.best_profile(named_files(spark, folder), [*P.PROFILES, extra]).groupBy(F.col("profile_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return registry.join(used, "id", "left").select("id", "name", "format", "entry_mode", F.coalesce("n", F.lit(0)).cast("bigint").alias("files"))


_SLOTS_SQL = "select * from (values " + ", ".join(
    f"({i}, '{s.profile}', '{s.id}', '{(s.label or '').replace(chr(39), chr(39) * 2)}', '{s.type}', {str(s.required).lower()}, {s.ask_priority})"
    for i, s in enumerate(P.SLOTS)
) + ") as t(pos, profile, id, label, type, required, ask_priority)"


@check(
    "pf21_project_fields",
    with_views(
        "",
        "select template_id, id, label, concat(label, '?') as question, required, type as field_type from (select o_orderkey as template_id, "
        "case o_orderkey % 5 when 0 then 'mom' when 1 then 'bfl' when 2 then 'poc_list' when 3 then 'brd' else 'sample_ppt' end as profile from orders) join slots using (profile)",
        slots=_SLOTS_SQL,
    ),
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("template_id"),
        F.element_at(F.array(*[F.lit(p.id) for p in P.PROFILES]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("profile"),
    )
    fields = A.project_fields(P.slot_table(spark))
    return rows.join(fields, "profile").select("template_id", "id", "label", "question", "required", "field_type")


@check(
    "tk10_order_by_priority",
    with_views(
        "",
        "select doc_id, id as next_id from (select doc_id, id, row_number() over (partition by doc_id order by ask_priority desc, pos) k from (select o_orderkey as doc_id, o_orderkey % 8 as skip from orders) "
        "join (select *, row_number() over (order by ask_priority desc, pos) - 1 as r from slots where profile = 'mom') on r >= skip) where k = 1",
        slots=_SLOTS_SQL,
    ),
)
def _(spark, folder):
    # the first question still open when the ``skip`` most urgent ones are answered
    ordered = [s.id for s in sorted(P.slots_of("mom"), key=lambda s: -s.ask_priority)]
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 8).alias("skip"))
    slots = A.order_by_priority(P.slot_table(spark).where("profile = 'mom'"))
    ranked = slots.agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("ask_priority")).alias("p"), "pos", "id"))), lambda s: s["id"]).alias("ids")
    ).scalar()
    assert ordered
    return rows.select("doc_id", F.get(ranked, F.col("skip").cast("int")).alias("next_id"))


def answers(spark, folder):
    """Answer maps with mixed key spellings and empty values, one per order."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, folder, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey"))
    key = F.col("o_orderkey") % 3
    return orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.create_map(
            F.lit("venue"), F.when(key == 0, "").otherwise(F.col("c_mktsegment")), F.lit("Prepared By"), F.col("c_name"),
            F.lit("prepared_by"), F.lit("snake"), F.lit("Meeting date"), F.when(key == 1, "today").otherwise(""),
            F.lit("Action-Plan"), F.col("o_orderpriority"), F.lit("_hidden"), F.lit("x"), F.lit("Other"), F.col("o_orderstatus"),
        ).alias("answers"),
    )


_ANS = (
    "select o_orderkey as doc_id, o_orderkey % 3 as k, c_mktsegment, c_name, o_orderpriority, o_orderstatus from orders join customer on c_custkey = o_custkey"
)


@check(
    "pf22_normalize_keys",
    with_views(
        "",
        "select doc_id, 'venue' as slot, c_mktsegment as value from a where k <> 0 union all select doc_id, 'prepared_by', 'snake' from a union all "
        "select doc_id, 'meeting_date', 'today' from a where k = 1 union all select doc_id, 'action_items', o_orderpriority from a",
        a=_ANS,
    ),
)
def _(spark, folder):
    return A.normalize_keys(A.answer_rows(answers(spark, folder), ["doc_id"]), ["doc_id"], P.slots_of("mom"))


@check(
    "ag08_dedupe_answers",
    with_views(
        "",
        "select doc_id, 'venue' as id, 'venue' as label, c_mktsegment as value from a where k <> 0 union all select doc_id, 'prepared_by', 'Prepared By', c_name from a union all "
        "select doc_id, 'meeting_date', 'Meeting date', 'today' from a where k = 1 union all select doc_id, 'action_plan', 'Action-Plan', o_orderpriority from a "
        "union all select doc_id, 'hidden', 'Hidden', 'x' from a union all select doc_id, 'other', 'Other', o_orderstatus from a",
        a=_ANS,
    ),
)
def _(spark, folder):
    return A.dedupe_answers(A.answer_rows(answers(spark, folder), ["doc_id"]), ["doc_id"])


@check(
    "pf16_is_usable",
    with_views(
        "",
        "select doc_id, doc_id % 2 = 0 as all_preview, doc_id % 2 = 0 as venue_preview from a", a=_ANS,
    ),
)
def _(spark, folder):
    even = F.col("doc_id") % 2 == 0
    rows = answers(spark, folder).select(
        "doc_id",
        F.create_map(F.lit("venue"), F.when(even, "[Venue]").otherwise("Hall"), F.lit("when"), F.lit(""), F.lit("who"), F.when(even, " [Who] ").otherwise("[x]")).alias("m"),
    )
    return rows.select("doc_id", T.is_preview_row(F.col("m")).alias("all_preview"), (~T.is_usable(F.col("m")["venue"])).alias("venue_preview"))


@check(
    "st05_merge_context",
    with_views(
        "",
        "select doc_id, 'theme' as field, case when k = 0 then 'short' else c_mktsegment end as value, '' as items from a union all "
        "select doc_id, 'points', null, case when k = 1 then 'a,b' else concat(c_mktsegment, ',x,y') end from a union all "
        "select doc_id, 'reach', case when k = 2 then o_orderpriority else o_orderstatus end, '' from a union all select doc_id, 'new', c_name, '' from a",
        a=_ANS,
    ),
)
def _(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = table(spark, folder, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey") % 3
    none = F.lit(None).cast("array<string>")
    text = F.lit(None).cast("string")

    def cells(*pairs):
        return rows.select(
            F.col("o_orderkey").alias("doc_id"),
            F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), i.alias("items")) for f, v, i in pairs])).alias("c"),
        ).select("doc_id", "c.*")

    base = cells(
        ("theme", F.lit("short"), none), ("points", text, F.array(F.lit("a"), F.lit("b"))), ("reach", F.col("o_orderstatus"), none)
    )
    overlay = cells(
        ("theme", F.when(k == 0, F.repeat("c_mktsegment", 9)).otherwise(F.col("c_mktsegment")), none),
        ("points", text, F.when(k == 1, F.array("c_mktsegment")).otherwise(F.array(F.col("c_mktsegment"), F.lit("x"), F.lit("y")))),
        ("reach", F.when(k == 2, F.col("o_orderpriority")).otherwise(""), none), ("new", F.col("c_name"), none), ("_skip", F.lit("x"), none),
    )
    merged = A.merge_context(base, overlay, ["doc_id"])
    return merged.withColumn("items", F.coalesce(F.array_join("items", ","), F.lit("")))


@check(
    "ag19_required_progress",
    with_views(
        "",
        "select session_id, count(*) as total, count(*) filter (not done) as n_missing, coalesce(string_agg(label, ',' order by pos) filter (not done), '') as missing, "
        "arg_min(concat(label, '?'), pos) filter (not done) as next_question, case when count(*) filter (not done) > 0 then count(*) filter (done) + 1 end as step "
        "from (select a.doc_id as session_id, s.*, (s.id = 'venue' and k <> 0) or s.id = 'prepared_by' or (s.id = 'meeting_date' and k = 1) or (s.id = 'purpose' and o_orderstatus <> 'P') as done from a, slots s "
        "where s.profile = 'mom' and s.required) group by 1",
        a=_ANS, slots=_SLOTS_SQL,
    ),
)
def _(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = table(spark, folder, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey") % 3
    given = rows.select(
        F.col("o_orderkey").alias("session_id"),
        F.explode(
            F.create_map(
                F.lit("venue"), F.when(k == 0, " ").otherwise(F.col("c_mktsegment")), F.lit("Prepared by"), F.col("c_name"),
                F.lit("meeting_date"), F.when(k == 1, "today").otherwise(""), F.lit("Purpose / meeting title"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
            )
        ).alias("key", "value"),
    )
    sessions = rows.select(F.col("o_orderkey").alias("session_id"), F.lit("mom").alias("profile"))
    fields = P.slot_table(spark).select("profile", "id", "label", "question", "required", "pos")
    return A.required_progress(sessions, given, fields).withColumn("missing", F.array_join("missing", ","))


_V = (
    "select doc_id, 1 as slide, 'Theme' as label, 'content' as kind, 0 as pos, concat('Theme: ', c_mktsegment, ' automation') as value from h where v <> 3 "
    "union all select doc_id, 1, 'Problem Statement ID', 'content', 0, concat('Problem Statement ID: PS-0', cast(p_size % 10 + 10 as varchar)) from h where v = 2 "
    f"union all select doc_id, 1, 'Team Members Details', 'content', 0, concat({N.PERSON}, ' • ', {N.PERSON2}, ' • Zoe') from h where v = 0 "
    f"union all select doc_id, unnest([2, 3, 4, 5, 6]), '{slides.FOOTER}', 'content', 0, concat(case when v < 2 then 'Team name' else concat('Team ', p_brand) end, '   |   ', "
    "case when v = 2 then concat('PS-0', cast(p_size % 10 + 10 as varchar)) else 'Problem Statement ID' end, '   |   ', case when v = 3 then 'Theme' else concat(c_mktsegment, ' automation') end) from h "
    f"union all select doc_id, 2, '{slides.CONTENT[0][2]}', 'content', 0, concat('For ', lower(c_mktsegment), ' clerks, our queue sorts every order of ', p_name, ' at once') from h "
    "union all select doc_id, 3, 'Paste the full URL here', 'content', 0, concat('https://example.org/', o_orderkey) from h union all select doc_id, 6, 'the reach if adopted', 'content', 0, concat(p_size, ' teams') from h "
    "union all select doc_id, 2, 'What breaks today, and where exactly does it break?', 'section', unnest([1, 2]), unnest([concat('Orders for ', p_name, ' sit unsorted'), 'Today clerks wait']) from h "
    "union all select doc_id, 2, 'What you built, in plain language.', 'section', unnest([1, 2, 3]), unnest([concat('A queue that reads ', p_name, ' orders'), 'One click release', 'The tool drafts a reply']) from h "
    "union all select doc_id, 4, 'Tools used, and for what', 'section', 1, concat('Spark for ', p_type) from h"
)


@check("cq27_slide_request", head_sql(_V))
def _(spark, folder):
    return slides.slide_request(forms.extract_pitch(N.profile_notes(spark, folder, N.PITCH)))
