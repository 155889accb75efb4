"""Similarity, label matching, fact extraction, best fact and list."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import roles as R
from quire.bridge import notes as N, plans as B
from quire.bridge.sql import with_views
from quire.checks import check
from quire.functions import lists as L, similarity as S, text as T
from quire.plans import extract as X, fill
from quire.sources.tables import spread, table

_LABELS = (
    "case p_partkey % 7 when 0 then concat('Date of the Meeting ', p_type) when 1 then 'Prepared By:' when 2 then concat('Responsible ', p_brand) when 3 then p_type "
    "when 4 then 'Venue / Room' when 5 then 'Action Points (Vendor)' else p_name end"
)


def labels(spark, folder):
    return spread(table(spark, folder, "part"), "p_partkey").select("p_partkey", F.expr(_LABELS).alias("label"))


@check("fn02_text_similarity")
def _(spark, folder):
    rows = labels(spark, folder).join(table(spark, folder, "part").select("p_partkey", "p_name"), "p_partkey")
    return rows.select("p_partkey", F.round(S.text_similarity("label", "p_name"), 6).alias("similarity"))


@check("ud02_text_similarity_sql")
def _(spark, folder):
    S.register_functions(spark)
    return labels(spark, folder).selectExpr("p_partkey", "round(text_similarity(label, 'meeting date'), 6) as similarity")


@check("fn03_evidence_present")
def _(spark, folder):
    rows = N.general_notes(spark, folder)
    quote = F.when(F.col("doc_id") % 2 == 0, F.substring(F.regexp_extract("text", "The order of [^.]+", 0), 1, 40)).otherwise("nobody wrote this sentence")
    staged = rows.select("doc_id", T.normalize_text(F.col("text")).alias("norm"), quote.alias("quote"))
    return staged.select("doc_id", S.evidence_present(F.col("quote"), F.col("norm")).alias("present"))


@check("jn07_fuzzy_label_join")
def _(spark, folder):
    scored = labels(spark, folder).select("p_partkey", "label", F.explode(S.role_scores(F.col("label"))).alias("s"))
    return scored.select("p_partkey", F.col("s.name").alias("role"), F.round("s.score", 6).alias("score"), F.col("s.synonym").alias("synonym"))


@check("tk11_top_candidates")
def _(spark, folder):
    return labels(spark, folder).select("p_partkey", F.posexplode(F.slice(S.role_scores(F.col("label")), 1, 12)).alias("pos", "s")).select(
        "p_partkey", F.col("pos").cast("bigint").alias("pos"), F.col("s.name").alias("role"), F.round("s.score", 6).alias("score")
    )


@check("jn08_classify_column")
def _(spark, folder):
    allowed = R.item_fields_of(F.lit("action_items"))
    scored = labels(spark, folder).withColumn("s", S.field_scores(F.col("label")))
    inside = F.filter("s", lambda x: F.array_contains(allowed, x["name"]))
    best = lambda a: F.when(F.get(a, F.lit(0))["score"] > 0.6, F.get(a, F.lit(0))["name"])
    return scored.select("p_partkey", best(F.col("s")).alias("field"), best(inside).alias("field_of_actions"))


@check("jn09_nearest_column")
def _(spark, folder):
    rows = labels(spark, folder).join(table(spark, folder, "part").select("p_partkey", "p_type"), "p_partkey")
    names = F.array(F.lit("task"), F.lit("owner"), F.lit("due_date"))
    near = S.nearest_columns(F.array("label"), names, F.array(F.lit("Work to do"), F.lit("Person"), F.col("p_type")))
    return rows.select("p_partkey", F.get(near, F.lit(0)).alias("column"))


@check(
    "ud01_register_roles",
    with_views(
        "",
        "select role, array_to_string(synonyms, ',') as synonyms, is_collection from (select role, synonyms, is_collection, row_number() over (partition by role order by late desc, ord desc) as k from "
        "(select * from base union all select * from pack)) where k = 1",
        base="select * from (values " + ", ".join(
            f"({i}, '{r.role}', [{', '.join(repr(s) for s in r.synonyms)}], {str(r.is_collection).lower()}, 0)" for i, r in enumerate(R.BASE_ROLES)
        ) + ") as t(ord, role, synonyms, is_collection, late)",
        pack="select p_partkey as ord, case when p_partkey % 20 = 0 then 'status' else concat('x_', replace(p_name, ' ', '_')) end as role, [lower(p_type), lower(p_brand)] as synonyms, p_size % 2 = 0 as is_collection, 1 as late from part",
    ),
)
def _(spark, folder):
    role = F.when(F.col("p_partkey") % 20 == 0, "status").otherwise(R.minted_role(F.col("p_name")))
    pack = table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("ord"), role.alias("role"), F.array("p_type", "p_brand").alias("synonyms"), F.lit("text").alias("format"),
        (F.col("p_size") % 2 == 0).alias("is_collection"), F.lit(False).alias("critical"), F.array().cast("array<string>").alias("item_fields"),
    )
    merged = R.register_roles(R.role_table(spark), pack)
    return merged.select("role", F.array_join("synonyms", ",").alias("synonyms"), "is_collection")


@check(
    "ag06_best_fact",
    with_views(
        "fact",
        "select doc_id, role, ord, confidence from (select *, row_number() over (partition by doc_id, role order by confidence desc, ord) as k from fact) where k = 1",
    ),
)
def _(spark, folder):
    return X.best_fact(B.facts(spark, folder)).select("doc_id", "role", "ord", "confidence")


@check(
    "ag07_best_collection",
    with_views(
        "fact",
        "select doc_id, role, r.o as ord, r.n as items from (select doc_id, role, list_reduce(list(struct_pack(n := n, c := confidence, o := ord) order by ord), "
        "lambda a, b: case when b.n > a.n or b.c > a.c then b else a end) as r from fact group by 1, 2)",
    ),
)
def _(spark, folder):
    best = X.best_collection(B.collections(spark, folder))
    return best.select("doc_id", "role", "ord", F.size("items").cast("bigint").alias("items"))


@check(
    "fn27_narrative_facts",
    with_views(
        "head",
        f"select doc_id, 'meeting_date' as role, {N.iso('o_orderdate')} as value, 0.65::double as confidence from h union all "
        "select doc_id, 'location', concat(c_mktsegment, ' Room'), 0.6::double from h where v <> 3 union all "
        f"select doc_id, 'recorder', {N.PERSON}, 0.7::double from h",
        h="select *, o_orderkey as doc_id, o_orderkey % 4 as v from head",
    ),
)
def _(spark, folder):
    text = (
        f"concat('We met ', case when o_orderkey % 4 = 3 then 'online' else 'with all in ' end, case when o_orderkey % 4 = 3 then '' else c_mktsegment || ' Room' end, "
        f"'. It was ', {N.day_name('o_orderdate')}, '. ', {N.PERSON}, ' prepared these notes.')"
    )
    facts = X.narrative_facts(N.profile_notes(spark, folder, text))
    return facts.select("doc_id", "role", "value", "confidence")


@check(
    "fn27_narrative_collections",
    with_views(
        "head",
        f"select doc_id, 'x_attendees_team_' || p_size as role, concat('[{{\"name\":\"', a, '\"}},{{\"name\":\"', b, '\"}}]') as items, concat('From Team ', p_size, ', ', a, ' and ', b, ' attended') as evidence from h union all "
        "select doc_id, 'action_items', concat('[{\"task\":\"count the ', p_name, ' stock\",\"owner\":\"', a, '\",\"due_date\":\"2024-08-20\",\"status\":\"Open\"}]'), concat(a, ' will count the ', p_name, ' stock by 20th August, marked open') from h",
        h=f"select *, o_orderkey as doc_id, {N.PERSON} as a, {N.PERSON2} as b from head",
    ),
)
def _(spark, folder):
    text = (
        f"concat('From Team ', p_size, ', ', {N.PERSON}, ' and ', {N.PERSON2}, ' attended. ', {N.PERSON}, ' will count the ', p_name, ' stock by 20th August, marked open. ')"
    )
    docs = N.profile_notes(spark, folder, text).withColumn("default_year", F.lit(2024))
    rows = X.narrative_collections(docs)
    return rows.select("doc_id", "role", F.to_json("items").alias("items"), "evidence")


_FACTS = (
    f"select *, o_orderkey as doc_id, o_orderkey % 4 as v from head join (select l_orderkey, count(*) as n, concat('[', string_agg(concat('{{\"due_date\":\"', {N.iso('l_shipdate')}, '\",\"owner\":\"', replace(s_name, '#', ' '), "
    "'\",\"task\":\"Ship ', lp_name, '\"}}'), ',' order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice), ']') as tasks from lparts group by 1) on l_orderkey = o_orderkey"
).replace("{{", "{").replace("}}", "}")


@check(
    "cq04_extract_facts",
    with_views(
        "notes",
        f"select doc_id, 'meeting_date' as role, {N.iso('o_orderdate')} as value, 0.95::double as confidence, 'rules' as extractor from f union all select doc_id, 'recorder', replace(c_name, '#', ' '), 0.95, 'rules' from f "
        "union all select doc_id, 'project_name', p_name, 0.95, 'rules' from f union all select doc_id, 'status', concat(o_orderstatus, case when v = 3 then concat(' and moving on with ', p_brand) else '' end), 0.95, 'rules' from f "
        "union all select doc_id, 'summary', replace(split_part(text, concat('Summary:', chr(10)), 2), chr(10), ' '), 0.92, 'rules' from notes union all select doc_id, 'action_items', tasks, 0.82, 'rules' from f "
        f"union all select doc_id, 'x_attendees_vendor', concat('[{{\"name\":\"', {N.PERSON}, '\"}},{{\"name\":\"', {N.PERSON2}, '\"}}]'), 0.93, 'rules' from f where v = 2",
        f=_FACTS,
    ),
)
def _(spark, folder):
    facts, lists = X.extract_facts(N.general_notes(spark, folder).select("doc_id", "text"))
    return facts.select("doc_id", "role", "value", F.round("confidence", 3).alias("confidence"), "extractor").unionByName(
        lists.select("doc_id", "role", F.to_json("items").alias("value"), F.round("confidence", 3).alias("confidence"), "extractor")
    )


@check("cq04_extract_facts_documents")
def _(spark, folder):
    talk = table(spark, folder, "conversations").select((-1 - F.col("conv_id") * 100 - F.col("turn")).alias("doc_id"), "text")
    # each table may be one file split
    texts = spread(table(spark, folder, "documents").select("doc_id", "text").unionByName(talk), "doc_id", "text")
    facts, lists = X.extract_facts(texts)
    return facts.select("doc_id", "role", "value", "confidence").unionByName(
        lists.select("doc_id", "role", F.to_json("items").alias("value"), "confidence")
    )


@check(
    "cq05_gate_candidates",
    with_views(
        "notes",
        "select doc_id, 'summary' as role, q as value, 0.97::double as confidence, q as evidence from q union all select doc_id, 'purpose', 'order review', 0.8, concat(upper(q), ' !') from q",
        q="select doc_id, regexp_extract(text, 'The order of [^.]+') as q from notes",
    ),
)
def _(spark, folder):
    docs = N.general_notes(spark, folder).select("doc_id", "text")
    known, _ = X.extract_facts(docs)
    text = F.col("text")
    quote = F.regexp_extract(text, "The order of [^.]+", 0)
    cands = docs.select(
        "doc_id",
        F.posexplode(
            F.array(
                F.struct(F.lit("summary").alias("role"), quote.alias("value"), quote.alias("evidence"), F.lit(0.99).alias("confidence")),
                F.struct(F.lit("meeting_date").alias("role"), F.lit("not a day").alias("value"), quote.alias("evidence"), F.lit(0.9).alias("confidence")),
                F.struct(F.lit("location").alias("role"), F.lit("Main Hall").alias("value"), F.lit("this was never written there").alias("evidence"), F.lit(0.9).alias("confidence")),
                F.struct(F.lit("purpose").alias("role"), F.lit("order review").alias("value"), F.concat(F.upper(quote), F.lit(" !")).alias("evidence"), F.lit(0.8).alias("confidence")),
            )
        ).alias("ord", "c"),
    ).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "c.*")
    return X.gate_candidates(cands, docs, known).select("doc_id", "role", "value", "confidence", "evidence")


@check(
    "cq05_gate_collections",
    with_views(
        "notes",
        # a longer or surer list than the rules' is taken, a list without items or quote never
        "select doc_id, role, n, confidence from (select doc_id, 'action_items' as role, 3 as n, 0.75::double as confidence from f where n < 3 union all select doc_id, 'attendees', 1, 0.97::double from f union all "
        "select doc_id, 'x_attendees_vendor', 2, 0.95::double from f where v = 2 or v = 3)",
        f=_FACTS,
    ),
)
def _(spark, folder):
    docs = N.general_notes(spark, folder).select("doc_id", "text")
    _, known = X.extract_facts(docs)
    quote = F.regexp_extract("text", "The order of [^.]+", 0)

    def named(n: int):
        return F.array(*[F.create_map(F.lit("name"), F.lit(f"Person {k}")) for k in range(n)], F.create_map().cast("map<string,string>"))

    def row(role: str, n: int, confidence, evidence):
        return F.struct(F.lit(role).alias("role"), named(n).alias("items"), F.lit(confidence).cast("double").alias("confidence"), evidence.alias("evidence"))

    made = F.array(
        row("action_items", 3, None, quote), row("attendees", 1, 0.99, quote), row("absentees", 0, 0.9, quote), row("decisions", 4, 0.9, F.lit("this was never written there")),
        row("x_attendees_vendor", 2, 0.95, F.when(F.col("doc_id") % 4 >= 2, quote).otherwise(F.lit(" "))),
    )
    cands = docs.select("doc_id", F.posexplode(made).alias("ord", "c")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "c.*")
    return X.gate_collections(cands, docs, known).select("doc_id", "role", F.size("items").alias("n"), "confidence")


@check(
    "ud03_extract_items",
    with_views(
        "notes",
        "select doc_id, pos, i - 1 as at, 'bullet' as kind, split_part(b, ' — ', 1) as task, split_part(b, ' — ', 2) as owner, split_part(b, ' — ', 3) as due_date, cast(null as varchar) as priority from "
        "(select doc_id, pos, generate_subscripts(bs, 1) as i, substr(unnest(bs), 3) as b from (select doc_id, 4 + (doc_id % 4 = 2)::int as pos, string_split(split_part(split_part(text, concat('Action items:', chr(10)), 2), concat(chr(10), chr(10)), 1), chr(10)) as bs from notes)) "
        "union all select doc_id, 7 + (doc_id % 4 = 2)::int, unnest([0, 1]), 'row', unnest(['Count ' || doc_id, 'Close']), unnest(['Ada', null]), unnest(['2024-01-02', 'soon']), unnest([null, 'high']) from notes",
    ),
)
def _(spark, folder):
    from quire.functions.items import items_view

    rows = F.concat(F.lit("\nTask | Action by | Due Date | Priority\n--- | --- | --- | ---\nCount "), F.col("doc_id"), F.lit(" | Ada | 2024-01-02\n| Close | | soon | high |\n | | | "))
    items_view(N.general_notes(spark, folder).select("doc_id", F.concat("text", rows).alias("text")), "quire_records")
    return spark.sql("select doc_id, pos, at, i.kind, i.task, i.owner, i.due_date, i.priority from quire_records lateral view posexplode(records) r as at, i")
