"""A knowledge base out of regions, nations, customers and documents, queries on it, and both as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.sources.tables import spread, table

#: Contents of a slide by ``doc_id % 8``; every eighth document is taken as it is. ``{id}`` is the document's id.
SLIDES = (
    "Overview: The stage {id} keeps the stock in order\nand books what comes in.\nPreconditions | The stock {id} is counted\nAcceptance\nThe clerk must sign sheet {id}.",
    "01\nRequirement definition\nThe buyer of lot {id} asks for a price and waits for the answer.\nHow it works?\nshort line",
    "Create the order {id} in the system\nNote: keep a copy in folder {id}\nCheck the totals of the day\nProcess",
    "tiny {id}",
    "Slide {id}\nOverview",
    "the text goes on here {id}\n1 | The plan shows each delivery of the week | Report {id}\n2 | short\nTarget Business of {id}",
    "A price should stand on each line | Overview - second {id}\n7 | Every lot has a number that can be read | ",
)


def _word(text: str) -> str:
    return "concat('" + text.replace("{id}", "', {id}, '").replace("\n", "', {nl}, '") + "')"


def _content(key: str, newline: str) -> str:
    cases = " ".join(f"when {k} then {_word(t).replace('{id}', key).replace('{nl}', newline)}" for k, t in enumerate(SLIDES))
    return f"case doc_id % 8 {cases} else coalesce(text, '') end"


def nations(spark: SparkSession, folder: str) -> DataFrame:
    """n_nationkey, name, region, root and two-level code."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    root = (F.col("n_regionkey") + 10).cast("string")
    return n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("name"), F.col("r_name").alias("region"), "n_regionkey", root.alias("root"), F.concat_ws(".", root, (F.col("n_nationkey") + 10).cast("string")).alias("code")
    )


def step_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of two and three levels: root, code, name."""
    two = nations(spark, folder)
    customers = table(spark, folder, "customer").join(two, F.col("n_nationkey") == F.col("c_nationkey"))
    three = customers.select(
        "root", F.concat_ws(".", "code", F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")).alias("code"), "name", "c_mktsegment"
    ).groupBy("root", "code").agg(F.concat_ws(" ", F.min("name"), F.min("c_mktsegment")).alias("name"))
    return two.select("root", "code", "name").unionByName(three)


def domains(spark: SparkSession, folder: str) -> DataFrame:
    """ord, root, business_process, process_map, source_file, overview: a domain a region, its map one line a step."""
    lines = step_rows(spark, folder).groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "code", "name"))), "\n").alias("map"))
    heads = nations(spark, folder).select("root", "region", "n_regionkey").distinct()
    return heads.join(lines, "root").select(
        F.col("n_regionkey").cast("int").alias("ord"), "root", F.concat_ws(" ", "root", "region", F.lit("to delivery")).alias("business_process"),
        F.concat(F.lit("Map of "), "region", F.lit("\n"), "map").alias("process_map"), F.concat(F.lower("region"), F.lit(".pptx")).alias("source_file"),
        F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("  All of "), "region")).alias("overview"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Slides by document: every third names its code, the others go on with the one before."""
    docs = table(spark, folder, "documents").withColumn("n_nationkey", (F.col("doc_id") % 25).cast("int"))
    rows = docs.join(nations(spark, folder), "n_nationkey")
    return rows.select(
        "root", F.col("doc_id").alias("slide_number"), F.concat(F.lit("Slide "), "doc_id").alias("title"), F.expr(_content("cast(doc_id as string)", "char(10)")).alias("content"),
        F.expr("case when doc_id % 13 = 0 then 'document_control' when doc_id % 8 > 4 then 'hq_requirement' else 'body' end").alias("category"),
        F.expr("case when doc_id % 3 = 0 then array(code) else cast(array() as array<string>) end").alias("process_codes"),
    )


_TEXT = """case c_custkey % 8 when 0 then concat('about ', code, ' delivery') when 1 then concat('steps ', code, '.', lpad(cast(c_custkey % 1000 as {text}), 3, '0'), ' delivery')
when 2 then 'The product master goes from design to retire' when 3 then concat('Goods of a nation in ', lower(region), ' for delivery to building furniture machinery household automobile ', lower(c_mktsegment), ' trade')
when 4 then 'nothing known' when 5 then concat('the part ', substring(code, 4, 2), '.', lpad(cast(c_custkey % 1000 as {text}), 3, '0'), ' alone')
when 6 then concat(code, ' or deeper ', code, '.', lpad(cast(c_custkey % 1000 as {text}), 3, '0'), '.77 and ', code, '.', lpad(cast(c_custkey % 1000 as {text}), 3, '0'), '.78') else concat('see 99.10 and ', root, ' of ', c_name) end"""


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """A query a customer (qid, text): codes of every depth, other names, words, unknown texts."""
    # short rows become texts that are read for codes and words: they are dealt over all tasks before that
    customers = spread(table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment"), "c_custkey")
    joined = customers.join(nations(spark, folder), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.select(F.col("c_custkey").alias("qid"), F.expr(_TEXT.format(text="string")).alias("text"))


def _clean(value: str) -> str:
    return f"regexp_replace(trim(regexp_replace(trim(replace({value}, chr(160), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^[| ]+', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t]+', ' ', 'g')"


_BREAK = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"
_STOPS = "(?:Preconditions|Target Business|Overview|Acceptance)"


def _section(heading: str) -> str:
    body = f"regexp_extract(joined, '(?is){heading}\\s*(?:\\||:|-)?\\s*(.+?)(?:\\n{_STOPS}|\\z)', 1)"
    return f"regexp_replace(regexp_replace(regexp_replace({body}, '\\s+', ' ', 'g'), '^[ |]+', ''), '[ |]+$', '')"


KB_CTES = {
    "kn": "select n_nationkey, n_regionkey, n_name as name, r_name as region, cast(n_regionkey + 10 as varchar) as root, concat(n_regionkey + 10, '.', n_nationkey + 10) as code "
    "from nation join region on r_regionkey = n_regionkey",
    "ksteps": "select root, code, name, row_number() over (partition by root order by code || ' ' || name) - 1 as pos from (select root, code, name from kn union all "
    "select root, concat(code, '.', lpad(cast(c_custkey % 1000 as varchar), 3, '0')) as code, concat(min(name), ' ', min(c_mktsegment)) as name from customer join kn on n_nationkey = c_nationkey group by 1, 2)",
    "kdom": "select n_regionkey as ord, root, concat(root, ' ', region, ' to delivery') as bp, case when n_regionkey % 2 = 0 then concat('All of ', region) end as about, concat('Map of ', region) as head, "
    "lower(concat(root, ' ', region, ' to delivery', chr(10), 'Map of ', region, chr(10), (select string_agg(s.code || ' ' || s.name, chr(10) order by s.pos) from ksteps s where s.root = h.root), chr(10), lower(region), '.pptx')) as hay "
    "from (select distinct root, region, n_regionkey from kn) h",
    "kchunk": f"select root, doc_id as slide_number, {_content('cast(doc_id as varchar)', 'chr(10)')} as content, case when doc_id % 13 = 0 then 'document_control' when doc_id % 8 > 4 then 'hq_requirement' else 'body' end as category, "
    "case when doc_id % 3 = 0 then code end as own from documents join kn on n_nationkey = doc_id % 25",
    "kgroup": "select * from (select *, last_value(own ignore nulls) over (partition by root order by slide_number) as code from kchunk) where code is not null",
    "kuse": f"select root, code, slide_number, category, content, list_filter(list_transform(regexp_split_to_array(replace({_clean('content')}, ' | ', chr(10)), {_BREAK}), lambda s: {_clean('s')}), "
    "lambda s: s <> '' and not regexp_matches(s, '(?i)^(?:\\d{2}|requirement definition|process|how it works\\??|methods of acquisition)$') and s <> 'Slide ' || slide_number) as ls from kgroup",
    "kblob": "select *, array_to_string(ls, chr(10)) as blob from kuse where len(ls) > 0",
    "kjoin": "select root, code, string_agg(blob, chr(10) order by slide_number) as joined, min_by(left(trim(regexp_replace(blob, '\\s+', ' ', 'g')), 400), slide_number) as short, "
    "min_by(para, slide_number) filter (length(para) >= 40) as para from (select *, list_aggregate(list_transform(ls, lambda s, i: {'n': length(s), 'i': -i, 's': s}), 'max').s as para from kblob) group by 1, 2",
    "knotes": "select root, code, list(s order by o) as notes from (select root, code, s, o, row_number() over (partition by root, code order by o) as k from (select root, code, s, min({'n': slide_number, 'i': i}) as o from "
    "(select root, code, slide_number, unnest(ls) as s, generate_subscripts(ls, 1) as i from kblob) where regexp_matches(s, '(?i)\\bnote\\s*:|\\bmust\\b|\\bshould\\b') group by 1, 2, 3)) where k <= 6 group by 1, 2",
    "kflow": "select root, code, list(s order by o) as flow from (select root, code, s, o, row_number() over (partition by root, code order by o) as k from (select root, code, s, min({'n': slide_number, 'i': i}) as o from "
    "(select root, code, slide_number, unnest(ls) as s, generate_subscripts(ls, 1) as i from kblob) where length(s) between 12 and 90 and not starts_with(lower(s), 'overview') "
    "and regexp_matches(s, '(?i)^(create|process|check|setup|acquire|post|transfer|approve|record)\\b') group by 1, 2, 3)) where k <= 8 group by 1, 2",
    "kcodes": f"select j.root, j.code, coalesce(nullif({_section('Overview')}, ''), para, short) as description, nullif({_section('Preconditions')}, '') as pre, coalesce(notes, []) as notes, coalesce(flow, []) as flow "
    "from kjoin j left join knotes n on n.root = j.root and n.code = j.code left join kflow f on f.root = j.root and f.code = j.code",
    "khq": f"select root, list(t order by slide_number, i) as hq from (select *, row_number() over (partition by root order by slide_number, i) as k from (select root, slide_number, i, "
    "case when trim(coalesce(p[3], '')) = '' then trim(coalesce(p[2], '')) else trim(p[2]) || ' Mapping: ' || trim(p[3]) end as t from (select root, slide_number, i, string_split(s, '|') as p from "
    f"(select root, slide_number, unnest(l) as s, generate_subscripts(l, 1) as i from (select root, slide_number, list_transform(regexp_split_to_array(content, {_BREAK}), lambda s: {_clean('s')}) as l from kchunk where category = 'hq_requirement')) "
    "where regexp_matches(s, '^\\d+\\s*\\|'))) where length(t) > 20) where k <= 12 group by 1",
    "kq": f"select c_custkey as qid, {_TEXT.format(text='varchar')} as text from customer join kn on n_nationkey = c_nationkey",
    "kqc": "select qid, code, min(i) as place from (select qid, unnest(cs) as code, generate_subscripts(cs, 1) as i from (select qid, regexp_extract_all(text, '\\b(\\d{2}(?:\\.\\d{2,3}){0,3})\\b', 1) as cs from kq)) group by 1, 2",
    "kqt": "select distinct qid, t from (select qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) as t from kq) where t not in ('with', 'from', 'that', 'this', 'process')",
    "kbest": "select qid, arg_max(ord, {'s': score, 'o': -ord}) as ord, max(score) as score from (select qid, ord, sum(p) as score from ("
    "select qid, ord, case when split_part(code, '.', 1) = root then 80 + 15 * least(len(string_split(code, '.')), 3) else 40 end as p from kqc join kdom on split_part(code, '.', 1) = root or contains(hay, code) "
    "union all select qid, ord, 50 from kq join kdom on root = '10' and (contains(lower(text), 'design to retire') or contains(lower(text), 'd2r') or contains(lower(text), 'product master')) "
    "union all select qid, ord, least(40, 3 * count(*)) from kqt join (select distinct ord, unnest(regexp_extract_all(hay, '[a-z0-9]{4,}')) as t from kdom) h using (t) group by 1, 2) group by 1, 2) group by 1 having max(score) >= 20",
    "kscope": "select b.qid, d.root, b.score, coalesce((select c.code from kqc c where c.qid = b.qid and (split_part(c.code, '.', 1) = d.root or exists (select 1 from ksteps s where s.root = d.root and (s.code = c.code or starts_with(s.code, c.code || '.') "
    "or starts_with(c.code, s.code || '.')))) order by len(string_split(c.code, '.')) desc, length(c.code) desc, place limit 1), w.code, d.root) as scope from kbest b join kdom d using (ord) left join ("
    "select qid, arg_max(array_to_string(string_split(code, '.')[1:2], '.'), {'n': n, 'p': -pos}) as code from (select b.qid, s.code, s.pos, count(*) as n from kbest b join kdom d using (ord) join kqt t on t.qid = b.qid "
    "join (select distinct root, code, pos, unnest(regexp_extract_all(lower(name || ' ' || code), '[a-z0-9]{4,}')) as t from ksteps) s on s.root = d.root and s.t = t.t group by 1, 2, 3) where n >= 2 group by 1) w on w.qid = b.qid",
    "kfeat": "select root, scope, k, code, name from (select s.root, scope, code, name, row_number() over (partition by s.root, scope order by pos) as k from ksteps s join (select distinct root, scope from kscope) w on w.root = s.root "
    "and s.code <> w.scope and array_to_string(string_split(s.code, '.')[1:len(string_split(s.code, '.')) - 1], '.') = w.scope) where k <= 16",
    "krows": "select root, scope, 0 as k, scope as code, coalesce((select name from ksteps s where s.root = w.root and s.code = w.scope order by pos limit 1), (select name from ksteps s where s.root = w.root and starts_with(s.code, w.scope) order by pos limit 1), scope) as name, "
    "'Epic' as type from (select distinct root, scope from kscope) w union all select root, scope, k, code, name, 'Feature' from kfeat",
    "kchild": "select root, code, list(step order by k) as children from (select root, up as code, step, row_number() over (partition by root, up order by pos) as k from (select root, pos, code || ' ' || name as step, "
    "array_to_string(string_split(code, '.')[1:len(string_split(code, '.')) - 1], '.') as up from ksteps)) where k <= 8 group by 1, 2",
    "kparts": "select r.root, r.scope, r.k, r.type, trim(r.code || ' ' || r.name) as name, coalesce(c.description, case when r.type = 'Epic' then coalesce(d.about, trim(r.code || ' ' || r.name)) else 'Process step ' || r.code || ' ' || r.name || '.' end) as description, "
    "list_concat(case when c.pre is null then [] else [c.pre] end, coalesce(c.notes, [])) as own, coalesce(q.hq, []) as hq, coalesce(h.children, c.flow, []) as flow "
    "from krows r join kdom d on d.root = r.root left join kcodes c on c.root = r.root and c.code = r.code left join kchild h on h.root = r.root and h.code = r.code left join khq q on q.root = r.root",
    "kitems": "select root, scope, k, type, name, description, case when type = 'Epic' then coalesce(nullif(a, ''), 'The stages of the process map are covered.') else a end as acceptance, array_to_string(flow, ' > ') as flow from ("
    "select *, array_to_string(list_transform(list_filter(list_transform(u, lambda s, i: {'s': s, 'd': list_position(u, s) <> i}), lambda x: not x.d)[1:6], lambda x: x.s), ' ; ') as a from ("
    "select *, case when len(own) > 0 then own when type = 'Epic' then hq[1:3] else [] end as u from kparts))",
}
KB_NEEDS = {
    "ksteps": ("kn",), "kdom": ("kn", "ksteps"), "kchunk": ("kn",), "kgroup": ("kchunk",), "kuse": ("kgroup",), "kblob": ("kuse",), "kjoin": ("kblob",), "knotes": ("kblob",), "kflow": ("kblob",),
    "kcodes": ("kjoin", "knotes", "kflow"), "khq": ("kchunk",), "kq": ("kn",), "kqc": ("kq",), "kqt": ("kq",), "kbest": ("kqc", "kqt", "kdom"), "kscope": ("kbest", "ksteps"), "kfeat": ("kscope",), "krows": ("kfeat",),
    "kchild": ("ksteps",), "kparts": ("krows", "kcodes", "khq", "kchild"), "kitems": ("kparts",),
}
