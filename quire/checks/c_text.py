"""Text functions, placeholders, typed values and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.bridge import notes as N, sqlfn as Q, views as V
from quire.bridge.sql import with_views
from quire.checks import check
from quire.functions import keys as K, text as T, values as X
from quire.sources import readers
from quire.sources.tables import table

DOCS = "documents"


def docs(spark, folder):
    return table(spark, folder, DOCS)


def norm_sql(t: str) -> str:
    return (
        f"trim(trim(regexp_replace(regexp_replace(replace(replace(lower({t}), '_', ' '), chr(160), ' '), "
        f"'[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s%/&.-]+', ' ', 'g'), '\\s+', ' ', 'g'), ' :*-.'))"
    )


_STOPS = "('the','of','a','an','for','to','in','on','by','and','is','no','s')"


def tokens_sql(t: str) -> str:
    return f"list_filter(string_split({norm_sql(t)}, ' '), lambda w: w <> '' and w not in {_STOPS})"


@check("fn01_normalize_text", f"select doc_id, {norm_sql('text')} as norm, array_to_string({tokens_sql('text')}, ' ') as tokens from documents")
def _(spark, folder):
    return docs(spark, folder).select(
        "doc_id", T.normalize_text(F.col("text")).alias("norm"), F.array_join(T.tokens(F.col("text")), " ").alias("tokens")
    )


@check(
    "st01_token_overlap",
    "select doc_id, item_id, round(case when least(len(a), len(b)) > 0 then len(list_intersect(a, b)) / least(len(a), len(b)) else 0 end, 6) as overlap "
    f"from (select doc_id, item_id, list_distinct({tokens_sql('d.text')}) as a, list_distinct({tokens_sql('b.text')}) as b "
    "from documents d join benchmark b on b.item_id = d.doc_id % 40)",
)
def _(spark, folder):
    # each document meets one benchmark item, so the comparison grows with the documents
    bench = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("other"))
    pairs = docs(spark, folder).join(bench, F.col("item_id") == F.col("doc_id") % 40)
    return pairs.select(
        "doc_id", "item_id",
        F.round(T.token_overlap(T.tokens(F.col("text")), T.tokens(F.col("other"))), 6).alias("overlap"),
    )


@check(
    "fn20_word_tokens",
    "select doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')), "
    "lambda w: w not in ('with', 'from', 'that', 'this', 'process'))), ' ') as words from documents",
)
def _(spark, folder):
    return docs(spark, folder).select("doc_id", F.array_join(F.sort_array(T.word_tokens(F.col("text"))), " ").alias("words"))


@check(
    "fn19_codes_in",
    "select doc_id, code, case when contains(code, '.') then regexp_replace(code, '\\.[^.]*$', '') else code end as parent, "
    "len(string_split(code, '.')) as depth from (select doc_id, unnest(list_distinct(regexp_extract_all("
    "concat(text, ' 55.10.', lpad(cast(doc_id % 1000 as varchar), 3, '0'), ' and 20.', cast(10 + doc_id % 90 as varchar)), "
    "'\\b(\\d{2}(?:\\.\\d{2,3}){0,3})\\b'))) as code from documents)",
)
def _(spark, folder):
    text = F.concat(
        "text", F.lit(" 55.10."), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(" and 20."),
        (F.col("doc_id") % 90 + 10).cast("string"),
    )
    code = F.col("code")
    return docs(spark, folder).select("doc_id", F.explode(T.codes_in(text)).alias("code")).select(
        "doc_id", "code", T.code_parent(code).alias("parent"), T.code_depth(code).cast("bigint").alias("depth")
    )


@check("fn39_content_digest", "select doc_id, substr(sha256(text), 1, 16) as digest from documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", T.content_digest(F.col("text")).alias("digest"))


@check(
    "fn45_clean_text",
    "select doc_id, regexp_replace(concat(text, chr(7), 'x', chr(31), chr(9)), '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') as clean, "
    "case when doc_id % 3 = 0 then '2024-02-29' when doc_id % 3 = 1 then '2024-13-01T00:00' else source end as day from documents",
)
def _(spark, folder):
    key = F.col("doc_id")
    given = F.when(key % 3 == 0, "2024-02-29T10:00:00").when(key % 3 == 1, "2024-13-01T00:00").otherwise(F.col("source"))
    return docs(spark, folder).select(
        "doc_id", T.clean_text(F.concat("text", F.lit("\u0007x\u001f\t"))).alias("clean"), T.as_date_cell(given).alias("day")
    )


@check(
    "pf17_looks_like_label",
    with_views("notes", "select doc_id, line_no - 1 as line_no, case when t = '' or length(t) > 80 then false when ends_with(t, ':') then true when w > 8 then false "
    "when regexp_matches(t, '[.!?]$') and w > 4 then false else true end as is_label from (select doc_id, line_no, t, "
    "len(list_filter(regexp_split_to_array(replace(t, '/', ' '), '\\s+'), lambda x: x <> '')) as w from (select doc_id, unnest(range(1, len(l) + 1)) as line_no, "
    "regexp_replace(regexp_replace(unnest(l), '^\\s+', ''), '\\s+$', '') as t from (select doc_id, string_split(text, chr(10)) as l from notes "
    "union all select 1000000000 + doc_id, string_split(text, chr(10)) from documents)))"),
)
def _(spark, folder):
    both = N.general_notes(spark, folder).select("doc_id", "text").unionByName(
        docs(spark, folder).select((F.col("doc_id") + 1000000000).alias("doc_id"), "text")
    )
    return T.line_table(both, ["doc_id"], "text").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), T.looks_like_label(F.col("line")).alias("is_label")
    )


@check(
    "pf19_turn_kind",
    "select conv_id, turn, case when regexp_matches(t, '(?i)^(hi|hello|hey|yo|thanks|thank you|good (morning|afternoon|evening)|how are you)[\\s!.?]*$') "
    "then 'greeting' when length(t) > 40 or contains(t, chr(10)) or length(t) - length(replace(t, '.', '')) >= 2 or length(t) - length(replace(t, ':', '')) >= 2 "
    "or length(t) - length(replace(t, '-', '')) >= 3 then 'notes' else 'answer' end as kind from "
    "(select conv_id, turn, case turn % 4 when 0 then 'Good morning!' when 1 then text[1:30] else trim(text) end as t from conversations)",
)
def _(spark, folder):
    turn = F.col("turn") % 4
    text = F.when(turn == 0, "Good morning!").when(turn == 1, F.substring("text", 1, 30)).otherwise(F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", T.turn_kind(text).alias("kind"))


# --- values -------------------------------------------------------------------------------------
_ND = "select doc_id, text, o_orderdate from notes"


@check(
    "fn04_parse_date",
    with_views("notes", "select doc_id, cast(cast(o_orderdate as date) as varchar) as day, concat(cast(year(o_orderdate) as varchar), '-08-20') as due from notes"),
)
def _(spark, folder):
    text = F.col("text")
    line = F.regexp_extract(text, "Meeting Date: ([^\n]+)", 1)
    return N.general_notes(spark, folder).select(
        "doc_id", X.parse_date(line).cast("string").alias("day"),
        X.parse_date(F.regexp_extract(text, r"stock by ([^.]+)\.", 1), default_year=F.year("o_orderdate")).cast("string").alias("due"),
    )


_FORMS = {
    0: N.iso("o_orderdate"), 1: f"replace({N.dmy('o_orderdate')}, '/', '-')", 2: N.dmy("o_orderdate"), 3: N.day_name("o_orderdate"),
    4: N.name_day("o_orderdate"), 5: f"concat(upper({N.day_name('o_orderdate')}), '.,')", 6: "'31/02/2024'", 7: "'2024-1'",
}
_FORM = "case o_orderkey % 8 " + " ".join(f"when {k} then {v}" for k, v in _FORMS.items()) + " end"


@check(
    "fn05_to_iso_date",
    f"select o_orderkey, {_FORM} as given, case when o_orderkey % 8 < 6 then cast(cast(o_orderdate as date) as varchar) else '' end as iso from orders",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    rows = rows.select("o_orderkey", F.expr(_FORM).alias("given"))
    return rows.withColumn("iso", F.coalesce(X.to_iso_date(F.col("given")), F.lit("")))


_CLOCK = "concat('at ', cast(o_orderkey % 27 as string), case o_orderkey % 3 when 0 then ':' else '.' end, lpad(cast(o_custkey % 70 as string), 2, '0'), case o_orderkey % 4 when 0 then ' pm' when 1 then 'am' else '' end, ' sharp')"


@check(
    "fn06_parse_time",
    f"select o_orderkey, {_CLOCK} as given, case when h2 between 0 and 23 and m <= 59 then h2 * 60 + m end as minutes from "
    "(select *, case when o_orderkey % 4 = 0 and h < 12 then h + 12 when o_orderkey % 4 = 1 and h = 12 then 0 else h end as h2 "
    "from (select *, cast(o_orderkey % 27 as integer) as h, cast(o_custkey % 70 as integer) as m from orders))",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.expr(_CLOCK).alias("given"))
    return rows.withColumn("minutes", X.parse_time(F.col("given")))


_MONEY = (
    "case o_orderkey % 5 when 0 then concat('($', cast(o_custkey as string), '.50)') when 1 then concat('EUR ', cast(o_custkey as string), ',', lpad(cast(o_orderkey % 1000 as string), 3, '0')) "
    "when 2 then concat(cast(o_custkey as string), '%') when 3 then 'none' else concat('-', cast(o_custkey as string), ' pieces of 7') end"
)


@check(
    "fn07_parse_number",
    f"select o_orderkey, {_MONEY} as given, case o_orderkey % 5 when 0 then -(o_custkey + 0.5::double) when 1 then cast(concat(o_custkey, lpad(cast(o_orderkey % 1000 as varchar), 3, '0')) as double) "
    "when 2 then cast(o_custkey as double) when 4 then -cast(o_custkey as double) end as number from orders",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.expr(_MONEY).alias("given"))
    return rows.withColumn("number", X.parse_number(F.col("given")))


_TYPED = (
    "case o_orderkey % 7 when 0 then 'date' when 1 then 'time' when 2 then 'percent' when 3 then 'bool' when 4 then 'number' when 5 then 'text' else 'currency' end"
)
_RAW = (
    f"case o_orderkey % 7 when 0 then case when o_custkey % 3 = 0 then 'someday' else {N.day_name('o_orderdate')} end "
    "when 1 then concat(cast(o_custkey % 24 as string), ':15') when 2 then case when o_custkey % 2 = 0 then concat(cast(o_custkey as string), '%') else cast(o_custkey as string) end "
    "when 3 then case o_custkey % 4 when 0 then 'Yes' when 1 then 'absent' when 2 then ' Present ' else 'maybe' end "
    "when 4 then concat(cast(o_custkey as string), ' units') when 5 then o_orderpriority else 'n/a' end"
)


@check(
    "fn08_coerce",
    f"select o_orderkey, {_TYPED} as fmt, case o_orderkey % 7 when 0 then case when o_custkey % 3 = 0 then 'someday' else strftime(o_orderdate, '%d-%b-%Y') end "
    "when 1 then concat(lpad(cast(o_custkey % 24 as varchar), 2, '0'), ':15') when 2 then case when o_custkey % 2 = 0 then case when o_custkey % 100 = 0 then cast(o_custkey // 100 as varchar) else cast(o_custkey / 100.0 as varchar) end "
    "else cast(o_custkey as varchar) end when 3 then case o_custkey % 4 when 0 then 'Yes' when 1 then 'No' when 2 then 'Yes' else 'maybe' end "
    "when 4 then cast(o_custkey as varchar) when 5 then o_orderpriority else 'n/a' end as shown, "
    "case o_orderkey % 7 when 0 then o_custkey % 3 <> 0 when 3 then o_custkey % 4 <> 3 when 6 then false else true end as ok from orders",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    rows = rows.select("o_orderkey", F.expr(_TYPED).alias("fmt"), F.expr(_RAW).alias("raw"))
    typed = rows.withColumn("typed", X.coerce(F.col("raw"), F.col("fmt")))
    return typed.select("o_orderkey", "fmt", X.to_display(F.col("typed")).alias("shown"), "typed.ok")


@check(
    "fn09_to_display",
    "select o_orderkey, strftime(o_orderdate, '%d-%b-%Y') as day, concat(lpad(cast(o_custkey % 24 as varchar), 2, '0'), ':', lpad(cast(o_orderkey % 60 as varchar), 2, '0')) as clock, "
    "case when o_orderkey % 2 = 0 then cast(o_custkey as varchar) else concat(o_custkey, '.5') end as number from orders",
)
def _(spark, folder):
    rows = table(spark, folder, "orders")
    half = F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(0.5)
    return rows.select(
        "o_orderkey", X.display_date(F.col("o_orderdate").cast("timestamp")).alias("day"),
        X.display_minutes((F.col("o_custkey") % 24) * 60 + F.col("o_orderkey") % 60).alias("clock"),
        X.display_double(F.col("o_custkey") + half).alias("number"),
    )


@check(
    "fn41_parse_ts",
    "select o_orderkey, case when o_orderkey % 4 in (0, 1) then o_orderdate + interval 1 hour when o_orderkey % 4 = 2 then o_orderdate - interval 1 hour end as ts from orders",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    text = F.expr(
        "concat(" + N.iso("o_orderdate") + ", case o_orderkey % 4 when 0 then 'T01:00:00Z' when 1 then 'T01:00:00' "
        "when 2 then 'T01:00:00+02:00' else 'Tx' end)"
    )
    return rows.select("o_orderkey", X.parse_ts(text).alias("ts"))


# --- placeholders -------------------------------------------------------------------------------
def tpl(spark, folder):
    return N.template_texts(spark, folder)


@check(
    "fn11_extract_placeholders",
    "select template_id, concat('customer_name,Item Name,Order Date,status,Ship Mode,line.text,if,free text,', t, '_code') as names, "
    "concat('customer_name,status,total,line.text,if,', t, '_code') as slots from (select p_partkey as template_id, lower(p_type) as t from part)",
)
def _(spark, folder):
    return tpl(spark, folder).select(
        "template_id", F.array_join(T.extract_placeholders(F.col("text")), ",").alias("names"),
        F.array_join(T.value_tokens(F.col("text")), ",").alias("slots"),
    )


@check(
    "fn12_mustache_sections",
    "select p_partkey as template_id, 'LINES,EMPTY' as blocks, concat('customer_name,order_id,line.text,if,', lower(p_type), '_code') as idents from part",
)
def _(spark, folder):
    text = F.col("text")
    values = F.filter(T.mustache_tokens(text), lambda t: t["prefix"] == "")
    return tpl(spark, folder).select(
        "template_id", F.array_join(T.mustache_sections(text), ",").alias("blocks"),
        F.array_join(F.transform(values, lambda t: t["ident"]), ",").alias("idents"),
    )


@check(
    "fn13_harvest_fields",
    "select p_partkey as template_id, unnest(['customer_name', 'order_id', 'line_text', concat(lower(p_type), '_code'), 'item_name', 'order_date', 'status', 'ship_mode', 'free_text', 'contact_person', 'remarks', replace(lower(concat(p_brand, '_code')), '#', '_')]) as id, "
    "unnest(['Customer Name', 'Order Id', 'Line.text', concat(p_type[1], lower(p_type[2:]), ' Code'), 'Item Name', 'Order Date', 'Status', 'Ship Mode', 'Free Text', 'Contact person', 'Remarks', concat(p_brand, ' code')]) as label, "
    "unnest(['placeholder', 'placeholder', 'placeholder', 'placeholder', 'detected', 'detected', 'detected', 'detected', 'detected', 'detected', 'detected', 'detected']) as source from part",
)
def _(spark, folder):
    return tpl(spark, folder).select("template_id", F.explode(T.harvest_fields(F.col("text"))).alias("f")).select(
        "template_id", "f.id", "f.label", "f.source"
    )


def tpl_answers():
    return F.create_map(
        F.lit("Customer_Name"), F.concat(F.lit("Mr "), F.col("p_brand")), F.lit("Item Name"), F.col("p_type"),
        F.lit("status"), F.lit(""), F.lit("total"), F.col("p_size").cast("string"), F.lit("Order Date"), F.lit("[total]"),
    )


_FILLED = (
    "replace(replace(replace(replace(text, '{{ customer_name }}', concat('Mr ', p_brand)), '[Item Name]', p_type), '${total}', cast(p_size as varchar)), '«Order Date»', '[total]')"
)


@check(
    "fn14_fill_text",
    with_views("tpl", f"select template_id, {_FILLED} as text from tpl join part on p_partkey = template_id"),
)
def _(spark, folder):
    parts = table(spark, folder, "part")
    return tpl(spark, folder).join(parts, F.col("p_partkey") == F.col("template_id")).select(
        "template_id", T.fill_text(F.col("text"), tpl_answers()).alias("text")
    )


_CLEAR = (
    "trim(regexp_replace(regexp_replace(text, '\\{\\{\\s*[\\w.\\-]+\\s*\\}\\}|\\$\\{\\s*[\\w.\\-]+\\s*\\}|<<\\s*[\\w.\\- ]+\\s*>>', '', 'g'), '\\{\\{\\s*[#/]\\s*[\\w.\\-]+\\s*\\}\\}', '', 'g'))"
)


@check(
    "fn15_clear_unresolved",
    with_views("tpl", f"select template_id, {_CLEAR} as text from tpl union all select -1 - doc_id, text from documents"),
)
def _(spark, folder):
    rows = tpl(spark, folder).unionByName(
        docs(spark, folder).select((-1 - F.col("doc_id")).alias("template_id"), "text")
    )
    return rows.select("template_id", T.clear_unresolved(F.col("text")).alias("text"))


_BARE = "regexp_replace(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '^[-•* ]+', ''), '^\\s+|\\s+$', '', 'g')"


@check(
    "fn16_kv_lines",
    with_views(
        "notes",
        "select doc_id, key, value from (select doc_id, n, " + Q.snake("regexp_extract(l, p, 1)") + " as key, trim(regexp_extract(l, p, 2)) as value, "
        "row_number() over (partition by doc_id, " + Q.snake("regexp_extract(l, p, 1)") + " order by n desc) as k from lns where regexp_matches(l, p) and l[1] <> '#') where k = 1 and key <> ''",
        lns="select doc_id, n, " + _BARE.format(x="x") + " as l, '^(.{1,48}?)\\s*[:\\-=]\\s+(.+)$' as p from "
        "(select doc_id, unnest(range(len(a))) as n, unnest(a) as x from (select doc_id, string_split(text, chr(10)) as a from notes))",
    ),
)
def _(spark, folder):
    return T.unfolded(N.general_notes(spark, folder), ["doc_id"], F.map_entries(T.kv_map(F.col("text"))), "e").select("doc_id", "e.key", "e.value")


@check(
    "fn17_pipe_rows",
    with_views(
        "notes",
        "select doc_id, n, p[1] as type, coalesce(p[2], '') as name, coalesce(p[3], '') as description, coalesce(p[4], '') as acceptance, coalesce(p[5], '') as flow from "
        "(select doc_id, n, list_transform(string_split(l, '|'), lambda c: trim(c)) as p from lns where contains(l, '|'))",
        lns="select doc_id, row_number() over (partition by doc_id order by n) - 1 as n, l from (select doc_id, n, " + _BARE.format(x="x") + " as l from "
        "(select doc_id, unnest(range(len(a))) as n, unnest(a) as x from (select doc_id, string_split(text, chr(10)) as a from notes)) where contains(x, '|'))",
    ),
)
def _(spark, folder):
    rows = T.pipe_rows(F.col("text"), ("type", "name", "description", "acceptance", "flow"))
    return N.general_notes(spark, folder).select("doc_id", F.posexplode(rows).alias("n", "r")).select(
        "doc_id", F.col("n").cast("bigint").alias("n"), "r.*"
    )


@check(
    "fn18_section_blob",
    with_views(
        "notes",
        "select doc_id, trim(split_part(split_part(text, concat('Action items:', chr(10)), 2), concat(chr(10), chr(10)), 1)) as actions, "
        "trim(split_part(split_part(text, concat('Items:', chr(10), 'Epic'), 2), concat(chr(10), chr(10)), 1)) as items_tail, "
        "trim(split_part(split_part(text, 'Project: ', 2), concat(chr(10), chr(10)), 1)) as inline from notes",
    ),
)
def _(spark, folder):
    text = F.col("text")
    return N.general_notes(spark, folder).select(
        "doc_id", T.section_blob(text, ["Action items"]).alias("actions"),
        F.trim(F.substring(T.section_blob(text, ["Items", "Rows"], ["Summary", "Items"]), 5, 1000000)).alias("items_tail"),
        T.section_blob(text, ["Project"]).alias("inline"),
    )


@check(
    "fn29_parse_json_loose",
    "select event_id, case event_id % 4 when 3 then '' else json_extract_string(props, '$.k') end as k from events",
)
def _(spark, folder):
    key, props = F.col("event_id") % 4, F.col("props")
    noisy = (
        F.when(key == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(key == 1, F.concat(F.lit("Answer: "), props, F.lit(" ok")))
        .when(key == 2, props).otherwise(F.concat(F.lit("["), props))
    )
    noisy = F.when(key == 3, F.lit("[1, 2]")).otherwise(noisy)
    return table(spark, folder, "events").select(
        "event_id", F.coalesce(F.get_json_object(T.parse_json_loose(noisy), "$.k"), F.lit("")).alias("k")
    )


@check(
    "sc10_json_flatten",
    "select event_id, pos, path, value from (select event_id, 0 as pos, 'props.k' as path, json_extract_string(props, '$.k') as value from events "
    "union all select event_id, 1, 'tags', event_type from events union all select event_id, 2, 'tags', 'x' from events union all select event_id, 3, 'user', cast(user_id as varchar) from events)",
)
def _(spark, folder):
    text = F.concat(
        F.lit('{"props": '), F.col("props"), F.lit(', "tags": ["'), F.col("event_type"), F.lit('", "x"], "user": '), F.col("user_id"), F.lit("}")
    )
    rows = table(spark, folder, "events").select("event_id", text.alias("doc"))
    return readers.json_flatten(rows, "doc")


@check(
    "sc09_delimited_lines",
    "select p_partkey, concat(p_name, ' | ', p_brand, ' | ', p_type, ' | ', p_size) as line from part",
)
def _(spark, folder):
    cells = [F.concat(F.lit("  "), F.col("p_name")), F.concat("p_brand", F.lit(" ")), F.col("p_type"), F.col("p_size").cast("string")]
    return table(spark, folder, "part").select("p_partkey", T.delimited_line(cells).alias("line"))


_CUES = (
    "concat('WEBVTT', chr(10), chr(10), cast(turn as string), chr(10), '00:00:0', cast(turn % 10 as string), '.000 --> 00:00:09.000', chr(10), "
    "'  line of ', role, chr(10), text, chr(10), '42')"
)


@check(
    "sc11_transcript_clean",
    "select conv_id, turn, array_to_string(list_filter(list_transform(string_split(concat('line of ', role, chr(10), text), chr(10)), "
    "lambda s: regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '')), lambda s: s <> '' and not regexp_matches(s, '^\\d+$')), chr(10)) as text from conversations",
)
def _(spark, folder):
    rows = table(spark, folder, "conversations").withColumn("cues", F.expr(_CUES))
    return rows.select("conv_id", "turn", T.transcript_clean(F.col("cues")).alias("text"))
