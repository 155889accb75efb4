"""Cells, tables, specs, diffs, structural checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.bridge import grids as B, notes as N, plans as BP
from quire.bridge.sql import with_views
from quire.checks import check
from quire.functions import text as T, values as X
from quire.operators import cells as G, diff as D, linediff as LD
from quire.plans import spec as S, templates as TP
from quire.sources.tables import spread, table


@check(
    "jn12_cell_diff",
    with_views(
        "ca cb",
        "select coalesce(a.book, b.book) as book, coalesce(a.r, b.r) as r, coalesce(a.c, b.c) as c, case when a.value is null then 'added' when b.value is null then 'removed' else 'updated' end as change, "
        "coalesce(a.value, '') as before, coalesce(b.value, '') as after from ca a full join cb b on a.book = b.book and a.r = b.r and a.c = b.c where a.value is distinct from b.value",
    ),
)
def _(spark, folder):
    return D.cell_diff(B.cells_a(spark, folder), B.cells_b(spark, folder)).drop("sheet")


@check(
    "cq14_diff_versions_cells",
    with_views(
        "ca cb",
        "select change, count(*) as n from (select case when a.value is null then 'added' when b.value is null then 'removed' else 'updated' end as change from ca a full join cb b "
        "on a.book = b.book and a.r = b.r and a.c = b.c where a.value is distinct from b.value) group by 1",
    ),
)
def _(spark, folder):
    return D.cell_diff(B.cells_a(spark, folder), B.cells_b(spark, folder)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def edited(spark, folder):
    """Every document against a copy with another first line, a closing line and, every second one, a line put in after its first."""
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    middle = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nMiddle line "), F.col("doc_id"), F.lit("\n"))).otherwise("\n")
    at = F.instr(text, "\n")
    body = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), middle, F.substring(text, at + 1, F.length(text)))).otherwise(text)
    return docs.select(
        F.col("doc_id").alias("pair"), F.concat(F.lit("Old head "), "doc_id", F.lit("\n"), text, F.lit("\nKept tail")).alias("old"),
        F.concat(F.lit("New head "), "doc_id", F.lit("\n"), body, F.lit("\nKept tail\nA closing line.")).alias("new"),
    )


def _ls(text: str) -> str:
    """The lines of a text that are not blank, without trailing blanks."""
    breaks = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
    return rf"list_filter(list_transform(regexp_split_to_array({text}, {breaks}), lambda s: regexp_replace(s, '\s+$', '')), lambda s: s <> '')"


_SIDES = {
    "d": "select doc_id, coalesce(text, '') as t, instr(coalesce(text, ''), chr(10)) as p, doc_id % 2 = 0 and instr(coalesce(text, ''), chr(10)) > 0 as mid from documents",
    "s": f"select doc_id, mid, {_ls("case when mid then substr(t, 1, p - 1) else '' end")} as a, list_append({_ls('case when mid then substr(t, p + 1) else t end')}, 'Kept tail') as b from d",
}


@check(
    "cq14_diff_versions_lines",
    with_views(
        "",
        "select doc_id as pair, (generate_subscripts(r, 1) - 1)::int as pos, unnest(r).k as type, unnest(r).t as text from (select doc_id, list_concat([{'k': 'removed', 't': 'Old head ' || doc_id}, {'k': 'added', 't': 'New head ' || doc_id}], "
        "case when mid then list_concat(list_transform(a, lambda x: {'k': 'context', 't': x}), [{'k': 'added', 't': 'Middle line ' || doc_id}]) else [] end, "
        "list_transform(case when len(b) <= 4 then b else [b[1], b[2], '…', b[-2], b[-1]] end, lambda x: {'k': 'context', 't': x}), [{'k': 'added', 't': 'A closing line.'}]) as r from s)",
        **_SIDES,
    ),
)
def _(spark, folder):
    return LD.line_diff(edited(spark, folder))


@check(
    "cq14_line_changes",
    with_views(
        "",
        "select doc_id as pair, 'line 1' as field, 'updated' as change, 'Old head ' || doc_id as before, 'New head ' || doc_id as after from s "
        "union all select doc_id, 'line ' || (2 + len(a)), 'added', '', 'Middle line ' || doc_id from s where mid and len(a) > 0 union all select doc_id, 'line 2', 'added', '', 'Middle line ' || doc_id from s where mid and len(a) = 0 "
        "union all select doc_id, 'line ' || (2 + len(a) + len(b)), 'added', '', 'A closing line.' from s",
        **_SIDES,
    ),
)
def _(spark, folder):
    return LD.line_changes(edited(spark, folder))


@check(
    "pf15_is_blank_slot",
    with_views("cb", "select book, r, c, value = '' or value in ('-', '...', 'n/a') or starts_with(value, '[') or contains(value, '{{') or regexp_matches(value, '^_+$') as blank from "
               "(select book, r, c, case r % 7 when 0 then '-' when 1 then concat('[', value, ']') when 2 then '____' when 3 then concat('{{', value, '}}') when 4 then 'n/a' else value end as value from cb)"),
)
def _(spark, folder):
    v = F.expr("case r % 7 when 0 then ' - ' when 1 then concat('[', value, ']') when 2 then '____' when 3 then concat('{{', value, '}}') when 4 then 'n/a' else value end")
    return B.cells_b(spark, folder).select("book", "r", "c", T.is_blank_slot(v).alias("blank"))


@check(
    "pf18_is_serial_header",
    with_views("cb", "select book, r, c, r % 6 < 4 as serial from cb"),
)
def _(spark, folder):
    head = F.expr("case r % 6 when 0 then 'Sl. No.' when 1 then '#' when 2 then '' when 3 then ' serial-number ' when 4 then concat('No ', value, ' x') else 'Task' end")
    return B.cells_b(spark, folder).select("book", "r", "c", T.is_serial_header(head).alias("serial"))


@check(
    "fn10_detect_value_format",
    with_views("cb", "select book, r, c, case (r + c) % 9 when 0 then 'date' when 1 then 'time' when 2 then 'percent' when 3 then 'currency' when 4 then 'number' when 5 then 'date' when 6 then 'time' when 7 then 'currency' else 'unknown' end as format from cb"),
)
def _(spark, folder):
    k = (F.col("r") + F.col("c")) % 9
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("dd-mmm-yy", "h:mm am/pm", "0.00%", "[$€] 0", "0", "General", "", "#,##0.00", "General")]), (k + 1).cast("int"))
    sample = F.when(k == 5, "2024-01-31").when(k == 6, "10:30 PM").otherwise(F.col("value"))
    return B.cells_b(spark, folder).select("book", "r", "c", X.detect_value_format(fmt, sample).alias("format"))


_LETTER = "case when n > 26 then concat(chr(cast(64 + (n - 1) // 26 as int)), chr(cast(65 + (n - 1) % 26 as int))) else chr(cast(64 + n as int)) end"


@check(
    "fn28_cell_address",
    with_views("cb", f"select book, r, c, concat('Lines!', {_LETTER}, r * 40) as address, 'Lines' as sheet, cast(r * 40 as integer) as row_no, cast(n as integer) as col_no, r * 40 <= 200 and n <= 40 as in_bounds from (select *, book % 60 + c as n from cb)"),
)
def _(spark, folder):
    n = (F.col("book") % 60 + F.col("c")).cast("int")
    address = F.concat(F.lit("Lines!"), G.column_letters(n), (F.col("r") * 40).cast("string"))
    return B.cells_b(spark, folder).select("book", "r", "c", address.alias("address"), G.cell_address(address).alias("a")).select(
        "book", "r", "c", "address", "a.sheet", F.col("a.row").alias("row_no"), F.col("a.col").alias("col_no"), "a.in_bounds"
    )


@check(
    "fn43_formula_shape",
    with_views("ca", "select book, r, c, concat('=SUM(A:B', upper(case when c = 3 then value else 'x' end), ')') as shape from ca"),
)
def _(spark, folder):
    f = F.concat(F.lit("=sum(a"), F.col("r"), F.lit(":b"), F.col("book"), F.when(F.col("c") == 3, F.col("value")).otherwise("x"), F.lit(")"))
    return B.cells_a(spark, folder).select("book", "r", "c", T.formula_shape(f).alias("shape"))


@check(
    "fn44_text_overflow",
    with_views("forms", "select book, 4 as r, 1 as c, length(p_name) as chars from forms where false union all select book, 9, 3, length('Responsible') from forms where false union all select book, 3, 1, 13 from forms where false "
               "union all select book, 5, 1, 20 from forms"),
)
def _(spark, folder):
    forms = B.forms(spark, folder).withColumn("text", F.when((F.col("r") == 5) & (F.col("c") == 1), "Notes that run along").otherwise(F.col("text")))
    return G.text_overflow(forms).select("book", "r", "c", "chars")


@check(
    "jn21_merge_anchor",
    with_views("ca", "select book, r, c, case when r between 3 and 4 and c between 1 and 2 then 3 else r end as a_r, case when r between 3 and 4 and c between 1 and 2 then 1 else c end as a_c from ca"),
)
def _(spark, folder):
    cells = B.cells_a(spark, folder)
    ranges = cells.select("book", "sheet").distinct().selectExpr("book", "sheet", "3 as min_r", "1 as min_c", "4 as max_r", "2 as max_c")
    return G.merge_anchor(cells, ranges).select("book", "r", "c", "a_r", "a_c")


@check("ag22_section_banners", with_views("forms", "select book, unnest([1, 8]) as r, unnest([concat('Order of ', p_name), concat('Lines of ', p_type)]) as text from forms"))
def _(spark, folder):
    return G.section_banners(B.forms(spark, folder)).select("book", "r", "text")


@check(
    "jn20_nearest_banner",
    with_views("forms", "select book, r, case when r <= 1 then 'Form' when r <= 8 then concat('Order of ', p_name) else concat('Lines of ', p_type) end as section from (select *, unnest(range(1, 13)) as r from forms)"),
)
def _(spark, folder):
    forms = B.forms(spark, folder)
    rows = forms.select("book", "sheet", "r").distinct()
    return G.nearest_banner(rows, G.section_banners(forms)).select("book", F.col("r").cast("bigint").alias("r"), "section")


@check("wn07_header_runs", with_views("forms", "select book, 9 as r, 1 as c0, 4 as c1 from forms"))
def _(spark, folder):
    return G.header_runs(B.forms(spark, folder)).select("book", "r", "c0", "c1")


@check("ag23_writable_band", with_views("forms", "select book, 9 as r, 1 as c0, 4 as c1 from forms"))
def _(spark, folder):
    forms = B.forms(spark, folder)
    return G.writable_band(forms, G.header_runs(forms)).select("book", "r", "c0", "c1")


@check(
    "ag20_table_extent",
    with_views("forms", "select book, 9 as header_row, case when book % 2 = 0 then 12 else 10 end as last_row, case when book % 2 = 0 then 2 else 0 end as existing, 4::bigint as n_columns from forms"),
)
def _(spark, folder):
    forms = B.forms(spark, folder)
    out = G.table_extent(forms, G.detect_tables(forms))
    return out.select("book", "header_row", "last_row", F.col("existing").cast("int").alias("existing"), "n_columns")


@check(
    "jn19_label_value_pairs",
    with_views(
        "forms",
        "select book, unnest([2, 3, 4, 5, 7]) as r, unnest(['Customer', 'Meeting Date', 'Owner', 'Notes', 'Total']) as label, unnest([2, 3, 4, 6, 7]) as t_r, unnest([2, 2, 2, 1, 2]) as t_c, "
        "unnest(['right', 'right', 'right', 'below', 'token']) as how from forms",
    ),
)
def _(spark, folder):
    forms = B.forms(spark, folder)
    busy = forms.where("r in (1, 8) or r >= 9")
    return G.label_value_pairs(forms, busy).select("book", "r", "label", "t_r", "t_c", "how")


@check("ag21_structure_profile", with_views("forms", "select book, 1::bigint as sheets, 2::bigint as formulas, case when book % 2 = 0 then 14 else 13 end::bigint as written from forms"))
def _(spark, folder):
    return G.structure_profile(B.forms(spark, folder))


@check(
    "ag24_is_key_value_table",
    with_views("ca", "select book, l >= greatest(2, n - 1) and r <= greatest(1, n // 3) as is_key_value from (select book, count(distinct r) as n, count(*) filter (c = 1) as l, "
               "count(*) filter (c = 2 and cast(value as int) > 30) as r from ca where c <= 2 group by 1)"),
)
def _(spark, folder):
    cells = B.cells_a(spark, folder)
    text = F.when((F.col("c") == 2) & (F.col("value").try_cast("int") <= 30), "").otherwise(F.col("value"))
    return G.is_key_value_table(cells.withColumn("text", text)).select("book", "is_key_value")


_PRINTED = (
    (0, "Form!2!1", "Customer"), (0, "Form!3!1", "Meeting Date:"), (0, "Form!5!1", "Notes"), (0, "Form!5!2", "=A1"), (0, "Form!7!1", "Total"), (0, "Form!7!2", "{{total_amount}}"),
    (1, "Form!9!1", "Sl No"), (1, "Form!9!2", "Task"), (1, "Form!9!3", "Responsible"), (1, "Form!9!4", "Due Date"),
)


@check(
    "ag13_template_fingerprint",
    with_views(
        "forms",
        "select book, substr(sha1('xlsx' || chr(10) || (select string_agg(upper(sha1(concat_ws('|', key, 'label', left(text, 40)))), chr(10) order by section, key) from printed)), 1, 16) as fingerprint from forms",
        printed="select * from (values " + ", ".join(f"({n}, '{key}', '{text}')" for n, key, text in _PRINTED) + ") as t(section, key, text)",
    ),
)
def _(spark, folder):
    forms = B.forms(spark, folder)
    parts = forms.where("text <> '' and r < 10 and r not in (1, 4, 8)").select(
        "book", F.when(F.col("r") == 9, 1).otherwise(0).alias("section"), F.concat_ws("!", "sheet", "r", "c").alias("key"), F.lit("label").alias("kind"), "text"
    )
    return G.template_fingerprint(parts)


@check("ag16_is_cell_snapshot", with_views("ca", "select book, count(*) >= 3 and count(*) filter (c <> 3) / count(*) >= 0.5 as is_cells from ca group by 1"))
def _(spark, folder):
    line = F.when(F.col("c") == 3, F.col("value")).otherwise(F.concat(F.lit("Lines!"), G.column_letters(F.col("c")), F.col("r"), F.lit(" = "), "value"))
    rows = B.cells_a(spark, folder).select("book", line.alias("line"))
    heads = rows.select("book").distinct().withColumn("line", F.lit("# Lines"))
    return G.is_cell_snapshot(rows.unionByName(heads))


@check(
    "wn10_assign_columns",
    # "Closure Date" is like a name of the status too, but the column called so is the better one
    "select p_partkey as node_id, unnest([0, 1, 2, 3, 4]) as idx, unnest(['Sl No', 'Closure Date', p_type, 'Status', 'Assigned to']) as header, unnest(['__serial_no__', null, null, 'status', 'owner']) as field, "
    "unnest([0.9::double, null, null, 1.0, 1.0]) as confidence from part",
)
def _(spark, folder):
    heads = F.array(F.lit("Sl No"), F.lit("Closure Date"), F.col("p_type"), F.lit("Status"), F.lit("Assigned to"))
    rows = spread(table(spark, folder, "part"), "p_partkey").select(
        F.lit(0).alias("template_id"), F.col("p_partkey").alias("node_id"), F.posexplode(heads).alias("idx", "header"),
        F.array().cast("array<string>").alias("allowed"), F.lit(True).alias("editable"),
    )
    return S.assign_columns(rows).select("node_id", "idx", "header", "field", "confidence")


def scored_labels(spark, folder):
    from quire.checks.f_semantic import labels

    k = F.col("p_partkey") % 2 == 0
    return labels(spark, folder).select(
        F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 3).alias("template_id"), F.col("p_partkey").alias("ord"), "label",
        F.lit("Meeting Information").alias("section"), F.when(k, "date").otherwise("unknown").alias("value_format"), k.alias("is_empty"),
        F.lit(False).alias("merged"), k.alias("bordered"), F.lit(False).alias("filled"), F.lit(False).alias("has_formula"), F.lit(True).alias("editable"),
        F.lit(True).alias("has_label_node"), F.lit(False).alias("multiline"), F.lit("").alias("placeholder"),
    )


@check("fn32_role_score")
def _(spark, folder):
    return T.unfolded(S.role_score(scored_labels(spark, folder)), ["node_id"], F.col("candidates"), "s").select(
        "node_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.role").alias("role"), F.round("s.score", 6).alias("score")
    )


@check("wn11_role_margin")
def _(spark, folder):
    return S.role_margin(S.role_score(scored_labels(spark, folder))).select("node_id", "role", "confidence", "decided_by")


@check("fn33_table_role_score")
def _(spark, folder):
    parts = table(spark, folder, "part")
    tables = parts.select(
        F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") % 2 == 0, "Action Plan").otherwise(F.col("p_name")).alias("section"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Task"), F.lit("Owner"), F.lit("Due"))).otherwise(F.array("p_type", F.lit("Name"), F.lit("Designation"))).alias("headers"),
    )
    return S.table_role_score(tables).select("node_id", "role", "confidence", "decided_by")


def claims(spark, folder):
    return BP.plan(spark, folder).select("template_id", "role", (F.col("job") * 100 + F.col("node_id").cast("bigint")).alias("ord"), "confidence", F.col("label"))


_CLAIMS = "select template_id, role, job * 100 + rn as ord, confidence from plan"


@check(
    "wn09_one_region_per_role",
    with_views("plan", "select template_id, role, ord, confidence, k = 1 as kept from (select *, row_number() over (partition by template_id, role order by confidence desc, ord) as k from c)", c=_CLAIMS),
)
def _(spark, folder):
    kept, demoted = S.one_region_per_role(claims(spark, folder))
    shape = ("template_id", "role", "ord", "confidence")
    return kept.select(*shape, F.lit(True).alias("kept")).unionByName(demoted.select(*shape, F.lit(False).alias("kept")))


# what each layout of ``mixed_forms`` must give, worked out by hand: layout, kind, node, name, detail
_SPEC = (
    (0, "field", "Form::A6", "comments", "Notes/Order details/rules_ambiguous/text"), (0, "field", "Form::B2", "customer", "Customer/Order details/rules/text"),
    (0, "field", "Form::B3", "meeting_date", "Meeting Date/Order details/rules_ambiguous/date"), (0, "field", "Form::B4", "owner", "Owner/Order details/rules/text"),
    (0, "field", "Form::B7", "amount", "Total/Order details/rules/currency"), (0, "table", "Form::table::9::1", "action_items", "9-{last}, {existing} written"),
    (0, "column", "Form::table::9::1/0", "__serial_no__", "number"), (0, "column", "Form::table::9::1/1", "task", "unknown"),
    (0, "column", "Form::table::9::1/2", "owner", "text"), (0, "column", "Form::table::9::1/3", "due_date", "date"),
    (0, "protected", "Form::A1", "section header", "Order details"), (0, "protected", "Form::A2", "label text", "Customer"), (0, "protected", "Form::A3", "label text", "Meeting Date:"),
    (0, "protected", "Form::A4", "label text", "Owner"), (0, "protected", "Form::A5", "label text", "Notes"), (0, "protected", "Form::A7", "label text", "Total"),
    (0, "protected", "Form::A8", "section header", "Lines of {type}"), (0, "protected", "Form::B5", "formula", "=A1"),
    # the formula below an empty table lies outside what the table takes
    (0, "odd protected", "Form::D12", "formula", "=SUM(A10:A11)"),
    # "Held on" loses meeting_date to "Date", whose slot is a date; the first table loses action_items to the one under a title of that name
    (1, "field", "Form::B2", "meeting_date", "Date/Meeting information of {brand}/rules_ambiguous/date"), (1, "field", "Form::B4", "owner", "Action Items/Meeting information of {brand}/rules/text"),
    (1, "field", "Form::B5", "vendor", "Attendees (Vendor)/Meeting information of {brand}/rules/text"), (1, "field", "Form::D2", "location", "Venue/Meeting information of {brand}/rules/text"),
    (1, "unresolved", "Form::B3", "Held on", "duplicate claim on role meeting_date"), (1, "table", "Form::table::11::1", "action_items", "11-12, 0 written"),
    (1, "column", "Form::table::11::1/0", "__serial_no__", "number"), (1, "column", "Form::table::11::1/1", "task", "unknown"),
    (1, "column", "Form::table::11::1/2", "owner", "text"), (1, "column", "Form::table::11::1/3", "remarks", "unknown"),
    (1, "protected", "Form::A1", "section header", "Meeting information of {brand}"), (1, "protected", "Form::A10", "section header", "Action Items"),
    (1, "protected", "Form::A2", "label text", "Date"), (1, "protected", "Form::A3", "label text", "Held on"), (1, "protected", "Form::A4", "label text", "Action Items"),
    (1, "protected", "Form::A5", "label text", "Attendees (Vendor)"), (1, "protected", "Form::A6", "static content", "This form is kept with the files of the north team."),
    (1, "protected", "Form::C2", "label text", "Venue:"),
    # a label that no role fits is a field of its own over an empty slot or a token, and unresolved over a sample
    (2, "field", "Form::A5", "x_zumbra", "Zumbra/Status of the works/open_world/text"), (2, "field", "Form::B3", "department", "Department/Status of the works/rules/text"),
    (2, "unresolved", "Form::B2", "Qwzx", "no candidate above threshold"), (2, "unresolved", "Form::table::7::1", "Vorlon | Krell", "no collection role matched"),
    (2, "protected", "Form::A1", "section header", "Status of the works"), (2, "protected", "Form::A2", "label text", "Qwzx"), (2, "protected", "Form::A3", "label text", "Department"),
    (2, "protected", "Form::A4", "label text", "Zumbra"), (2, "protected", "Form::C3", "sheet protection", "Kept by hand"), (2, "protected", "Form::D5", "formula", "=B2"),
)


@check(
    "cq06_build_spec",
    with_views(
        "forms",
        "select book as template_id, replace(kind, 'odd ', '') as kind, node_id, name, replace(replace(replace(replace(detail, '{type}', p_type), '{brand}', p_brand), '{last}', case when book % 2 = 0 then '12' else '10' end), "
        "'{existing}', case when book % 2 = 0 then '2' else '0' end) as detail from forms join spec on book % 3 = layout where not starts_with(kind, 'odd') or book % 2 = 1",
        spec="select * from (values " + ", ".join(f"({n}, '{kind}', '{node}', '{name}', '{detail}')" for n, kind, node, name, detail in _SPEC) + ") as t(layout, kind, node_id, name, detail)",
    ),
)
def _(spark, folder):
    made = S.build_spec(B.mixed_forms(spark, folder))

    def part(table: str, kind: str, node, name, detail):
        return made[table].select("template_id", F.lit(kind).alias("kind"), node.alias("node_id"), name.alias("name"), detail.alias("detail"))

    node = F.col("node_id")
    rows = F.format_string("%d-%d, %d written", "header_row", "last_row", "existing")
    return (
        part("fields", "field", node, F.col("role"), F.concat_ws("/", "label", "section", "decided_by", "value_format"))
        .unionByName(part("tables", "table", node, F.col("role"), rows))
        .unionByName(part("columns", "column", F.concat_ws("/", "node_id", "idx"), F.col("field"), F.col("format")))
        .unionByName(part("protected", "protected", node, F.col("reason"), F.col("text")))
        .unionByName(part("unresolved", "unresolved", node, F.col("label"), F.col("reason")))
    )


@check(
    "ag17_spec_stats",
    with_views(
        "plan",
        "select template_id, count(*) filter (kind = 'field' and node_id <> '6') as fields_mapped, count(*) filter (kind = 'table') as tables_mapped, count(*) filter (critical) as protected_regions, count(*) filter (node_id = '6') as unresolved from plan group by 1",
    ),
)
def _(spark, folder):
    plan = BP.plan(spark, folder)
    return S.spec_stats(plan.where("kind = 'field' and node_id <> '6'"), plan.where("kind = 'table'"), plan.where("critical"), plan.where("node_id = '6'"))


@check(
    "cq07_spec_cache",
    with_views("ordered", "select o_orderkey as book, p_name as fingerprint, case when p_size % 2 = 0 then 'stored' else 'build' end as state from ordered"),
)
def _(spark, folder):
    from quire.bridge.views import ordered_parts

    rows = ordered_parts(spark, folder).select(F.col("o_orderkey").alias("book"), F.concat("p_name", F.lit("|"), F.col("p_size") % 2).alias("fingerprint"))
    stored = table(spark, folder, "part").where("p_size % 2 = 0").select(F.concat("p_name", F.lit("|0")).alias("fingerprint")).distinct().withColumn("spec", F.lit("s"))
    known, fresh = S.spec_cache(stored, rows)
    both = known.select("book", "fingerprint", F.lit("stored").alias("state")).unionByName(fresh.select("book", "fingerprint", F.lit("build").alias("state")))
    return both.withColumn("fingerprint", F.element_at(F.split("fingerprint", r"\|"), 1))


@check(
    "cq13_templatize",
    with_views(
        "plan",
        "select template_id, node_id, case when rn % 2 = 0 then concat('{{', role, '}}') else 'not editable' end as token from (select distinct template_id, node_id, rn, role from plan where kind = 'field') "
        "union all select template_id, node_id, concat('{{', case when rn % 2 = 0 then 'task' else 'owner' end, '}}') from (select distinct template_id, node_id, rn from plan where kind = 'table')",
    ),
)
def _(spark, folder):
    plan = BP.plan(spark, folder).select("template_id", "node_id", "role", "kind").distinct()
    even = F.col("node_id").cast("bigint") % 2 == 0
    fields = plan.where("kind = 'field'").withColumn("editable", even)
    tables = plan.where("kind = 'table'")
    columns = tables.select("template_id", "node_id", F.when(even, "task").otherwise("owner").alias("field"), F.lit(True).alias("editable"))
    none = plan.where("false").select("template_id", "node_id", F.lit("").alias("reason"))
    slots, skipped = S.templatize(fields, tables, columns, none)
    return slots.select("template_id", "node_id", "token").unionByName(
        skipped.select("template_id", "node_id", F.col("reason").alias("token"))
    )


def merges(spark, folder, shift: int):
    rows = B.cells_a(spark, folder).select("book", "sheet").distinct()
    made = F.array(
        *[F.struct((F.lit(r) + s).alias("min_r"), F.lit(1).alias("min_c"), (F.lit(r) + s + 1).alias("max_r"), F.lit(2).alias("max_c"))
          for r, s in ((2, 0), (5, shift), (9, shift))]
    )
    out = rows.select("book", "sheet", F.explode(made).alias("m")).select("book", "sheet", "m.*")
    return out if not shift else out.where("book % 10 <> 0 or min_r <> 9 + 3")


@check("st04_multiset_lost", with_views("ca", "select distinct book, 9 as min_r from ca where book % 10 = 0"))
def _(spark, folder):
    return D.lost_merges(merges(spark, folder, 0), merges(spark, folder, 3).where("book % 10 <> 0 or min_r = 2")).select("book", "min_r")


@check(
    "cq16_structural_qa",
    with_views(
        "forms",
        "select book, 'sheets' as \"check\", 'error' as severity from forms where book % 15 = 0 union all select book, 'sheets', 'error' from forms where book % 15 = 0 "
        "union all select book, 'formulas', 'error' from forms where book % 15 <> 0 and book % 10 = 0 union all select book, 'formulas', 'error' from forms where book % 15 <> 0 and book % 10 = 0 "
        "union all select book, 'placeholders', 'warning' from forms where book % 15 <> 0 and book % 4 = 0 union all select book, 'rows', 'error' from forms where book % 15 <> 0 and book % 10 = 0 "
        "union all select book, 'protection', 'error' from forms where book % 15 <> 0 and book % 7 = 0",
    ),
)
def _(spark, folder):
    forms = B.forms(spark, folder)
    book = F.col("book")
    out = forms.where("not (book % 10 = 0 and r = 12)").withColumns(
        {
            "sheet": F.when(book % 15 == 0, "Other").otherwise(F.col("sheet")),
            "text": F.when((F.col("r") == 7) & (F.col("c") == 2) & (book % 4 != 0), "12.50").otherwise(F.col("text")),
            "locked": F.col("locked") & (book % 7 != 0),
        }
    )
    ranges = forms.select("book", "sheet").distinct().selectExpr("book", "sheet", "1 as min_r", "1 as min_c", "1 as max_r", "4 as max_c")
    moved = ranges.withColumns({"min_r": F.col("min_r") + 1, "max_r": F.col("max_r") + 1})
    return D.structural_qa(forms, out, ranges, moved).select("book", "check", "severity")


_ASKED = "'customer_name,order_id,line_text,item_name,order_date,status,ship_mode,contact_person,free_text,remarks,' || lower(p_type) || '_code,' || replace(lower(p_brand), '#', '_') || '_code'"
_LABELS = "'Customer Name|Order Id|Line.text|Item Name|Order Date|Status|Ship Mode|Contact person'"


@check(
    "cq26_analyze_templates",
    with_views(
        "forms tpl",
        f"select p_partkey as template_id, case when p_partkey % 7 = 0 then 'document_title' else {_ASKED} end as ids, case when p_partkey % 7 = 0 then 'What is the title of this document?' else 'What is the Customer Name?' end as question, "
        f"case when p_partkey % 5 = 0 then trim(split_part(case when p_partkey % 7 = 0 then 'Nothing to fill in here' else text end, chr(10), 1)) when p_partkey % 7 = 0 then '' else {_LABELS} end as outline, 0::bigint as tables, p_partkey % 7 <> 0 as literal, "
        "left(case when p_partkey % 7 = 0 then 'Nothing to fill in here' else text end, 240) as summary from part join tpl on template_id = p_partkey "
        "union all select -1 - book, case book % 3 when 0 then concat('order_details,customer,meeting_date,the_north_team_looks_after_', replace(p_name, ' ', '_'), ',a1,total_amount,lines_of_', lower(p_type), ',due_date,sum_a10_a11') "
        "when 1 then concat('meeting_information_of_', replace(lower(p_brand), '#', '_'), ',date,venue,held_on,action_items,attendees_vendor,status,remarks') else 'status_of_the_works,department,kept_by_hand,zumbra,prepared_by,b2,krell' end, "
        "case book % 3 when 0 then 'What is the Order details?' when 1 then concat('What is the Meeting information of ', p_brand, '?') else 'What is the Status of the works?' end, 'Form', 1, book % 3 <> 1, '# Form' from forms",
    ),
)
def _(spark, folder):
    blank = F.col("template_id") % 7 == 0
    texts = N.template_texts(spark, folder).withColumn("text", F.when(blank, "Nothing to fill in here").otherwise(F.col("text")))
    lines = T.line_table(texts, ["template_id"], "text")
    paragraphs = lines.select("template_id", F.col("line_no").alias("pos"), F.col("line").alias("text"), ((F.col("template_id") % 5 == 0) & (F.col("line_no") == 0)).alias("heading"))
    grids = B.mixed_forms(spark, folder).select((-1 - F.col("book")).alias("template_id"), "sheet", "r", "c", "text")
    made = TP.analyze_templates(paragraphs, grids)
    summary = F.when(F.col("template_id") < 0, F.element_at(F.split("summary", "\n"), 1)).otherwise(F.col("summary"))
    return made.select(
        "template_id", F.array_join("fields.id", ",").alias("ids"), F.get("questions", F.lit(0)).alias("question"), F.array_join("outline", "|").alias("outline"), "tables", "literal", summary.alias("summary")
    )
