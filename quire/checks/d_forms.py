"""Note extraction per profile, list helpers, forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.bridge import notes as N
from quire.bridge.sql import with_views
from quire.checks import check
from quire.functions import lists as L, text as T
from quire.plans import forms
from quire.sources.tables import table

SEP = "' ~ '"


def joined(rows, columns, lists=()):
    """Struct rows as text, for comparison."""
    cells = lambda r: [F.array_join(r[c], ";") if c in lists else r[c] for c in columns]
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(" ~ ", *cells(r))), "\n")


def head_sql(query: str) -> str:
    return with_views("head", query, h="select *, o_orderkey as doc_id, o_orderkey % 4 as v from head")


_CAP = "concat(upper(p_name[1]), p_name[2:])"
_PEOPLE = f"case when v = 1 then '' else concat({N.PERSON}, ',', {N.PERSON2}, ',', p_type, ' Team') end"
_SUMMARY = f"concat({_CAP}, ';', p_brand, ';Stock levels;keep ', p_name, ' in stock;', p_brand, ' stays listed')"


@check("fn23_split_people", head_sql(f"select doc_id, concat({N.PERSON}, ',', {N.PERSON2}, ',', p_type, ' Team') as people, concat(p_name, ';', p_brand, ';x y') as list from h"))
def _(spark, folder):
    rows = N.profile_notes(
        spark, folder,
        f"concat({N.PERSON}, ', ', {N.PERSON2}, ' and ', p_type, ' Team, the sales team and field representatives', chr(10), p_name, ' and ', p_brand, '; x y')",
    )
    parts = F.split("text", "\n")
    return rows.select(
        "doc_id", F.array_join(L.split_people(parts[0]), ",").alias("people"), F.array_join(L.split_list(parts[1]), ";").alias("list")
    )


@check(
    "fn24_agenda_decisions",
    head_sql(f"select doc_id, concat({_CAP}, ';', p_brand, ';Stock levels') as agenda, concat('keep ', p_name, ' in stock;', p_brand, ' stays listed') as decisions from h"),
)
def _(spark, folder):
    text = F.col("text")
    return N.profile_notes(spark, folder, N.FREE).select(
        "doc_id", F.array_join(L.agenda_items(text), ";").alias("agenda"), F.array_join(L.decision_items(text), ";").alias("decisions")
    )


@check(
    "fn25_action_rows",
    head_sql(
        f"select doc_id, case when v < 2 then concat('Count ', p_name, {SEP}, {N.PERSON}, {SEP}, {N.iso('o_orderdate')}, {SEP}, 'Open', {SEP}, chr(10), "
        f"'Review ', p_brand, {SEP}, {N.PERSON2}, {SEP}, 'soon', {SEP}, 'Closed', {SEP}, 'by mail') else '' end as segments, "
        f"concat('Count ', p_name, {SEP}, {N.PERSON}, {SEP}, {N.iso('o_orderdate')}, {SEP}, 'Open', {SEP}, '') as lines from h"
    ),
)
def _(spark, folder):
    note = N.profile_notes(spark, folder, N.FREE)
    line = N.profile_notes(spark, folder, f"concat('Action | Owner | Due', chr(10), '* Count ', p_name, ' | ', {N.PERSON}, ' | ', {N.ANY_DATE.replace('when 1 then ' + N.dmy('o_orderdate'), 'when 1 then ' + N.iso('o_orderdate'))})")
    return note.select("doc_id", joined(L.action_segments(F.col("text")), L.ACTION_COLUMNS).alias("segments")).join(
        line.select("doc_id", joined(L.action_rows(F.col("text")), L.ACTION_COLUMNS).alias("lines")), "doc_id"
    )


@check(
    "fn26_bullet_item",
    with_views(
        "lparts",
        f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when m = 1 then concat('Send ', lp_name, ' , , ] )') else concat('Ship ', lp_name) end as task, "
        f"case when m = 1 then 'Max' else replace(s_name, '#', ' ') end as owner, case when m = 1 then '5 May' else {N.iso('l_shipdate')} end as due_date, "
        "case when m = 1 then 'open' when m = 2 then 'done' end as status, case when m = 1 then 'high' end as priority "
        "from (select *, l_orderkey % 3 as m from lparts)",
    ),
)
def _(spark, folder):
    text = F.expr(
        f"case l_orderkey % 3 when 1 then concat('Send ', lp_name, ' [Owner: Max, Due: 5 May, status=open] (priority: high)') "
        f"when 2 then concat('Ship ', lp_name, ' — ', replace(s_name, '#', ' '), ' — ', {N.iso('l_shipdate')}, ' — done') "
        f"else concat('Ship ', lp_name, ' — ', replace(s_name, '#', ' '), ' — ', {N.iso('l_shipdate')}) end"
    )
    return N.line_parts(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", L.bullet_item(text).alias("i")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "i.*")


@check(
    "fn21_map_vocab",
    "select o_orderkey, case o_orderkey % 5 when 0 then 'Ondemand' when 1 then 'Yearly' when 2 then 'Daily' when 3 then o_orderpriority else 'Monthly' end as frequency from orders",
)
def _(spark, folder):
    key = F.col("o_orderkey") % 5
    given = F.when(key == 0, " On   Demand").when(key == 1, "annual").when(key == 2, "").when(key == 3, F.col("o_orderpriority")).otherwise("MONTHLY")
    return table(spark, folder, "orders").select("o_orderkey", L.map_vocab(given, L.FREQUENCY, "Daily").alias("frequency"))


@check("fn22_alias_pick", "select p_partkey, case when p_size % 2 = 0 then p_brand when p_size % 3 = 0 then p_type else p_name end as picked from part")
def _(spark, folder):
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        "p_partkey",
        L.alias_pick(F.when(size % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(""), F.when(size % 3 == 0, F.col("p_type")), F.col("p_name")).alias("picked"),
    )


@check(
    "fn34_flow_steps",
    "select p_partkey, case p_size % 5 when 0 then concat('Pick ', p_name, '|Pack|Ship') when 1 then concat('Open ', p_name, '|Post') when 2 then concat(p_name, '|', p_brand) "
    "when 3 then concat('Take the ', p_name, '.|Store it in the hall.') else p_name end as steps from part",
)
def _(spark, folder):
    text = F.expr(
        "case p_size % 5 when 0 then concat('Pick ', p_name, ' ; Pack ; Ship') when 1 then concat('1. Open ', p_name, '; 2) Post') "
        "when 2 then concat('- ', p_name, chr(10), '- ', p_brand) when 3 then concat('Take the ', p_name, '. Store it in the hall. Yes.') else p_name end"
    )
    return table(spark, folder, "part").select("p_partkey", F.array_join(L.flow_steps(text), "|").alias("steps"))


@check(
    "fn35_item_type",
    "select p_partkey, case p_size % 6 when 0 then 'Epic' when 1 then 'User Story' when 2 then 'Feature' when 3 then 'Feature' when 4 then p_type else 'User Story' end as type from part",
)
def _(spark, folder):
    given = F.expr("case p_size % 6 when 0 then 'sub-EPIC' when 1 then 'user_story' when 2 then ' new feature ' when 3 then '' when 4 then p_type else 'Story of the User' end")
    return table(spark, folder, "part").select("p_partkey", L.item_type(given).alias("type"))


@check(
    "fn38_rows_to_lines",
    with_views(
        "",
        "select p_partkey, concat(p_name, ' | ', p_brand, ' ; ', p_type, ' | a ; ', p_size) as lines, p_name as name, concat(p_brand, ' ; ', p_type) as note from part",
    ),
)
def _(spark, folder):
    rows = F.array(
        F.struct(
            F.col("p_name").alias("name"), F.concat("p_brand", F.lit("\n"), "p_type").alias("note"),
            F.array(F.lit("a "), F.lit(" "), F.col("p_size").cast("string")).alias("flow"),
        )
    )
    lined = table(spark, folder, "part").select("p_partkey", L.rows_to_lines(rows, ("name", "note", "flow"), ("flow",)).alias("lines"))
    back = L.lines_to_rows(F.col("lines"), ("name", "note"))
    return lined.select("p_partkey", "lines", back[0]["name"].alias("name"), back[0]["note"].alias("note"))


@check(
    "fn46_item_line_role",
    "select p_partkey, case p_size % 7 when 0 then 'blank' when 1 then 'area' when 2 then 'desc_label' when 3 then 'acc_label' when 4 then 'flow_label' when 5 then 'title' else 'body' end as role from part",
)
def _(spark, folder):
    line = F.expr(
        "case p_size % 7 when 0 then '  ' when 1 then concat('Area Path: ', p_name) when 2 then 'Description:' when 3 then concat('acceptance of ', p_name) "
        "when 4 then 'Process steps' when 5 then concat('Type: Epic | ', p_name) else p_name end"
    )
    return table(spark, folder, "part").select("p_partkey", L.item_line_role(line).alias("role"))


@check(
    "wn08_serial_numbers",
    "select p_partkey, concat('1. ', p_name, '|2) ready|3. ', p_brand) as steps, concat('55.10.', lpad(cast(p_size as varchar), 3, '0')) as code from part",
)
def _(spark, folder):
    steps = F.array(F.concat(F.col("p_name"), F.lit(" ")), F.lit("2) ready"), F.col("p_brand"), F.lit(" "))
    return table(spark, folder, "part").select(
        "p_partkey", F.array_join(L.number_steps(steps), "|").alias("steps"), L.serial_code(F.lit("55.10"), F.col("p_size")).alias("code")
    )


@check(
    "st02_ordered_distinct",
    "select p_partkey, concat(p_name, ',', p_type, ',', p_brand, ',', upper(p_name)) as exact, concat(p_name, ',', p_type, ',', p_brand) as folded from part",
)
def _(spark, folder):
    items = F.array(F.col("p_name"), F.col("p_type"), F.col("p_name"), F.col("p_brand"), F.upper("p_name"), F.col("p_brand"))
    return table(spark, folder, "part").select(
        "p_partkey", F.array_join(T.ordered_distinct(items), ",").alias("exact"), F.array_join(T.ordered_distinct(items, True), ",").alias("folded")
    )


@check(
    "st03_split_misplaced",
    head_sql("select doc_id, concat('Orders for ', p_name, ' sit unsorted|Today clerks wait') as what_breaks, concat('A queue that reads ', p_name, ' orders|One click release|The tool drafts a reply') as what_you_built from h"),
)
def _(spark, folder):
    out = forms.extract_pitch(N.profile_notes(spark, folder, N.PITCH))
    return out.select("doc_id", F.array_join("what_breaks", "|").alias("what_breaks"), F.array_join("what_you_built", "|").alias("what_you_built"))


@check(
    "cq17_extract_meeting",
    head_sql(
        f"select doc_id, 'Stock Review Meeting' as purpose, {N.iso('o_orderdate')} as meeting_date, concat(c_mktsegment, ' Room') as venue, {N.PERSON} as prepared_by, "
        f"{_PEOPLE} as people, {_SUMMARY} as summary, case when v < 2 then concat('Count ', p_name, {SEP}, {N.day_name('o_orderdate')}, '; ', {N.PERSON2}, {SEP}, 'Review ', p_brand, {SEP}, 'soon') else '' end as actions from h"
    ),
)
def _(spark, folder):
    out = forms.extract_meeting(N.profile_notes(spark, folder, N.FREE), today="2024-02-01")
    none = F.lit("")
    return out.select(
        "doc_id", "purpose", "meeting_date", "venue", "prepared_by",
        F.coalesce(F.array_join("attendees_team", ","), none).alias("people"), F.array_join("summary_items", ";").alias("summary"),
        F.coalesce(joined(F.col("action_items"), ("owner", "due_date", "status", "remarks")), none).alias("actions"),
    )


_BP = "case when v = 0 then concat('5', cast(p_size % 10 as varchar), '. Order to Ship') end"
_PRE = "case when v = 0 then concat('5', cast(p_size % 10 as varchar), '.10') else '55.10' end"
_FUNC = (
    f"case when v < 2 then concat({_PRE}, '.001 Stock check', {SEP}, 'Check stock of ', p_name, {SEP}, 'Order', {SEP}, 'Report', {SEP}, c_mktsegment, {SEP}, "
    f"case o_orderstatus when 'O' then 'Ondemand' when 'F' then 'Monthly' else 'every' end, {SEP}, 'Automatic', {SEP}, lower(p_type), {SEP}, 'Fixed Assets', {SEP}, 'Gap', {SEP}, '', chr(10), "
    f"'55.10.009 Release', {SEP}, 'Release order', {SEP}, '', {SEP}, 'Note', {SEP}, 'Finance', {SEP}, 'Weekly', {SEP}, 'Manual', {SEP}, 'Batch', {SEP}, 'Sales', {SEP}, 'Partial', {SEP}, '1. Open 2. Post') "
    f"else concat({_PRE}, '.001 Stock check', {SEP}, 'verify ', p_name, ' , input: order list', {SEP}, 'order list', {SEP}, 'report', {SEP}, 'Finance', {SEP}, 'Daily', {SEP}, 'Manual', {SEP}, 'Report', {SEP}, 'Sales', {SEP}, 'Fit', {SEP}, '', chr(10), "
    f"{_PRE}, '.002 Invoice run', {SEP}, 'for ', c_mktsegment, ' with handling', {SEP}, '', {SEP}, '', {SEP}, 'Finance', {SEP}, 'Ondemand', {SEP}, 'Manual', {SEP}, 'Batch', {SEP}, 'Fixed Assets', {SEP}, 'Gap', {SEP}, '', chr(10), "
    f"{_PRE}, '.003 Post the ledger', {SEP}, 'step', {SEP}, '', {SEP}, '', {SEP}, 'Finance', {SEP}, 'Ondemand', {SEP}, 'Automatic', {SEP}, 'Screen', {SEP}, 'Fixed Assets', {SEP}, 'Fit', {SEP}, '') end"
)


@check(
    "cq18_extract_functions",
    head_sql(f"select doc_id, p_name as project_name, c_mktsegment as workstream, coalesce({_BP}, '') as business_process, {_FUNC} as functions from h"),
)
def _(spark, folder):
    out = forms.extract_functions(N.profile_notes(spark, folder, N.FUNCTIONS))
    return out.select(
        "doc_id", "project_name", "workstream", F.coalesce("business_process", F.lit("")).alias("business_process"),
        joined(F.col("functions"), L.FUNCTION_COLUMNS).alias("functions"),
    )


@check("fn42_prose_rows", head_sql("select doc_id, unnest(['Stock check', 'Invoice run', 'Post the ledger']) as process, unnest(['Daily', '', '']) as frequency, unnest(['', 'Manual', 'Automatic']) as manual_auto, unnest(['', 'Gap', '']) as fit_gap from h where v >= 2"))
def _(spark, folder):
    # the other notes hold rows with bars only, of which none reads as prose
    notes = N.profile_notes(spark, folder, N.FUNCTIONS)
    rows = L.prose_rows(T.section_blob(F.col("text"), ["Functions"]))
    return notes.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.process", "r.frequency", "r.manual_auto", "r.fit_gap")


@check(
    "cq19_extract_scenarios",
    head_sql(
        f"select doc_id, p_name as project_name, c_mktsegment as workstream, {N.PERSON} as updated_by, "
        f"concat('POC-', cast(o_orderkey as varchar), {SEP}, p_type, {SEP}, p_brand, {SEP}, 'Check ', p_name, {SEP}, 'Full run', {SEP}, 'Stock set', {SEP}, 'Open list', {SEP}, 'Standard', {SEP}, cast(o_custkey as varchar), chr(10), "
        f"'POC-y', {SEP}, o_orderstatus, {SEP}, 'third', {SEP}, {SEP}, {SEP}, {SEP}, {SEP}, {SEP}) as pocs from h"
    ),
)
def _(spark, folder):
    out = forms.extract_scenarios(N.profile_notes(spark, folder, N.SCENARIOS))
    return out.select("doc_id", "project_name", "workstream", "updated_by", joined(F.col("pocs"), L.SCENARIO_COLUMNS).alias("pocs"))


_DEFAULT_FLOW = "concat('Start ', {n}, ';Complete required checks for ', {n}, ';Record the outcome and continue the process')"
_ITEMS = (
    f"concat('Epic', {SEP}, p_name, ' delivery', {SEP}, 'End to end delivery of ', p_name, {SEP}, 'All stages covered', {SEP}, 'Request ', p_brand, ';Ship ', p_type, chr(10), "
    f"'Feature', {SEP}, 'Request ', p_brand, {SEP}, 'Ask for the part. Check the stock level.', {SEP}, 'Request stored and checked', {SEP}, 'Ask for the part.;Check the stock level.', chr(10), "
    f"'Feature', {SEP}, 'Ship ', p_type, {SEP}, {SEP}, {SEP}, 'Pick;Pack;Ship', chr(10), "
    f"'User Story', {SEP}, 'Track ', p_name, {SEP}, 'User can track', {SEP}, {SEP}, 'Open Track ', p_name, ';Enter required details and validate mandatory fields;Submit and record the outcome')"
)


@check(
    "cq20_extract_requirements",
    head_sql(
        f"select doc_id, concat('5', cast(p_size % 10 as varchar), '.10 ', p_name) as process_name, {N.PERSON} as prepared_by, case when v = 1 then {N.iso('o_orderdate')} else {N.iso('o_orderdate')} end as document_date, "
        f"case when v = 1 then c_mktsegment else 'Area' end as area_path, concat('Bring ', p_name, ' from request to delivery with checks.') as overview, {_ITEMS} as items from h"
    ),
)
def _(spark, folder):
    out = forms.extract_requirements(N.profile_notes(spark, folder, N.REQUIREMENTS), area_path="Area")
    return out.select(
        "doc_id", "process_name", "prepared_by", "document_date", "area_path", "overview", joined(F.col("items"), L.ITEM_COLUMNS, ("flow",)).alias("items")
    )


_TEAM = "case v when 0 then '' when 1 then '' else concat('Team ', p_brand) end"


@check(
    "cq21_extract_pitch",
    head_sql(
        f"select doc_id, {_TEAM} as team_name, case when v = 0 then concat({N.PERSON}, ', ', {N.PERSON2}, ', Zoe') else '' end as team_members, "
        "case when v = 2 then concat('PS-0', cast(p_size % 10 + 10 as varchar)) else '' end as problem_statement_id, "
        "case when v = 3 then '' else concat(c_mktsegment, ' automation') end as theme, concat('https://example.org/', o_orderkey) as demo_url, concat(p_size, ' teams') as reach, "
        "concat('For ', lower(c_mktsegment), ' clerks, our queue sorts every order of ', p_name, ' at once') as pitch, concat('Spark for ', p_type) as tools_used from h"
    ),
)
def _(spark, folder):
    out = forms.extract_pitch(N.profile_notes(spark, folder, N.PITCH))
    none = F.lit("")
    return out.select(
        "doc_id", *[F.coalesce(c, none).alias(c) for c in ("team_name", "team_members", "problem_statement_id", "theme", "demo_url", "reach", "pitch")],
        F.array_join("tools_used", "|").alias("tools_used"),
    )


@check(
    "fn37_sanitize_identity",
    "select o_orderkey, case o_orderkey % 3 when 0 then '' when 1 then 'Crew' else '' end as team_name, case o_orderkey % 3 when 0 then 'Ann; Bob' when 1 then 'given' else 'given' end as team_members, "
    "case o_orderkey % 4 when 0 then concat('PS-', lpad(cast(o_custkey % 100 as varchar), 3, '0')) when 1 then '' else 'short id' end as problem_statement_id, "
    "case o_orderkey % 2 when 0 then 'Theme one' else '' end as theme, case o_orderkey % 2 when 0 then '' else 'for clerks so that it works' end as pitch from orders",
)
def _(spark, folder):
    ctx = table(spark, folder, "orders").select(
        "o_orderkey", F.expr("case o_orderkey % 3 when 0 then 'Ann; Bob' when 1 then concat('Crew', chr(10), 'x') else 'Members' end").alias("team_name"),
        F.expr("case o_orderkey % 3 when 0 then '' else 'given' end").alias("team_members"),
        F.expr("case o_orderkey % 4 when 0 then concat('see ps ', lpad(cast(o_custkey % 100 as string), 3, '0'), ' there') when 1 then 'this one has far too many words' else 'short id' end").alias("problem_statement_id"),
        F.expr("case o_orderkey % 2 when 0 then 'Theme one.' else 'for clerks so that it works' end").alias("theme"),
        F.lit(None).cast("string").alias("pitch"),
    )
    out = forms.sanitize_identity(ctx)
    return out.select("o_orderkey", *[F.coalesce(c, F.lit("")).alias(c) for c in ("team_name", "team_members", "problem_statement_id", "theme", "pitch")])


def _mixed(spark, folder):
    """Notes of all shapes, a fifth of them without a profile."""
    head = {"mom": N.FREE, "bfl": N.FUNCTIONS, "poc_list": N.SCENARIOS, "brd": N.REQUIREMENTS, "sample_ppt": N.PITCH}
    names = list(head) + [None]
    rows = None
    for i, name in enumerate(names):
        part = N.profile_notes(spark, folder, head.get(name, N.SCENARIOS)).where(f"doc_id % 6 = {i}").withColumn("profile", F.lit(name).cast("string"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@check(
    "cq22_extract_form",
    head_sql(
        "select doc_id, case k when 0 then 'mom' when 1 then 'bfl' when 2 then 'poc_list' when 3 then 'brd' when 4 then 'sample_ppt' else '' end as profile, "
        "case k when 0 then case when v < 2 then case when v = 1 then 'Attendees (team)' else '' end when v >= 2 then 'Action plan' end "
        "when 1 then case when v = 0 then '' else 'Business process' end when 2 then '' when 3 then '' "
        "when 4 then concat_ws(',', case when v < 2 then 'Team name' end, case when v <> 2 then 'Problem statement ID' end, case when v = 3 then 'Theme' end, case when v <> 0 then 'Team members' end) else '' end as missing "
        "from (select *, doc_id % 6 as k from h)"
    ),
)
def _(spark, folder):
    form = forms.extract_form(_mixed(spark, folder), "2024-02-01", "the author")
    return forms.missing_required(form).select("doc_id", "profile", F.array_join("missing", ",").alias("missing"))
