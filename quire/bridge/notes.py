"""Notes, templates, answers and list items derived from orders, as text.

The pieces are plain SQL expressions that Spark and the checking engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.bridge.views import ordered_parts
from quire.sources.tables import spread, table

NL = "chr(10)"
_MONTH = (
    "split_part('January February March April May June July August September October November December', ' ', "
    "cast(month({d}) as int))"
)


def iso(d: str) -> str:
    return (
        f"concat(cast(year({d}) as string), '-', lpad(cast(month({d}) as string), 2, '0'), '-', "
        f"lpad(cast(day({d}) as string), 2, '0'))"
    )


def dmy(d: str) -> str:
    return f"concat(cast(day({d}) as string), '/', cast(month({d}) as string), '/', cast(year({d}) as string))"


def day_name(d: str) -> str:
    return f"concat(cast(day({d}) as string), ' ', {_MONTH.format(d=d)}, ' ', cast(year({d}) as string))"


def name_day(d: str) -> str:
    return f"concat({_MONTH.format(d=d)}, ' ', cast(day({d}) as string), ', ', cast(year({d}) as string))"


D = "o_orderdate"
VARIANT = "o_orderkey % 4"
ANY_DATE = f"case {VARIANT} when 0 then {iso(D)} when 1 then {dmy(D)} when 2 then {day_name(D)} else {name_day(D)} end"
PERSON = (
    "concat(split_part('Ada Bela Cleo Dora Emil Fritz Gina Hugo Ines Jana', ' ', cast(o_custkey % 10 as int) + 1), ' ', "
    "split_part('Adler Brandt Conti Duval Ebner Frank Gallo Huber', ' ', cast(o_custkey % 8 as int) + 1))"
)
PERSON2 = (
    "concat(split_part('Karl Lena Mara Nils Olga Paul Rosa Sven', ' ', cast(o_orderkey % 8 as int) + 1), ' ', "
    "split_part('Keller Lang Moser Nagel Olsen Popp', ' ', cast(o_orderkey % 6 as int) + 1))"
)

BULLET = "concat('- Ship ', lp_name, ' — ', replace(s_name, '#', ' '), ' — ', " + iso("l_shipdate") + ")"
PIPE = "concat('Feature | ', lp_name, ' | ', lp_type, ' item for ', replace(s_name, '#', ' '), ' | ', lp_brand)"

GENERAL = (
    f"concat('Meeting Date: ', {ANY_DATE}, {NL}, 'Prepared by: ', replace(c_name, '#', ' '), {NL}, "
    f"case when {VARIANT} = 2 then concat('Attendees (Vendor): ', {PERSON}, ', ', {PERSON2}, {NL}) else '' end, "
    f"'Project: ', p_name, {NL}, 'Status: ', o_orderstatus, {NL}, "
    f"case when {VARIANT} = 3 then concat('  and moving on with ', p_brand, {NL}) else '' end, {NL}, "
    f"'Action items:', {NL}, bullets, {NL}, {NL}, 'Items:', {NL}, "
    f"'Epic | ', p_name, ' program | Everything about ', p_name, ' | Accepted by ', {PERSON}, {NL}, pipes, {NL}, {NL}, "
    f"'Summary:', {NL}, 'The order of ', {day_name(D)}, ' covers ', cast(n as string), ' lines for ', p_name, "
    f"' and stays within the plan.', {NL}, 'The Order Review Meeting was held on ', {day_name(D)}, ' at the Main Hall. "
    f"It was chaired by ', {PERSON}, ', with ', {PERSON2}, ', ', p_type, ' Team and the sales team attending. "
    f"The agenda focused on reviewing ', p_name, ', discussing ', p_brand, ' and confirming stock levels. "
    f"The team agreed to ship ', p_name, ' early. ', {PERSON}, ' will check the ', p_name, ' stock by 20 August.')"
)

FREE = (
    f"concat('The Stock Review Meeting was held on ', {day_name(D)}, ' at the ', c_mktsegment, ' Room. It was ', "
    f"case when {VARIANT} = 1 then 'hosted' else 'chaired' end, ' by ', {PERSON}, ', with ', {PERSON2}, ', ', p_type, "
    f"' Team and field representatives attending. The agenda focused on reviewing ', p_name, ', discussing ', p_brand, "
    f"' and confirming stock levels. The team agreed to keep ', p_name, ' in stock. It was also decided that ', p_brand, "
    f"' stays listed. ', case when {VARIANT} < 2 then concat('The following action items were noted: ', {PERSON}, ' | Count ', p_name, "
    f"' | ', {day_name(D)}, '; ', {PERSON2}, ' | Review ', p_brand, ' | soon | Closed | by mail. The meeting concluded.') else '' end)"
)

FUNCTIONS = (
    f"concat('Project: ', p_name, {NL}, 'Workstream: ', c_mktsegment, {NL}, "
    f"case when {VARIANT} = 0 then concat('Business process: 5', cast(p_size % 10 as string), '. Order to Ship', {NL}) else '' end, {NL}, "
    f"'Functions:', {NL}, case when {VARIANT} < 2 then concat("
    f"'Stock check | Check stock of ', p_name, ' | Order | Report | ', c_mktsegment, ' | ', case o_orderstatus when 'O' then 'on demand' "
    f"when 'F' then 'Monthly' else 'every ' end, ' | auto | ', lower(p_type), ' | | gap', {NL}, "
    f"'55.10.009 Release | Release order | | Note | | weekly | manual | job | Sales | partial | 1. Open 2. Post') "
    f"else concat('1. Stock check: verify ', p_name, ' daily, input: order list; output: report; module: Sales', {NL}, "
    f"'- Invoice run - manual batch for ', c_mktsegment, ' with gap handling', {NL}, 'Post the ledger; automatic screen step') end)"
)

SCENARIOS = (
    f"concat('Project: ', p_name, {NL}, 'Prepared by: ', {PERSON}, {NL}, case when {VARIANT} = 0 then 'Workstream: ' || c_mktsegment "
    f"else 'POC list for ' || p_name || ' / ' || c_mktsegment end, {NL}, {NL}, 'Scenarios:', {NL}, "
    f"'ID | Cycle | Sub-Process | Title', {NL}, 'POC-', cast(o_orderkey as string), ' | ', p_type, ' | ', p_brand, ' | Check ', p_name, "
    f"' | Full run | Stock set | Open list | Standard | ', cast(o_custkey as string), {NL}, 'POC-x | short', {NL}, "
    f"'- POC-y | ', o_orderstatus, ' | third')"
)

REQUIREMENTS = (
    f"concat('Process: 5', cast(p_size % 10 as string), '.10 ', p_name, {NL}, 'Prepared by: ', {PERSON}, {NL}, 'Date: ', {ANY_DATE}, {NL}, "
    f"case when {VARIANT} = 1 then concat('Area path: ', c_mktsegment, {NL}) else '' end, "
    f"'Overview: Bring ', p_name, ' from request to delivery with checks.', {NL}, {NL}, 'Items:', {NL}, "
    f"'Epic | ', p_name, ' delivery | End to end delivery of ', p_name, ' | All stages covered', {NL}, "
    f"'feature | Request ', p_brand, ' | Ask for the part. Check the stock level. | Request stored and checked', {NL}, "
    f"'Feature | Ship ', p_type, ' | | | Pick ; Pack ; Ship', {NL}, "
    f"case when {VARIANT} = 2 then concat('Note | Not an item | ', p_brand, {NL}) else '' end, "
    f"'user_story | Track ', p_name, ' | User can track | ')"
)

PITCH = (
    f"concat('Team name: ', case {VARIANT} when 0 then {PERSON} || ', ' || {PERSON2} || ', Zoe' when 1 then 'members' "
    f"else 'Team ' || p_brand end, {NL}, 'Problem statement: ', case when {VARIANT} = 2 then 'ps 0' || cast(p_size % 10 + 10 as string) else 'a long text with more than four words' end, {NL}, "
    f"'Theme: ', case when {VARIANT} = 3 then 'For ' || c_mktsegment || ' so that ' || p_name || ' ships' else c_mktsegment || ' automation.' end, {NL}, "
    f"'Demo link: https://example.org/', cast(o_orderkey as string), {NL}, 'Reach: ', cast(p_size as string), ' teams', {NL}, "
    f"'For ', lower(c_mktsegment), ' clerks, our queue sorts every order of ', p_name, ' at once.', {NL}, {NL}, "
    f"'What breaks today', {NL}, '- Orders for ', p_name, ' sit unsorted', {NL}, '- The tool drafts a reply', {NL}, {NL}, "
    f"'What you built', {NL}, '- A queue that reads ', p_name, ' orders', {NL}, '- Today clerks wait', {NL}, "
    f"'- One click release', {NL}, {NL}, 'Tools used', {NL}, '- Spark for ', p_type)"
)

TEMPLATE = (
    "concat('Dear {{ customer_name }}, your {{order_id|plain}} for ', p_name, ' [Item Name] is «Order Date» and <<status>> at $', '{total}. ', "
    "'{% Ship Mode %} {{#LINES}}{{line.text}}{{/LINES}} {{^EMPTY}} {{if}}', chr(10), 'Contact person: ____', chr(10), 'Remarks: [free text]', "
    "chr(10), p_brand, ' code: {{', lower(p_type), '_code}}', chr(10), 'Total:')"
)
# --------------------------------------------------------------------------------------------------


def _head(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    # short rows become long texts: they are dealt over all tasks before that
    rows = ordered_parts(spark, folder).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return spread(rows.join(customer, F.col("c_custkey") == F.col("o_custkey")), "o_orderkey")


def line_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the names of their part and supplier."""
    part = table(spark, folder, "part").select(
        "p_partkey", F.col("p_name").alias("lp_name"), F.col("p_type").alias("lp_type"), F.col("p_brand").alias("lp_brand")
    )
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return (
        table(spark, folder, "lineitem")
        .withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    )


def general_notes(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text: every order with its lines as bullets and pipe rows."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = spread(line_parts(spark, folder), "l_orderkey")
    packed = F.sort_array(F.collect_list(F.struct(*order, F.expr(BULLET).alias("b"), F.expr(PIPE).alias("p"))))
    lines = rows.groupBy("l_orderkey").agg(packed.alias("rows")).select(
        "l_orderkey", F.size("rows").alias("n"),
        F.array_join(F.transform("rows", lambda r: r["b"]), "\n").alias("bullets"),
        F.array_join(F.transform("rows", lambda r: r["p"]), "\n").alias("pipes"),
    )
    return _head(spark, folder).join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("doc_id"), F.expr(GENERAL).alias("text"), "o_orderdate"
    )


def profile_notes(spark: SparkSession, folder: str, expression: str) -> DataFrame:
    """doc_id, text of one note shape; one order, one note."""
    return _head(spark, folder).select(F.col("o_orderkey").alias("doc_id"), F.expr(expression).alias("text"))


def template_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "part"), "p_partkey").select(F.col("p_partkey").alias("template_id"), F.expr(TEMPLATE).alias("text"))


HEAD_SQL = "select * from ordered join customer on c_custkey = o_custkey"
NOTE_CTES = {
    "head": HEAD_SQL,
    "lparts": "select l.*, p_name as lp_name, p_type as lp_type, p_brand as lp_brand, s_name from lineitem l "
    "join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey",
    "notes": f"select o_orderkey as doc_id, {GENERAL} as text, o_orderdate from head join (select l_orderkey, count(*) as n, "
    f"string_agg({BULLET}, chr(10) order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as bullets, "
    f"string_agg({PIPE}, chr(10) order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as pipes "
    "from lparts group by 1) on l_orderkey = o_orderkey",
    "tpl": f"select p_partkey as template_id, {TEMPLATE} as text from part",
}


def notes_sql(expression: str) -> str:
    return f"select o_orderkey as doc_id, {expression} as text from head"
