"""Inventory scans, key functions and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.bridge import sqlfn as Q, views as V
from quire.bridge.sql import with_views
from quire.checks import check
from quire.functions import keys as K
from quire.operators import catalog as C, inventory as I
from quire.sources import records as R
from quire.sources.tables import table


def inv1(spark, folder):
    return I.merge_listings(V.inventory(spark, folder))


@check(
    "sc01_inventory_scan",
    with_views("inv", "select key, name, size, last_modified, etag from inv where starts_with(key, 'documents/')"),
)
def _(spark, folder):
    return I.from_listing(V.inventory(spark, folder).drop("name"), "documents/")


@check("sc02_inventory_union", with_views("inv1", "select key, name, size, last_modified, prefix_ord from inv1"))
def _(spark, folder):
    return inv1(spark, folder).select("key", "name", "size", "last_modified", "prefix_ord")


@check(
    "sc02_inventory_union_first",
    with_views(
        "inv",
        "select key, size, last_modified from (select *, row_number() over (partition by key order by prefix_ord, "
        "last_modified desc nulls last, size desc) k from inv) where k = 1",
    ),
)
def _(spark, folder):
    return I.merge_listings(V.inventory(spark, folder), "first").select("key", "size", "last_modified")


_OBJECT_VERSIONS = "select s3_key as key, concat('id-', part) as version_id, part % 3 = 0 as is_latest, part as size, " \
    "created_at as last_modified, substr(md5(s3_key), 1, 16) as etag from vers"


@check(
    "sc03_object_versions",
    with_views(
        "vers",
        "select version_id, is_latest, size, last_modified, etag from ov where key = (select max(key) from ov) "
        "order by last_modified desc, version_id limit 20",
        ov="select concat(template_id, '/file') as key, concat('id-', part) as version_id, part % 3 = 0 as is_latest, "
        "part as size, created_at as last_modified, substr(md5(s3_key), 1, 16) as etag from vers",
    ),
)
def _(spark, folder):
    rows = V.versions(spark, folder).select(
        F.concat("template_id", F.lit("/file")).alias("key"), F.concat(F.lit("id-"), F.col("part")).alias("version_id"),
        (F.col("part") % 3 == 0).alias("is_latest"), F.col("part").alias("size"),
        F.col("created_at").alias("last_modified"), F.substring(F.md5("s3_key"), 1, 16).alias("etag"),
    )
    newest = rows.agg(F.max("key")).scalar()
    return I.object_versions(rows, newest)


@check(
    "sc04_with_object_metadata",
    with_views(
        "inv1 omd",
        "select i.key, i.size, coalesce(m.template_id, '') as template_id, coalesce(m.generated_by, '') as generated_by, "
        "coalesce(m.template_name, '') as template_name from inv1 i left join omd m using (key)",
    ),
)
def _(spark, folder):
    merged = I.with_object_metadata(inv1(spark, folder), V.object_metadata(spark, folder))
    return merged.select(
        "key", "size",
        *[F.coalesce(F.col("metadata")[c], F.lit("")).alias(c) for c in ("template_id", "generated_by", "template_name")],
    )


_SIDECAR = """
select p_partkey, case p_partkey % 5 when 0 then concat('["', p_name, '"]') when 1 then concat('{"id": "', p_name)
  when 2 then '' else concat('{"id": "p', p_partkey, '", "name": "', p_name, '", "usage_count": ', p_size, '}') end as raw
from part"""


@check(
    "sc05_metadata_read",
    f"select p_partkey, case when ok then json_extract_string(raw, '$.id') end as id, "
    f"case when ok then json_extract_string(raw, '$.name') end as name, "
    f"case when ok then cast(json_extract_string(raw, '$.usage_count') as bigint) end as usage_count "
    f"from (select *, json_valid(raw) and starts_with(raw, '{{') as ok from ({_SIDECAR}))",
)
def _(spark, folder):
    key, name = F.col("p_partkey"), F.col("p_name")
    raw = (
        F.when(key % 5 == 0, F.concat(F.lit('["'), name, F.lit('"]')))
        .when(key % 5 == 1, F.concat(F.lit('{"id": "'), name))
        .when(key % 5 == 2, "")
        .otherwise(
            F.concat(F.lit('{"id": "p'), key, F.lit('", "name": "'), name, F.lit('", "usage_count": '),
                     F.col("p_size"), F.lit("}"))
        )
    )
    rows = table(spark, folder, "part").select("p_partkey", raw.alias("raw"))
    return R.metadata_parse(rows, "raw").select("p_partkey", "meta.id", "meta.name", "meta.usage_count")


@check(
    "sc06_metadata_write",
    with_views(
        "meta",
        "select concat('metadata/', trim(regexp_replace(id, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), '.json') as key, id, name, "
        "description, usage_count, active_version, created_by, '2024-02-01T00:00:00+00:00' as updated_at, 'admin' as updated_by "
        "from (select * replace (concat(id, ' (', created_by, ')') as id) from meta)",
    ),
)
def _(spark, folder):
    rows = V.template_metadata(spark, folder).withColumns(
        {"id": F.concat("id", F.lit(" ("), "created_by", F.lit(")")), "scratch": F.lit("dropped")}
    ).drop("tags")
    return R.metadata_rows(rows, "admin", "2024-02-01T00:00:00+00:00")


_STAMP = (
    "concat({y}, {m}, {d}, '_', lpad(cast(hour(created_at) as varchar), 2, '0'), lpad(cast(minute(created_at) as varchar), 2, '0'), "
    "lpad(cast(second(created_at) as varchar), 2, '0'))"
).format(
    y="cast(year(created_at) as varchar)", m="lpad(cast(month(created_at) as varchar), 2, '0')",
    d="lpad(cast(day(created_at) as varchar), 2, '0')",
)


@check(
    "sc07_generated_sink",
    with_views(
        "vers",
        f"select concat('documents/generated/', strftime(created_at, '%Y/%m/%d/'), doc) as key, doc as document_name, "
        f"template_id, version as template_version, year(created_at) as year, month(created_at) as month, "
        f"day(created_at) as day from (select *, concat({Q.stem('s3_key')}, '_', {_STAMP}, '.', {Q.ext('s3_key')}) as doc "
        f"from (select * replace (created_at + part * interval 61 second as created_at) from vers))",
    ),
)
def _(spark, folder):
    rows = V.versions(spark, folder).select(
        K.base_name(F.col("s3_key")).alias("name"), "template_id", F.col("s3_key").alias("template_key"),
        F.lit("").alias("template_name"), "version", F.lit("").alias("owner"),
        (F.col("created_at") + F.make_dt_interval(secs=F.col("part") * 61)).alias("made_at"),
    )
    return R.generated_rows(rows, F.col("made_at")).select(
        "key", "document_name", "template_id", "template_version", "year", "month", "day"
    )


@check(
    "sc12_pick_kb_source",
    with_views(
        "inv1",
        "select key, size, contains(lower(name), 'knowledge_base') as preferred from f where ends_with(lower(name), '.json') "
        "order by preferred desc, size desc, key limit 1",
        f="select key, size, case when size % 11 = 0 and ends_with(name, '.json') then concat('Knowledge_Base_', name) "
        "else name end as name from inv1",
    ),
)
def _(spark, folder):
    renamed = inv1(spark, folder).withColumn(
        "name",
        F.when((F.col("size") % 11 == 0) & F.col("name").endswith(".json"), F.concat(F.lit("Knowledge_Base_"), "name"))
        .otherwise(F.col("name")),
    )
    return R.pick_kb_source(renamed).select("key", "size", "preferred")


@check(
    "sc14_ingest_guard",
    "select doc_id, coalesce(case when strlen(text) = 0 then 'empty' when strlen(text) > 4096 then 'too large' end, '') as reason, "
    "cast(length(text[1:4000]) as bigint) as preview_chars, cast(length(text) as bigint) as chars from documents",
)
def _(spark, folder):
    good, bad = R.ingest_guard(table(spark, folder, "documents"), max_bytes=4096)
    chars = F.length("text").cast("bigint").alias("chars")
    first = good.select("doc_id", F.lit("").alias("reason"), F.length("preview_text").cast("bigint").alias("preview_chars"), chars)
    rest = bad.select("doc_id", "reason", F.length(F.substring("text", 1, 4000)).cast("bigint").alias("preview_chars"), chars)
    return first.unionByName(rest)


@check("pf01_classify_area", with_views("inv", f"select distinct key, {Q.area('key')} as area from inv"))
def _(spark, folder):
    return V.inventory(spark, folder).select("key", K.classify_area(F.col("key")).alias("area")).distinct()


@check("pf02_file_kind", with_views("inv1", f"select key, {Q.kind('name')} as kind from inv1"))
def _(spark, folder):
    return inv1(spark, folder).select("key", K.file_kind(F.col("name")).alias("kind"))


@check(
    "pf03_label_for",
    with_views(
        "inv1",
        f"select key, {Q.area_label('area')} as area_label, {Q.kind_label('kind')} as kind_label "
        f"from (select key, {Q.area('key')} as area, {Q.kind('name')} as kind from inv1)",
    ),
)
def _(spark, folder):
    rows = I.classified(inv1(spark, folder))
    return rows.select(
        "key", K.area_label(F.col("area")).alias("area_label"), K.kind_label(F.col("kind")).alias("kind_label")
    )


@check("pf04_usage_stem", with_views("inv1", f"select key, {Q.usage_stem('name')} as stem from inv1"))
def _(spark, folder):
    return inv1(spark, folder).select("key", K.usage_stem(F.col("name")).alias("stem"))


@check("pf05_logical_template_id", with_views("inv1", f"select key, {Q.ident('key')} as ident from inv1"))
def _(spark, folder):
    return inv1(spark, folder).select("key", K.logical_template_id(F.col("key")).alias("ident"))


@check(
    "pf06_version_from_key",
    with_views(
        "inv1", f"select key, {Q.version('key')} as version, regexp_matches(key, '/[vV][0-9]') as versioned from inv1"
    ),
)
def _(spark, folder):
    key = F.col("key")
    return inv1(spark, folder).select("key", K.version_from_key(key).alias("version"), K.is_versioned(key).alias("versioned"))


@check(
    "pf07_version_tuple",
    with_views(
        "vers",
        "select template_id, version, cast(row_number() over (partition by template_id order by ver, version) as bigint) as pos "
        "from vers",
    ),
)
def _(spark, folder):
    from quire.operators.ordered import part_rank

    rows = V.versions(spark, folder).withColumn("ver", K.version_tuple(F.col("version")))
    return part_rank(rows, ["template_id"], F.col("ver")[0], [F.col("ver"), F.col("version")]).select(
        "template_id", "version", "pos"
    )


@check(
    "pf08_next_version",
    with_views(
        "vers",
        "select part, case when part % 4 = 3 then '1.0' when part % 4 = 2 then concat(part, '.1') "
        "else concat(cast(p as varchar), '.', cast(q + 1 as varchar)) end as next "
        "from (select part, cast(split_part(version, '.', 1) as bigint) as p, cast(split_part(version, '.', 2) as bigint) as q from vers)",
    ),
)
def _(spark, folder):
    part, version = F.col("part"), F.col("version")
    given = (
        F.when(part % 4 == 3, F.concat(version, F.lit(".7")))
        .when(part % 4 == 2, part.cast("string"))
        .otherwise(F.concat(F.lit("v"), version))
    )
    return V.versions(spark, folder).select("part", K.next_version(given).alias("next"))


@check(
    "pf09_identifiers",
    f"select p_partkey, {Q.snake('t')} as snake, coalesce(nullif({Q.snake('t')}, ''), 'field') as slug, "
    "array_to_string(list_transform(list_filter(string_split(replace(replace(u, '_', ' '), '-', ' '), ' '), lambda w: w <> ''), "
    "lambda w: case when w = lower(w) and w <> upper(w) then concat(upper(w[1]), w[2:]) else w end), ' ') as title, "
    f"{Q.pretty('f')} as pretty "
    "from (select p_partkey, concat('  ', p_name, ' -- ', p_brand, ' / ', p_type, ' ', p_name) as t, "
    "concat(replace(p_name, ' ', '_'), '-', p_type, ' ', p_size) as u, "
    "concat('x/', replace(p_name, ' ', '__'), '-', p_brand, '.docx') as f from part)",
)
def _(spark, folder):
    name = F.col("p_name")
    text = F.concat(F.lit("  "), name, F.lit(" -- "), F.col("p_brand"), F.lit(" / "), F.col("p_type"), F.lit(" "), name)
    ident = F.concat(F.translate(name, " ", "_"), F.lit("-"), F.col("p_type"), F.lit(" "), F.col("p_size"))
    file = F.concat(F.lit("x/"), F.replace(name, F.lit(" "), F.lit("__")), F.lit("-"), F.col("p_brand"), F.lit(".docx"))
    return table(spark, folder, "part").select(
        "p_partkey", K.snake(text).alias("snake"), K.slugify(text).alias("slug"),
        K.title_from_ident(ident).alias("title"), K.pretty_name(file).alias("pretty"),
    )


_BAD_KEYS = (
    "select key, case length(key) % 7 when 0 then concat('//', key) when 1 then replace(key, '/', '\\') "
    "when 2 then concat('x', key) when 3 then concat(key, '/../a') when 4 then name else key end as given from inv1"
)


def _given_keys(spark, folder):
    key = F.col("key")
    rest = F.length(key) % 7
    return inv1(spark, folder).select(
        "key",
        F.when(rest == 0, F.concat(F.lit("//"), key)).when(rest == 1, F.translate(key, "/", "\\"))
        .when(rest == 2, F.concat(F.lit("x"), key)).when(rest == 3, F.concat(key, F.lit("/../a")))
        .when(rest == 4, F.col("name")).otherwise(key).alias("given"),
    )


@check(
    "pf10_validate_key",
    with_views(
        "inv1",
        "select key, k as given, case when contains(k, '..') or k = '' or not contains(k, '/') then 'invalid' "
        "when not regexp_matches(lower(k), '^(template|templates|documents|document|metadata|kb)/') then 'outside allowed prefixes' "
        "else '' end as problem from (select key, ltrim(replace(given, '\\', '/'), '/') as k from g)",
        g=_BAD_KEYS,
    ),
)
def _(spark, folder):
    given = F.col("given")
    return _given_keys(spark, folder).select(
        "key", K.normalised_key(given).alias("given"), F.coalesce(K.key_problem(given), F.lit("")).alias("problem")
    )


@check(
    "pf11_safe_filename",
    with_views(
        "inv1",
        "select key, coalesce(case when contains(n, '..') or n in ('', '.') then null else n end, '(rejected)') as safe "
        "from (select key, replace(split_part(case when length(key) % 5 = 0 then concat(key, '..') else given end, '/', -1), '\\', '_') as n from g)",
        g=_BAD_KEYS,
    ),
)
def _(spark, folder):
    given = F.when(F.length("key") % 5 == 0, F.concat("key", F.lit(".."))).otherwise(F.col("given"))
    return _given_keys(spark, folder).select(
        "key", F.coalesce(K.safe_filename(given), F.lit("(rejected)")).alias("safe")
    )


@check(
    "pf12_format_lookup",
    with_views(
        "inv1",
        f"select key, {Q.category('name')} as category, case {Q.ext('name')} "
        "when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' "
        "when 'pptx' then 'application/vnd.openxmlformats-officedocument.presentationml.presentation' "
        "when 'xlsx' then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' "
        "when 'html' then 'text/html' when 'json' then 'application/json' else 'application/octet-stream' end as mime from inv1",
    ),
)
def _(spark, folder):
    name = F.col("name")
    return inv1(spark, folder).select("key", K.category_of(name).alias("category"), K.mime_of(name).alias("mime"))


@check(
    "pf20_app_url",
    with_views(
        "inv1",
        "select key, concat('/api/preview/', replace(url_encode(n), '%2F', '/'), '?s3_key=', url_encode(k)) as url "
        "from (select key, replace(name, '_', ' & ') as n, replace(key, '_', '~ ') as k from inv1)",
    ),
)
def _(spark, folder):
    name = F.replace(F.col("name"), F.lit("_"), F.lit(" & "))
    key = F.replace(F.col("key"), F.lit("_"), F.lit("~ "))
    return inv1(spark, folder).select("key", K.app_url("preview", name, key).alias("url"))


@check(
    "ag01_storage_by_area",
    with_views(
        "inv1",
        f"select id, {Q.area_label('id')} as label, count, bytes from (select {Q.area('key')} as id, count(*) as count, "
        "cast(sum(size) as bigint) as bytes from inv1 group by 1)",
    ),
)
def _(spark, folder):
    return I.storage_by_area(inv1(spark, folder))


@check(
    "ag02_storage_by_kind",
    with_views(
        "inv1",
        f"select id, {Q.kind_label('id')} as label, count, bytes from (select {Q.kind('name')} as id, count(*) as count, "
        "cast(sum(size) as bigint) as bytes from inv1 group by 1)",
    ),
)
def _(spark, folder):
    return I.storage_by_kind(inv1(spark, folder))


@check(
    "ag04_generated_per_stem",
    with_views(
        "inv1",
        f"select * from (select {Q.usage_stem('name')} as stem, count(*) as generated from inv1 "
        f"where {Q.area('key')} = 'generated' group by 1) where stem <> ''",
    ),
)
def _(spark, folder):
    return I.generated_per_stem(inv1(spark, folder))


@check(
    "tk01_largest",
    with_views(
        "inv1",
        f"select name, key, size, last_modified, {Q.area('key')} as area, {Q.kind('name')} as kind from inv1 "
        "order by size desc, key limit 10",
    ),
)
def _(spark, folder):
    return I.largest(inv1(spark, folder))


@check(
    "tk01_recent",
    with_views(
        "inv1",
        f"select name, key, size, last_modified, {Q.area('key')} as area, {Q.kind('name')} as kind from inv1 "
        "order by last_modified desc nulls last, key limit 10",
    ),
)
def _(spark, folder):
    return I.recent(inv1(spark, folder))


TODAY = "2001-07-20"


@check(
    "cq02_daily_activity",
    with_views(
        "inv1",
        "select cast(d as varchar) as day, count(*) filter (area = 'templates') as templates, "
        "count(*) filter (area = 'generated') as generated, count(*) filter (area not in ('templates', 'generated')) as other, "
        "count(area) as count from days left join f on day = d group by 1",
        days=f"select cast(date '{TODAY}' - cast(i as integer) as date) as d from range(14) t(i)",
        f=f"select cast(last_modified as date) as day, {Q.area('key')} as area from inv1",
    ),
)
def _(spark, folder):
    return I.daily_activity(inv1(spark, folder), TODAY)


@check(
    "cq02_daily_activity_events",
    with_views(
        "",
        "select cast(d as varchar) as day, count(*) filter (area = 'templates') as templates, "
        "count(*) filter (area = 'generated') as generated, count(*) filter (area not in ('templates', 'generated')) as other, "
        "count(area) as count from days left join f on day = d group by 1",
        days="select cast(date '2024-02-03' - cast(i as integer) as date) as d from range(14) t(i)",
        f="select cast(ts as date) as day, case event_type when 'click' then 'templates' when 'view' then 'generated' "
        "else 'other' end as area from events",
    ),
)
def _(spark, folder):
    rows = table(spark, folder, "events").select(
        F.concat(
            F.when(F.col("event_type") == "click", "template/").when(F.col("event_type") == "view", "documents/")
            .otherwise("logs/"), F.col("event_id").cast("string"),
        ).alias("key"),
        F.col("ts").cast("timestamp").alias("last_modified"),
    )
    return I.daily_activity(rows, "2024-02-03")


@check(
    "wn12_share_of_total",
    with_views(
        "inv1",
        "select id, bytes, round(bytes * 100.0 / sum(bytes) over (), 6) as pct_total, "
        "round(bytes * 100.0 / max(bytes) over (), 6) as pct_max from a where bytes > 0",
        a=f"select {Q.area('key')} as id, cast(sum(size) as bigint) as bytes from inv1 group by 1",
    ),
)
def _(spark, folder):
    return I.share_of_total(I.storage_by_area(inv1(spark, folder)), "bytes").select("id", "bytes", "pct_total", "pct_max")


_SCALED = (
    "concat(cast((n * {s} * 2 + {u}) // (2 * cast({u} as bigint)) // {s} as varchar), '.', "
    "lpad(cast((n * {s} * 2 + {u}) // (2 * cast({u} as bigint)) % {s} as varchar), {p}, '0'), ' {name}')"
)


@check(
    "fn40_format_bytes",
    with_views(
        "inv1",
        "select key, case when n < 1024 then concat(n, ' B') when n < 1048576 then "
        + _SCALED.format(s=10, u=1024, p=1, name="KB")
        + " when n < 1073741824 then " + _SCALED.format(s=10, u=1048576, p=1, name="MB")
        + " else " + _SCALED.format(s=100, u=1073741824, p=2, name="GB")
        + " end as shown from (select key, size * (length(key) % 5) * (length(key) % 5) * 1000 + size % 2000 as n from inv1)",
    ),
)
def _(spark, folder):
    from quire.functions.values import format_bytes

    factor = F.length("key") % 5
    n = F.col("size") * factor * factor * 1000 + F.col("size") % 2000
    return inv1(spark, folder).select("key", format_bytes(n).alias("shown"))
