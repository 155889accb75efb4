"""Versioned catalog, dashboard, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.bridge import sqlfn as Q, views as V
from quire.bridge.sql import with_views
from quire.checks import check
from quire.checks.a_inventory import TODAY, inv1
from quire.functions import keys as K
from quire.operators import catalog as C, inventory as I
from quire.plans import dashboard

_OFFICE = (
    f"select key, name, size, last_modified, {Q.ident('key')} as own, regexp_matches(key, '/[vV][0-9]') as versioned, "
    f"{Q.version('key')} as version, lower(name) as lname from inv1 "
    f"where {Q.area('key')} = 'templates' and {Q.ext('name')} in ('docx', 'pptx', 'xlsx')"
)
_FIRST = "select own as ident, min(concat(lname, chr(1), key)) as fs from office where versioned group by 1"
_OWNERS = (
    "select lname, arg_min(own, concat(fs, chr(1), own)) as owner from office join firsts on own = ident "
    "where versioned group by 1"
)
_FILES = (
    f"select case when versioned then own else coalesce(owner, own) end as ident, key, name, size, last_modified, versioned, "
    f"version, {Q.ver('version')} as ver from office left join owners using (lname)"
)
_HYDRATED = (
    "select * from files union all select template_id, s3_key, any_value(split_part(s3_key, '/', -1)), 0, "
    f"max(coalesce(modified_at, created_at)), true, any_value({Q.version('s3_key')}), any_value({Q.ver(Q.version('s3_key'))}) "
    "from mvers where template_id in (select ident from files) and s3_key not in (select key from files) group by 1, 2"
)
_LISTED = (
    "select ident, version, key, last_modified from (select *, row_number() over (partition by ident, version "
    "order by versioned, ver, last_modified, key) as k from (select *, max(versioned) over (partition by ident) as hv "
    "from hydrated) where versioned or not hv) where k = 1"
)
_MERGED = (
    "select coalesce(l.ident, m.template_id) as template_id, coalesce(l.version, m.version) as version, "
    f"{Q.ver('coalesce(l.version, m.version)')} as ver, coalesce(nullif(m.status, ''), case when l.ident is not null then 'published' end) as status, "
    "coalesce(nullif(m.changelog, ''), case when l.ident is not null then '' end) as changelog, "
    "coalesce(m.created_at, l.last_modified) as created_at, coalesce(m.modified_at, l.last_modified) as modified_at, "
    "coalesce(m.s3_key, l.key) as s3_key from listed l full join "
    "(select * from mvers where template_id in (select ident from hydrated)) m on l.ident = m.template_id and l.version = m.version"
)
_CURRENT = (
    "select g.template_id, coalesce(p.pin, g.highest) as current from "
    "(select template_id, version as highest from (select *, row_number() over (partition by template_id "
    "order by ver desc, version desc) k from merged) where k = 1) g "
    "left join (select v.template_id, v.version as pin from merged v join meta on id = v.template_id "
    "and nullif(active_version, '') = v.version) p using (template_id)"
)
_SETTLED = (
    "select m.* replace (case when m.version = current then 'published' when coalesce(status, '') in ('', 'published') "
    "then 'archived' else status end as status), m.version = current as is_active from merged m join currents using (template_id)"
)
_PUBLIC = (
    "select p.template_id as id, coalesce(nullif(meta.name, ''), {pretty}) as name, ckey as s3_key, {ext} as output_format, "
    "coalesce(fsize, 0) as size, flast as last_modified, lowest as created_at, {cat} as category, "
    "coalesce(nullif(description, ''), concat('Office template (', filename, ')')) as description, "
    "array_to_string(case when len(tags) > 0 then tags else [{ext}, {cat}] end, ',') as tags, cv as current_version, "
    "filename as original_filename, cast(coalesce(usage_count, 0) as bigint) as usage_count, created_by, n as version_count from "
    "(select a.*, split_part(ckey, '/', -1) as filename, f.size as fsize, f.last_modified as flast from "
    "(select template_id, count(*) as n, min(version) filter (is_active) as cv, min(s3_key) filter (is_active) as ckey, "
    "arg_min(created_at, list_extract(ver, 1) * 1000000000 + list_extract(ver, 2)) as lowest from settled group by 1) a "
    "left join hydrated f on f.ident = a.template_id and f.key = ckey) p left join meta on meta.id = p.template_id"
).format(pretty=Q.pretty("filename"), ext=Q.ext("filename"), cat=Q.category("filename"))

CATALOG = dict(
    office=_OFFICE, firsts=_FIRST, owners=_OWNERS, files=_FILES, hydrated=_HYDRATED, listed=_LISTED, merged=_MERGED,
    currents=_CURRENT, settled=_SETTLED, catalog=_PUBLIC,
)


def catalog_sql(query: str, upto: str = "catalog", **extra: str) -> str:
    chosen = {}
    for name, sql in CATALOG.items():
        chosen[name] = sql
        if name == upto:
            break
    return with_views("inv1 meta mvers vers", query, **chosen, **extra)


def files(spark, folder):
    return C.attach_loose(C.office_objects(inv1(spark, folder)))


def hydrated(spark, folder):
    return C.hydrate_versions(files(spark, folder), V.metadata_versions(spark, folder))


def catalog(spark, folder):
    return C.template_catalog(inv1(spark, folder), V.template_metadata(spark, folder), V.metadata_versions(spark, folder))


def settled(spark, folder):
    return C.catalog_versions(inv1(spark, folder), V.template_metadata(spark, folder), V.metadata_versions(spark, folder))


def ver_versions(spark, folder):
    return V.versions(spark, folder).withColumn("ver", K.version_tuple(F.col("version"))).drop("part")


@check("jn04_attach_loose", catalog_sql("select ident, key, version, versioned from files", "files"))
def _(spark, folder):
    return files(spark, folder).select("ident", "key", "version", "versioned")


@check(
    "ag05_group_versions",
    catalog_sql(
        "select ident, key, size, cast(row_number() over (partition by ident order by versioned desc, ver desc, "
        "last_modified desc nulls last, key) as bigint) as pos from files", "files",
    ),
)
def _(spark, folder):
    return C.group_versions(files(spark, folder)).select("ident", "key", "size", "pos")


@check(
    "wn01_latest_version",
    catalog_sql(
        "select ident, key, version, last_modified from (select *, row_number() over (partition by ident order by versioned desc, "
        "ver desc, last_modified desc nulls last, key desc) as k from files) where k = 1", "files",
    ),
)
def _(spark, folder):
    return C.latest_version(files(spark, folder)).select("ident", "key", "version", "last_modified")


@check("jn05_hydrate_versions", catalog_sql("select ident, key, name, size, last_modified, version from hydrated", "hydrated"))
def _(spark, folder):
    return hydrated(spark, folder).select("ident", "key", "name", "size", "last_modified", "version")


@check(
    "jn06_merge_versions",
    catalog_sql("select template_id, version, status, changelog, created_at, modified_at, s3_key from merged", "merged"),
)
def _(spark, folder):
    return C.merge_versions(hydrated(spark, folder), V.metadata_versions(spark, folder)).drop("ver", "current")


@check(
    "wn02_active_version",
    catalog_sql("select template_id, version, status, is_active from settled", "settled"),
)
def _(spark, folder):
    return settled(spark, folder).select("template_id", "version", "status", "is_active")


@check("jn01_catalog_left_meta", catalog_sql("select id, name, description, tags, created_by from catalog"))
def _(spark, folder):
    return catalog(spark, folder).select("id", "name", "description", F.array_join("tags", ",").alias("tags"), "created_by")


@check("cq03_template_catalog", catalog_sql("select * from catalog"))
def _(spark, folder):
    return catalog(spark, folder).withColumn("tags", F.array_join("tags", ",")).orderBy(F.lower("name"), "id")


_TOTALS = (
    f"select count(*) as objects, cast(sum(size) as bigint) as bytes, "
    f"count(*) filter ({Q.kind('name')} in ('xlsx', 'docx', 'pptx')) as office_files, "
    f"count(*) filter ({Q.area('key')} = 'generated') as generated_documents, (select count(*) from catalog) as templates, "
    "(select cast(sum(version_count) as bigint) from catalog) as versions from inv1"
)


@check("ag03_inventory_totals", catalog_sql(_TOTALS))
def _(spark, folder):
    return I.inventory_totals(inv1(spark, folder), catalog(spark, folder))


_STEMS = (
    f"select * from (select {Q.usage_stem('name')} as stem, count(*) as generated from inv1 "
    f"where {Q.area('key')} = 'generated' group by 1) where stem <> ''"
)
_USED = (
    f"select c.*, coalesce(nullif(f.generated, 0), n.generated, 0) as generated_count from catalog c "
    f"left join stems f on f.stem = {Q.usage_stem('original_filename')} left join stems n on n.stem = {Q.usage_stem('c.name')}"
)
_SIZED = (
    "select u.*, coalesce(nullif(s.found, 0), u.size) as storage_bytes from used u left join "
    "(select template_id, cast(sum(i.size) as bigint) as found from settled join inv1 i on i.key = s3_key group by 1) s "
    "on s.template_id = u.id"
)
_MOST = (
    "select id, name, output_format, usage_count, generated_count, usage_count + generated_count as score, size, storage_bytes, "
    "version_count as versions, s3_key from sized order by score desc, storage_bytes desc, id limit 10"
)


@check("jn02_usage_join", catalog_sql("select id, generated_count from used", stems=_STEMS, used=_USED))
def _(spark, folder):
    return C.usage_join(catalog(spark, folder), I.generated_per_stem(inv1(spark, folder))).select("id", "generated_count")


@check("jn03_version_bytes", catalog_sql("select id, storage_bytes from sized", stems=_STEMS, used=_USED, sized=_SIZED))
def _(spark, folder):
    return C.version_bytes(settled(spark, folder), inv1(spark, folder), catalog(spark, folder)).select("id", "storage_bytes")


@check("tk02_most_used", catalog_sql(_MOST, stems=_STEMS, used=_USED, sized=_SIZED))
def _(spark, folder):
    return C.most_used(inv1(spark, folder), catalog(spark, folder), settled(spark, folder))


_SNAP = f"""
select 'totals' as section, k as id, cast(null as varchar) as label, v as count, cast(null as bigint) as bytes
  from (unpivot totals on objects, bytes, office_files, generated_documents, templates, versions into name k value v)
union all select 'by_area', id, {Q.area_label('id')}, count, bytes from (select {Q.area('key')} as id, count(*) as count,
  cast(sum(size) as bigint) as bytes from inv1 group by 1)
union all select 'by_kind', id, {Q.kind_label('id')}, count, bytes from (select {Q.kind('name')} as id, count(*) as count,
  cast(sum(size) as bigint) as bytes from inv1 group by 1)
union all select 'most_used', id, name, score, storage_bytes from ({_MOST})
union all select 'largest', key, name, null, size from (select * from inv1 order by size desc, key limit 10)
union all select 'recent', key, name, null, size from (select * from inv1 order by last_modified desc nulls last, key limit 10)
union all select 'activity', cast(d as varchar), null, count(key), null from
  (select cast(date '{TODAY}' - cast(i as integer) as date) as d from range(14) t(i))
  left join inv1 on cast(last_modified as date) = d group by 2
"""


@check("cq01_inventory_snapshot", catalog_sql(_SNAP, stems=_STEMS, used=_USED, sized=_SIZED, totals=_TOTALS))
def _(spark, folder):
    parts = dashboard.inventory_snapshot(
        V.inventory(spark, folder), V.template_metadata(spark, folder), V.metadata_versions(spark, folder), TODAY
    )
    return dashboard.long_form(parts)


_NEW = "select id as template_id, concat(id, '.docx') as filename, 'Quarterly refresh' as changelog, timestamp '2002-01-01' as created_at from meta"
_TOP = (
    "select template_id, version as previous_version, ver from (select *, row_number() over (partition by template_id order by ver desc, "
    "version desc) k from vers) where k = 1"
)
_NEXT = "concat(cast(list_extract(t.ver, 1) as varchar), '.', cast(list_extract(t.ver, 2) + 1 as varchar))"


def _published(new: str) -> str:
    return (
        "select v.template_id, v.version, case when n.template_id is not null and coalesce(nullif(status, ''), 'published') = 'published' "
        "then 'archived' else status end as status, v.changelog, v.created_at, v.s3_key, null as previous_version, false as is_active "
        f"from vers v left join (select distinct template_id from {new}) n on v.template_id = n.template_id "
        f"union all select n.template_id, {_NEXT}, 'published', n.changelog, n.created_at, concat('template/', {Q.category('n.filename')}, "
        f"'/', n.template_id, '/v', {_NEXT}, '/', n.filename), t.previous_version, true from {new} n join tops t using (template_id)"
    )


_SHOWN = ("template_id", "version", "status", "changelog", "created_at", "s3_key", "previous_version", "is_active")


@check("wn03_publish", with_views("vers meta", _published("new"), new=_NEW + " where id in (select template_id from vers)", tops=_TOP))
def _(spark, folder):
    versions = ver_versions(spark, folder)
    new = V.template_metadata(spark, folder).join(
        versions.select(F.col("template_id").alias("id")).distinct(), "id", "left_semi"
    ).select(
        F.col("id").alias("template_id"), F.concat("id", F.lit(".docx")).alias("filename"),
        F.lit("Quarterly refresh").alias("changelog"), F.lit("2002-01-01").cast("timestamp").alias("created_at"),
    )
    return C.publish(versions, new).select(*_SHOWN)


_LOW = (
    "select template_id, version from (select *, row_number() over (partition by template_id order by ver, version) k from vers) where k = 1"
)


def _lowest(versions):
    return versions.groupBy("template_id").agg(F.min_by("version", F.struct("ver", "version")).alias("version"))


@check(
    "wn04_activate",
    with_views(
        "vers",
        "select v.template_id, v.version, case when v.version = low.version then 'published' else 'archived' end as status, "
        "v.version = low.version as is_active from vers v join low on v.template_id = low.template_id",
        low=_LOW,
    ),
)
def _(spark, folder):
    versions = ver_versions(spark, folder)
    return C.activate(versions, _lowest(versions)).select("template_id", "version", "status", "is_active")


@check(
    "wn04_restore",
    with_views(
        "vers", _published("new"), tops=_TOP,
        new=f"select v.template_id, split_part(s3_key, '/', -1) as filename, concat('Restored from v', v.version) as changelog, "
        f"timestamp '2002-02-02' as created_at from vers v join ({_LOW}) l on v.template_id = l.template_id and v.version = l.version",
    ),
)
def _(spark, folder):
    versions = ver_versions(spark, folder)
    return C.restore(versions, _lowest(versions), "2002-02-02").select(*_SHOWN)


@check(
    "wn13_version_history",
    catalog_sql("select template_id, version, status, coalesce(modified_at, created_at) as changed_at, is_active from settled", "settled"),
)
def _(spark, folder):
    return C.version_history(settled(spark, folder)).select("template_id", "version", "status", "changed_at", "is_active")


@check(
    "cq15_compare_versions",
    with_views(
        "vers",
        "select template_id, from_version, to_version, field, case when field is not null then 'updated' end as change, before as removed, after as added, "
        "concat(n, ' difference(s) between v', from_version, ' and v', to_version, '.') as summary from "
        "(select p.*, c.field, c.before, c.after, count(c.field) over (partition by p.template_id, p.from_version, p.to_version) as n "
        "from pairs p left join changes c on c.template_id = p.template_id and c.from_version = p.from_version and c.to_version = p.to_version)",
        pairs="select template_id, lag(version) over w as from_version, version as to_version from vers "
        "window w as (partition by template_id order by ver, version) qualify from_version is not null",
        sides="select p.*, a.s3_key as ak, b.s3_key as bk, coalesce(a.changelog, '') as al, coalesce(b.changelog, '') as bl from pairs p "
        "join vers a on a.template_id = p.template_id and a.version = from_version join vers b on b.template_id = p.template_id and b.version = to_version",
        changes="select template_id, from_version, to_version, 's3_key' as field, ak as before, bk as after from sides where ak is distinct from bk "
        "union all select template_id, from_version, to_version, 'changelog', al, bl from sides where al is distinct from bl",
    ),
)
def _(spark, folder):
    from pyspark.sql import Window as W

    versions = ver_versions(spark, folder)
    order = W.partitionBy("template_id").orderBy("ver", "version")
    pairs = versions.select(
        "template_id", F.lag("version").over(order).alias("from_version"), F.col("version").alias("to_version")
    ).where("from_version is not null")
    return C.compare_versions(versions, pairs)


@check(
    "pf13_owner_filter",
    with_views(
        "inv1 omd",
        f"select key, coalesce(generated_by, '') as generated_by from inv1 left join omd using (key) "
        f"where {Q.area('key')} = 'generated' and lower(trim(coalesce(generated_by, ''))) in ('', 'user3')",
    ),
)
def _(spark, folder):
    docs = C.generated_documents(inv1(spark, folder), V.object_metadata(spark, folder))
    return C.owner_filter(docs, " USER3").select("key", "generated_by")


@check(
    "tk08_recent_generated",
    with_views(
        "inv1 omd",
        f"select key, name, size, last_modified, coalesce(template_id, '') as template_id, coalesce(nullif(template_name, ''), {Q.stem('name')}) as template_name, "
        f"coalesce(generated_by, '') as generated_by from inv1 left join omd using (key) where {Q.area('key')} = 'generated' "
        "and lower(trim(coalesce(generated_by, ''))) in ('', 'user3') order by last_modified desc nulls last, key limit 50",
    ),
)
def _(spark, folder):
    docs = C.generated_documents(inv1(spark, folder), V.object_metadata(spark, folder))
    return C.recent_generated(docs, "user3").drop("id", "document_name")


@check(
    "pf23_resolve",
    catalog_sql(
        "select ref, template_id, s3_key from (select ref, id as template_id, c.s3_key, row_number() over (partition by ref order by prio, id) k from "
        "(select ref, 0 as prio, ref as t, 'exact' as how from refs union all select ref, 1, own, 'path' from refs where own is not null) r "
        "join catalog c on (how = 'exact' and (t = c.id or t = c.s3_key)) or (how = 'path' and t = c.id)) where k = 1",
        refs=f"select s3_key as ref, {Q.ident('s3_key')} as own from vers union all select id, null from meta union all "
        "select distinct concat('none-', created_by), null from meta",
    ),
)
def _(spark, folder):
    meta = V.template_metadata(spark, folder)
    refs = V.versions(spark, folder).select(F.col("s3_key").alias("ref")).unionByName(
        meta.select(F.col("id").alias("ref"))
    ).unionByName(meta.select(F.concat(F.lit("none-"), "created_by").alias("ref")).distinct())
    return C.resolve(catalog(spark, folder), refs)


@check(
    "pf23_find_by_filename",
    with_views(
        "inv1",
        f"select filename, key, last_modified from (select upper(name) as filename, lower(name) as l from inv1 where size % 7 = 0 and {Q.area('key')} = 'generated') "
        "join (select lower(name) as l, arg_max(key, concat(cast(epoch(last_modified) as varchar), key)) as key, max(last_modified) as last_modified "
        f"from inv1 where {Q.area('key')} = 'generated' group by 1) using (l)",
    ),
)
def _(spark, folder):
    generated = inv1(spark, folder).where(K.classify_area(F.col("key")) == "generated")
    wanted = generated.where("size % 7 = 0").select(F.upper("name").alias("filename"))
    return C.find_by_filename(generated, wanted)
