"""The bridge views as common table expressions for the SQL side of the checks."""

from __future__ import annotations

_EXT = "case length(p_name) % 3 when 0 then 'docx' when 1 then 'pptx' else 'xlsx' end"
_KIND = "case length(p_name) % 3 when 0 then 'word' when 1 then 'powerpoint' else 'excel' end"
_VERSION = "concat(cast(p_size % 2 + 1 as varchar), '.', cast(p_partkey as varchar))"
_VKEY = (
    f"concat('template/', {_KIND}, '/tmpl-', replace(p_name,' ','-'), '/v', {_VERSION}, '/', "
    f"replace(p_name,' ','_'), '.', {_EXT})"
)
_Y = "cast(year(o_orderdate) as varchar)"
_M = "lpad(cast(month(o_orderdate) as varchar), 2, '0')"
_D = "lpad(cast(day(o_orderdate) as varchar), 2, '0')"
_GKEY = (
    f"concat('documents/generated/', {_Y}, '/', {_M}, '/', {_D}, '/', replace(p_name,' ','_'), '_', {_Y}, {_M}, {_D}, "
    f"'_', lpad(cast(o_orderkey % 1000000 as varchar), 6, '0'), '.', {_EXT})"
)

CTES: dict[str, str] = {
    "dated": "select * from part join orders on o_orderkey = p_partkey",
    "ordered": "select o.*, p.* from orders o join part p on p_partkey = o_orderkey % (select count(*) from part)",
    "inv": f"""
select key, split_part(key, '/', -1) as name, cast(size as bigint) as size, last_modified,
       substr(md5(key), 1, 16) as etag, prefix_ord
from (
  select {_VKEY} as key, floor(p_retailprice * 10) as size, o_orderdate as last_modified, 1 as prefix_ord
  from dated where p_partkey % 10 <> 0
  union all
  select concat('Template/', replace(p_name,' ','_'), '.', {_EXT}), floor(p_retailprice), o_orderdate, 2
  from dated where p_partkey % 10 = 0
  union all select {_GKEY}, floor(o_totalprice), o_orderdate, 3 from ordered
  union all select concat('documents/previews/', page_id, '.html'), length(html), null, 4 from pages
  union all select concat('metadata/template/s', s_suppkey, '.json'), 512 + s_nationkey, null, 5 from supplier
  union all select concat('KB/doc_', doc_id, '.txt'), n_chars, null, 6 from documents
)""",
    # last listing of a key wins; the same key inside one listing keeps its newest, then largest row
    "inv1": """
select key, name, size, last_modified, etag, prefix_ord from (
  select *, row_number() over (partition by key
    order by prefix_ord desc, last_modified desc nulls last, size desc) as k from inv) where k = 1""",
    "vers": f"""
select concat('tmpl-', replace(p_name,' ','-')) as template_id, {_VERSION} as version,
  case when p_partkey % 3 = 0 then 'published' when p_partkey % 3 = 1 then 'archived'
       when p_partkey % 6 = 2 then 'draft' end as status,
  case when p_partkey % 7 = 0 then '' else concat('Update for ', p_brand) end as changelog,
  o_orderdate as created_at,
  case when p_partkey % 5 <> 0 then o_orderdate + interval 1 day end as modified_at,
  {_VKEY} as s3_key, p_partkey as part,
  [cast(p_size % 2 + 1 as bigint), p_partkey] as ver
from dated""",
    "mvers": "select * from vers where part % 10 = 0 or part % 3 = 1",
    "meta": f"""
select concat('tmpl-', replace(p_name,' ','-')) as id,
  case when first % 3 <> 0 then
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') end as name,
  case when first % 2 = 0 then concat('About ', p_name) end as description,
  cast(parts % 7 as bigint) as usage_count,
  case when first % 4 = 0 then lowest end as active_version,
  case when first % 2 = 1 then string_split(p_name, ' ') else [] end as tags,
  concat('user', cast(first % 9 as varchar)) as created_by
from (select p_name, min(p_partkey) as first, count(*) as parts,
        arg_min({_VERSION}, (p_size % 2) * 1000000000000 + p_partkey) as lowest from part group by p_name)
where first % 5 <> 4""",
    "omd": f"""
select {_GKEY} as key, concat('tmpl-', replace(p_name,' ','-')) as template_id,
  case when o_orderkey % 6 = 0 then '' else concat('User', cast(o_custkey % 10 as varchar)) end as generated_by,
  case when o_orderkey % 4 = 0 then '' else p_name end as template_name
from ordered where o_orderkey % 9 <> 0""",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "inv": ("dated", "ordered"),
    "inv1": ("inv",),
    "vers": ("dated",),
    "mvers": ("vers",),
    "omd": ("ordered",),
}


def with_views(names: str, query: str, **extra: str) -> str:
    """``query`` behind the named views and everything they need, then the extra ones in order."""
    placed: list[str] = []

    def place(name: str) -> None:
        for need in NEEDS.get(name, ()):
            place(need)
        if name not in placed:
            placed.append(name)

    for name in names.split():
        place(name)
    parts = [f"{n} as ({CTES[n]})" for n in placed] + [f"{n} as ({q})" for n, q in extra.items()]
    return f"with {', '.join(parts)} {query}" if parts else query


def _join_notes() -> None:
    from quire.bridge.notes import NOTE_CTES

    CTES.update(NOTE_CTES)
    from quire.bridge.plans import PLAN_CTES, PLAN_NEEDS

    CTES.update(PLAN_CTES)
    NEEDS.update(PLAN_NEEDS)
    from quire.bridge.grids import GRID_CTES, GRID_NEEDS

    CTES.update(GRID_CTES)
    NEEDS.update(GRID_NEEDS)
    from quire.bridge.kb import KB_CTES, KB_NEEDS

    CTES.update(KB_CTES)
    NEEDS.update(KB_NEEDS)
    NEEDS.update({"head": ("ordered",), "notes": ("head", "lparts")})


_join_notes()
