"""SQL expressions used on the checking side."""

from __future__ import annotations


def area(key: str) -> str:
    return (
        f"case when list_contains(string_split(lower({key}), '/')[1:3], 'preview') or contains(lower({key}), '/previews/') "
        f"then 'previews' when starts_with(lower({key}), 'metadata/') or contains(lower({key}), '/metadata/') then 'metadata' "
        f"when starts_with(lower({key}), 'document') then 'generated' "
        f"when starts_with(lower({key}), 'template') then 'templates' else 'other' end"
    )


def ext(name: str) -> str:
    return f"regexp_extract(lower({name}), '[^/]\\.([^./]+)$', 1)"


def kind(name: str) -> str:
    e = ext(name)
    return (
        f"case when {e} in ('xlsx','xls','xlsm') then 'xlsx' when {e} in ('docx','doc') then 'docx' "
        f"when {e} in ('pptx','ppt') then 'pptx' when {e} = '' then 'other' else {e} end"
    )


def stem(name: str) -> str:
    return f"regexp_replace(split_part({name}, '/', -1), '^(.+)\\.[^./]+$', '\\1')"


def usage_stem(name: str) -> str:
    return f"lower(trim(regexp_replace({stem(name)}, '_[0-9]{{8}}_[0-9]{{6}}$', '')))"


def area_label(code: str) -> str:
    return (
        f"case {code} when 'templates' then 'Templates' when 'generated' then 'Generated documents' "
        f"when 'previews' then 'Previews' when 'metadata' then 'Metadata' when 'other' then 'Other' end"
    )


def kind_label(code: str) -> str:
    return (
        f"case {code} when 'xlsx' then 'Excel' when 'docx' then 'Word' when 'pptx' then 'PowerPoint' "
        f"when 'json' then 'Metadata' when 'html' then 'Preview' when 'pdf' then 'PDF' else upper({code}) end"
    )


def category(name: str) -> str:
    return f"case {ext(name)} when 'pptx' then 'powerpoint' when 'xlsx' then 'excel' else 'word' end"


def snake(text: str) -> str:
    return (
        f"trim(regexp_replace(lower(trim(coalesce({text}, ''))), '[^a-z0-9]+', '_', 'g'), '_')"
    )


def ident(key: str) -> str:
    """Logical template id of a key without bad parts."""
    return (
        f"case when regexp_matches({key}, '/[vV][0-9]') then "
        f"regexp_extract({key}, '^(?:.*?/)?([^/]+)/+[vV][0-9][^/]*(?:/.*)?$', 1) else "
        f"lower(trim(regexp_replace({stem(key)}, '[^A-Za-z0-9._-]+', '-', 'g'), '-')) end"
    )


def version(key: str) -> str:
    return (
        f"case when regexp_matches({key}, '/[vV][0-9]+(\\.[0-9]+)*/') "
        f"then regexp_extract({key}, '/[vV]([0-9]+(?:\\.[0-9]+)*)/', 1) else '1.0' end"
    )


def ver(v: str) -> str:
    return f"list_transform(string_split({v}, '.'), lambda p: cast(p as bigint))"


def pretty(name: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({stem(name)}, '[_-]+', ' ', 'g')), ''), 'Template')"


def quote_url(text: str) -> str:
    return f"replace(url_encode({text}), '+', '%20')"
