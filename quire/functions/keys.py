"""Column functions over object keys, file names and version strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -------------------------------------------------------------------------------
OFFICE_EXTENSIONS = ("docx", "pptx", "xlsx")
AREA_LABELS = {
    "templates": "Templates",
    "generated": "Generated documents",
    "previews": "Previews",
    "metadata": "Metadata",
    "other": "Other",
}
KIND_LABELS = {
    "xlsx": "Excel",
    "xls": "Excel",
    "xlsm": "Excel",
    "docx": "Word",
    "doc": "Word",
    "pptx": "PowerPoint",
    "ppt": "PowerPoint",
    "json": "Metadata",
    "html": "Preview",
    "pdf": "PDF",
}
CATEGORY_BY_EXTENSION = {"docx": "word", "pptx": "powerpoint", "xlsx": "excel"}
MIME_BY_EXTENSION = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "html": "text/html",
    "pdf": "application/pdf",
    "json": "application/json",
}
ALLOWED_PREFIXES = ("template/", "templates/", "documents/", "document/", "metadata/", "kb/")
# ------------------------------------------------------------------------------------------------


def lookup(table: dict[str, str], code: Column, default: Column) -> Column:
    """Value of a small fixed map, evaluated inside generated code."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[code], default)


def slashed(key: Column) -> Column:
    return F.translate(F.coalesce(key, F.lit("")), "\\", "/")


def base_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.regexp_extract(F.lower(name), r"[^/]\.([^./]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(base_name(name), r"^(.+)\.[^./]+$", "$1")


def classify_area(key: Column) -> Column:
    path = F.lower(slashed(key))
    return (
        F.when(
            F.array_contains(F.slice(F.split(path, "/"), 1, 3), "preview") | path.contains("/previews/"),
            "previews",
        )
        .when(path.startswith("metadata/") | path.contains("/metadata/"), "metadata")
        .when(path.startswith("document"), "generated")
        .when(path.startswith("template"), "templates")
        .otherwise("other")
    )


def file_kind(name: Column) -> Column:
    ext = extension(name)
    return (
        F.when(ext.isin("xlsx", "xls", "xlsm"), "xlsx")
        .when(ext.isin("docx", "doc"), "docx")
        .when(ext.isin("pptx", "ppt"), "pptx")
        .when(ext == "", "other")
        .otherwise(ext)
    )


def area_label(area: Column) -> Column:
    return lookup(AREA_LABELS, area, F.initcap(area))


def kind_label(kind: Column) -> Column:
    return lookup(KIND_LABELS, kind, F.upper(kind))


def usage_stem(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(stem(name), r"_[0-9]{8}_[0-9]{6}$", "")))


def logical_template_id(key: Column) -> Column:
    """Segment before the first ``v<digit>`` segment, else the slugged stem; null for a bad key."""
    path = F.regexp_replace(slashed(key), r"^/+", "")
    owner = F.regexp_extract(path, r"^(?:.*?/)?([^/]+)/+[vV][0-9][^/]*(?:/.*)?$", 1)
    slug = F.lower(F.regexp_replace(F.regexp_replace(stem(path), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", ""))
    return F.when((path == "") | path.contains(".."), F.lit(None).cast("string")).otherwise(
        F.when(owner != "", owner).when(slug != "", slug).otherwise("template")
    )


def is_versioned(key: Column) -> Column:
    return slashed(key).rlike(r"/[vV][0-9]")


def version_from_key(key: Column) -> Column:
    found = F.regexp_extract(slashed(key), r"/[vV]([0-9]+(?:\.[0-9]+)*)/", 1)
    return F.when(found == "", "1.0").otherwise(found)


def version_tuple(version: Column) -> Column:
    """Comparable array of numbers; anything that is not a version gives [0]."""
    plain = F.regexp_extract(F.trim(F.coalesce(version, F.lit(""))), r"^[vV]?([0-9]+(?:\.[0-9]+)*)$", 1)
    return F.when(plain == "", F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.split(plain, r"\."), lambda part: part.cast("bigint"))
    )


def next_version(version: Column) -> Column:
    """``M.m`` counts up the minor; three-part and unreadable versions start again at 1.0."""
    plain = F.regexp_replace(F.coalesce(version, F.lit("")), r"^[vV]+", "")
    major = F.regexp_extract(plain, r"^([0-9]+)(?:\.([0-9]+))?$", 1)
    minor = F.regexp_extract(plain, r"^([0-9]+)(?:\.([0-9]+))?$", 2)
    up = F.when(minor == "", F.lit(1)).otherwise(F.expr("null"))
    return F.when(major == "", "1.0").otherwise(
        F.concat(
            major.try_cast("bigint").cast("string"),
            F.lit("."),
            F.coalesce(up, minor.try_cast("bigint") + 1).cast("string"),
        )
    )


def snake(text: Column) -> Column:
    runs = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^a-z0-9]+", "_")
    return F.btrim(runs, F.lit("_"))


def slugify(text: Column) -> Column:
    """Snake case of the whole text; an empty result becomes ``field``."""
    slug = snake(text)
    return F.when(slug == "", "field").otherwise(slug)


def title_from_ident(text: Column) -> Column:
    """Blanks for ``_`` and ``-``; only words that are wholly lower case are capitalised."""
    words = F.filter(
        F.split(F.trim(F.translate(F.coalesce(text, F.lit("")), "_-", "  ")), r"\s+"), lambda w: w != ""
    )
    shown = F.array_join(
        F.transform(
            words,
            lambda w: F.when(
                (w == F.lower(w)) & (w != F.upper(w)),
                F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))),
            ).otherwise(w),
        ),
        " ",
    )
    return F.when(shown == "", "Template").otherwise(shown)


def pretty_name(name: Column) -> Column:
    shown = F.trim(F.regexp_replace(stem(name), r"[_-]+", " "))
    return F.when(shown == "", "Template").otherwise(shown)


def normalised_key(key: Column) -> Column:
    return F.regexp_replace(slashed(key), r"^/+", "")


def key_problem(key: Column, prefixes: tuple[str, ...] = ALLOWED_PREFIXES) -> Column:
    """Reason a key is rejected, null when it is acceptable."""
    path = normalised_key(key)
    allowed = F.lit(False)
    for prefix in prefixes:
        allowed = allowed | F.lower(path).startswith(prefix)
    return (
        F.when((path == "") | path.contains(".."), "invalid")
        .when(~path.contains("/"), "invalid")
        .when(~allowed, "outside allowed prefixes")
    )


def safe_filename(name: Column) -> Column:
    """Last path segment, null when it is a dot name or holds two dots in a row."""
    given = F.when(F.coalesce(name, F.lit("")) == "", "file.bin").otherwise(name)
    last = F.translate(base_name(F.regexp_replace(given, r"/+$", "")), "\\", "_")
    return F.when(~(last.isin(".", "..", "") | last.contains("..")), last)


def category_of(name: Column) -> Column:
    return lookup(CATEGORY_BY_EXTENSION, extension(name), F.lit("word"))


def mime_of(name: Column) -> Column:
    return lookup(MIME_BY_EXTENSION, extension(name), F.lit("application/octet-stream"))


def app_url(kind: str, name: Column, key: Column) -> Column:
    """Link with both parts percent-encoded; slashes stay readable only in the file name."""
    quoted = F.replace(_percent(name), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(f"/api/{kind}/"), quoted, F.lit("?s3_key="), _percent(key))


def _percent(text: Column) -> Column:
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
