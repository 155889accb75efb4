"""Versioned template catalog: grouping, overlay of metadata, active version, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import keys as K, text as T
from quire.operators import inventory as I
from quire.operators.ordered import best_per_group, part_rank

_FILE_ORDER = ("versioned", "ver", "last_modified", "key")


def office_objects(inventory: DataFrame) -> DataFrame:
    """Template files in an office format.

    Both tests read the key alone, so they reach below the merge of listings and into the scan. There a key may be an
    expression of many parts: it is computed once, however often the tests name it, and its start decides first.
    """
    return inventory.where(T.let(
        F.col("key"),
        lambda key: F.lower(K.slashed(key)).startswith("template") & (K.classify_area(key) == "templates")
        & K.extension(K.base_name(key)).isin(*K.OFFICE_EXTENSIONS),
    ))


def _described(files: DataFrame) -> DataFrame:
    key = F.col("key")
    return files.withColumns(
        {
            "versioned": K.is_versioned(key),
            "version": K.version_from_key(key),
            "ver": K.version_tuple(K.version_from_key(key)),
        }
    )


def attach_loose(files: DataFrame) -> DataFrame:
    """Every file with its template id.

    A loose file joins the versioned template that holds a file of the same name; the template seen
    first wins. Two loose files with one name slug to one id, so no second claim pass is needed.
    """
    tagged = _described(files).withColumns(
        {"ident": K.logical_template_id(F.col("key")), "lname": F.lower("name")}
    ).where("ident is not null")
    # one row per (template, file name): far fewer than files, and windowed only at that level
    names = tagged.where("versioned").groupBy("ident", "lname").agg(F.min("key").alias("key"))
    seen = F.min(F.struct("lname", "key")).over(W.partitionBy("ident"))
    owners = (
        names.withColumn("first_seen", seen)
        .groupBy("lname")
        .agg(F.min_by("ident", F.struct("first_seen", "ident")).alias("owner"))
    )
    return (
        tagged.join(owners, "lname", "left")
        .withColumn("ident", F.when(F.col("versioned"), F.col("ident")).otherwise(F.coalesce("owner", "ident")))
        .drop("owner", "lname")
    )


def group_versions(files: DataFrame) -> DataFrame:
    """Files per template with their rank, newest version first (rows, not one array per template)."""
    coarse = F.struct("versioned", F.col("ver")[0].alias("major"))
    order = [F.desc("versioned"), F.desc("ver"), F.desc_nulls_last("last_modified"), F.asc("key")]
    return part_rank(files, ["ident"], coarse, order, "pos", descending=True)


def latest_version(files: DataFrame) -> DataFrame:
    """The first file of each template by (versioned, version, time)."""
    return best_per_group(files, ["ident"], [F.col(c) for c in _FILE_ORDER])


def hydrate_versions(files: DataFrame, meta_versions: DataFrame) -> DataFrame:
    """Adds versions known only to the metadata, with size 0, to templates that have a listed file."""
    both = _with_metadata_keys(files, meta_versions)
    return both.join(files.select("ident").distinct(), "ident", "left_semi").drop("listed")


def _with_metadata_keys(files: DataFrame, meta_versions: DataFrame) -> DataFrame:
    """Listed and metadata rows per (template, key) in one aggregate; the listed row wins."""
    extra = _described(
        meta_versions.where("coalesce(s3_key, '') <> ''").select(
            F.col("template_id").alias("ident"), F.col("s3_key").alias("key"),
            K.base_name(F.col("s3_key")).alias("name"), F.lit(0).cast("bigint").alias("size"),
            F.coalesce("modified_at", "created_at").alias("last_modified"),
        )
    ).withColumn("listed", F.lit(False))
    columns = ["ident", "key", "name", "size", "last_modified", "versioned", "version", "ver", "listed"]
    listed = files.withColumn("listed", F.lit(True)).select(*columns)
    return best_per_group(
        listed.unionByName(extra.select(*columns)), ["ident", "key"], [F.col("listed"), F.col("last_modified")]
    )


def _filled(overlay: Column, listed: Column) -> Column:
    return F.coalesce(F.nullif(overlay, F.lit("")), listed)


_ITEM = ("key", "last_modified", "size")


def version_entries(files: DataFrame, meta_versions: DataFrame) -> DataFrame:
    """Per (template, version) the versioned file, the loose file and the metadata entry, in one aggregate."""
    none_item = F.lit(None).cast("struct<key:string,last_modified:timestamp,size:bigint>")
    none_meta = F.lit(None).cast(
        "struct<status:string,changelog:string,created_at:timestamp,modified_at:timestamp,s3_key:string>"
    )
    none_rank = F.lit(None).cast(
        "struct<versioned:boolean,ver:array<bigint>,last_modified:timestamp,key:string>"
    )
    listed = F.col("listed") if "listed" in files.columns else F.lit(True)
    items = files.select(
        "ident", "version", "versioned", listed.alias("listed"), F.struct(*_ITEM).alias("item"), F.struct(*_FILE_ORDER).alias("rank"),
        none_meta.alias("meta"),
    )
    notes = meta_versions.where("coalesce(version, '') <> ''").select(
        F.col("template_id").alias("ident"), "version", F.lit(None).cast("boolean").alias("versioned"), F.lit(False).alias("listed"),
        none_item.alias("item"), none_rank.alias("rank"),
        F.struct("status", "changelog", "created_at", "modified_at", "s3_key").alias("meta"),
    )
    # of several files with one version the lowest in listing order supplies the entry
    return (
        items.unionByName(notes)
        .groupBy("ident", "version")
        .agg(
            F.min_by("item", F.when(F.col("versioned"), F.col("rank"))).alias("v_item"),
            F.min_by("item", F.when(~F.col("versioned"), F.col("rank"))).alias("l_item"),
            F.max_by("meta", F.when(F.col("meta").isNotNull(), F.struct("meta.created_at", "meta.s3_key"))).alias("meta"),
            F.bool_or("listed").alias("listed"),
        )
        .withColumn("ver", K.version_tuple(F.col("version")))
    )


def merge_versions(
    files: DataFrame, meta_versions: DataFrame, pinned: DataFrame | None = None
) -> DataFrame:
    """Listed versions overlaid with non-empty metadata values, one row per (template, version).

    Loose files count only where a template has no versioned file. With ``pinned`` (template_id,
    active_version) the rows also carry ``current``: the pinned version if it exists, else the
    highest. All that is needed per template comes from one summary that is joined back, so a
    template with very many versions is combined map-side and never gathered in one task.
    """
    entries = version_entries(files, meta_versions)
    if pinned is not None:
        pins = pinned.select(F.col("template_id").alias("ident"), F.nullif(F.col("active_version"), F.lit("")).alias("pin"))
        entries = entries.join(pins, "ident", "left")
    else:
        entries = entries.withColumn("pin", F.lit(None).cast("string"))
    order = F.struct("ver", "version")
    strong = F.col("v_item").isNotNull() | F.col("meta").isNotNull()
    hit = F.col("version") == F.col("pin")
    summary = entries.groupBy("ident").agg(
        F.count("v_item").alias("n_versioned"),
        F.bool_or("listed").alias("any_listed"),
        F.max_by("version", F.when(strong, order)).alias("top_strong"),
        F.max_by("version", order).alias("top_any"),
        F.max(F.when(hit & strong, F.col("pin"))).alias("pin_strong"),
        F.max(F.when(hit, F.col("pin"))).alias("pin_any"),
    ).where("any_listed").select(
        "ident", (F.col("n_versioned") > 0).alias("has_versioned"),
        F.when(F.col("n_versioned") > 0, F.coalesce("pin_strong", "top_strong"))
        .otherwise(F.coalesce("pin_any", "top_any")).alias("current"),
    )
    joined = entries.join(summary, "ident").where(strong | ~F.col("has_versioned"))
    item = F.when(F.col("has_versioned"), F.col("v_item")).otherwise(F.coalesce("v_item", "l_item"))
    listed = item.isNotNull()
    meta = F.col("meta")
    return joined.select(
        F.col("ident").alias("template_id"),
        "version",
        "ver",
        _filled(meta["status"], F.when(listed, "published")).alias("status"),
        _filled(meta["changelog"], F.when(listed, "")).alias("changelog"),
        F.coalesce(meta["created_at"], item["last_modified"]).alias("created_at"),
        F.coalesce(meta["modified_at"], item["last_modified"]).alias("modified_at"),
        _filled(meta["s3_key"], item["key"]).alias("s3_key"),
        "current",
    )


def settle(merged: DataFrame) -> DataFrame:
    """Flags and final status of rows that carry ``current``."""
    is_current = F.col("version") == F.col("current")
    status = F.when(is_current, "published").otherwise(
        F.when(F.coalesce(F.col("status"), F.lit("")).isin("", "published"), "archived").otherwise(F.col("status"))
    )
    return merged.withColumns({"is_latest": is_current, "is_active": is_current, "status": status}).drop("current")


def active_version(versions: DataFrame, pinned: DataFrame) -> DataFrame:
    """Marks the pinned version of a version table if it exists, else the highest.

    ``pinned`` has template_id and active_version.
    """
    pins = pinned.select("template_id", F.nullif(F.col("active_version"), F.lit("")).alias("pin"))
    tagged = versions.join(pins, "template_id", "left")
    current = tagged.groupBy("template_id").agg(
        F.coalesce(
            F.max(F.when(F.col("version") == F.col("pin"), F.col("pin"))),
            F.max_by("version", F.struct("ver", "version")),
        ).alias("current")
    )
    return settle(versions.join(current, "template_id"))


def highest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("template_id").agg(
        F.regexp_replace(F.max_by("version", F.struct("ver", "version")), r"^[vV]+", "").alias("previous_version")
    )


def publish(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Appends one new version per row of ``new`` (template_id, filename, changelog, created_at).

    Rows of earlier versions keep their content; only published ones turn archived.
    """
    added = (
        new.join(highest_version(versions), "template_id", "left")
        .withColumn("version", K.next_version(F.col("previous_version")))
        .select(
            "template_id", "version", K.version_tuple(F.col("version")).alias("ver"),
            F.lit("published").alias("status"), "changelog", "created_at",
            F.col("created_at").alias("modified_at"),
            F.concat(
                F.lit("template/"), K.category_of(F.col("filename")), F.lit("/"), F.col("template_id"),
                F.lit("/v"), F.col("version"), F.lit("/"), F.col("filename"),
            ).alias("s3_key"),
            "previous_version", F.lit(True).alias("is_active"),
        )
    )
    touched = new.select("template_id", F.lit(True).alias("touched")).distinct()
    flag = F.col("is_active") if "is_active" in versions.columns else F.lit(False)
    previous = F.col("previous_version") if "previous_version" in versions.columns else F.lit(None).cast("string")
    earlier = versions.join(touched, "template_id", "left").select(
        "template_id", "version", "ver",
        F.when(
            F.col("touched") & (F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("published")) == "published"),
            "archived",
        ).otherwise(F.col("status")).alias("status"),
        "changelog", "created_at", "modified_at", "s3_key", previous.alias("previous_version"),
        F.when(F.col("touched"), F.lit(False)).otherwise(flag).alias("is_active"),
    )
    return earlier.unionByName(added)


def activate(versions: DataFrame, choice: DataFrame) -> DataFrame:
    """Flips flags to the chosen version of each template; nothing else changes."""
    picked = versions.join(choice, ["template_id", "version"], "left_semi").select(
        "template_id", F.col("version").alias("chosen")
    )
    hit = F.col("version") == F.col("chosen")
    return (
        versions.join(picked, "template_id", "left")
        .withColumns(
            {
                "is_active": F.coalesce(hit, F.lit(False)),
                "status": F.when(F.col("chosen").isNull(), F.col("status"))
                .when(hit, "published").otherwise("archived"),
            }
        )
        .drop("chosen")
    )


def restore(versions: DataFrame, choice: DataFrame, at: str) -> DataFrame:
    """Appends a new version that carries the content of the chosen old one."""
    copies = versions.join(choice, ["template_id", "version"], "left_semi").select(
        "template_id", K.base_name(F.col("s3_key")).alias("filename"),
        F.concat(F.lit("Restored from v"), F.col("version")).alias("changelog"),
        F.lit(at).cast("timestamp").alias("created_at"),
    )
    return publish(versions, copies)


def template_catalog(inventory: DataFrame, meta: DataFrame, meta_versions: DataFrame) -> DataFrame:
    """One row per template: grouped, hydrated, versioned and enriched."""
    files = _with_metadata_keys(attach_loose(office_objects(inventory)), meta_versions)
    pins = meta.select(F.col("id").alias("template_id"), "active_version")
    per_template = merge_versions(files, meta_versions, pins).groupBy("template_id").agg(
        F.count(F.lit(1)).alias("version_count"),
        F.min_by("created_at", F.struct("ver", "version")).alias("created_at"),
        F.max("current").alias("current_version"),
        F.max(F.when(F.col("version") == F.col("current"), F.col("s3_key"))).alias("current_key"),
    )
    carried = ("version_count", "created_at", "current_version", "current_key")
    joined = (
        files.withColumnRenamed("last_modified", "modified")
        .join(per_template.withColumnRenamed("template_id", "ident"), "ident")
        .groupBy("ident")
        .agg(
            F.max_by(
                F.struct("key", F.col("size"), F.col("modified").alias("last_modified")),
                F.struct((F.col("key") == F.col("current_key")).alias("hit"), "versioned", "ver", "modified", "key"),
            ).alias("file"),
            *[F.any_value(c).alias(c) for c in carried],
        )
        .withColumnRenamed("ident", "template_id")
        .join(meta, F.col("template_id") == F.col("id"), "left")
    )
    key = F.coalesce(F.nullif(F.col("current_key"), F.lit("")), F.col("file.key"))
    filename = K.base_name(key)
    ext = K.extension(filename)
    return joined.select(
        F.col("template_id").alias("id"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), K.pretty_name(filename)).alias("name"),
        key.alias("s3_key"),
        ext.alias("output_format"),
        F.coalesce("file.size", F.lit(0)).alias("size"),
        F.col("file.last_modified").alias("last_modified"),
        F.col("created_at"),
        K.category_of(filename).alias("category"),
        F.coalesce(
            F.nullif(F.col("description"), F.lit("")),
            F.concat(F.lit("Office template ("), filename, F.lit(")")),
        ).alias("description"),
        F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(ext, K.category_of(filename))).alias("tags"),
        "current_version",
        filename.alias("original_filename"),
        F.coalesce("usage_count", F.lit(0)).cast("bigint").alias("usage_count"),
        "created_by",
        "version_count",
    )


def usage_join(templates: DataFrame, per_stem: DataFrame) -> DataFrame:
    """Generated files by file-name stem, by the stem of the template name where that finds none."""
    first = per_stem.select(F.col("stem").alias("file_stem"), F.col("generated").alias("by_file"))
    second = per_stem.select(F.col("stem").alias("name_stem"), F.col("generated").alias("by_name"))
    return (
        templates.withColumns(
            {"file_stem": K.usage_stem(F.col("original_filename")), "name_stem": K.usage_stem(F.col("name"))}
        )
        .join(first, "file_stem", "left")
        .join(second, "name_stem", "left")
        .withColumn(
            "generated_count",
            F.coalesce(F.nullif(F.col("by_file"), F.lit(0)), F.col("by_name"), F.lit(0)).cast("bigint"),
        )
        .drop("file_stem", "name_stem", "by_file", "by_name")
    )


def version_bytes(versions: DataFrame, inventory: DataFrame, templates: DataFrame) -> DataFrame:
    """Stored bytes of a template's versions; the template's own size where none is in the inventory."""
    summed = (
        versions.join(inventory.select(F.col("key").alias("s3_key"), F.col("size").alias("v_size")), "s3_key")
        .groupBy("template_id")
        .agg(F.sum("v_size").cast("bigint").alias("found"))
    )
    return (
        templates.join(summed, F.col("id") == F.col("template_id"), "left")
        .withColumn("storage_bytes", F.coalesce(F.nullif(F.col("found"), F.lit(0)), F.col("size")))
        .drop("template_id", "found")
    )


def most_used(inventory: DataFrame, catalog: DataFrame, versions: DataFrame, n: int = 10) -> DataFrame:
    counted = usage_join(catalog, I.generated_per_stem(inventory))
    sized = version_bytes(versions, inventory, counted)
    return (
        sized.withColumn("score", F.col("usage_count") + F.col("generated_count"))
        .select("id", "name", "output_format", "usage_count", "generated_count", "score", "size", "storage_bytes",
                F.col("version_count").alias("versions"), "s3_key")
        .orderBy(F.desc("score"), F.desc("storage_bytes"), "id")
        .limit(n)
    )


def catalog_versions(inventory: DataFrame, meta: DataFrame, meta_versions: DataFrame) -> DataFrame:
    """All versions of all templates with their settled status."""
    files = _with_metadata_keys(attach_loose(office_objects(inventory)), meta_versions)
    pins = meta.select(F.col("id").alias("template_id"), "active_version")
    return settle(merge_versions(files, meta_versions, pins))


def version_history(versions: DataFrame) -> DataFrame:
    """Newest change first, with the active flag."""
    return versions.withColumn("changed_at", F.coalesce("modified_at", "created_at")).orderBy(
        F.desc_nulls_last("changed_at"), "template_id", F.desc("ver")
    )


def compare_versions(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Path and changelog changes between two versions; pairs has template_id, from_version, to_version."""
    side = versions.select("template_id", "version", "s3_key", F.coalesce("changelog", F.lit("")).alias("changelog"))
    left = side.select("template_id", F.col("version").alias("from_version"), F.col("s3_key").alias("l_key"),
                       F.col("changelog").alias("l_log"))
    right = side.select("template_id", F.col("version").alias("to_version"), F.col("s3_key").alias("r_key"),
                        F.col("changelog").alias("r_log"))
    both = pairs.join(left, ["template_id", "from_version"]).join(right, ["template_id", "to_version"])
    fields = F.array(
        F.struct(F.lit("s3_key").alias("field"), F.col("l_key").alias("before"), F.col("r_key").alias("after")),
        F.struct(F.lit("changelog").alias("field"), F.col("l_log").alias("before"), F.col("r_log").alias("after")),
    )
    changed = F.filter(fields, lambda f: ~f["before"].eqNullSafe(f["after"]))
    return (
        both.withColumn("n_changes", F.size(changed).cast("bigint"))
        .withColumn("change", F.explode_outer(changed))
        .select(
            "template_id", "from_version", "to_version", F.col("change.field").alias("field"),
            F.when(F.col("change").isNotNull(), "updated").alias("change"),
            F.col("change.before").alias("removed"), F.col("change.after").alias("added"),
            F.concat(
                F.col("n_changes").cast("string"), F.lit(" difference(s) between v"), F.col("from_version"),
                F.lit(" and v"), F.col("to_version"), F.lit("."),
            ).alias("summary"),
        )
    )


def resolve(catalog: DataFrame, refs: DataFrame) -> DataFrame:
    """Catalog row per reference: its id, its key, or the id a path belongs to. No match, no row."""
    candidates = catalog.select(
        F.col("id").alias("template_id"), "s3_key",
        F.explode(
            F.array(
                F.struct(F.lit("exact").alias("how"), F.col("id").alias("token"), F.lit(0).alias("prio")),
                F.struct(F.lit("exact").alias("how"), F.col("s3_key").alias("token"), F.lit(0).alias("prio")),
                F.struct(F.lit("path").alias("how"), F.col("id").alias("token"), F.lit(1).alias("prio")),
            )
        ).alias("c"),
    ).select("template_id", "s3_key", "c.*")
    wanted = refs.select(
        "ref",
        F.explode(
            F.array(
                F.struct(F.lit("exact").alias("how"), F.trim("ref").alias("token")),
                F.struct(
                    F.lit("path").alias("how"),
                    F.when(
                        F.col("ref").contains("/") & K.key_problem(F.col("ref")).isNull(),
                        K.logical_template_id(F.trim("ref")),
                    ).alias("token"),
                ),
            )
        ).alias("w"),
    ).select("ref", "w.*").where("token is not null")
    hits = wanted.join(candidates, ["how", "token"]).select("ref", "template_id", "s3_key", "prio")
    return (
        hits.groupBy("ref")
        .agg(F.min_by(F.struct("template_id", "s3_key"), F.struct("prio", "template_id")).alias("hit"))
        .select("ref", "hit.template_id", "hit.s3_key")
    )


def find_by_filename(generated: DataFrame, names: DataFrame) -> DataFrame:
    """Newest generated file per wanted name, names compared in lower case."""
    wanted = names.select(F.col("filename"), F.lower(K.safe_filename(F.col("filename"))).alias("lname")).where(
        "lname is not null"
    )
    newest = best_per_group(
        generated.select(F.lower("name").alias("lname"), "key", "last_modified"),
        ["lname"], [F.col("last_modified"), F.col("key")],
    )
    return wanted.join(newest, "lname").select("filename", "key", "last_modified")


def owner_filter(docs: DataFrame, user: str | None) -> DataFrame:
    """Own files and files without an owner; no user means an administrator, who sees all."""
    wanted = (user or "").strip().lower()
    if not wanted:
        return docs
    owner = F.lower(F.trim(F.coalesce(F.col("generated_by"), F.lit(""))))
    return docs.where((owner == "") | (owner == wanted))


def generated_documents(inventory: DataFrame, metadata: DataFrame) -> DataFrame:
    """Generated files with the fields kept in their object metadata."""
    files = I.with_object_metadata(inventory.where(K.classify_area(F.col("key")) == "generated"), metadata)
    field = lambda name: F.coalesce(F.col("metadata")[name], F.lit(""))
    return files.select(
        F.col("key").alias("id"), "key", "name", "size", "last_modified",
        field("template_id").alias("template_id"),
        F.coalesce(F.nullif(field("template_name"), F.lit("")), K.stem(F.col("name"))).alias("template_name"),
        F.coalesce(F.nullif(field("template_name"), F.lit("")), F.col("name")).alias("document_name"),
        field("generated_by").alias("generated_by"),
    )


def recent_generated(docs: DataFrame, user: str | None, n: int = 50) -> DataFrame:
    """Newest first; the owner rule is applied before the limit."""
    return owner_filter(docs, user).orderBy(F.desc_nulls_last("last_modified"), "key").limit(n)
