"""Notes to facts and collections with confidence and a verbatim quote.

One pass reads the blocks of each text; labels are matched in place (see ``similarity``); all the
rest is built-in expressions and one aggregate per (document, role). Documents are never gathered.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire import roles as R
from quire.functions import lists as L, similarity as S, text as T, values as X
from quire.functions.linescan import read_blocks
from quire.operators.ordered import PART_ROWS, best_per_group
from quire.sources.staged import staged

FACT_COLUMNS = ("doc_id", "role", "ord", "value", "confidence", "evidence", "extractor", "raw")
COLLECTION_COLUMNS = ("doc_id", "role", "ord", "items", "confidence", "evidence", "extractor")
_MAPS = "array<map<string,string>>"

# --- fixed values: phrasings of narrative notes -----------------------------------------------------
DATE_ANYWHERE = (
    r"\b(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\.?,?\s+\d{4}"
    r"|[A-Za-z]{3,9}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})\b"
)
PLACE = (
    r"(?s)\b(?:met|meeting|held|conducted|took place)\b(?:\s+\S+){0,4}?\s+(?:at|in)\s+"
    r"([A-Z][^.,;\n]{2,45}?)(?=[.,;]|\s+(?:to|on|for|and)\b|$)"
)
PURPOSE = (
    r"(?is)(?:to\s+discuss|meeting\s+was\s+(?:called|held)(?:\s+\S+){0,2}?\s+to"
    r"|purpose\s+(?:of\s+(?:the|this)\s+meeting\s+)?(?:was|is)\s+to)\s+([a-z][^.;]{5,90}?)(?=[.;]|$)"
)
PREPARED = (
    r"(?s)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\s+(?:prepared|drafted|wrote|recorded|took)\s+"
    r"(?:these\s+|this\s+|the\s+)?(?:notes|minutes)\b"
)
GROUP_PRESENT = (
    r"(?is)\bfrom\s+([A-Za-z0-9][\w &/\-]{1,24}?)(?:\s+side)?[,:]?\s+([A-Z][\w .,'&\-]+?)\s+"
    r"(?:attended|joined|were\s+present|participated|joined\s+the\s+call)\b"
)
WILL_DO = (
    r"(?is)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\s+(?:will|needs\s+to|is\s+to|should|must)\s+([a-z][^.;]{5,150}?)\s+by\s+"
    r"(\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9})"
    r"(?:,?\s*(?:marked|status(?:ed)?\s+as)?\s*(in progress|open|closed|done|pending|completed))?"
)
# ----------------------------------------------------------------------------------------------------


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _kept_map(*pairs: tuple[Column, Column]) -> Column:
    """Map of the pairs that have a value."""
    whole = F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    return F.map_filter(whole, lambda k, v: F.coalesce(v, F.lit("")) != "")


def block_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per block with the roles its label may mean."""
    found = read_blocks(docs, text, ("doc_id",))
    # structured blocks of a document come before everything found in its prose
    return found.withColumn("scores", S.role_scores(F.col("label"))).withColumn("top", F.get("scores", F.lit(0)))


def _with_typed(df: DataFrame, value: str, fmt: Column) -> DataFrame:
    """Adds ``shown``, the canonical text of a value, and ``fits``, whether it has the format."""
    typed = F.col("__typed")
    shown = F.coalesce(
        typed["v_date"].cast("string"), F.when(typed["v_minutes"].isNotNull(), X.display_minutes(typed["v_minutes"])),
        X.display_double(typed["v_double"]), typed["v_string"],
    )
    staged = df.withColumn("__typed", X.coerce(F.col(value), fmt))
    return staged.withColumns({"shown": shown, "fits": typed["ok"]}).drop("__typed")


def _pairs(found: DataFrame) -> DataFrame:
    """Key-value blocks whose key is a known label, as a value or as a list of parts."""
    role, score = F.col("top.name"), F.col("top.score")
    qualified = F.col("label").rlike(R.QUALIFIER)
    named = found.where((F.col("kind") == "pair") & (score >= 0.70)).withColumns(
        {
            "role": F.when(qualified, R.minted_role(F.col("label"))).otherwise(role),
            "listed": R.is_collection(role),
            "format": F.when(qualified, "text").otherwise(R.expected_format(role)),
            "primary": F.when(qualified | role.isin("attendees", "absentees"), "name").otherwise(
                F.coalesce(F.get(R.item_fields_of(role), F.lit(0)), F.lit("text"))
            ),
            "parts": L.split_list(F.col("value")),
        }
    )
    as_list = F.col("listed") & (
        (F.size("parts") >= 2) | F.col("role").isin("attendees", "absentees") | F.col("role").startswith("x_")
    )
    return named.withColumn("as_list", as_list)


def _rule_facts(found: DataFrame) -> DataFrame:
    score, role = F.col("top.score"), F.col("top.name")
    pairs = _with_typed(_pairs(found).where("not as_list"), "value", F.col("format"))
    trust = F.least(F.lit(0.95), 0.55 + 0.4 * score) * F.when(F.col("fits"), 1.0).otherwise(0.75)
    from_pairs = pairs.select(
        "doc_id", "role", F.col("pos").alias("ord"), F.col("shown").alias("value"), F.round(trust, 3).alias("confidence"),
        "evidence", F.lit("rules").alias("extractor"), F.col("value").alias("raw"),
    )
    single = ~R.is_collection(role)
    first = F.array_join(F.slice("items", 1, 3), "; ")
    collection_hit = F.exists("scores", lambda s: R.is_collection(s["name"]) & (s["score"] >= 0.70))
    from_bullets = found.where((F.col("kind") == "bullets") & ~collection_hit & (score >= 0.75) & single).select(
        "doc_id", role.alias("role"), F.col("pos").alias("ord"),
        F.array_join(F.transform("items", lambda b: F.concat(F.lit("• "), b)), "\n").alias("value"),
        F.round(F.least(F.lit(0.9), 0.5 + 0.4 * score), 3).alias("confidence"),
        F.concat(F.col("label"), F.lit(": "), first).alias("evidence"),
        F.lit("rules").alias("extractor"), _none("string").alias("raw"),
    )
    from_prose = found.where((F.col("kind") == "prose") & (score >= 0.72) & single).select(
        "doc_id", role.alias("role"), F.col("pos").alias("ord"), "value",
        F.round(F.least(F.lit(0.92), 0.55 + 0.4 * score), 3).alias("confidence"),
        F.col("value").alias("evidence"), F.lit("rules").alias("extractor"), _none("string").alias("raw"),
    )
    return from_pairs.unionByName(from_bullets).unionByName(from_prose)


def _primary_field(fields: Column) -> Column:
    preferred = F.filter(F.array(*[F.lit(f) for f in ("task", "item", "name", "description", "text")]), lambda f: F.array_contains(fields, f))
    return F.when(F.size(fields) == 0, "task").otherwise(F.coalesce(F.get(preferred, F.lit(0)), F.get(fields, F.lit(0))))


def _rule_collections(found: DataFrame) -> DataFrame:
    pairs = _pairs(found).where("as_list").select(
        "doc_id", "role", F.col("pos").alias("ord"),
        F.transform("parts", lambda p: F.map_from_arrays(F.array("primary"), F.array(p))).cast(_MAPS).alias("items"),
        F.round(F.least(F.lit(0.93), 0.55 + 0.4 * F.col("top.score")), 3).alias("confidence"),
        "evidence", F.lit("rules").alias("extractor"),
    )
    hits = F.filter("scores", lambda s: R.is_collection(s["name"]) & (s["score"] >= 0.70))
    bulleted = found.where("kind = 'bullets'").withColumn("role", F.get(hits, F.lit(0))["name"]).where("role is not null")
    bulleted = bulleted.withColumn("primary", _primary_field(R.item_fields_of(F.col("role"))))

    def item(i: Column) -> Column:
        return _kept_map(
            (F.lit("due_date"), i["due_date"]), (F.lit("owner"), i["owner"]), (F.lit("status"), i["status"]),
            (F.lit("priority"), i["priority"]), (F.col("primary"), i["task"]),
        )

    from_bullets = bulleted.select(
        "doc_id", "role", F.col("pos").alias("ord"),
        F.filter(F.transform(F.transform("items", L.bullet_item), item), lambda m: F.size(m) > 0).alias("items"), F.lit(0.82).alias("confidence"),
        F.concat("label", F.lit(": "), F.array_join(F.slice("items", 1, 3), "; ")).alias("evidence"),
        F.lit("rules").alias("extractor"),
    )
    return pairs.unionByName(from_bullets).unionByName(_tables(found))


def classify_headers(table: DataFrame, header: str = "header") -> DataFrame:
    """Adds ``mapped``: the columns of a header that mean an item field, each field once (leftmost wins)."""
    exploded = F.transform(header, lambda h, i: F.struct(i.alias("idx"), h.alias("header")))
    staged = table.withColumn("__h", exploded).withColumn("__scores", S.header_fields(F.col(header)))
    named = F.transform(
        "__h", lambda h: F.struct(h["idx"].alias("idx"), F.get(F.col("__scores"), h["idx"]).alias("field"))
    )
    staged = T.settled(staged, "__n", F.filter(named, lambda n: n["field"] != ""))
    firsts = F.filter(
        "__n",
        lambda n: F.forall("__n", lambda o: (o["field"] != n["field"]) | (o["idx"] >= n["idx"])),
    )
    return T.settled(staged, "mapped", firsts).drop("__h", "__scores", "__n")


def _tables(found: DataFrame) -> DataFrame:
    mapped = classify_headers(found.where("kind = 'table'")).where(F.size("mapped") >= 2)

    def item(row: Column) -> Column:
        cells = F.transform("mapped", lambda m: F.struct(m["field"].alias("k"), F.get(row, m["idx"]).alias("v")))
        used = F.filter(cells, lambda c: F.coalesce(c["v"], F.lit("")) != "")
        return F.map_from_entries(used)

    fields = F.transform("mapped", lambda m: m["field"])
    has = lambda *names: F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains("__fields", n))
    by_heading = F.get(F.filter("scores", lambda s: R.is_collection(s["name"]) & (s["score"] >= 0.65)), F.lit(0))["name"]
    by_fields = (
        F.when(has("owner", "task") | has("task", "due_date"), "action_items")
        .when(has("name") & (F.size("__fields") <= 4), "attendees")
        .when(has("description", "quantity") | has("unit_price", "amount"), "line_items")
    )
    minted = R.minted_role(F.when(F.col("label") == "", "items").otherwise(F.col("label")))
    staged = T.settled(mapped.withColumn("__fields", fields), "__items", F.filter(F.transform("rows", item), lambda m: F.size(m) > 0)).where(F.size("__items") > 0)
    return staged.select(
        "doc_id", F.coalesce(by_heading, by_fields, minted).alias("role"), F.col("pos").alias("ord"),
        F.col("__items").alias("items"), F.lit(0.88).alias("confidence"),
        F.concat(F.array_join("header", " | "), F.lit("  (+"), F.size("__items").cast("string"), F.lit(" rows)")).alias("evidence"),
        F.lit("rules").alias("extractor"),
    )


# --- one fact, one collection per role ----------------------------------------------------------
def best_fact(facts: DataFrame) -> DataFrame:
    """Highest confidence per (document, role); the earliest wins ties."""
    return best_per_group(facts, ["doc_id", "role"], [F.col("confidence"), -F.col("ord")])


_STEP = "doc_id bigint, role string, part bigint, at bigint, by_size boolean, bound double, n bigint, conf double, ord bigint"
_LAST = "doc_id bigint, role string, ord bigint, n bigint, conf double"


def _grouped(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in their first ``width`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, rows


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while some := list(itertools.islice(rows, 10_000)):
        yield pd.DataFrame(some, columns=columns)


def _part_steps(rows: list[tuple]) -> Iterator[tuple]:
    """What one part of a group does to any collection that enters it: (at, by_size, bound, n, conf, ord).

    The fold replaces the current entry by a later one with more items or more confidence. An entry
    (n, c) coming in is first replaced at the first row with more items than n or more confidence
    than c, and those rows are the running maxima of the part. So the running maxima, each with the
    entry the fold has reached at the end of the part when it starts there, say all there is to say.
    """
    size = len(rows)
    o, n, c = zip(*rows, strict=True)
    # last entry reached from each row, from the back: the first later row that replaces it is found
    # on two stacks of later rows whose items, or confidence, still exceed everything before them
    end = list(range(size))
    by_n: list[int] = []
    by_c: list[int] = []
    for i in range(size - 1, -1, -1):
        while by_n and n[by_n[-1]] <= n[i]:
            by_n.pop()
        while by_c and c[by_c[-1]] <= c[i]:
            by_c.pop()
        later = min(by_n[-1] if by_n else size, by_c[-1] if by_c else size)
        if later < size:
            end[i] = end[later]
        by_n.append(i)
        by_c.append(i)
    top_n, top_c = -1, -1.0
    for i in range(size):
        if n[i] > top_n:
            top_n = n[i]
            yield i, True, float(n[i]), n[end[i]], c[end[i]], o[end[i]]
        if c[i] > top_c:
            top_c = c[i]
            yield i, False, float(c[i]), n[end[i]], c[end[i]], o[end[i]]


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, role, part, ord, n, conf) in this order to the steps of each part."""
    steps = ((*key, *step) for key, rows in _grouped(batches, 3) for step in _part_steps(rows))
    return _frames(steps, ["doc_id", "role", "part", "at", "by_size", "bound", "n", "conf", "ord"])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Steps in order of (doc_id, role, part, at) to the entry that each group ends with."""

    def last() -> Iterator[tuple]:
        for key, steps in _grouped(batches, 2):
            n, c, chosen, left = -1, -1.0, None, None
            for part, _, by_size, bound, to_n, to_c, to in steps:
                if part != left and bound > (n if by_size else c):
                    n, c, chosen, left = to_n, to_c, to, part
            yield *key, chosen, n, c

    return _frames(last(), ["doc_id", "role", "ord", "n", "conf"])


def best_collection(collections: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """Ordered fold per (document, role): a later collection replaces one with fewer items or less confidence.

    Order matters, so this is no plain maximum. Collections stand by ord, size and confidence; equal ones count once, and of
    those one is taken by a hash of its items. Only these three numbers travel. Each group is cut into parts of
    its order, each part is reduced to its running maxima, and those are folded: the same at every size.
    """
    order = ["part", "ord", "n", "conf"]
    light = collections.select(
        "doc_id", "role", F.floor(F.col("ord") / F.lit(rows)).alias("part"), F.col("ord").cast("bigint").alias("ord"),
        F.size("items").cast("bigint").alias("n"), F.col("confidence").alias("conf"),
    ).distinct()
    parts = light.repartition("doc_id", "role", "part").sortWithinPartitions("doc_id", "role", *order).mapInPandas(_summarise, _STEP)
    last = parts.repartition("doc_id", "role").sortWithinPartitions("doc_id", "role", "part", "at").mapInPandas(_fold, _LAST)
    sized = collections.withColumns({"n": F.size("items").cast("bigint"), "conf": F.col("confidence")})
    won = sized.join(last, ["doc_id", "role", "ord", "n", "conf"], "left_semi").drop("n", "conf")
    return best_per_group(won.withColumn("__text", F.to_json(F.struct(*won.columns))), ["doc_id", "role"], [F.xxhash64("__text"), F.col("__text")]).drop("__text")


# --- narrative ------------------------------------------------------------------------------------
_LATE = 1_000_000_000


def narrative_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Facts from common phrasings, each with the words that matched as evidence."""
    t = F.col(text)
    whole = T.found(t, DATE_ANYWHERE, 0)
    found = F.array(
        F.struct(F.lit("meeting_date").alias("role"), X.parse_date(whole).cast("string").alias("value"), F.lit(0.65).alias("confidence"), whole.alias("evidence")),
        F.struct(F.lit("location").alias("role"), T.strip(T.squeeze(T.found(t, PLACE))).alias("value"), F.lit(0.60).alias("confidence"), T.found(t, PLACE, 0).alias("evidence")),
        F.struct(F.lit("purpose").alias("role"), T.strip(T.squeeze(T.found(t, PURPOSE))).alias("value"), F.lit(0.55).alias("confidence"), T.found(t, PURPOSE, 0).alias("evidence")),
        F.struct(F.lit("recorder").alias("role"), T.strip(T.found(t, PREPARED)).alias("value"), F.lit(0.70).alias("confidence"), T.found(t, PREPARED, 0).alias("evidence")),
    )
    return T.unfolded(docs, ["doc_id"], found, "f", "i").where("f.value is not null").select(
        "doc_id", "f.role", (F.col("i") + _LATE).cast("bigint").alias("ord"), "f.value", "f.confidence", "f.evidence",
        F.lit("narrative").alias("extractor"), _none("string").alias("raw"),
    )


def narrative_collections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Groups that attended and ``<Name> will .. by <day>`` tasks; docs may bring ``default_year``."""
    t = F.col(text)
    groups = T.unfolded(docs, ["doc_id"], T.all_found(t, GROUP_PRESENT, 0), "quote", "i")
    name = r"^[A-Z][\w.'\-]*(\s+[A-Z][\w.'\-]*)*$"
    who = T.strip(F.regexp_extract("quote", GROUP_PRESENT, 1))
    people = F.filter(L.split_list(T.strip(F.regexp_extract("quote", GROUP_PRESENT, 2))), lambda p: p.rlike(name))
    label = F.concat(F.lit("Attendees ("), who, F.lit(")"))
    words = F.size(F.filter(F.split(who, r"\s+"), lambda w: w != ""))
    staged = T.settled(groups, "names", people).withColumns({"label": label, "named": words <= 3}).where(F.size("names") > 0)
    staged = staged.withColumn("score", F.get(S.role_scores(F.col("label")), F.lit(0))["score"])
    present = staged.select(
        "doc_id",
        F.when(F.col("named") & (F.col("score") >= 0.7), R.minted_role(F.col("label"))).otherwise("attendees").alias("role"),
        (F.col("i") + _LATE).cast("bigint").alias("ord"),
        F.transform("names", lambda n: F.map_from_arrays(F.array(F.lit("name")), F.array(n))).cast(_MAPS).alias("items"),
        F.lit(0.60).alias("confidence"), F.col("quote").alias("evidence"), F.lit("narrative").alias("extractor"),
    )
    year = F.col("default_year") if "default_year" in docs.columns else _none("int")
    quotes = T.all_found(t, WILL_DO, 0)

    def task(q: Column) -> Column:
        part = lambda g: F.regexp_extract(q, WILL_DO, g)
        return _kept_map(
            (F.lit("task"), T.strip(T.squeeze(part(2)))), (F.lit("owner"), T.strip(T.squeeze(part(1)))),
            (F.lit("due_date"), X.parse_date(part(3), default_year=year).cast("string")),
            (F.lit("status"), F.initcap(T.strip(part(4)))),
        )

    tasks = T.settled(docs, "__q", quotes).where(F.size("__q") > 0).select(
        "doc_id", F.lit("action_items").alias("role"), F.lit(2 * _LATE).cast("bigint").alias("ord"),
        F.transform("__q", task).alias("items"), F.lit(0.60).alias("confidence"),
        F.array_join(F.slice("__q", 1, 2), "; ").alias("evidence"), F.lit("narrative").alias("extractor"),
    )
    return present.unionByName(tasks)


def extract_facts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(facts, collections) of notes (doc_id, text): rules first, narrative where rules found nothing.

    A narrative list is taken only if it has more items than the list the rules found. The texts, their blocks and the lists
    that the rules find are stages of their own: each is read several times and computed once.
    """
    docs = staged(docs, "texts")
    found = staged(block_rows(docs, text), "blocks")
    both = _rule_facts(found).withColumn("__rule", F.lit(1)).unionByName(
        narrative_facts(docs, text).withColumn("__rule", F.lit(0))
    )
    facts = staged(best_per_group(
        both, ["doc_id", "role"], [F.col("__rule"), F.col("confidence"), -F.col("ord")]
    ).drop("__rule"), "facts")
    years = facts.where("role = 'meeting_date'").select(
        "doc_id", F.year(F.try_to_date("value", "yyyy-MM-dd")).alias("default_year")
    )
    told = narrative_collections(docs.join(years, "doc_id", "left"), text).withColumn("__rule", F.lit(0))
    ruled = best_collection(staged(_rule_collections(found), "lists")).withColumn("__rule", F.lit(1))
    lists = best_per_group(
        ruled.unionByName(told), ["doc_id", "role"], [F.size("items"), F.col("__rule"), -F.col("ord")]
    ).drop("__rule")
    return facts, staged(lists, "collections")


def gate_candidates(
    candidates: DataFrame, docs: DataFrame, facts: DataFrame, roles: tuple[R.Role, ...] = R.BASE_ROLES
) -> DataFrame:
    """Facts of an outside model that quote the text and beat the fact the rules found.

    A value that does not fit its role counts four fifths, confidence stays below 0.97.
    """
    texts = docs.select("doc_id", T.normalize_text(F.col("text")).alias("__norm"))
    usable = candidates.where("coalesce(value, '') <> '' and trim(coalesce(evidence, '')) <> ''")
    quoted = usable.join(texts, "doc_id").where(S.evidence_present(F.trim("evidence"), F.col("__norm"))).drop("__norm")
    typed = _with_typed(quoted, "value", R.expected_format(F.col("role"), roles, "text"))
    weighed = typed.withColumns(
        {"raw": F.col("value"), "__conf": F.coalesce("confidence", F.lit(0.7)) * F.when(F.col("fits"), 1.0).otherwise(0.8)}
    )
    known = facts.select("doc_id", "role", F.col("confidence").alias("__known"))
    kept = weighed.join(known, ["doc_id", "role"], "left").where("__known is null or __conf > __known")
    ready = kept.select(
        "doc_id", "role", "ord", F.col("shown").alias("value"), F.round(F.least("__conf", F.lit(0.97)), 3).alias("confidence"),
        F.trim("evidence").alias("evidence"), F.lit("outside").alias("extractor"), "raw",
    )
    return best_fact(ready)


def gate_collections(candidates: DataFrame, docs: DataFrame, collections: DataFrame) -> DataFrame:
    """Lists of an outside model that quote the text and beat the list the rules found.

    Empty items are dropped, and a list without items or without a quote in the text is dropped. A known list of at
    least as many items and as much confidence stays, so the candidate is dropped too. Confidence stays below 0.97.
    """
    texts = docs.select("doc_id", T.normalize_text(F.col("text")).alias("__norm"))
    filled = candidates.withColumn("items", F.filter(F.coalesce("items", F.array().cast(_MAPS)), lambda m: F.size(m) > 0))
    usable = filled.where("size(items) > 0 and trim(coalesce(evidence, '')) <> ''")
    quoted = usable.join(texts, "doc_id").where(S.evidence_present(F.trim("evidence"), F.col("__norm"))).drop("__norm")
    known = collections.select("doc_id", "role", F.size("items").alias("__n"), F.col("confidence").alias("__known"))
    beaten = (F.col("__n") >= F.size("items")) & (F.col("__known") >= F.coalesce("confidence", F.lit(0.7)))
    kept = quoted.join(known, ["doc_id", "role"], "left").where(F.col("__n").isNull() | ~beaten)
    ready = kept.select(
        "doc_id", "role", "ord", "items", F.round(F.least(F.coalesce("confidence", F.lit(0.75)), F.lit(0.97)), 3).alias("confidence"),
        F.trim("evidence").alias("evidence"), F.lit("outside").alias("extractor"),
    )
    return best_collection(staged(ready, "candidates"))
