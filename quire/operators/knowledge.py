"""Hierarchical knowledge base: domain score, scope, chunks by code, passages, enrichment."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import passages as P, text as T
from quire.operators.ordered import best_per_group, carry_forward

# --- fixed values: points, limits and other names of processes -------------------------------------
CODE_POINTS, DEPTH_POINTS, ANYWHERE_POINTS, ALIAS_POINTS, TOKEN_POINTS, TOKEN_CAP, FLOOR = 80, 15, 40, 50, 3, 40, 20
PASSAGES, SHORT_BODY, FEATURES = 12, 20, 16
ALIASES = (
    (("acquire to dispose", "a2d", "capital asset", "fixed asset", "capex"), "55"),
    (("order to cash", "o2c"), "35"),
    (("procure to pay", "p2p", "purchase order"), "20"),
    (("prospect to quote", "p2q"), "30"),
    (("plan to produce", "manufactur"), "25"),
    (("inbound to outbound", "i2o", "warehouse"), "45"),
    (("record to result", "r2r", "general ledger", "chart of account"), "65"),
    (("design to retire", "d2r", "product master"), "10"),
    (("case to resolution", "c2r", "warranty"), "50"),
)
# --------------------------------------------------------------------------------------------------


def under(rows: DataFrame, scopes: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose code is a scope or lies below one: each code brings its ancestors, so this is an equi join."""
    spelled = rows.withColumn("scope", F.explode(T.code_ancestors(F.col(code))))
    return spelled.join(scopes.select("scope").distinct(), "scope")


def features(steps: DataFrame, scopes: DataFrame, n: int = FEATURES) -> DataFrame:
    """The first ``n`` steps (root, pos, code, name) exactly one level below each scope (root, scope), in map order.

    A step is one level below its parent only, so this is an equi join on the parent.
    """
    below = steps.where(T.code_depth(F.col("code")) > 1).withColumn("scope", T.code_parent(F.col("code")))
    inside = below.join(scopes.select("root", "scope").distinct(), ["root", "scope"], "left_semi")
    ranked = inside.withColumn("k", F.row_number().over(W.partitionBy("root", "scope").orderBy("pos"))).where(F.col("k") <= n)
    return ranked.select("root", "scope", F.col("k").cast("int").alias("k"), "pos", "code", "name")


def alias_root(text: Column, root: Column, aliases: Sequence[tuple[Sequence[str], str]] = ALIASES) -> Column:
    """The lower-case text has one of the other names of the root's process."""
    hit = F.lit(False)
    for needles, of in aliases:
        any_of = F.lit(False)
        for needle in needles:
            any_of = any_of | text.contains(needle)
        hit = hit | ((root == of) & any_of)
    return hit


def _code_spans(hay: Column) -> Column:
    """Every stretch of a text that reads as a code, inside longer digits too."""
    # looking ahead, one pass finds the stretches that begin at any sign; cutting them out by position would read the text anew for each
    heads = F.array_distinct(T.all_found(hay, r"(?=(\d{2}[\d.]{0,12}))"))
    shapes = [r"^\d{2}" + "".join(rf"\.\d{{{n}}}" for n in widths) for levels in range(4) for widths in itertools.product((2, 3), repeat=levels)]
    spans = F.flatten(F.transform(heads, lambda s: F.array(*[F.regexp_extract(s, shape, 0) for shape in shapes])))
    return F.array_distinct(F.filter(spans, lambda s: s != ""))


def kb_score(queries: DataFrame, domains: DataFrame, aliases: Sequence[tuple[Sequence[str], str]] = ALIASES) -> DataFrame:
    """Best domain per query (qid, text), at least 20 points: qid, ord, root, score.

    Domains are (ord, root, hay); roots have two digits, so they are few. A code under the root counts 80 plus 15 per level
    up to three, one that only stands in the text 40; another name of the process 50; shared words 3 each up to 40. Equal
    scores go to the first domain. The domains of a word or a code are packed into one row before they meet the queries.
    """
    hay = domains.select("ord", "root", F.lower("hay").alias("hay"))
    words = hay.select("ord", F.explode(T.word_tokens(F.col("hay"))).alias("token")).groupBy("token").agg(F.collect_set("ord").alias("ords"))
    spans = hay.select("ord", F.explode(_code_spans(F.col("hay"))).alias("code")).groupBy("code").agg(F.collect_set("ord").alias("ords"))
    roots = hay.where("root <> ''").groupBy("root").agg(F.collect_set("ord").alias("own"))
    codes = queries.select("qid", F.explode(T.codes_in(F.col("text"))).alias("code")).withColumn("root", F.element_at(T.code_parts(F.col("code")), 1))
    met = codes.join(roots, "root", "left").join(spans, "code", "left")
    none = F.array().cast("array<int>")
    under_root = F.explode(F.coalesce("own", none)).alias("ord")
    depth = (CODE_POINTS + DEPTH_POINTS * F.least(T.code_depth(F.col("code")), F.lit(3))).alias("points")
    by_root = met.select("qid", under_root, depth)
    elsewhere = met.select("qid", F.explode(F.array_except(F.coalesce("ords", none), F.coalesce("own", none))).alias("ord"), F.lit(ANYWHERE_POINTS).alias("points"))
    shared = (
        queries.select("qid", F.explode(T.word_tokens(F.col("text"))).alias("token")).join(words, "token").select("qid", F.explode("ords").alias("ord"))
        .groupBy("qid", "ord").agg(F.least(F.lit(TOKEN_CAP), F.count(F.lit(1)) * TOKEN_POINTS).cast("int").alias("points"))
    )
    known = {of for _, of in aliases}
    named = F.array_compact(F.array(*[F.when(alias_root(F.lower("text"), F.lit(of), aliases), F.lit(of)) for of in sorted(known)])) if known else F.array().cast("array<string>")
    called = queries.select("qid", F.explode(named).alias("root")).join(roots, "root").select("qid", F.explode("own").alias("ord"), F.lit(ALIAS_POINTS).alias("points"))
    total = by_root.unionByName(elsewhere).unionByName(shared).unionByName(called).groupBy("qid", "ord").agg(F.sum("points").alias("score"))
    best = total.groupBy("qid").agg(F.max(F.struct("score", (-F.col("ord")).alias("first"))).alias("b")).where(F.col("b.score") >= FLOOR)
    return best.select("qid", (-F.col("b.first")).alias("ord"), F.col("b.score").alias("score")).join(domains.select("ord", "root"), "ord").select("qid", "ord", "root", "score")


def kb_group_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with the code that governs them: the first code of a chunk holds for later chunks without codes.

    chunks: root, slide_number, process_codes, ... Slides carry forward in parts, so one large domain
    is not sorted as a whole.
    """
    own = F.when(F.size("process_codes") > 0, F.get("process_codes", F.lit(0)))
    return carry_forward(chunks, ["root"], "slide_number", own, "code").where("code is not null")


def kb_passages(chunks: DataFrame, scopes: DataFrame, n: int = PASSAGES) -> DataFrame:
    """First ``n`` useful chunks in the scope of each query (qid, root, scope), by slide: qid, slide_number, title, body.

    A chunk is in a scope if its code is the scope, below it, or above it.
    """
    body = P.useful_text(F.col("title"), F.col("content"))
    useful = kb_group_chunks(chunks).withColumn("body", body).where((F.col("category") != "document_control") & (F.length("body") >= SHORT_BODY))
    wanted = scopes.select("root", "scope").distinct()
    below = useful.withColumn("scope", F.explode(T.code_ancestors(F.col("code")))).join(wanted, ["root", "scope"], "left_semi")
    over = wanted.select("root", "scope", F.explode(T.code_ancestors(F.col("scope"))).alias("code")).where("code <> scope")
    above = useful.join(over, ["root", "code"])
    # each scope is ranked once, and a filter on row_number <= n keeps only n rows per scope and map task before the shuffle
    shape = ["root", "scope", "slide_number", "title", "body"]
    inside = below.select(*shape).unionByName(above.select(*shape))
    ranked = inside.withColumn("k", F.row_number().over(W.partitionBy("root", "scope").orderBy("slide_number"))).where(F.col("k") <= n)
    return scopes.select("qid", "root", "scope").join(ranked, ["root", "scope"]).select("qid", "slide_number", "title", "body")


def kb_scope(queries: DataFrame, steps: DataFrame) -> DataFrame:
    """Scope of each query (qid, root, text) among the steps (root, pos, code, name) of its root: qid, root, scope.

    The deepest, then longest code that the query names, the first of equals, if it is a step, above or below one, or
    under the root; else the step that shares most words, the first of equals, cut to two levels, if it shares two or
    more; else the root itself. Steps of equal words are one before they meet the queries.
    """
    codes = queries.select("qid", "root", F.posexplode(T.codes_in(F.col("text"))).alias("at", "code"))
    tree = steps.select("root", "code", F.explode(T.code_ancestors(F.col("code"))).alias("up"))
    above = tree.select("root", F.col("up").alias("probe")).distinct().withColumn("above", F.lit(True))
    exact = steps.select("root", F.col("code").alias("probe")).distinct().withColumn("exact", F.lit(True))
    inside = codes.withColumn("in_root", (F.col("root") != "") & (F.element_at(T.code_parts(F.col("code")), 1) == F.col("root")))
    strange = inside.where("not in_root").withColumn("probe", F.explode(T.code_ancestors(F.col("code"))))
    known = strange.join(exact, ["root", "probe"], "left").join(above, ["root", "probe"], "left").where(
        F.coalesce("exact", F.lit(False)) | (F.coalesce("above", F.lit(False)) & (F.col("probe") == F.col("code")))
    )
    sure = F.lit(2).alias("sure")
    named = inside.where("in_root").unionByName(known.select("qid", "root", "at", "code", "in_root")).select(
        "qid", "root", "code", sure, T.code_depth(F.col("code")).alias("weight"), F.length("code").alias("longer"), (-F.col("at")).alias("before")
    )
    bags = steps.select("root", "pos", "code", F.array_sort(T.word_tokens(F.concat_ws(" ", "name", "code"))).alias("bag")).where(F.size("bag") > 1)
    first = bags.groupBy("root", "bag").agg(F.min_by(F.struct("pos", "code"), "pos").alias("s")).select("root", "s.pos", "s.code", "bag")
    alike = (
        queries.select("qid", "root", F.explode(T.word_tokens(F.col("text"))).alias("token")).join(first.select("root", "pos", "code", F.explode("bag").alias("token")), ["root", "token"])
        .groupBy("qid", "root", "pos", "code").agg(F.count(F.lit(1)).cast("int").alias("weight")).where("weight >= 2")
        .select("qid", "root", F.array_join(F.slice(T.code_parts(F.col("code")), 1, 2), ".").alias("code"), F.lit(1).alias("sure"), "weight", F.lit(0).alias("longer"), (-F.col("pos")).alias("before"))
    )
    plain = queries.select("qid", "root", F.col("root").alias("code"), F.lit(0).alias("sure"), F.lit(0).alias("weight"), F.lit(0).alias("longer"), F.lit(0).alias("before"))
    every = named.unionByName(alike).unionByName(plain)
    return best_per_group(every, ["qid", "root"], [F.col("sure"), F.col("weight"), F.col("longer"), F.col("before")]).select("qid", "root", F.col("code").alias("scope"))


# --- enrichment: suggestions are an array of at most some twenty items, so a row is enriched by itself -------
def blank(value: Column, least: int = 1) -> Column:
    return F.length(T.strip(F.coalesce(value, F.lit("")))) < least


def read_offers(suggested: Column) -> Column:
    """What items are compared with of each suggestion: its name and description in lower case, and their words."""
    def read(row: Column) -> Column:
        hay = F.lower(F.concat(F.coalesce(row["name"], F.lit("")), F.lit(" "), F.coalesce(row["description"], F.lit(""))))
        return T.let(hay, lambda h: F.struct(h.alias("hay"), T.word_tokens(h).alias("words")))

    return F.transform(suggested, read)


def lacks(item: Column) -> Column:
    """A description under 24 characters, an acceptance under 12 or an empty flow."""
    flow = F.size(F.coalesce(item["flow"], F.array().cast("array<string>"))) == 0
    return blank(item["description"], 24) | blank(item["acceptance"], 12) | flow


def enrich_item(item: Column, suggested: Column, offers: Column | None = None) -> Column:
    """An item (type, name, description, acceptance, flow) with what it lacks from its best suggestion of two or more points.

    10 points for each code of its name in the suggestion's name and description, 1 for each shared word; the first of
    equals. A description under 24 characters, an acceptance under 12 and an empty flow count as lacking. ``offers`` are
    ``read_offers(suggested)``, for callers that compare more than one item with them.
    """
    name = F.lower(F.coalesce(item["name"], F.lit("")))
    offers = read_offers(suggested) if offers is None else offers

    def best_of(asked: Column) -> Column:
        def points(offer: Column) -> Column:
            return 10 * F.size(F.filter(asked["codes"], lambda c: offer["hay"].contains(c))) + F.size(F.array_intersect(asked["words"], offer["words"]))

        return F.array_max(F.transform(offers, lambda o, i: F.struct(points(o).alias("points"), (-i).alias("first"))))

    # the name is read once and every suggestion is rated once, however many fields ask for the best one
    asked = F.struct(T.codes_in(name).alias("codes"), T.word_tokens(name).alias("words"))
    best = F.when(lacks(item), T.let(asked, best_of))

    def filled(best: Column) -> Column:
        fit = F.coalesce(best["points"] >= 2, F.lit(False))
        row = F.get(suggested, -best["first"])

        def either(field: str, least: int) -> Column:
            return F.when(fit & blank(item[field], least), F.coalesce(F.nullif(row[field], F.lit("")), item[field])).otherwise(item[field]).alias(field)

        flow = F.when(fit & (F.size(F.coalesce(item["flow"], F.array().cast("array<string>"))) == 0), F.coalesce(row["flow"], item["flow"])).otherwise(item["flow"])
        return F.struct(item["type"].alias("type"), item["name"].alias("name"), either("description", 24), either("acceptance", 12), flow.alias("flow"))

    return T.let(best, filled)


def enrich_items(items: DataFrame, suggested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items (keys, ord, type, name, description, acceptance, flow) enriched from the ``suggested`` array of their keys."""
    # suggestions are read before they meet the items of their keys
    offered = suggested.select(*keys, "suggested", read_offers(F.col("suggested")).alias("__offers"))
    both = items.join(offered, list(keys), "left")
    fields = ("type", "name", "description", "acceptance", "flow")
    rest = [c for c in items.columns if c not in fields]
    made = enrich_item(F.struct(*fields), F.col("suggested"), F.col("__offers"))
    # without suggestions the item stays as it is
    kept = F.when(F.coalesce(F.size("suggested"), F.lit(0)) > 0, made).otherwise(F.struct(*fields))
    return both.select(*rest, kept.alias("__item")).select(*rest, *[F.col("__item")[f].alias(f) for f in fields])


TOP_FIELDS = (("process_name", 1), ("overview", 8), ("area_path", 1), ("prepared_by", 1), ("doc_code", 1))


def enrich_context(contexts: DataFrame, suggested: DataFrame, keys: Sequence[str], fields: Sequence[tuple[str, int]] = TOP_FIELDS) -> DataFrame:
    """Blank fields and thin lists of contexts from what the knowledge base suggests; adds ``filled``, the names of what changed.

    ``contexts`` and ``suggested`` have the keys, the text ``fields`` (with the length under which a text counts as blank)
    and ``items``. An empty list becomes the suggested one; else each item is enriched, and a list of thin items only
    that is shorter than the suggested one is replaced by it. What the user wrote is never overwritten.
    """
    names = [f for f, _ in fields]
    offer = suggested.select(*keys, F.lit(True).alias("__hit"), F.struct(*names, F.col("items")).alias("__s"))
    both = contexts.join(offer, list(keys), "left")
    take = {f: F.col("__hit") & blank(F.col(f), least) & ~blank(F.col(f"__s.{f}")) for f, least in fields}
    own = F.coalesce("items", F.expr("cast(array() as " + contexts.schema["items"].dataType.simpleString() + ")"))
    theirs = F.coalesce(F.col("__s.items"), F.slice(own, 1, 0))
    staged = both.withColumns({"__own": own, "__theirs": theirs}).withColumn(
        "__rich", F.when(F.exists("__own", lacks), T.let(
            read_offers(F.col("__theirs")), lambda offers: F.transform("__own", lambda item: enrich_item(item, F.col("__theirs"), offers))
        )).otherwise(F.col("__own"))
    )
    thin = F.forall("__own", lambda item: blank(item["description"], 24) & blank(item["acceptance"], 12))
    replaced = (F.size("__own") == 0) | (thin & (F.size("__theirs") > F.size("__own")))
    offered = F.coalesce("__hit", F.lit(False)) & (F.size("__theirs") > 0)
    items = F.when(~offered, F.col("items")).when(replaced, F.col("__theirs")).otherwise(F.col("__rich"))
    changed = offered & (replaced | ~F.col("__rich").eqNullSafe(F.col("__own")))
    filled = F.array_compact(F.array(*[F.when(take[f], F.lit(f)) for f in names], F.when(changed, F.lit("items"))))
    rest = [c for c in contexts.columns if c not in (*names, "items")]
    return staged.select(
        *rest, *[F.when(F.coalesce(take[f], F.lit(False)), F.col(f"__s.{f}")).otherwise(F.col(f)).alias(f) for f in names], items.alias("items"), filled.alias("filled")
    )
