"""Notes to form fields, one plan per profile.

Each plan adds columns to the notes; a note is one row, so nothing is shuffled and no text is cut.
Defaults that name an author, a date or a project are arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quire import profiles as P
from quire.functions import lists as L, text as T, values as X

# --- fixed values -------------------------------------------------------------------------------
PITCH_ALIASES = {
    "theme": ("theme", "hackathon_theme"),
    "problem_statement_id": ("problem_statement_id", "problem_statement", "ps_id", "problem_id"),
    "pitch": ("pitch", "one_sentence_pitch", "one_liner", "tagline"),
    "demo_url": ("demo_url", "demo_link", "recording"),
    "next_need": ("next_need", "what_you_need_next"),
}
PITCH_PLAIN = (
    "demo_moment", "hardest_input", "user_outcome", "ai_decision", "why_not_rules", "ai_stack", "input_source",
    "processing", "ai_layer", "output_user", "flow_summary", "today_limitation", "win_dimension", "why_not_clone",
    "hours_saved", "faster_response", "reach",
)
PITCH_SECTIONS = {
    "what_breaks": (
        "What breaks today, and where exactly does it break?", "What breaks today", "What breaks",
    ),
    "what_you_built": ("What you built, in plain language.", "What you built", "What we built"),
    "tools_used": ("Tools used, and for what", "Tools used"),
    "stack": ("Tech stack", "Front end"),
    "demo_status": ("What is demoable", "Built and demoable"),
    "technical_gap": ("Biggest technical gap", "Technical gap"),
}
PITCH_STOPS = tuple(h for heads in PITCH_SECTIONS.values() for h in heads) + (
    "Pitch", "Demo URL", "Demo moment", "Hardest input", "User outcome", "AI decision", "Team name", "Theme",
    "Problem statement ID",
)
BREAKS_HINT = (
    r"(?i)\b(today|currently|right now|unsorted|hours before|shared inbox|delayed|hurts|csat|sit[s]?\s+unsorted|"
    r"feel it|costs roughly|figuring out what.?s urgent)\b"
)
BUILT_HINT = (
    r"(?i)\b(reads|classifies|drafts|one click|we built|product screenshot|queue view|approve,?\s*edit|"
    r"within seconds|triage queue|insert (?:product )?screenshot)\b"
)
MEETING_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
# ------------------------------------------------------------------------------------------------

def _stripped(notes: DataFrame, text: str) -> DataFrame:
    return notes.withColumn("__t", T.strip(F.col(text))).withColumn("__kv", T.kv_map(F.col("__t")))


def _some(items: Column) -> Column:
    return T.let(items, lambda xs: F.when(F.size(xs) > 0, xs))


def extract_meeting(
    notes: DataFrame, text: str = "text", author: str | None = None, today: str | None = None
) -> DataFrame:
    """purpose, meeting_date, venue, prepared_by, attendees_team, summary_items, action_items."""
    base = notes.withColumn("__flat", T.strip(T.squeeze(F.col(text))))
    flat, raw = F.col("__flat"), F.col(text)
    on = F.coalesce(
        T.found(flat, rf"(?i)\bon\s+(\d{{1,2}}\s+(?:{MEETING_MONTHS})\s+\d{{4}})"),
        T.found(flat, rf"(?i)(\d{{1,2}}\s+(?:{MEETING_MONTHS})\s+\d{{4}})"),
    )
    venue = F.coalesce(
        T.found(flat, r"(?i)\bat\s+the\s+([^.]+?)(?:\.|,|\s+The\s+meeting)"),
        T.found(flat, r"\bat\s+([A-Z][^.]{3,80}?(?:Room|Office|Hall|Floor)[^.,]*)"),
    )
    lead = T.strip(T.found(flat, r"(?i)(?:facilitated by|chaired by|hosted by|led by)\s+([^,.]+)"))
    present = T.found(flat, r"(?i)(?:facilitated by|chaired by)\s+[^,]+,\s*with\s+(.+?)\s+attending")
    listed = T.found(flat, r"(?i)(?:attendees?|participants?)\s*[:\-]\s*([^.]+)")
    with_lead = L.split_people(present)
    led = lambda who: T.let(with_lead, lambda xs: F.when(who.isNotNull() & ~F.array_contains(xs, who), F.concat(F.array(who), xs)).otherwise(xs))
    people = F.when(present.isNotNull(), T.let(lead, led)).otherwise(L.split_people(F.coalesce(listed, F.lit(""))))
    points = T.ordered_distinct(F.concat(L.agenda_items(flat), L.decision_items(flat)), ignore_case=True)
    title = F.coalesce(
        T.found(flat, r"(?i)(?:The\s+)?([A-Z][^.]{5,120}?Meeting)\s+(?:was conducted|was held|took place)"),
        T.found(flat, r"([A-Z][^.]{5,80}?Meeting)"),
    )
    marked = F.filter(T.lines(raw), lambda s: s.contains(":") & s.rlike(r"(?i)^(purpose|title|subject|meeting)\b"))
    by_line = F.when(F.size(marked) > 0, T.strip(F.regexp_replace(F.get(marked, F.lit(0)), r"^[^:]*:", "")))
    first = T.strip(F.element_at(F.split(T.strip(raw), r"\."), 1))
    opening = F.when((F.length(T.strip(raw)) > 8) & (F.length(first) > 5), first)
    return base.select(
        *notes.columns,
        F.coalesce(T.strip(title), by_line, opening).alias("purpose"),
        F.coalesce(T.let(on, X.to_iso_date), F.lit(today)).alias("meeting_date"),
        T.strip(venue, " ,.").alias("venue"),
        F.coalesce(lead, F.lit(author)).alias("prepared_by"),
        _some(people).alias("attendees_team"),
        _some(points).alias("summary_items"),
        _some(L.action_rows(raw)).alias("action_items"),
    )


def extract_functions(
    notes: DataFrame, text: str = "text", project: str | None = None, workstream: str | None = None,
    process: str | None = None,
) -> DataFrame:
    """project_name, workstream, business_process and polished function rows."""
    base = _stripped(notes, text)
    t, kv = F.col("__t"), F.col("__kv")
    named = r"(?i)(?:BFL|business function list)\s+for\s+([^/\n]+)(?:\s*/\s*([^/\n]+))?(?:\s*/\s*([^\n.]+))?"
    topic = F.lower(t).contains("acquire") & F.lower(t).contains("dispose")

    def cover(keys: tuple[str, ...], group: int, of_topic: str | None, default: str | None) -> Column:
        given = T.first_key(kv, *keys)
        title = F.when(given.isNotNull(), L.clean_title(given))
        quoted = T.found(t, named, group)
        return F.coalesce(
            title, F.when(quoted.isNotNull(), L.clean_title(quoted)), F.when(topic, F.lit(of_topic)), F.lit(default)
        )

    heads = (
        "Functions", "Business Functions", "Function List", "Rows", "Function rows", "We need", "Scope",
    )
    section = T.section_blob(t, heads)
    loose = T.found(t, r"(?is)(?:functions?\s+we\s+need|functions?|function\s+list)\s*[:\-]\s*(.+)\z")
    staged = base.select(
        *notes.columns, "__t",
        cover(("project_name", "project", "client"), 1, None, project).alias("project_name"),
        cover(("workstream", "stream"), 2, "Acquire to Dispose", workstream).alias("workstream"),
        cover(
            ("business_process", "process", "top_level_process", "cycle"), 3, "55. Acquire to Dispose", process
        ).alias("business_process"),
        F.coalesce(F.nullif(section, F.lit("")), T.strip(loose), t).alias("__blob"),
    )
    piped, prose = T.pipe_rows(F.col("__blob"), L.FUNCTION_COLUMNS, 2), L.prose_rows(F.col("__blob"))
    found = staged.withColumn("__piped", piped).withColumn(
        "__rows",
        F.when(F.size("__piped") > 0, F.col("__piped")).otherwise(
            T.let(prose, lambda rows: F.when(F.size(rows) > 0, rows).otherwise(L.prose_rows(F.col("__t"))))
        ),
    )
    known = F.coalesce(F.col("business_process"), F.lit(""))
    polished = F.filter(
        F.transform("__rows", lambda r, i: L.polish_function_row(r, i + 1, known)),
        lambda r: (F.length(r["process"]) >= 4) | (F.length(r["description"]) >= 4),
    )
    return found.withColumn("functions", _some(polished)).drop("__t", "__blob", "__piped", "__rows")


def extract_scenarios(notes: DataFrame, text: str = "text", author: str | None = None) -> DataFrame:
    """project_name, workstream, updated_by and scenario rows of nine columns."""
    base = _stripped(notes, text)
    t, kv = F.col("__t"), F.col("__kv")
    named = r"(?i)(?:POC list|POCs?)\s+for\s+([^/\n]+)(?:\s*/\s*([^\n.]+))?"
    blob = F.coalesce(F.nullif(T.section_blob(t, ("POCs", "POC List", "Scenarios", "Rows")), F.lit("")), t)
    return base.select(
        *notes.columns,
        F.coalesce(T.first_key(kv, "project_name", "project"), T.strip(T.found(t, named, 1))).alias("project_name"),
        F.coalesce(kv["workstream"], T.strip(T.found(t, named, 2))).alias("workstream"),
        F.coalesce(T.first_key(kv, "updated_by", "prepared_by"), F.lit(author)).alias("updated_by"),
        _some(T.pipe_rows(blob, L.SCENARIO_COLUMNS, 3)).alias("pocs"),
    )


def extract_requirements(
    notes: DataFrame, text: str = "text", doc_code: str | None = "Business Requirement Document",
    author: str | None = None, area_path: str | None = None, today: str | None = None, polish: bool = True,
) -> DataFrame:
    """Document fields and items; rows typed Epic, Feature or User Story are kept alone if there are any."""
    base = _stripped(notes, text)
    t, kv = F.col("__t"), F.col("__kv")
    named = T.strip(T.found(t, r"(?i)(?:BRD|business requirements?(?:\s+document)?)\s+for\s+([^\n.]+)"))
    told = T.found(t, r"(?is)(?:overview|process description)\s*[:\-]\s*(.+?)(?:\n\s*\n|Items|Epics|\z)")
    section = T.section_blob(t, ("Items", "Epics", "Features", "User Stories", "Rows"))
    rows = T.let(section, lambda s: T.pipe_rows(F.when(s != "", s).otherwise(t), L.ITEM_COLUMNS, 2))

    def typed(rows: Column) -> Column:
        own = F.filter(rows, lambda r: F.lower(r["type"]).rlike("epic|feature|story"))
        return T.let(own, lambda found: F.when(F.size(found) > 0, found).otherwise(rows))

    given = T.first_key(kv, "document_date", "date")
    staged = base.select(
        *notes.columns,
        F.coalesce(T.first_key(kv, "doc_code", "document_code", "title"), F.lit(doc_code)).alias("doc_code"),
        F.coalesce(T.first_key(kv, "process_name", "process"), named).alias("process_name"),
        F.coalesce(kv["prepared_by"], F.lit(author)).alias("prepared_by"),
        F.coalesce(X.to_iso_date(given), given, F.lit(today)).alias("document_date"),
        F.coalesce(kv["area_path"], F.lit(area_path)).alias("area_path"),
        F.coalesce(T.first_key(kv, "overview", "description"), T.strip(T.squeeze(told))).alias("overview"),
        T.let(rows, typed).alias("__items"),
    )
    if polish:
        staged = L.polish_items(staged, "__items", F.coalesce("overview", F.lit("")))
    return staged.withColumn("items", _some(F.col("__items"))).drop("__items")


# --- pitch --------------------------------------------------------------------------------------
def _member_list(value: Column) -> Column:
    parts = F.filter(F.split(value, r"[,/]"), lambda p: T.strip(p) != "")
    return value.contains("•") | value.contains(";") | (F.size(parts) >= 3)


def sanitize_identity(ctx: DataFrame) -> DataFrame:
    """Keeps team_name, problem_statement_id, theme, team_members and pitch short and in their place."""
    first = T.strip(F.element_at(T.lines(T.strip(F.col("team_name"))), 1))
    is_list = _member_list(first)
    bad_team = first.rlike(r"(?i)^(members?|details|name|team)$") | is_list
    members = F.coalesce(F.nullif(F.col("team_members"), F.lit("")), F.when(is_list, first))
    statement = T.strip(F.col("problem_statement_id"))
    number = T.found(statement, r"(?i)PS[\s\-]?(\d{2,4})")
    words = F.size(F.filter(F.split(statement, r"\s+"), lambda w: w != ""))
    long = (F.length(statement) > 32) | statement.contains("\n") | (words > 4)
    theme = T.strip(F.element_at(T.lines(T.strip(F.col("theme"))), 1), " .")
    moved = (F.length(theme) > 80) | theme.rlike(r"(?i)\bfor\b.+\bso that\b")
    pitch = F.coalesce(F.col("pitch"), F.when(moved, theme))
    short = T.strip(T.squeeze(T.strip(pitch)), " .")
    return ctx.withColumns(
        {
            "team_name": F.when((first != "") & ~bad_team, first),
            "problem_statement_id": F.when(number.isNotNull(), F.concat(F.lit("PS-"), number)).when(
                (statement != "") & ~long, F.col("problem_statement_id")
            ),
            "theme": F.when((theme != "") & ~moved, theme),
            "team_members": F.when(~T.strip(members).rlike(r"(?i)^(members?|details)$"), members),
            "pitch": F.when(T.strip(pitch) != "", short),
        }
    )


def split_misplaced(breaks: Column, built: Column, keep: int | None = None) -> tuple[Column, Column]:
    """Moves a line that hits only the other list's words; no duplicates, all of each or the first ``keep``."""
    none = F.array().cast("array<string>")
    breaks, built = F.coalesce(breaks, none), F.coalesce(built, none)
    to_built = lambda s: s.rlike(BUILT_HINT) & ~s.rlike(BREAKS_HINT)
    to_breaks = lambda s: s.rlike(BREAKS_HINT) & ~s.rlike(BUILT_HINT)
    kept_breaks, kept_built = F.filter(breaks, lambda s: ~to_built(s)), F.filter(built, lambda s: ~to_breaks(s))
    new_breaks = F.filter(F.filter(built, to_breaks), lambda s: ~F.array_contains(kept_breaks, s))
    new_built = F.filter(F.filter(breaks, to_built), lambda s: ~F.array_contains(kept_built, s))
    first = (lambda rows: rows) if keep is None else (lambda rows: F.slice(rows, 1, keep))
    return _some(first(F.concat(kept_breaks, new_breaks))), _some(first(F.concat(kept_built, new_built)))


def _bullets(blob: Column) -> Column:
    return F.transform(F.filter(T.lines(blob), lambda s: T.strip(s) != ""), T.bare_line)


def extract_pitch(notes: DataFrame, text: str = "text") -> DataFrame:
    """Short fields by their aliases, bullet sections, and patterns where a field was not labelled."""
    base = _stripped(notes, text)
    t, kv = F.col("__t"), F.col("__kv")
    bad = lambda v: v.rlike(r"(?i)^(members?|details|name)$") | _member_list(v)
    a, b = kv["team_name"], kv["our_team"]
    team = F.coalesce(F.when(~bad(a), a), F.when(~bad(b), b))
    in_team = F.coalesce(
        F.when(_member_list(a), a), F.when(a.isNull() | bad(a), F.when(_member_list(b), b))
    )
    members = F.coalesce(in_team, T.first_key(kv, "team_members", "members", "team_member_details", "people"))
    aliased = {name: T.first_key(kv, *keys) for name, keys in PITCH_ALIASES.items()}
    number = T.found(t, r"(?i)\bPS[\s\-]?(\d{2,4})\b")
    url = F.regexp_replace(F.regexp_extract(t, r"(?i)https?://[^\s)>\]]+", 0), r"[.,;]+$", "")
    said = T.strip(T.squeeze(T.found(t, r"(?i)\bfor\s+[^,]{3,80},\s+(?:our|we|the)\s+[^\n.]{10,160}", 0)), " .")
    sentences = F.filter(
        F.transform(
            F.split(F.regexp_replace(t, r"\s*\n\s*", ". "), r"(?<=[.!?])\s+"), lambda s: T.strip(s, " .")
        ),
        lambda s: F.length(s).between(40, 180)
        & s.rlike(r"(?i)^(?:for\b|our solution\b)|(?:so that|we built|one[- ]sentence)"),
    )
    sections = {
        name: T.let(T.section_blob(t, heads, PITCH_STOPS), lambda blob: F.when(blob != "", _bullets(blob)))
        for name, heads in PITCH_SECTIONS.items()
    }
    built_said = F.transform(
        T.all_found(t, r"(?i)(?:we built|what we built(?: is)?)\s+([^\n.]{10,180})"), lambda s: T.strip(s)
    )
    breaks_said = F.transform(
        F.filter(
            T.all_found(
                t, r"(?i)((?:today|currently|right now)[^\n.]{10,160}|(?:sit|sits|sitting) unsorted[^\n.]{0,80})"
            ),
            lambda s: F.length(T.strip(s)) > 12,
        ),
        lambda s: T.strip(T.squeeze(s)),
    )
    line = lambda p: T.found(t, p)
    staged = base.select(
        *notes.columns,
        F.coalesce(team, T.strip(line(r"(?im)^team\s+name\s*[:\-]\s*([^\n]{2,60})\s*$"), " .")).alias("team_name"),
        F.coalesce(
            members, T.strip(line(r"(?im)^(?:team\s+members(?:\s+details)?|members)\s*[:\-]\s*([^\n]+)\s*$"))
        ).alias("team_members"),
        F.coalesce(aliased["theme"], T.strip(line(r"(?im)^(?:hackathon\s+)?theme\s*[:\-]\s*([^\n]{3,80})\s*$"), " .")).alias("theme"),
        F.coalesce(aliased["problem_statement_id"], F.concat(F.lit("PS-"), number)).alias("problem_statement_id"),
        F.coalesce(aliased["pitch"], said, F.get(sentences, F.lit(0))).alias("pitch"),
        F.coalesce(aliased["demo_url"], F.nullif(url, F.lit(""))).alias("demo_url"),
        aliased["next_need"].alias("next_need"),
        *[kv[name].alias(name) for name in PITCH_PLAIN],
        F.coalesce(sections["what_breaks"], _some(breaks_said)).alias("what_breaks"),
        F.coalesce(sections["what_you_built"], _some(built_said)).alias("what_you_built"),
        *[sections[name].alias(name) for name in ("tools_used", "stack", "demo_status", "technical_gap")],
    )
    clean = sanitize_identity(staged)
    breaks, built = split_misplaced(F.col("what_breaks"), F.col("what_you_built"))
    return clean.withColumns({"what_breaks": breaks, "what_you_built": built})


# --- forms --------------------------------------------------------------------------------------
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "mom": extract_meeting,
    "bfl": extract_functions,
    "poc_list": extract_scenarios,
    "brd": extract_requirements,
    "sample_ppt": extract_pitch,
}
ROW_COLUMNS = {
    ("mom", "action_items"): L.ACTION_COLUMNS,
    ("bfl", "functions"): L.FUNCTION_COLUMNS,
    ("poc_list", "pocs"): L.SCENARIO_COLUMNS,
    ("brd", "items"): L.ITEM_COLUMNS,
}


def _shown(profile: str, slot: P.Slot, have: set[str], today: str | None) -> Column:
    default = F.lit(today if slot.default == "today" else slot.default)
    if slot.id not in have:
        return F.coalesce(default, F.lit(""))
    value = F.col(slot.id)
    if (profile, slot.id) in ROW_COLUMNS:
        lists = ("flow",) if profile == "brd" else ()
        value = L.rows_to_lines(value, ROW_COLUMNS[(profile, slot.id)], lists)
    elif slot.type == "list" and slot.id.startswith("attendees"):
        value = F.array_join(value, ", ")
    elif slot.type == "list":
        value = F.array_join(F.filter(F.transform(value, lambda v: T.strip(v)), lambda v: v != ""), "\n")
    return F.coalesce(F.nullif(value, F.lit("")), default, F.lit(""))


def form_fields(context: DataFrame, profile: str, today: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Long form (keys, profile, id, label, required, value) of one profile's context columns."""
    have = set(context.columns)
    slots = P.slots_of(profile)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"), F.lit(s.id).alias("id"), F.lit(s.label).alias("label"),
                F.lit(s.required).alias("required"), _shown(profile, s, have, today).alias("value"),
            )
            for i, s in enumerate(slots)
        ]
    )
    return context.select(*keys, F.lit(profile).alias("profile"), F.explode(cells).alias("f")).select(
        *keys, "profile", "f.*"
    )


def extract_form(notes: DataFrame, today: str, author: str, text: str = "text") -> DataFrame:
    """Form fields of every note by its ``profile``; notes without a known profile give their key-value lines."""
    parts = []
    for profile, extractor in EXTRACTORS.items():
        some = notes.where(F.col("profile") == profile).drop("profile")
        extra = {"mom": {"author": author, "today": today}, "poc_list": {"author": author},
                 "brd": {"author": author, "today": today}}.get(profile, {})
        parts.append(form_fields(extractor(some, text, **extra), profile, today))
    plain = notes.where(~F.coalesce(F.col("profile").isin(*EXTRACTORS), F.lit(False))).select(
        "doc_id", F.lit("").alias("profile"), F.explode(T.kv_map(T.strip(F.col(text)))).alias("id", "value")
    ).select(
        "doc_id", "profile", F.lit(0).alias("pos"), "id", F.col("id").alias("label"), F.lit(False).alias("required"), "value"
    )
    out = plain
    for part in parts:
        out = out.unionByName(part)
    return out


def missing_required(form: DataFrame, keys: tuple[str, ...] = ("doc_id", "profile")) -> DataFrame:
    """Labels of required fields without a value, in slot order."""
    empty = F.when(F.col("required") & (T.strip(F.col("value")) == ""), F.struct("pos", "label"))
    return form.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(empty)), lambda e: e["label"]).alias("missing"),
        F.count_if(T.strip(F.col("value")) != "").alias("filled"),
    )
