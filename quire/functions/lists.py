"""People, agenda points, decisions, action rows and steps out of one note."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T, values as X

# --- fixed values -------------------------------------------------------------------------------
FREQUENCY = {
    "on demand": "Ondemand", "ondemand": "Ondemand", "ad hoc": "Ondemand", "adhoc": "Ondemand", "daily": "Daily",
    "weekly": "Weekly", "monthly": "Monthly", "yearly": "Yearly", "annual": "Yearly", "real time": "Realtime",
    "realtime": "Realtime",
}
MANUAL = {
    "manual": "Manual", "automatic": "Automatic", "auto": "Automatic", "semi": "Manual", "semi-automatic": "Manual",
}
FIT = {"fit": "Fit", "gap": "Gap", "partial": "Partial"}
FUNCTION_TYPE = {
    "screen": "Screen", "batch": "Batch", "report": "Report", "interface": "Interface", "workflow": "Workflow",
    "job": "Batch",
}
ACTION_COLUMNS = ("action", "owner", "due_date", "status", "remarks")
FUNCTION_COLUMNS = (
    "process", "description", "input", "output", "department", "frequency", "manual_auto", "type", "module", "fit_gap",
    "steps",
)
SCENARIO_COLUMNS = (
    "id", "cycle", "subprocess", "title", "description", "prereq", "steps", "decision", "azure_ids",
)
ITEM_COLUMNS = ("type", "name", "description", "acceptance", "flow")
PROSE_SKIPS = (
    "project", "workstream", "business process", "functions", "bfl", "hey", "hi ", "hello", "we are", "for the",
)
STATUS_WORDS = ("open", "closed", "in progress", "pending", "done", "wip")
# ------------------------------------------------------------------------------------------------


def _kept(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def map_vocab(value: Column, table: dict[str, str], default: Column | str) -> Column:
    """Controlled word; an unknown value stays as it is, an empty one becomes the default."""
    raw = T.strip(F.coalesce(value, F.lit("")))
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(raw == "", fallback).otherwise(
        F.coalesce(pairs[T.squeeze(F.lower(raw))], raw)
    )


def alias_pick(*columns: Column) -> Column:
    """First non-empty of several spellings of one column, trimmed."""
    picked = F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))
    return T.strip(picked)


def split_people(blob: Column) -> Column:
    """Names split on commas and ``and``; group words go unless they read ``Xyz Team``."""
    parts = F.transform(F.split(F.regexp_replace(blob, r"(?i)\band\b", ","), ","), lambda p: T.strip(p, " ."))
    group = r"(?i)representatives|team|teams|attending|session"
    return F.filter(
        parts,
        lambda p: F.when(p.rlike(group), p.rlike(r"^[A-Z][A-Za-z]+ Team$")).otherwise(F.length(p) >= 2),
    )


def split_list(blob: Column) -> Column:
    return _kept(F.transform(F.split(blob, r"\s*[,;]\s*|\s+and\s+"), lambda p: T.strip(p)))


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def agenda_items(text: Column) -> Column:
    chunk = F.regexp_extract(
        text, r"(?is)(?:agenda focused on|agenda included|agenda covered|agenda was)\s+(.+?)(?:\.|\z)", 1
    )
    verb = r"(?i)^(reviewing|discussing|understanding|identifying|finalizing|confirming)\s+"
    cut = F.transform(
        F.split(chunk, r",|\band\b"), lambda p: T.strip(F.regexp_replace(T.strip(p, " .;"), verb, ""))
    )
    return F.transform(F.filter(cut, lambda p: F.length(p) > 3), _capital)


def decision_items(text: Column) -> Column:
    key = F.regexp_extract(text, r"(?i)The key decisions from the meeting were to\s+(.+?)\.", 1)
    said = T.all_found(
        text, r"(?i)(?:It was also decided that|The team agreed that|The team agreed to)\s+([^.]+)"
    )
    spoken = F.filter(F.transform(said, lambda p: T.strip(p)), lambda p: F.length(p) > 8)

    def chosen(key: Column) -> Column:
        keyed = F.filter(F.transform(F.split(key, r",|\band\b"), lambda p: T.strip(p)), lambda p: F.length(p) > 5)
        return F.when(key != "", keyed).otherwise(spoken)

    return T.let(key, chosen)


def _cell(parts: Column, i: int, default: str = "") -> Column:
    return F.coalesce(F.get(parts, F.lit(i)), F.lit(default))


def _due(text: Column) -> Column:
    return F.coalesce(X.to_iso_date(text), text)


def action_segments(text: Column) -> Column:
    """``owner | action | due | status | remarks`` segments parted by semicolons."""
    section = F.regexp_extract(
        text, r"(?is)(?:action items[^:]*:|following action items[^:]*:)\s*(.+?)(?:\. The meeting concluded|\z)", 1
    )
    whole = F.coalesce(F.nullif(section, F.lit("")), text)
    segments = F.transform(F.split(F.regexp_replace(whole, r"\s*\n\s*", " "), ";"), lambda s: T.strip(s, " ."))
    cells = F.transform(F.filter(segments, lambda s: s.contains("|")), T.pipe_cells)

    def row(p: Column) -> Column:
        owner = F.regexp_replace(p[0], r"(?i)^(?:the\s+)?following\s+action\s+items[^:]*:\s*", "")
        owner = T.strip(F.regexp_replace(owner, r"(?i)^action items[^:]*:\s*", ""))
        return F.struct(
            p[1].alias("action"), owner.alias("owner"), _due(_cell(p, 2)).alias("due_date"),
            _cell(p, 3, "Open").alias("status"), _cell(p, 4).alias("remarks"),
        )

    return F.filter(F.transform(cells, row), lambda r: (r["owner"] != "") & (r["action"] != ""))


def action_lines(text: Column) -> Column:
    """``action | owner | due | status | remarks`` lines."""
    cells = F.transform(F.filter(F.transform(T.lines(text), T.bare_line), lambda s: s.contains("|")), T.pipe_cells)
    data = F.filter(
        cells,
        lambda p: ~(F.lower(p[0]).isin("action", "task", "item") & F.lower(F.array_join(p, " ")).contains("owner")),
    )
    return F.transform(
        data,
        lambda p: F.struct(
            p[0].alias("action"), p[1].alias("owner"), _due(_cell(p, 2)).alias("due_date"),
            _cell(p, 3, "Open").alias("status"), _cell(p, 4).alias("remarks"),
        ),
    )


def action_rows(notes: Column) -> Column:
    """The line form where there is one, else the segment form of the notes or of their one-line text."""
    def or_else(rows: Column, other: Column) -> Column:
        return T.let(rows, lambda found: F.when(F.size(found) > 0, found).otherwise(other))

    return or_else(action_lines(notes), or_else(action_segments(notes), action_segments(T.strip(T.squeeze(notes)))))


def bullet_item(text: Column) -> Column:
    """One bullet as (task, owner, due_date, status, priority).

    ``[Owner: x, Due: y]`` keys first, then the parts between dashes: a date is the due date, up to
    four words an owner, a status word the status.
    """
    return T.let(F.struct(T.all_found(text, _ITEM_KEY, 0).alias("marks"), F.regexp_replace(text, _ITEM_KEY, " ").alias("rest")), _item_of)


_ITEM_KEY = r"(?i)(?:\(|\[)?\s*(owner|assignee|responsible|due|by|status|priority)\s*[:=]\s*([^\)\],;]+)"


def _item_of(said: Column) -> Column:
    """The item of a bullet's keys (marks) and of what stands around them (rest)."""

    def last(*names: str) -> Column:
        own = F.filter(said["marks"], lambda m: F.lower(F.regexp_extract(m, _ITEM_KEY, 1)).isin(*names))
        return F.when(F.size(said["marks"]) > 0, F.nullif(T.strip(F.regexp_extract(F.coalesce(F.get(F.reverse(own), F.lit(0)), F.lit("")), _ITEM_KEY, 2)), F.lit("")))

    start = F.struct(
        last("due", "by").alias("due_date"), last("owner", "assignee", "responsible").alias("owner"),
        last("status").alias("status"),
    )

    def step(acc: Column, part: Column) -> Column:
        text, day = part["text"], part["day"]
        is_due = day.isNotNull() & acc["due_date"].isNull()
        is_owner = ~is_due & (part["words"] <= 4) & acc["owner"].isNull()
        is_status = ~is_due & ~is_owner & acc["status"].isNull() & F.lower(text).isin(*STATUS_WORDS)
        return F.struct(
            F.when(is_due, day).otherwise(acc["due_date"]).alias("due_date"),
            F.when(is_owner, text).otherwise(acc["owner"]).alias("owner"),
            F.when(is_status, text).otherwise(acc["status"]).alias("status"),
        )

    def of_parts(parts: Column) -> Column:
        many = F.size(parts) >= 2
        tail = F.when(many, F.slice(parts, 2, F.size(parts))).otherwise(F.array().cast("array<string>"))
        # each part is read once, then folded
        known = F.transform(
            tail,
            lambda p: F.struct(
                p.alias("text"), X.parse_date(p).cast("string").alias("day"), F.size(_kept(F.split(p, r"\s+"))).alias("words")
            ),
        )
        main = F.when(many, parts[0]).otherwise(said["rest"])
        task = T.strip(F.regexp_replace(main, r"\s{2,}", " "), " -–—:")
        return T.let(
            F.aggregate(known, start, step),
            lambda read: F.struct(
                F.nullif(task, F.lit("")).alias("task"), read["owner"].alias("owner"), read["due_date"].alias("due_date"),
                read["status"].alias("status"), last("priority").alias("priority"),
            ),
        )

    return T.let(_kept(F.transform(F.split(said["rest"], r"\s+[—–|]\s+|\s+--\s+"), lambda p: T.strip(p))), of_parts)


# --- function rows ------------------------------------------------------------------------------
def clean_title(text: Column) -> Column:
    t = T.strip(T.squeeze(F.coalesce(text, F.lit(""))), " -–—|")
    return T.strip(F.regexp_replace(t, r"(?i)^(?:hey|hi|hello)[,!\s-]*", ""))


def code_prefix(process: Column, default: str = "55.10") -> Column:
    """Leading code of the top process; a one-part code gets ``.10``."""
    code = F.regexp_extract(T.strip(F.coalesce(process, F.lit(""))), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(code == "", default).when(~code.contains("."), F.concat(code, F.lit(".10"))).otherwise(code)


def serial_code(prefix: Column, index: Column) -> Column:
    return F.concat(prefix, F.lit("."), F.format_string("%03d", index))


def polish_function_row(
    row: Column, index: Column, process: Column, module: str = "Fixed Assets", department: str = "Finance"
) -> Column:
    """Codes, vocabulary words and defaults of one function row; ``index`` counts from 1."""
    code = serial_code(code_prefix(process), index)
    name, desc = T.strip(row["process"]), T.strip(row["description"])
    shown = (
        F.when((name != "") & ~name.rlike(r"^\d"), F.concat(code, F.lit(" "), name))
        .when((name == "") & (desc != ""), F.concat(code, F.lit(" "), desc))
        .otherwise(name)
    )

    def filled(field: str, default: str) -> Column:
        value = T.strip(row[field])
        return F.when(value == "", default).otherwise(value)

    return F.struct(
        shown.alias("process"), desc.alias("description"), T.strip(row["input"]).alias("input"),
        T.strip(row["output"]).alias("output"), filled("department", department).alias("department"),
        map_vocab(row["frequency"], FREQUENCY, "Ondemand").alias("frequency"),
        map_vocab(row["manual_auto"], MANUAL, "Manual").alias("manual_auto"),
        map_vocab(row["type"], FUNCTION_TYPE, "Screen").alias("type"),
        filled("module", module).alias("module"), map_vocab(row["fit_gap"], FIT, "Fit").alias("fit_gap"),
        T.strip(row["steps"]).alias("steps"),
    )


def _starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.lower(text).startswith(prefix)
    return hit


def _first_word(text: Column, table: dict[str, str], whole_words: bool = True) -> Column:
    result = F.lit("")
    for word, norm in reversed(table.items()):
        hit = text.rlike(rf"\b{word}\b") if whole_words else text.contains(word)
        result = F.when(hit, norm).otherwise(result)
    return result


def prose_rows(text: Column) -> Column:
    """Function rows from numbered or bulleted prose."""

    def expand(line: Column) -> Column:
        numbered = F.transform(
            F.filter(F.split(line, r"(?:(?<=\s)|^)\d+[.)]\s+"), lambda p: F.length(T.strip(p)) > 5),
            lambda p: T.strip(p, " -–—;"),
        )
        return F.when(line.rlike(r"\d+[.)]\s+\S") & (F.size(numbered) >= 2), numbered).otherwise(F.array(line))

    stripped = _kept(F.transform(T.lines(text), lambda s: T.strip(s)))
    bare = F.transform(
        F.flatten(F.transform(stripped, expand)),
        lambda s: T.strip(F.regexp_replace(T.strip(F.regexp_replace(s, r"^[-*•]+\s*", "")), r"^\d+[.)]\s*", "")),
    )
    rambling = r"(?i)[:–—].{8,}|\binput\b|\boutput\b|\bmanual\b|\bgap\b"
    usable = F.filter(
        bare,
        lambda s: (F.length(s) >= 8) & ~_starts_with_any(s, PROSE_SKIPS) & ~s.contains("|")
        & ~((F.length(s) > 220) & ~s.rlike(rambling)),
    )
    parted = r"^([^:–—\-]{3,80})\s*[:–—\-]\s*(.+)$"

    def split(s: Column) -> Column:
        by_stop = F.split(s, r"[.;]", 2)
        return F.when(
            s.rlike(parted),
            F.struct(
                T.strip(F.regexp_extract(s, parted, 1)).alias("process"),
                T.strip(F.regexp_extract(s, parted, 2)).alias("rest"),
            ),
        ).otherwise(
            F.struct(
                T.strip(by_stop[0]).alias("process"),
                F.coalesce(T.strip(F.get(by_stop, F.lit(1))), s).alias("rest"),
            )
        )

    named = F.filter(
        F.transform(usable, split),
        lambda r: (r["process"] != "") & ~_starts_with_any(r["process"], PROSE_SKIPS),
    )

    def labelled(rest: Column, names: str) -> Column:
        return T.strip(F.regexp_extract(rest, rf"(?i)\b(?:{names})\b\s*[:\-]?\s*([^;|]+)", 1))

    words = (
        r"(?i)\b(?:manual|automatic|auto|ondemand|on demand|daily|weekly|monthly|fit|gap|screen|batch|report)\b"
    )

    def row(r: Column) -> Column:
        rest, low = r["rest"], F.lower(r["rest"])
        given = labelled(rest, "description|desc")
        plain = T.strip(F.regexp_replace(F.regexp_replace(rest, words, ""), r"\s{2,}", " "), " ;,")
        first = T.strip(F.element_at(F.split(plain, ";"), 1))
        desc = F.when(first != "", first).otherwise(r["process"])
        return F.struct(
            r["process"].alias("process"), F.when(given != "", given).otherwise(desc).alias("description"),
            labelled(rest, "input").alias("input"), labelled(rest, "output").alias("output"),
            labelled(rest, "department|dept|owner").alias("department"),
            _first_word(low, FREQUENCY, whole_words=False).alias("frequency"),
            _first_word(low, MANUAL).alias("manual_auto"), _first_word(low, FUNCTION_TYPE).alias("type"),
            labelled(rest, "module|app").alias("module"), _first_word(low, FIT).alias("fit_gap"), F.lit("").alias("steps"),
        )

    return F.transform(named, row)


# --- requirement items --------------------------------------------------------------------------
def item_type(text: Column) -> Column:
    """Epic, User Story or Feature where the words say so, else the text."""
    given = T.strip(F.coalesce(text, F.lit("")))
    low = F.translate(F.lower(given), "_", " ")
    return (
        F.when(given == "", "Feature")
        .when(low.contains("epic"), "Epic")
        .when(low.contains("user") & low.contains("story"), "User Story")
        .when(low.contains("feature"), "Feature")
        .otherwise(given)
    )


def flow_steps(text: Column) -> Column:
    """Steps parted by `` ; ``, numbers, lines or sentences."""
    none = F.array().cast("array<string>")

    def steps(raw: Column) -> Column:
        by_mark = _kept(F.transform(F.split(raw, " ; "), lambda p: T.strip(p)))
        numbered = _kept(F.transform(T.all_found(raw, r"(?:^|[;\n])\s*\d+[.)]\s*([^\n;]+)"), lambda p: T.strip(p)))
        by_line = _kept(F.transform(T.lines(raw), T.bare_line))
        sentences = F.filter(F.transform(F.split(raw, r"(?<=[.!?])\s+"), lambda p: T.strip(p)), lambda p: F.length(p) > 12)
        told = F.when(raw.contains("\n"), by_line).otherwise(T.let(sentences, lambda xs: F.when(F.size(xs) >= 2, xs).otherwise(F.array(raw))))
        return (
            F.when(raw == "", none).when(raw.contains(" ; "), by_mark)
            .otherwise(T.let(numbered, lambda xs: F.when(F.size(xs) > 0, xs).otherwise(told)))
        )

    return T.let(T.strip(F.coalesce(text, F.lit(""))), steps)


def item_flow(item: Column, features: Column, overview: Column) -> Column:
    """Steps of one item: its own, its acceptance, its description, its Features, else a default."""
    def long_enough(steps: Column, least: int, other: Column) -> Column:
        return T.let(steps, lambda xs: F.when(F.size(xs) >= least, xs).otherwise(other))

    name = F.when(T.strip(item["name"]) == "", "this step").otherwise(T.strip(item["name"]))
    story = F.array(
        F.concat(F.lit("Open "), name), F.lit("Enter required details and validate mandatory fields"),
        F.lit("Submit and record the outcome"),
    )
    plain = F.array(
        F.concat(F.lit("Start "), name), F.concat(F.lit("Complete required checks for "), name),
        F.lit("Record the outcome and continue the process"),
    )
    last = F.when(item["type"] == "User Story", story).otherwise(plain)
    epic = F.when(F.size(features) > 0, features).otherwise(long_enough(flow_steps(overview), 1, last))
    other = F.when(item["type"] == "Epic", epic).otherwise(last)
    told = long_enough(flow_steps(item["acceptance"]), 2, long_enough(flow_steps(item["description"]), 2, other))
    return F.when(T.strip(F.coalesce(item["flow"], F.lit(""))) != "", flow_steps(item["flow"])).otherwise(told)


def polish_items(df: DataFrame, items: str, overview: Column) -> DataFrame:
    """Named items with their type settled and steps attached, in place of column ``items``.

    The typed rows and the Feature names are columns of their own, computed once per document.
    """
    typed = F.transform(
        F.filter(items, lambda i: T.strip(F.coalesce(i["name"], F.lit(""))) != ""),
        lambda i: F.struct(
            item_type(i["type"]).alias("type"), T.strip(i["name"]).alias("name"),
            T.strip(F.coalesce(i["description"], F.lit(""))).alias("description"),
            T.strip(F.coalesce(i["acceptance"], F.lit(""))).alias("acceptance"), i["flow"].alias("flow"),
        ),
    )
    staged = df.withColumn(items, typed)
    names = F.transform(F.filter(items, lambda r: r["type"] == "Feature"), lambda r: r["name"])
    staged = staged.withColumn("__features", names)
    return staged.withColumn(
        items,
        F.transform(
            items,
            lambda i: F.struct(
                i["type"].alias("type"), i["name"].alias("name"), i["description"].alias("description"),
                i["acceptance"].alias("acceptance"), item_flow(i, F.col("__features"), overview).alias("flow"),
            ),
        ),
    ).drop("__features")


def number_steps(steps: Column) -> Column:
    """``1. step`` unless the step is numbered already; blank steps go."""
    numbered = F.transform(
        steps,
        lambda s, i: F.when(T.strip(s).rlike(r"^\d+[.)]\s+"), T.strip(s)).when(
            T.strip(s) != "", F.concat((i + 1).cast("string"), F.lit(". "), T.strip(s))
        ).otherwise(""),
    )
    return _kept(numbered)


# --- rows as text -------------------------------------------------------------------------------
def one_line_cell(value: Column) -> Column:
    return T.strip(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ; "))


def list_cell(values: Column) -> Column:
    return F.array_join(_kept(F.transform(values, lambda v: T.strip(v))), " ; ")


def rows_to_lines(rows: Column, columns: Sequence[str], lists: Sequence[str] = ()) -> Column:
    """Struct rows as ``a | b | c`` lines."""
    return F.array_join(
        F.transform(
            rows, lambda r: F.concat_ws(" | ", *[list_cell(r[c]) if c in lists else one_line_cell(r[c]) for c in columns])
        ),
        "\n",
    )


def lines_to_rows(text: Column, columns: Sequence[str]) -> Column:
    cells = F.transform(_kept(F.transform(T.lines(text), lambda s: T.strip(s))), T.pipe_cells)
    return F.transform(
        cells, lambda p: F.struct(*[_cell(p, i).alias(c) for i, c in enumerate(columns)])
    )


def lines_to_list(text: Column) -> Column:
    """Lines without bullet marks, or the comma parts where there is only one line."""
    by_comma = _kept(F.transform(F.split(text, ","), lambda p: T.strip(p)))
    by_line = F.transform(_kept(F.transform(T.lines(text), lambda s: T.strip(s))), T.bare_line)
    return F.when(text.contains("\n"), by_line).otherwise(by_comma)


def item_line_role(line: Column) -> Column:
    """Role of a line inside an item block: blank, area, desc_label, acc_label, flow_label, title, body."""
    raw = T.strip(F.coalesce(line, F.lit("")))
    low = F.lower(raw)
    bare = F.regexp_replace(low, r":+$", "")
    return (
        F.when(raw == "", "blank")
        .when(low.startswith("area path"), "area")
        .when(bare == "description", "desc_label")
        .when(low.startswith("acceptance"), "acc_label")
        .when(low.startswith("process flow") | bare.isin("flow", "process steps", "steps"), "flow_label")
        .when(low.contains("type:") & (low.contains("|") | low.contains("board state")), "title")
        .otherwise("body")
    )
