"""Pitch fields to slide change rows (slide, label, kind, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T

# --- fixed values: labels of the deck the rows address --------------------------------------------
FOOTER = "Team name   |   Problem Statement ID   |   Theme"
CONTENT = (
    (2, "pitch", "One sentence, max 20 words: for <who>, our solution <does what> so that <what changes>.", ""),
    (3, "demo_url", "Paste the full URL here", ""),
    (3, "demo_moment", "The moment the AI does its job — timestamp it.", ""),
    (3, "hardest_input", "The hardest input you tested it against.", ""),
    (3, "user_outcome", "What the user gets at the end, and how fast.", ""),
    (4, "ai_decision", "Which decision, judgement or generation does the model actually make? Name the single step.", ""),
    (4, "why_not_rules", "What could an if-else or a SQL query never have done here? Be specific.", ""),
    (4, "ai_stack", "Service used, and prompt / RAG / agent / fine-tune. PII handling, grounding, who overrides it.", ""),
    (5, "input_source", "INPUT / SOURCE", "INPUT / SOURCE — "),
    (5, "processing", "PROCESSING", "PROCESSING — "),
    (5, "ai_layer", "AI LAYER", "AI LAYER — "),
    (5, "output_user", "OUTPUT / USER", "OUTPUT / USER — "),
    (5, "flow_summary", "Replace these four boxes with your real components — name the service or library in each.", ""),
    (6, "today_limitation", "What exists today — a tool, a vendor, a spreadsheet, a person — and what it cannot do.", ""),
    (6, "win_dimension", "The one dimension you clearly win on: speed, accuracy, cost, coverage or effort.", ""),
    (6, "why_not_clone", "Domain logic, data, workflow fit — why a weekend clone would not match this.", ""),
    (6, "hours_saved", "measured or estimated", ""),
    (6, "faster_response", "say which one, and how you know", ""),
    (6, "reach", "the reach if adopted", ""),
    (6, "next_need", "One sentence: what you need to take this forward — a data owner, a pilot team, an AWS account, two more weeks.", ""),
)
SECTIONS = (
    (2, "what_breaks", "What breaks today, and where exactly does it break?", 4),
    (2, "what_you_built", "What you built, in plain language.", 4),
    (4, "tools_used", "Tools used, and for what", None),
    (5, "stack", "Front end", None),
    (5, "demo_status", "Built and demoable", None),
    (5, "technical_gap", "Biggest technical gap", None),
)
# --------------------------------------------------------------------------------------------------


def _prefixed(value: Column, prefix: str) -> Column:
    return F.when(F.lower(value).startswith(prefix.lower()), value).otherwise(F.concat(F.lit(prefix), value))


def _text(name: str) -> Column:
    return T.strip(F.coalesce(F.col(name), F.lit("")))


def members_line(value: Column) -> Column:
    """Names joined by bullets, whatever parted them."""
    joined = lambda parts: F.array_join(F.filter(parts, lambda p: p != ""), " • ")
    return (
        F.when(value.contains("•"), joined(F.transform(F.split(value, "•"), lambda p: T.strip(p))))
        .when(value.contains("\n"), joined(F.transform(T.lines(value), T.bare_line)))
        .when(value.contains(","), joined(F.transform(F.split(value, ","), lambda p: T.strip(p))))
        .otherwise(value)
    )


def section_points(points: Column, limit: int | None) -> Column:
    """All points; in a section with a ``limit``, which is what its page shows well, one long point falls into its sentences."""
    lines = F.filter(F.transform(points, T.bare_line), lambda p: p != "")
    if limit is None:
        return lines

    def cut(lines: Column) -> Column:
        only = F.get(lines, F.lit(0))
        sentences = F.filter(F.transform(F.split(only, r"(?<=[.!?])\s+"), lambda s: T.strip(s)), lambda s: s != "")
        long = (F.size(lines) == 1) & (F.length(only) > 140) & (F.size(sentences) >= 2)
        return F.when(long, sentences).otherwise(lines)

    return T.let(lines, cut)


def slide_request(ctx: DataFrame, key: str = "doc_id") -> DataFrame:
    """Change rows of a deck; empty values give no row, the footer stands on slides 2 to 6."""
    theme, statement, team = _text("theme"), _text("problem_statement_id"), _text("team_name")

    def row(slide: int, label: str, kind: str, value: Column, pos: Column | int = 0) -> Column:
        return F.struct(
            F.lit(slide).alias("slide"), F.lit(label).alias("label"), F.lit(kind).alias("kind"),
            (F.lit(pos) if isinstance(pos, int) else pos).cast("int").alias("pos"), value.alias("value"),
        )

    def orelse(value: Column, default: str) -> Column:
        return F.when(value == "", default).otherwise(value)

    footer = F.concat_ws(
        "   |   ", orelse(team, "Team name"), orelse(statement, "Problem Statement ID"), orelse(theme, "Theme")
    )
    single = [
        row(1, "Theme", "content", F.when(theme != "", _prefixed(theme, "Theme: ")).otherwise("")),
        row(1, "Problem Statement ID", "content",
            F.when(statement != "", _prefixed(statement, "Problem Statement ID: ")).otherwise("")),
        row(1, "Team Members Details", "content", members_line(_text("team_members"))),
        *[row(slide, FOOTER, "content", footer) for slide in range(2, 7)],
    ]
    for slide, name, label, prefix in CONTENT:
        value = _text(name)
        shown = F.when(value == "", "").otherwise(_prefixed(value, prefix)) if prefix else value
        single.append(row(slide, label, "content", shown))

    def pointed(slide: int, label: str):
        return lambda p, i: row(slide, label, "section", p, i + 1)

    rows = F.filter(F.array(*single), lambda r: r["value"] != "")
    for slide, name, label, limit in SECTIONS:
        points = section_points(F.coalesce(F.col(name), F.array().cast("array<string>")), limit)
        rows = F.concat(rows, F.transform(points, pointed(slide, label)))
    return T.unfolded(ctx, [key], rows, "r", "__i").select(key, "r.*")
