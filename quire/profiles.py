"""Guided profiles and their slots: small configuration rows, never sized by the data.

A new profile is a new ``Profile`` with its ``Slot`` rows; no operator branches on a profile id
except the table of note extractors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Profile:
    id: str
    name: str
    sample_file: str
    format: str
    hints: tuple[str, ...]
    tokens: tuple[str, ...]
    extensions: tuple[str, ...]


@dataclass(frozen=True)
class Slot:
    profile: str
    id: str
    label: str | None
    type: str | None
    required: bool | None
    ask_priority: int | None
    question: str | None = None
    help: str | None = None
    default: str | None = None


# --- fixed values -------------------------------------------------------------------------------
PROFILES: list[Profile] = [
    Profile(
        "mom", "Minutes of Meeting", "MOM Sample.xlsx", "xlsx",
        ("mom sample", "mom_sample", "minutes of meeting", "meeting minutes", "mom template", "mom_template"),
        ("mom", "minutes"), ("xlsx", "xls", "xlsm"),
    ),
    Profile(
        "bfl", "Business Function List", "BFL Sample.xlsx", "xlsx",
        ("bfl sample", "bfl_sample", "business function list", "business function"),
        ("bfl",), ("xlsx", "xls", "xlsm"),
    ),
    Profile(
        "poc_list", "POC List", "POC List sample.xlsx", "xlsx",
        ("poc list sample", "poc list", "poc_list", "proof of concept"),
        ("poc",), ("xlsx", "xls", "xlsm"),
    ),
    Profile(
        "brd", "Business Requirements Document", "BRD Sample.docx", "docx",
        ("brd sample", "brd_sample", "business requirements document", "business requirement"),
        ("brd",), ("docx", "doc"),
    ),
    Profile(
        "sample_ppt", "Hackathon / Salesforce PPT", "Sample_ppt.pptx", "pptx",
        ("sample_ppt", "sample ppt", "sample_ppt.pptx", "hackathon deck", "salesforce ppt", "ppt ai"),
        ("sample_ppt", "hackathon"), ("pptx", "ppt"),
    ),
]

# profile: (slot id, label, type, required, ask priority, default)
_SLOTS = {
    "mom": [
        ("purpose", "Purpose / meeting title", "string", True, 100, None),
        ("meeting_date", "Meeting date", "date", True, 95, "today"),
        ("prepared_by", "Prepared by", "string", True, 90, None),
        ("venue", "Venue", "string", True, 85, None),
        ("attendees_team", "Attendees (team)", "list", True, 80, None),
        ("attendees_client", "Attendees (client)", "list", False, 50, None),
        ("summary_items", "Meeting summary items", "list", True, 75, None),
        ("action_items", "Action plan", "list", True, 70, None),
    ],
    "bfl": [
        ("project_name", "Project name", "string", True, 100, None),
        ("workstream", "Workstream", "string", True, 95, None),
        ("business_process", "Business process", "string", True, 90, None),
        ("functions", "Business functions", "list", True, 80, None),
    ],
    "poc_list": [
        ("project_name", "Project name", "string", True, 100, None),
        ("workstream", "Workstream", "string", True, 95, None),
        ("updated_by", "Updated by", "string", False, 40, None),
        ("pocs", "POC entries", "list", True, 80, None),
    ],
    "brd": [
        ("doc_code", "Document code / title line", "string", True, 100, "Business Requirement Document"),
        ("process_name", "Process name", "string", True, 95, None),
        ("prepared_by", "Prepared by", "string", True, 90, None),
        ("document_date", "Revision date", "date", True, 85, "today"),
        ("area_path", "Area path", "string", False, 40, None),
        ("overview", "Process overview", "text", True, 80, None),
        ("items", "BRD items", "list", True, 75, None),
    ],
    "sample_ppt": [
        ("team_name", "Team name", "string", True, 100, None),
        ("problem_statement_id", "Problem statement ID", "string", True, 98, None),
        ("theme", "Theme", "string", True, 96, None),
        ("team_members", "Team members", "string", True, 94, None),
        ("pitch", "One-sentence pitch", "text", True, 90, None),
        ("what_breaks", "What breaks today", "list", True, 88, None),
        ("what_you_built", "What you built", "list", True, 86, None),
        ("demo_url", "Demo URL", "string", False, 80, None),
        ("demo_moment", "Demo moment", "text", False, 78, None),
        ("hardest_input", "Hardest input", "text", False, 76, None),
        ("user_outcome", "User outcome", "text", False, 74, None),
        ("ai_decision", "AI decision", "text", False, 70, None),
        ("why_not_rules", "Why not rules / SQL", "text", False, 68, None),
        ("ai_stack", "AI service & guardrails", "text", False, 66, None),
        ("tools_used", "Tools used", "list", False, 64, None),
        ("input_source", "Input / source", "string", False, 60, None),
        ("processing", "Processing", "string", False, 58, None),
        ("ai_layer", "AI layer", "string", False, 56, None),
        ("output_user", "Output / user", "string", False, 54, None),
        ("flow_summary", "Architecture flow", "text", False, 52, None),
        ("stack", "Tech stack", "list", False, 50, None),
        ("demo_status", "What is demoable", "list", False, 48, None),
        ("technical_gap", "Biggest technical gap", "list", False, 46, None),
        ("today_limitation", "What exists today", "text", False, 40, None),
        ("win_dimension", "Where you win", "text", False, 38, None),
        ("why_not_clone", "Why a clone would fail", "text", False, 36, None),
        ("hours_saved", "Time saved", "string", False, 34, None),
        ("faster_response", "Speed / accuracy claim", "string", False, 32, None),
        ("reach", "Reach if adopted", "string", False, 30, None),
        ("next_need", "What you need next", "text", False, 28, None),
    ],
}
# profiles whose answers are reviewed in a form; all others are asked for in chat
FORM_PROFILES = ("bfl", "sample_ppt", "brd")
# ------------------------------------------------------------------------------------------------

SLOTS: list[Slot] = [
    Slot(profile, ident, label, kind, required, priority, f"{label}?", None, default)
    for profile, rows in _SLOTS.items()
    for ident, label, kind, required, priority, default in rows
]


def slots_of(profile: str) -> list[Slot]:
    return [s for s in SLOTS if s.profile == profile]


def profile_table(spark: SparkSession, profiles: list[Profile] = PROFILES) -> DataFrame:
    rows = [
        (i, p.id, p.name, p.sample_file, p.format, list(p.hints), list(p.tokens), list(p.extensions),
         "form" if p.id in FORM_PROFILES else "chat")
        for i, p in enumerate(profiles)
    ]
    return spark.createDataFrame(
        rows,
        "ord int, id string, name string, sample_file string, format string, hints array<string>, "
        "tokens array<string>, extensions array<string>, entry_mode string",
    )


def slot_table(spark: SparkSession, slots: list[Slot] = SLOTS) -> DataFrame:
    rows = [
        (i, s.profile, s.id, s.label, s.type, s.required, s.ask_priority, s.question, s.help, s.default)
        for i, s in enumerate(slots)
    ]
    return spark.createDataFrame(
        rows,
        "pos int, profile string, id string, label string, type string, required boolean, ask_priority int, "
        "question string, help string, `default` string",
    )
