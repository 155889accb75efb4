"""Role vocabulary: the meanings a label or a column header can have.

The vocabulary is configuration, not data: a few dozen rows that travel inside the matching
functions. Packs add or replace rows; labels nobody knows get a role of their own (``x_<slug>``).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import keys as K
from quire.operators.ordered import best_per_group


@dataclass(frozen=True)
class Role:
    role: str
    synonyms: tuple[str, ...]
    format: str = "text"
    is_collection: bool = False
    critical: bool = False
    item_fields: tuple[str, ...] = field(default=())

    def names(self) -> tuple[str, ...]:
        return (self.role.replace("_", " "), *self.synonyms)


# --- fixed values: the base vocabulary ------------------------------------------------------------
BASE_ROLES: tuple[Role, ...] = (
    Role("document_title", ("title", "document title", "subject", "topic", "re")),
    Role("meeting_title", ("meeting title", "meeting name", "meeting subject", "agenda title", "discussion topic")),
    Role("purpose", ("purpose", "purpose of meeting", "objective", "meeting purpose", "aim", "goal of meeting")),
    Role(
        "meeting_date",
        ("meeting date", "date", "date of meeting", "conducted on", "held on", "dated", "meeting held on",
         "date & time", "day"),
        "date", critical=True,
    ),
    Role("meeting_time", ("time", "meeting time", "start time", "timing", "from", "commenced at"), "time"),
    Role("end_time", ("end time", "closed at", "concluded at", "to"), "time"),
    Role("duration", ("duration", "length")),
    Role("location", ("location", "venue", "place", "meeting room", "room", "held at", "mode", "platform")),
    Role(
        "facilitator",
        ("facilitator", "chair", "chairperson", "chaired by", "organizer", "organiser", "host", "conducted by",
         "moderator", "meeting lead"),
    ),
    Role(
        "recorder",
        ("minutes by", "recorded by", "prepared by", "scribe", "note taker", "notes by", "author", "documented by"),
    ),
    Role("approver", ("approved by", "reviewed by", "sign off", "signed by", "authorized by"), critical=True),
    Role("department", ("department", "dept", "team", "business unit", "division")),
    Role("project_name", ("project", "project name", "project title", "programme", "program", "initiative")),
    Role(
        "project_code",
        ("project code", "project id", "job number", "wbs", "reference", "ref no", "document no", "doc id"),
    ),
    Role("customer", ("customer", "client", "account", "customer name", "client name", "party")),
    Role("vendor", ("vendor", "supplier", "contractor")),
    Role("version", ("version", "rev", "revision", "issue")),
    Role("status", ("status", "state", "current status", "progress")),
    Role("priority", ("priority", "severity", "criticality")),
    Role(
        "owner",
        ("owner", "responsible", "assignee", "assigned to", "responsibility", "action by", "who",
         "person responsible", "spoc"),
    ),
    Role(
        "due_date",
        ("due", "due date", "target date", "deadline", "by when", "completion date", "eta", "target completion"),
        "date",
    ),
    Role("start_date", ("start date", "from date", "commencement", "kickoff"), "date"),
    Role("end_date", ("end date", "to date", "finish date", "closure date"), "date"),
    Role("agenda", ("agenda", "agenda items", "points of discussion", "topics", "purpose"), "list", True),
    Role("summary", ("summary", "executive summary", "overview", "abstract", "brief", "background", "minutes", "notes")),
    Role("discussion", ("discussion", "key discussion", "deliberations", "details", "remarks", "observations")),
    Role(
        "discussion_points",
        ("discussion points", "meeting summary", "key discussion points", "summary points", "points discussed",
         "minutes of discussion"),
        is_collection=True, item_fields=("point",),
    ),
    Role(
        "decisions",
        ("decision", "decisions", "decisions taken", "conclusions", "resolutions", "outcome", "agreed"), "list", True,
    ),
    Role("risks", ("risk", "risks", "issues", "concerns", "blockers", "challenges"), "list", True),
    Role(
        "next_steps",
        ("next steps", "way forward", "follow up", "follow-up", "next meeting", "recommendations"), "list", True,
    ),
    Role("comments", ("comments", "notes", "additional notes", "remarks", "any other business", "aob")),
    Role(
        "attendees",
        ("attendees", "participants", "present", "members present", "attendance", "invitees", "participant list",
         "present members"),
        is_collection=True, item_fields=("name", "role", "department", "email", "present"),
    ),
    Role(
        "absentees", ("absent", "absentees", "apologies", "not present", "regrets"), is_collection=True,
        item_fields=("name", "role", "reason"),
    ),
    Role(
        "action_items",
        ("action items", "actions", "action plan", "action point", "action points", "tasks", "task list", "to do",
         "todo", "deliverables", "follow up actions", "action tracker"),
        is_collection=True, critical=True, item_fields=("task", "owner", "due_date", "status", "priority", "remarks"),
    ),
    Role(
        "agenda_items", ("agenda item", "sr no", "s no", "sl no", "item", "topic discussed", "point"),
        is_collection=True, item_fields=("item", "presenter", "discussion", "outcome"),
    ),
    Role("amount", ("amount", "value", "total", "cost", "price", "budget"), "currency", critical=True),
    Role("quantity", ("qty", "quantity", "units", "no of", "count"), "number"),
    Role(
        "invoice_number", ("invoice no", "invoice number", "bill no", "po number", "purchase order"), critical=True,
    ),
    Role(
        "line_items", ("line items", "items", "particulars", "description of goods", "bill of materials"),
        is_collection=True, item_fields=("description", "quantity", "unit_price", "amount"),
    ),
)

ITEM_FIELDS: dict[str, tuple[str, ...]] = {
    "name": ("name", "attendee", "participant", "member", "person", "employee", "full name"),
    "role": ("role", "designation", "title", "position", "function"),
    "department": ("department", "dept", "team", "division", "org"),
    "email": ("email", "e-mail", "mail id", "email id"),
    "present": ("present", "attended", "attendance", "y/n", "yes/no"),
    "task": (
        "task", "action", "action item", "activity", "description", "work", "deliverable", "action required",
        "particulars",
    ),
    "owner": (
        "owner", "responsible", "assignee", "assigned to", "action by", "by whom", "who", "responsibility", "spoc",
        "person",
    ),
    "due_date": ("due", "due date", "target date", "deadline", "by when", "eta", "completion date", "timeline"),
    "status": ("status", "state", "progress", "open/closed", "closure status"),
    "priority": ("priority", "severity", "importance"),
    "remarks": ("remarks", "comments", "notes", "observation"),
    "item": ("item", "topic"),
    "point": ("point", "detail", "details", "discussion point", "summary point"),
    "presenter": ("presenter", "speaker", "presented by", "led by"),
    "discussion": ("discussion", "details", "summary", "minutes", "notes"),
    "outcome": ("outcome", "decision", "conclusion", "resolution", "result"),
    "reason": ("reason", "cause", "justification"),
    "description": ("description", "particulars", "details", "item description"),
    "quantity": ("qty", "quantity", "units", "nos", "count"),
    "unit_price": ("rate", "unit price", "price", "unit cost"),
    "amount": ("amount", "total", "value", "line total"),
}
# --------------------------------------------------------------------------------------------------

SERIAL_COLUMN = "__serial_no__"
QUALIFIER = r"\(([A-Za-z0-9][A-Za-z0-9 &/\-]{0,24})\)"


def with_pack(pack: Iterable[Role], base: Iterable[Role] = BASE_ROLES) -> tuple[Role, ...]:
    """Base roles with the pack's rows added; a pack row of a known name replaces it in place."""
    merged = {r.role: r for r in base}
    merged.update({r.role: r for r in pack})
    return tuple(merged.values())


def role_table(spark: SparkSession, roles: Iterable[Role] = BASE_ROLES) -> DataFrame:
    rows = [(i, r.role, list(r.synonyms), r.format, r.is_collection, r.critical, list(r.item_fields)) for i, r in enumerate(roles)]
    return spark.createDataFrame(
        rows,
        "ord int, role string, synonyms array<string>, format string, is_collection boolean, critical boolean, "
        "item_fields array<string>",
    )


def register_roles(base: DataFrame, pack: DataFrame) -> DataFrame:
    """Role rows of both tables; the pack wins where both name a role, its synonyms in lower case."""
    lowered = pack.withColumn("synonyms", F.transform("synonyms", lambda s: F.lower(s)))
    both = base.withColumn("__late", F.lit(0)).unionByName(lowered.withColumn("__late", F.lit(1)))
    return best_per_group(both, ["role"], [F.col("__late"), F.col("ord")]).drop("__late")


def minted_role(label: Column) -> Column:
    """Stable role name of a label outside the vocabulary."""
    return F.concat(F.lit("x_"), K.slugify(label))


def _lookup(roles: Iterable[Role], value) -> Column:
    return F.create_map(*[F.lit(x) for r in roles for x in (r.role, value(r))])


def is_collection(role: Column, roles: Iterable[Role] = BASE_ROLES) -> Column:
    return F.coalesce(_lookup(roles, lambda r: r.is_collection)[role], F.lit(False))


def is_critical(role: Column, roles: Iterable[Role] = BASE_ROLES) -> Column:
    return F.coalesce(_lookup(roles, lambda r: r.critical)[role], F.lit(False))


def expected_format(role: Column, roles: Iterable[Role] = BASE_ROLES, unknown: str = "unknown") -> Column:
    return F.coalesce(_lookup(roles, lambda r: r.format)[role], F.lit(unknown))


def item_fields_of(role: Column, roles: Iterable[Role] = BASE_ROLES) -> Column:
    """Declared fields of a collection role, an empty array where there are none."""
    pairs = [x for r in roles if r.item_fields for x in (F.lit(r.role), F.array(*[F.lit(f) for f in r.item_fields]))]
    return F.coalesce(F.create_map(*pairs)[role], F.array().cast("array<string>"))
