"""Column functions over the passages of a knowledge base: useful lines, sections, notes, steps.

Each works on one passage; what a code's passages give together is put together by ``quire.plans.retrieve``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions import text as T

# --- fixed values: noise lines, headings, line shapes and limits ---------------------------------
NOISE_LINE = r"(?i)^(?:\d{2}|requirement definition|process|how it works\??|methods of acquisition)$"
SECTION_ENDS = ("Preconditions", "Target Business", "Overview", "Acceptance")
NOTE_LINE = r"(?i)\bnote\s*:|\bmust\b|\bshould\b"
STEP_LINE = r"(?i)^(create|process|check|setup|acquire|post|transfer|approve|record)\b"
REQUIREMENT_LINE = r"^\d+\s*\|"
MAP_STEP = r"^(\d{2}(?:\.\d{2,3})+)\s+(.+)$"
ROOT = r"^(\d{2})\b"
PARAGRAPH, SHORT_TEXT, REQUIREMENT, SHORT_STEP, LONG_STEP = 40, 400, 20, 12, 90
# --------------------------------------------------------------------------------------------------


def clean(value: Column) -> Column:
    """Without outer blanks and leading bars, inner blanks and tabs squeezed."""
    t = T.strip(F.translate(F.coalesce(value, F.lit("")), " ", " "))
    return F.regexp_replace(T.strip(F.regexp_replace(t, r"^[| ]+", "")), r"[ \t]+", " ")


def useful_lines(title: Column, content: Column) -> Column:
    """Lines of a passage without blanks, noise and its own title; `` | `` starts a new line."""
    head = clean(title)
    split = T.lines(F.replace(clean(content), F.lit(" | "), F.lit("\n")))
    return F.filter(F.transform(split, clean), lambda s: (s != "") & ~s.rlike(NOISE_LINE) & (s != head))


def useful_text(title: Column, content: Column) -> Column:
    return F.array_join(useful_lines(title, content), "\n")


def squeeze(text: Column) -> Column:
    return T.strip(T.squeeze(text))


def section_body(text: Column) -> Column:
    """A section's text on one line, without outer bars."""
    return T.strip(T.squeeze(text), " |")


def _stop() -> str:
    return "|".join(SECTION_ENDS)


def after_heading(text: Column, heading: str) -> Column:
    """What follows the first ``heading`` up to the next one of the fixed headings; null without the heading."""
    return F.when(text.rlike(rf"(?i){heading}"), F.regexp_extract(text, rf"(?is){heading}\s*(?:\||:|-)?\s*(.+?)(?:\n(?:{_stop()})|\z)", 1))


def ends_section(text: Column, heading: str) -> Column:
    """The section that starts in this text ends in it."""
    return text.rlike(rf"(?is){heading}\s*(?:\||:|-)?\s*.+?\n(?:{_stop()})")


def before_stop(text: Column, inside: bool = False) -> Column:
    """The text up to its first heading; ``inside``: a heading at its very start does not count."""
    lead = rf"(?is)\A(.+?)(?:\n(?:{_stop()})|\z)"
    after = F.regexp_extract(text, lead, 1)
    return after if inside else F.when(text.rlike(rf"(?is)\A(?:{_stop()})"), "").otherwise(after)


def has_stop(text: Column, inside: bool = False) -> Column:
    return text.rlike(rf"(?is)\n(?:{_stop()})") if inside else text.rlike(rf"(?is)(?:\A|\n)(?:{_stop()})")


def longest(lines: Column) -> Column:
    """The longest line, the first of equals."""
    ranked = F.transform(lines, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(ranked)["s"]


def note_lines(lines: Column) -> Column:
    return F.filter(lines, lambda s: s.rlike(NOTE_LINE))


def step_lines(lines: Column) -> Column:
    """Lines that read as a step: a verb of work first, of a step's length."""
    return F.filter(
        lines, lambda s: F.length(s).between(SHORT_STEP, LONG_STEP) & ~F.lower(s).startswith("overview") & s.rlike(STEP_LINE)
    )


def requirements(content: Column) -> Column:
    """Numbered rows ``n | requirement | mapping`` as texts of more than twenty characters."""
    rows = F.filter(F.transform(T.lines(F.coalesce(content, F.lit(""))), clean), lambda s: s.rlike(REQUIREMENT_LINE))

    def text(row: Column) -> Column:
        part = lambda n: T.strip(F.coalesce(F.get(F.split(row, r"\|"), F.lit(n)), F.lit("")))
        return F.when(part(2) == "", part(1)).otherwise(F.concat(part(1), F.lit(" Mapping: "), part(2)))

    return F.filter(F.transform(rows, text), lambda s: F.length(s) > REQUIREMENT)


def map_steps(process_map: Column) -> Column:
    """Steps (pos, code, name) of the lines ``code name`` of a process map."""
    rows = F.filter(F.transform(T.lines(F.coalesce(process_map, F.lit(""))), clean), lambda s: s.rlike(MAP_STEP))
    return F.transform(
        rows, lambda s, i: F.struct(i.alias("pos"), F.regexp_extract(s, MAP_STEP, 1).alias("code"), clean(F.regexp_extract(s, MAP_STEP, 2)).alias("name"))
    )


def domain_root(business_process: Column, steps: Column) -> Column:
    """Two digits at the start of the process name, else the first part of the first step, else empty."""
    own = F.regexp_extract(clean(business_process), ROOT, 1)
    first = F.element_at(T.code_parts(F.get(steps, F.lit(0))["code"]), 1)
    return F.when(own != "", own).otherwise(F.coalesce(first, F.lit("")))
