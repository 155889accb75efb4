"""Column functions over free text: normal forms, tokens, placeholders, key-value lines, sections.

Everything is a built-in expression on one row, so notes stay whole and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import keys as K

# --- fixed values -------------------------------------------------------------------------------
STOP_WORDS = ("the", "of", "a", "an", "for", "to", "in", "on", "by", "and", "is", "no", "s")
KB_STOP_WORDS = ("with", "from", "that", "this", "process")
SKIP_FIELDS = (
    "if", "else", "each", "with", "unless", "this", "for", "endif", "endfor", "none", "n_a", "sheet1", "sheet2",
    "total", "sum", "s_no", "sr_no", "sno",
)
SERIAL_HEADERS = ("sl no", "sr no", "s no", "serial no", "serial number", "", "no")
PIPE_HEADS = ("id", "process", "type", "task", "action", "item")
CODE = r"\b(\d{2}(?:\.\d{2,3}){0,3})\b"
MUSTACHE = r"\{\{\s*([#^/]?)([^}]+?)\s*\}\}"
PLACEHOLDERS = (
    r"\{\{\s*([A-Za-z_][\w.\- ]{0,80})\s*\}\}",
    r"\{%\s*([A-Za-z][A-Za-z0-9_ ]{0,60})\s*%\}",
    r"«\s*([A-Za-z][A-Za-z0-9_ ]{0,60})\s*»",
    r"<<\s*([A-Za-z][A-Za-z0-9_ ]{0,60})\s*>>",
    r"\[([A-Za-z][A-Za-z0-9_ /-]{1,60})\]",
)
VALUE_TOKENS = (r"\{\{\s*([\w.\-]+)\s*\}\}", r"\$\{\s*([\w.\-]+)\s*\}", r"<<\s*([\w.\- ]+)\s*>>")
BLOCK_TOKEN = r"\{\{\s*[#/]\s*[\w.\-]+\s*\}\}"
BLANK_LABEL_LINE = r"^(.{2,48}?)\s*[:：]\s*(\{\{[^}]+\}\}|_+|\[.*\]|\s*)$"
# ------------------------------------------------------------------------------------------------

LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
_WHITE = " \t\n\x0b\f\r"
_RARE_BREAK = "[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
_ODD_RUN = r"(?U)[^a-z0-9\w%/&. -][^a-z0-9\w%/&.-]*+| [^a-z0-9\w%/&.-]++"
BULLET_MARKS = "-•* "


def strip(text: Column, chars: str | None = None) -> Column:
    """White space, or the given characters, off both ends."""
    one = r"\s" if chars is None else "[" + "".join("\\" + c if c in r"-]^\[" else c for c in chars) + "]"
    return F.regexp_replace(text, f"^{one}+|{one}+$", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text; where line feeds are its only breaks, they are looked for as plain characters."""
    return F.when(text.rlike(_RARE_BREAK), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))


def trim_line(line: Column) -> Column:
    """``strip`` of a piece of ``lines``: without a line break in it, plain trimming comes to the same and reads only the ends."""
    return F.btrim(line, F.lit(_WHITE))


def bare_line(line: Column) -> Column:
    """A line without surrounding blanks and leading bullet marks."""
    return trim_line(F.ltrim(trim_line(line), F.lit(BULLET_MARKS)))


def word_count_over(text: Column, n: int) -> Column:
    """Whether the text has more than ``n`` words; it is read from its front, up to the word that decides."""
    return text.rlike(r"\A\s*+(?:\S++\s++){%d}\S" % n)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def normalize_text(text: Column) -> Column:
    """Lower case, odd punctuation to blanks, blanks squeezed; letters of any language stay."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for blank in ("_", "\u00a0"):
        t = F.replace(t, F.lit(blank), F.lit(" "))
    # a run of punctuation and blanks is one blank; a blank that stands alone is left, so most of a text is only read
    return F.btrim(F.regexp_replace(t, _ODD_RUN, " "), F.lit(" :*-."))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_text(text), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two token arrays; equal sets give 1."""
    ta, tb = F.array_distinct(a), F.array_distinct(b)
    small = F.least(F.size(ta), F.size(tb))
    shared = F.size(F.array_intersect(ta, tb))
    return F.when(small > 0, shared.cast("double") / small).otherwise(0.0)


def word_tokens(text: Column, shortest: int = 4) -> Column:
    """Distinct lower-case runs of letters and digits."""
    runs = all_found(F.lower(F.coalesce(text, F.lit(""))), "([a-z0-9]{%d,})" % shortest)
    return F.array_except(runs, F.array(*[F.lit(w) for w in KB_STOP_WORDS]))


def ordered_distinct(items: Column, ignore_case: bool = False) -> Column:
    """Duplicates dropped, first occurrence kept."""
    if not ignore_case:
        return F.array_distinct(items)

    def first(xs: Column) -> Column:
        return let(F.transform(xs, lambda x: F.lower(x)), lambda low: F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))

    return let(items, first)


def is_blank_slot(value: Column) -> Column:
    """Nothing, a dash, a placeholder or a drawn line: a place meant to be written on."""
    t = strip(F.coalesce(value, F.lit("")))
    return (
        t.isin("", "-", "—", "...", "n/a", "N/A") | t.startswith("[") | t.contains("{{") | t.rlike(r"^_+$")
    )


def is_preview(value: Column) -> Column:
    t = strip(value)
    return t.startswith("[") & t.endswith("]")


def is_usable(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).__ne__("") & ~is_preview(F.coalesce(value, F.lit("")))


def is_preview_row(answers: Column) -> Column:
    """No answer but ``[label]`` stand-ins; empty answers do not count."""
    values = F.filter(F.map_values(answers), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.forall(values, lambda v: is_preview(v))


def looks_like_label(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    # words are counted from the front only: tried from every sign, a line would be read as often as it has signs
    more_words = lambda n: t.rlike(r"\A[\s/]*+(?:[^\s/]++[\s/]++){%d}[^\s/]" % n)
    return (
        F.when((t == "") | (F.length(t) > 80), False)
        .when(t.endswith(":"), True)
        .when(more_words(8), False)
        .when(t.rlike(r"[.!?]$") & more_words(4), False)
        .otherwise(True)
    )


def is_serial_header(header: Column) -> Column:
    """Row-number columns; a header of signs only, or none at all, also counts."""
    slug = F.trim(F.regexp_replace(F.lower(strip(F.coalesce(header, F.lit("")))), r"[^a-z0-9]+", " "))
    return slug.isin(*SERIAL_HEADERS)


def turn_kind(text: Column) -> Column:
    """greeting, notes or answer."""
    t = strip(F.coalesce(text, F.lit("")))
    greeting = t.rlike(
        r"(?i)^(hi|hello|hey|yo|thanks|thank you|good (morning|afternoon|evening)|how are you)[\s!.?]*$"
    )

    def times(sign: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))

    notes = (
        (F.length(t) > 40) | t.contains("\n") | (times(".") >= 2) | (times(":") >= 2) | (times("-") >= 3)
    )
    return F.when(greeting, "greeting").when(notes, "notes").otherwise("answer")


# --- placeholders -------------------------------------------------------------------------------
def _either(patterns: Sequence[str]) -> str:
    return "(?U)(?:" + "|".join(patterns) + ")"


VALUE_TOKEN = _either(VALUE_TOKENS)


def _ident_of(match: Column, patterns: Sequence[str]) -> Column:
    return strip(F.coalesce(*[found(match, "(?U)^" + p + "$") for p in patterns]))


def extract_placeholders(text: Column) -> Column:
    """Names of ``{{x}}``, ``{% x %}``, ``«x»``, ``<<x>>`` and ``[x]`` in order of appearance."""
    whole = all_found(F.coalesce(text, F.lit("")), _either(PLACEHOLDERS), 0)
    return F.transform(whole, lambda m: _ident_of(m, PLACEHOLDERS))


def value_tokens(text: Column) -> Column:
    """Names of ``{{x}}``, ``${x}`` and ``<<x>>``, the forms a fill plan addresses."""
    whole = all_found(F.coalesce(text, F.lit("")), VALUE_TOKEN, 0)
    return F.transform(whole, lambda m: _ident_of(m, VALUE_TOKENS))


def mustache_tokens(text: Column) -> Column:
    """Array of (prefix, ident): prefix ``#``, ``/`` or ``^`` marks a block, empty a value."""
    whole = all_found(F.coalesce(text, F.lit("")), MUSTACHE, 0)

    def parsed(m: Column) -> Column:
        raw = F.regexp_extract(m, MUSTACHE, 2)
        first = F.element_at(F.split(strip(F.element_at(F.split(strip(raw), r"\|"), 1)), r"\s+"), 1)
        ident = strip(F.regexp_replace(first, r"(?U)[^\w.\- ]+", ""), "._-")
        return F.struct(F.regexp_extract(m, MUSTACHE, 1).alias("prefix"), ident.alias("ident"))

    return F.filter(F.transform(whole, parsed), lambda t: t["ident"] != "")


def mustache_sections(text: Column) -> Column:
    blocks = F.filter(mustache_tokens(text), lambda t: t["prefix"] != "")
    names = F.array_distinct(F.transform(blocks, lambda t: t["ident"]))
    return F.filter(names, lambda n: ~K.snake(n).isin(*SKIP_FIELDS))


def _field(ident: Column, label: Column, source: str) -> Column:
    return F.struct(K.snake(ident).alias("id"), label.alias("label"), F.lit(source).alias("source"))


def field_candidates(text: Column) -> Column:
    """Value tokens, placeholders, then ``Label: ____`` lines, each as (id, label, source)."""
    values = F.filter(mustache_tokens(text), lambda t: t["prefix"] == "")
    first = F.transform(values, lambda t: _field(t["ident"], K.title_from_ident(t["ident"]), "placeholder"))
    second = F.transform(extract_placeholders(text), lambda p: _field(p, K.title_from_ident(p), "detected"))
    drawn = F.filter(F.transform(lines(text), lambda s: strip(s)), lambda s: s.rlike(BLANK_LABEL_LINE))
    label = lambda s: F.regexp_extract(s, BLANK_LABEL_LINE, 1)
    third = F.transform(drawn, lambda s: _field(label(s), strip(label(s)), "detected"))
    return F.filter(F.concat(first, second, third), lambda f: (f["id"] != "") & ~f["id"].isin(*SKIP_FIELDS))


def harvest_fields(text: Column) -> Column:
    """Distinct field records of one text; the first source of an id wins."""
    def first(every: Column) -> Column:
        return let(F.transform(every, lambda f: f["id"]), lambda ids: F.filter(every, lambda f, i: F.array_position(ids, f["id"]) == i + 1))

    kept = let(field_candidates(text), first)
    return F.transform(
        kept,
        lambda f: F.struct(
            f["id"].alias("id"), f["label"].alias("label"),
            F.concat(F.lit("What is the "), f["label"], F.lit("?")).alias("question"),
            F.lit(True).alias("required"), F.lit("string").alias("field_type"), f["source"].alias("source"),
        ),
    )


def spellings(answers: Column) -> Column:
    """Array of (k, v): every non-empty answer under its key, and that in snake, underscore and lower form; the last of a name wins."""
    entries = F.filter(F.map_entries(answers), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    spelled = F.flatten(
        F.transform(
            entries,
            lambda e: F.array(
                pair(e["key"], e["value"]), pair(K.snake(e["key"]), e["value"]),
                pair(F.replace(e["key"], F.lit(" "), F.lit("_")), e["value"]), pair(F.lower(e["key"]), e["value"]),
            ),
        )
    )

    def last_of_each(every: Column) -> Column:
        names = F.array_distinct(F.transform(every, lambda s: s["k"]))
        return F.transform(names, lambda name: F.element_at(F.filter(every, lambda s: s["k"] == name), -1))

    return let(spelled, last_of_each)


def fill_text(template: Column, answers: Column) -> Column:
    """Replaces six placeholder forms by the answers; keys also match in snake, underscore and lower form."""
    return fill_spelled(template, spellings(answers))


def fill_spelled(template: Column, spelled: Column) -> Column:
    """``fill_text`` with the ``spellings`` of the answers, for many texts filled with the same answers."""

    def put(text: Column, s: Column) -> Column:
        for left, right in (("{{", "}}"), ("{{ ", " }}"), ("[", "]"), ("«", "»"), ("<<", ">>"), ("${", "}")):
            text = F.replace(text, F.concat(F.lit(left), s["k"], F.lit(right)), s["v"])
        return text

    return F.aggregate(spelled, template, put)


def clear_unresolved(text: Column) -> Column:
    """Value and block tokens nobody filled become nothing; text without tokens is unchanged."""
    token = VALUE_TOKEN
    block = "(?U)" + BLOCK_TOKEN
    cleared = strip(F.regexp_replace(F.regexp_replace(text, token, ""), block, ""))
    return F.when(text.rlike(token) | text.rlike(block), cleared).otherwise(text)


# --- key-value lines, pipe rows, sections -------------------------------------------------------
_KV = r"^(.{1,48}?)\s*[:\-=]\s+(.+)$"


def kv_lines(text: Column) -> Column:
    """Array of (key, value) of the ``key: value`` lines, keys in snake case, in line order."""
    usable = F.filter(
        F.transform(lines(text), bare_line),
        lambda s: (s != "") & ~s.startswith("#") & s.rlike(_KV)
        & ~F.regexp_extract(s, _KV, 1).rlike(r"(?i)https?://"),
    )
    pairs = F.transform(
        usable,
        lambda s: F.struct(
            K.snake(F.regexp_extract(s, _KV, 1)).alias("key"), trim_line(F.regexp_extract(s, _KV, 2)).alias("value")
        ),
    )
    return F.filter(pairs, lambda p: p["key"] != "")


def kv_map(text: Column) -> Column:
    """The lines as a map; a later line of the same key wins and stands where it is."""

    def last_of_each(pairs: Column) -> Column:
        back = F.reverse(F.transform(pairs, lambda p: p["key"]))
        return let(back, lambda names: F.filter(pairs, lambda p, i: F.array_position(names, p["key"]) == F.size(names) - i))

    return F.map_from_entries(let(kv_lines(text), last_of_each))


def first_key(kv: Column, *names: str) -> Column:
    """Value of the first of the names that the map holds."""
    return F.coalesce(*[kv[n] for n in names])


def pipe_cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), lambda c: strip(c))


def pipe_rows(text: Column, columns: Sequence[str], min_parts: int = 2) -> Column:
    """Rows of ``a | b | c`` lines as structs; missing cells are empty, heading lines are skipped."""
    cells = F.transform(
        F.filter(F.transform(lines(text), bare_line), lambda s: s.contains("|")),
        lambda s: F.transform(F.split(s, r"\|"), trim_line),
    )

    def data(parts: Column) -> Column:
        head = F.lower(F.array_join(parts, " "))
        marked = head.contains("owner") | head.contains("description") | head.contains("cycle") | head.contains("name")
        return (F.size(parts) >= min_parts) & ~(F.lower(parts[0]).isin(*PIPE_HEADS) & marked)

    return F.transform(
        F.filter(cells, data),
        lambda parts: F.struct(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)]),
    )


def _any_of(names: Sequence[str]) -> str:
    return "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", n) for n in names)


def section_blob(text: Column, headings: Sequence[str], stops: Sequence[str] = ()) -> Column:
    """Text under the first heading line up to the next heading, else its inline form; empty if absent.

    With ``stops`` only those end the section, without them any whole ``Label:`` line does.
    """
    names = _any_of(headings)
    head = rf"(?:#+\s*)?(?:{names})\s*:?\s*$"
    rest = F.regexp_extract(text, rf"(?s)\A.*?(?im-s:^{head})(.*)\z", 1)
    own = {h.lower() for h in headings}
    ends = [s for s in stops if s.lower() not in own]
    if ends:
        stop = rf"^(?:#+\s*)?(?:{_any_of(ends)})\s*:?(?:\s+\S.*)?$"
    else:
        stop = r"^(?:#+\s*)?[A-Z][A-Za-z0-9 /_,.&-]{1,60}:\s*$"
    body = F.regexp_extract(rest, rf"(?s)\A(.*?)(?:(?im-s:{stop})|\z)", 1)
    inline = F.regexp_extract(text, rf"(?is)(?:{names})\s*[:\-]\s*(.+?)(?:\n\s*\n|\z)", 1)
    return strip(F.when(text.rlike(rf"(?im)^{head}"), body).otherwise(inline))


# --- codes --------------------------------------------------------------------------------------
def codes_in(text: Column) -> Column:
    """Distinct dotted codes in order of appearance."""
    return F.array_distinct(all_found(F.coalesce(text, F.lit("")), CODE))


def code_parts(code: Column) -> Column:
    return F.split(code, r"\.")


def code_depth(code: Column) -> Column:
    return F.size(code_parts(code))


def code_parent(code: Column) -> Column:
    """Code without its last part; a root is its own parent."""
    return F.when(code.contains("."), F.regexp_replace(code, r"\.[^.]*$", "")).otherwise(code)


def code_ancestors(code: Column) -> Column:
    """The code and every prefix of it, which turns ``under`` into an equi join."""
    parts = code_parts(code)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


# --- files and cells ----------------------------------------------------------------------------
def content_digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def formula_shape(formula: Column) -> Column:
    return F.regexp_replace(F.upper(formula), r"[0-9]", "")


def clean_text(value: Column) -> Column:
    """Control characters that a cell cannot hold are dropped."""
    return F.regexp_replace(value, "[\u0001-\u0008\u000b\u000c\u000e-\u001f]", "")


def as_date_cell(value: Column) -> Column:
    """ISO text of a leading date, the unchanged text otherwise."""
    t = strip(value)
    day = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-M-d"))
    return F.coalesce(day.cast("string"), value)


def parse_json_loose(text: Column) -> Column:
    """Object text out of fenced or wrapped JSON; ``{}`` when there is none."""
    raw = strip(F.coalesce(text, F.lit("")))
    bare = strip(F.regexp_replace(F.regexp_replace(raw, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)

    def usable(t: Column) -> Column:
        return F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t)

    return F.coalesce(usable(bare), usable(braces), F.lit("{}"))


def unfolded(df: DataFrame, keys: Sequence[str | Column], items: Column, item: str = "x", pos: str = "pos") -> DataFrame:
    """One row per item with its place from 0.

    The plain form of this would first filter by the array's size, ahead of any exchange before it: the array is then computed
    twice, the first time in the few tasks that read the table.
    """
    return df.select(*keys, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row, whatever asks for it.

    A filter by a plain column, or one that an explode of it brings along, is moved below it and computes it again.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def line_table(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per line with its number from 0; the texts stay whole and spread over tasks."""
    return unfolded(df, keys, lines(F.col(text)), "line", "line_no")


def transcript_clean(text: Column) -> Column:
    """Caption text without file marks, cue numbers and time lines."""
    kept = F.filter(
        F.transform(lines(text), lambda s: strip(s)),
        lambda s: (s != "") & (s != "WEBVTT") & ~s.rlike(r"^\d+$") & ~s.rlike(r"^\d{2}:\d{2}:\d{2}[.,]\d{3}\s*-->"),
    )
    return F.array_join(kept, "\n")


def delimited_line(cells: Sequence[Column]) -> Column:
    return F.concat_ws(" | ", *[strip(F.coalesce(c, F.lit(""))) for c in cells])
