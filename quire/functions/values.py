"""Typed values from text: dates, times, numbers, display forms.

Nothing here raises: what cannot be read becomes null, and ``coerce`` keeps the text.
Money is a double, as the rest of the value model is.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -------------------------------------------------------------------------------
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
    "November", "December",
)
CURRENCY_SIGNS = "₹$€£¥"
TRUE_WORDS = ("yes", "y", "true", "1", "present", "attended")
FALSE_WORDS = ("no", "n", "false", "0", "absent")
# ------------------------------------------------------------------------------------------------

_LONG = "|".join(MONTHS)
_SHORT = "|".join(m[:3] for m in MONTHS)
MONTH_NAMES = f"{_LONG}|{_SHORT}"


def month_number(name: Column) -> Column:
    """1 to 12 from the first three letters, null for anything else."""
    pairs = [F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m[:3].lower(), i)]
    return F.create_map(*pairs)[F.lower(F.substring(name, 1, 3))]


def make_date(year: Column, month: Column, day: Column) -> Column:
    """Date of number columns, null when there is no such day."""
    text = F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    known = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(known & month.between(1, 12) & day.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _int(text: Column) -> Column:
    return text.try_cast("int")


_ISO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
_DMY = r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b"
_DAY_NAME = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3})[A-Za-z]{0,6}\.?,?\s+(\d{4})\b"
_NAME_DAY = r"\b([A-Za-z]{3})[A-Za-z]{0,6}\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
_DAY_MONTH = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3})[A-Za-z]{0,6}\b"


def parse_date(text: Column, dayfirst: bool = True, default_year: Column | None = None) -> Column:
    """First readable date anywhere in the text; forms are tried in order, each at its first match."""

    def named(pattern: str, order: str, tail: Column | None = None) -> Column:
        spelled = F.initcap(F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, order))
        return F.try_to_date(spelled if tail is None else F.concat_ws(" ", spelled, tail), "d MMM yyyy")

    iso = F.regexp_extract(text, _ISO, 0)
    dmy = F.translate(F.regexp_extract(text, _DMY, 0), ".", "/")
    forms = [F.try_to_date(iso, "yyyy-M-d"), F.try_to_date(dmy, "d/M/yyyy")]
    if not dayfirst:
        # month and day change places only where the first reading has no such month
        forms = [forms[0], F.try_to_date(iso, "yyyy-d-M"), forms[1], F.try_to_date(dmy, "M/d/yyyy")]
    forms += [named(_DAY_NAME, "$1 $2 $3"), named(_NAME_DAY, "$2 $1 $3")]
    if default_year is not None:
        forms.append(named(_DAY_MONTH, "$1 $2", default_year.cast("string")))
    return F.coalesce(*forms)


def to_iso_date(text: Column) -> Column:
    """The whole text as one of nine fixed date forms, as yyyy-MM-dd text."""
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    dmy = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$"
    day_name = rf"(?i)^(\d{{1,2}})\s+({MONTH_NAMES}),?\s+(\d{{4}})$"
    name_day = rf"(?i)^({MONTH_NAMES})\s+(\d{{1,2}}),\s+(\d{{4}})$"

    def read(t: Column) -> Column:
        # a text has one of the forms at most, so only that one is taken apart
        return (
            F.when(t.rlike(iso), make_date(_int(_part(t, iso, 1)), _int(_part(t, iso, 2)), _int(_part(t, iso, 3))))
            .when(t.rlike(dmy), make_date(_int(_part(t, dmy, 4)), _int(_part(t, dmy, 3)), _int(_part(t, dmy, 1))))
            .when(t.rlike(day_name), make_date(_int(_part(t, day_name, 3)), month_number(_part(t, day_name, 2)), _int(_part(t, day_name, 1))))
            .when(t.rlike(name_day), make_date(_int(_part(t, name_day, 3)), month_number(_part(t, name_day, 1)), _int(_part(t, name_day, 2))))
        ).cast("string")

    return F.get(F.transform(F.array(F.regexp_replace(F.trim(text), r"[.,;]+$", "")), read), F.lit(0))


def parse_time(text: Column) -> Column:
    """Minutes after midnight of the first ``h:mm``, null when out of range."""
    pattern = r"\b(\d{1,2})[:.](\d{2})\s*(am|pm|AM|PM)?\b"
    hour, minute = _int(_part(text, pattern, 1)), _int(_part(text, pattern, 2))
    half = F.lower(_part(text, pattern, 3))
    h = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    return F.when(h.between(0, 23) & minute.between(0, 59), h * 60 + minute)


def parse_number(text: Column) -> Column:
    """First number; currency signs, percent signs and thousands commas are dropped, (x) is negative."""
    t = F.trim(text)
    negative = t.startswith("(") & t.endswith(")")
    bare = F.regexp_replace(t, r"^[()]+|[()]+$", "")
    found = F.regexp_extract(F.regexp_replace(bare, f"[{CURRENCY_SIGNS}%]", ""), r"-?[\d,]*\.?\d+", 0)
    number = F.replace(found, F.lit(","), F.lit("")).try_cast("double")
    return F.when(negative, -number).otherwise(number)


def coerce(value: Column, fmt: Column) -> Column:
    """Struct of the typed value and ``ok``; a value that does not fit keeps its text."""
    day, minutes, number = parse_date(value), parse_time(value), parse_number(value)
    scaled = F.when((fmt == "percent") & value.contains("%"), number / 100).otherwise(number)
    word = F.lower(F.trim(value))
    truth = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    numeric = fmt.isin("number", "currency", "percent")
    ok = (
        F.when(value.isNull(), False)
        .when(fmt == "date", day.isNotNull())
        .when(fmt == "time", minutes.isNotNull())
        .when(numeric, number.isNotNull())
        .when(fmt == "bool", truth.isNotNull())
        .otherwise(True)
    )
    return F.struct(
        F.when(fmt == "date", day).alias("v_date"),
        F.when(fmt == "time", minutes).alias("v_minutes"),
        F.when(numeric, scaled).alias("v_double"),
        F.when(fmt == "bool", truth).alias("v_bool"),
        F.when(~ok | ~(fmt.isin("date", "time", "bool") | numeric), value).alias("v_string"),
        ok.alias("ok"),
    )


def display_double(value: Column) -> Column:
    """Whole numbers without decimals."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def display_date(value: Column) -> Column:
    return F.date_format(value, "dd-MMM-yyyy")


def display_minutes(value: Column) -> Column:
    hours = F.floor(value / 60).cast("string")
    return F.concat_ws(":", F.lpad(hours, 2, "0"), F.lpad((value % 60).cast("string"), 2, "0"))


def to_display(typed: Column) -> Column:
    """Text of a ``coerce`` struct."""
    return F.coalesce(
        display_date(typed["v_date"]),
        F.when(typed["v_minutes"].isNotNull(), display_minutes(typed["v_minutes"])),
        display_double(typed["v_double"]),
        F.when(typed["v_bool"], "Yes").when(~typed["v_bool"], "No"),
        typed["v_string"],
        F.lit(""),
    )


def detect_value_format(number_format: Column, sample: Column) -> Column:
    """Value type from a cell's number format, else from its text."""
    nf = F.lower(F.coalesce(number_format, F.lit("")))
    given = (nf != "") & (nf != "general")
    hours = F.replace(nf, F.lit("mmm"), F.lit("")).contains("h")
    money = F.lit(False)
    for sign in ("$", "€", "£", "₹", "usd", "eur", "inr", "\\r"):
        money = money | nf.contains(sign)
    s = F.trim(F.coalesce(sample, F.lit("")))
    return (
        F.when(given & nf.rlike("yy|dd|mmm") & ~hours, "date")
        .when(given & nf.rlike("h:mm|am/pm|ss"), "time")
        .when(given & nf.contains("%"), "percent")
        .when(given & (money | (nf.contains("#,##") & nf.contains("."))), "currency")
        .when(given & nf.rlike("[0#]"), "number")
        .when(s.rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"), "date")
        .when(s.rlike(r"(?i)^\d{1,2}:\d{2}\s*(am|pm)?$"), "time")
        .otherwise("unknown")
    )


def format_bytes(n: Column) -> Column:
    kb, mb, gb = 1024, 1024**2, 1024**3

    def scaled(unit: int, places: int, name: str) -> Column:
        # integer arithmetic: half a last place rounds up
        shift = 10**places
        units = F.floor((n.cast("bigint") * shift * 2 + unit) / F.lit(2 * unit)).cast("bigint")
        whole = F.floor(units / F.lit(shift)).cast("bigint").cast("string")
        return F.concat(whole, F.lit("."), F.lpad((units % shift).cast("string"), places, "0"), F.lit(f" {name}"))

    return (
        F.when(F.coalesce(n, F.lit(0)) < kb, F.concat(F.coalesce(n, F.lit(0)).cast("string"), F.lit(" B")))
        .when(n < mb, scaled(kb, 1, "KB"))
        .when(n < gb, scaled(mb, 1, "MB"))
        .otherwise(scaled(gb, 2, "GB"))
    )


def parse_ts(text: Column) -> Column:
    """ISO text with ``Z`` or an offset; null when empty or bad."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))
