"""Text to typed value and back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing", the date patterns in order of preference, the
# pattern dates are shown in, the enum limits and the delimiter of array texts.
NULL_ALIASES = ("", "na", "n/a", "null")
DATE_PATTERNS = (
    "yyyy-MM-dd HH:mm:ss.SS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH",
    "yyyy-MM-dd",
    "dd-MMM-yyyy HH:mm:ss",
    "dd-MMM-yyyy HH:mm",
    "dd-MMM-yyyy HH",
    "dd-MMM-yyyy",
    "dd.MMM.yyyy HH:mm:ss",
    "dd.MMM.yyyy HH:mm",
    "dd.MMM.yyyy HH",
    "dd.MMM.yyyy",
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm",
    "dd.MM.yyyy HH",
    "dd.MM.yyyy",
    "MM.yyyy",
    "MM/dd/yyyy",
)
DISPLAY_DATE_PATTERN = "yyyy-MM-dd HH:mm:ss"
MAX_ENUM_VALUES = 20
MIN_AVG_VALUES_PER_ENUM = 1.5
ARRAY_DELIMITER = ","
MIN_YEAR = 1000

SCALAR_TYPES = ("null", "boolean", "integer", "double", "date", "json", "enum", "string")
SPARK_TYPES = {
    "null": "string",
    "boolean": "boolean",
    "integer": "bigint",
    "double": "double",
    "date": "timestamp",
    "json": "variant",
    "enum": "int",
    "string": "string",
}


@dataclass(frozen=True)
class FieldType:
    """Type of a dictionary field with its display settings."""

    kind: str
    is_array: bool = False
    enum_values: tuple[str, ...] = ()
    decimals: int | None = None
    true_label: str = "true"
    false_label: str = "false"
    delimiter: str = ARRAY_DELIMITER
    null_aliases: tuple[str, ...] = NULL_ALIASES
    date_patterns: tuple[str, ...] = field(default=DATE_PATTERNS)
    boolean_numbers: bool = True

    def __post_init__(self):
        if self.kind not in SCALAR_TYPES:
            raise ValueError(f"unknown field type {self.kind}")

    @property
    def spark_type(self) -> str:
        base = SPARK_TYPES[self.kind]
        return f"array<{base}>" if self.is_array else base


def clean_text(c: Column, aliases: tuple[str, ...] = NULL_ALIASES) -> Column:
    """Trimmed text, null for a missing-value alias."""
    text = F.trim(c)
    return F.when(F.lower(text).isin(*aliases), None).otherwise(text)


def _lenient(pattern: str) -> str:
    """One- and two-digit days, months, hours and any number of fraction digits are accepted."""
    out = pattern.replace("SS", "[SSSSSS][SSSSS][SSSS][SSS][SS][S]")
    out = out.replace("dd", "d").replace("HH", "H").replace("mm", "m").replace(":ss", ":s")
    return out if "MMM" in out else out.replace("MM", "M")


def _shape(pattern: str) -> str:
    """Regular expression of the texts a pattern can match; spares the parser all others."""
    out = pattern.replace(".", r"\.")
    for token, digits in (("yyyy", "Y"), ("SS", "F"), ("MMM", "W"), ("dd", "N"), ("HH", "N"), ("mm", "N"), ("ss", "N"), ("MM", "N")):
        out = out.replace(token, digits)
    parts = {"Y": r"\d{4}", "F": r"\d{1,6}", "W": r"[A-Za-z]{3}", "N": r"\d{1,2}"}
    return "^" + "".join(parts.get(ch, ch) for ch in out) + "$"


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _date_time(text: Column, patterns: tuple[str, ...]) -> Column:
    """Moment of a date text or of epoch milliseconds, null outside the years accepted.

    Plain conditions outside ``let`` keep the many other texts away from the pattern list.
    """
    top_year = F.year(F.current_date()) + 1000

    def moment(x: Column) -> Column:
        return F.coalesce(*[F.when(x.rlike(_shape(p)), F.try_to_timestamp(x, F.lit(_lenient(p)))) for p in patterns])

    def in_range(m: Column) -> Column:
        return F.when((F.year(m) > MIN_YEAR) & (F.year(m) < top_year), m)

    ms = text.try_cast("bigint")
    first, last = F.make_timestamp(F.lit(MIN_YEAR + 1), *[F.lit(1)] * 2, *[F.lit(0)] * 3), F.make_timestamp(top_year, *[F.lit(1)] * 2, *[F.lit(0)] * 3)
    ms_ok = (ms >= F.unix_millis(first)) & (ms < F.unix_millis(last))
    return F.when(text.rlike(r"^\d{1,4}[-./]"), let(let(text, moment), in_range)).when(
        text.rlike(r"^[+-]?\d{1,14}$") & ms_ok, F.timestamp_millis(ms)
    )


def try_parse(text: Column, t: FieldType) -> Column:
    """Typed scalar of an already cleaned text, null where it does not parse."""
    if t.kind == "null":
        return F.lit(None).cast("string")
    if t.kind == "boolean":
        low = F.lower(text)
        yes = (low == "true") | (text == t.true_label)
        no = (low == "false") | (text == t.false_label)
        if t.boolean_numbers:
            yes, no = yes | (text == "1"), no | (text == "0")
        return F.when(yes, True).when(no, False)
    if t.kind == "integer":
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    if t.kind == "double":
        return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?$|^[+-]?(NaN|Infinity)$"), text.try_cast("double"))
    if t.kind == "date":
        return _date_time(text, t.date_patterns)
    if t.kind == "json":
        return F.when(text.startswith("{"), F.try_parse_json(text))
    if t.kind == "enum":
        code = F.array_position(F.array(*[F.lit(v) for v in t.enum_values]), text).cast("int") - 1
        return F.when(code >= 0, code)
    return text


def split_items(text: Column, t: FieldType) -> Column:
    return F.split(text, "\\Q" + t.delimiter + "\\E")


def parse(c: Column, t: FieldType, strict: bool = True, name: str = "value") -> Column:
    """Typed value of display text. Text that does not parse raises, or is null if not strict."""
    text = clean_text(c, t.null_aliases)

    def one(cleaned):
        value = try_parse(cleaned, t)
        if not strict:
            return value
        problem = F.concat(F.lit(f"{name}: not of type {t.kind}: "), cleaned)
        error = F.raise_error(problem).cast(SPARK_TYPES[t.kind])
        return F.when(cleaned.isNotNull(), F.coalesce(value, error))

    if not t.is_array:
        return one(text)
    return F.transform(split_items(text, t), lambda item: one(clean_text(item, t.null_aliases)))


def display(c: Column, t: FieldType) -> Column:
    """Display text of a typed value."""

    def one(v):
        if t.kind == "boolean":
            return F.when(v, t.true_label).when(~v, t.false_label)
        if t.kind == "date":
            return F.date_format(v, DISPLAY_DATE_PATTERN)
        if t.kind == "enum":
            return F.try_element_at(F.array(*[F.lit(x) for x in t.enum_values]), v + 1)
        if t.kind == "double" and t.decimals is not None:
            return F.round(v, t.decimals).cast("string")
        if t.kind == "json":
            return F.to_json(v)
        return v.cast("string")

    if not t.is_array:
        return one(c)
    return F.array_join(F.transform(c, lambda v: F.coalesce(one(v), F.lit(""))), t.delimiter)


def item_name(c: Column) -> Column:
    """Every character other than letters, digits and underscore becomes an underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
