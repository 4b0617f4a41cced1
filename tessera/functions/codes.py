"""Response and rating codes: parsing to arrays of segment numbers, bounds, repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# What a response holds.
NO_MATCH = "<NONE>"
MATCHES = r"(?U)<([0-9,\s\x1c-\x1f]+)>"
#: Wider numbers than a long holds are as invalid as any other out of bounds.
TOO_LARGE = (1 << 63) - 1


def parse_response(raw: Column | str) -> Column:
    """The segment numbers of a response, distinct, in order: NULL if it cannot be parsed, empty if it says there are none."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    inner = F.regexp_extract(raw, MATCHES, 1)
    digits = F.filter(F.transform(F.split(inner, ",", -1), strip), lambda x: x.rlike("^[0-9]+$"))
    numbers = F.transform(digits, lambda x: F.coalesce(x.try_cast("bigint"), F.lit(TOO_LARGE)))
    return F.when(F.contains(raw, F.lit(NO_MATCH)), F.array().cast("array<bigint>")).when(inner != "", F.array_sort(F.array_distinct(numbers)))


def in_bounds(parsed: Column | str, n: Column | int) -> Column:
    """Parsed, and all numbers from 1 to n."""
    parsed = F.col(parsed) if isinstance(parsed, str) else parsed
    return F.coalesce(F.forall(parsed, lambda x: x.between(1, n)), F.lit(False))


def zero_based(parsed: Column | str) -> Column:
    return F.array_sort(F.transform(parsed, lambda x: x - 1))


def parse_events(raw: Column | str, n: Column | int) -> Column:
    """0-based events of a code like '3', '1.2,3' or '003004005' (three digits each), in order, distinct, those from 1 to n."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    codes = F.filter(F.transform(F.split(F.regexp_replace(raw, r"\.", ","), ",", -1), strip), lambda x: x.rlike("^-?[0-9]+$"))

    def split(x):
        merged = F.regexp_extract_all(x, F.lit(r"(\d{3})"), F.lit(1))
        return F.when(x.try_cast("bigint") <= 100_000, F.array(x)).when(F.length(x) % 3 == 0, merged).otherwise(F.array().cast("array<string>"))

    numbers = F.transform(F.flatten(F.transform(codes, split)), lambda x: x.try_cast("bigint") - 1)
    kept = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x >= 0) & (x < n))))
    return F.coalesce(kept, F.array().cast("array<bigint>"))


def event_text(value: Column | str, numeric: Column | str | None = None) -> Column:
    """The code of a cell: a number loses its fraction, NaN and NULL have none."""
    if numeric is None:
        return F.col(value) if isinstance(value, str) else value
    numeric = F.col(numeric) if isinstance(numeric, str) else numeric
    return F.when(numeric.isNotNull() & ~F.isnan(numeric), numeric.cast("bigint").cast("string")).otherwise(F.lit(None))


def parse_sentinel_codes(raw: Column | str, n: Column | int, sentinels: tuple[int, ...]) -> Column:
    """0-based codes in the order given, repeats kept; blanks, other text, sentinels and those out of 1 to n are skipped."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    numbers = F.transform(F.split(raw, ",", -1), lambda x: strip(x).try_cast("bigint"))
    kept = F.filter(numbers, lambda x: x.isNotNull() & ~x.isin(*sentinels) & x.between(1, n))
    return F.coalesce(F.transform(kept, lambda x: x - 1), F.array().cast("array<bigint>"))


def repair_date(cell: Column | str) -> Column:
    """'month,day' of a cell that a spreadsheet took for a date; other text as it is, NULL is empty."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    day = F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(cell))
    return F.coalesce(F.when(day.isNotNull(), F.concat(F.month(day).cast("string"), F.lit(","), F.dayofmonth(day).cast("string"))), cell, F.lit(""))


def repair_cell(cell: Column) -> Column:
    """As repair_date, of a spreadsheet's cell (kind, text): only what the sheet holds as a date is one."""
    return F.when(cell["kind"] == "date", repair_date(cell["text"])).otherwise(F.coalesce(cell["text"], F.lit("")))


def param_string(matcher: Column | str, recall_seg: Column | str, story_seg: Column | str) -> Column:
    return F.concat_ws("-", matcher, recall_seg, story_seg)


def run_name(at: Column, testset: Column, matcher: Column, model: Column | None = None, repeated: bool = False) -> Column:
    """YYYYmmdd_HHMMSS[-rr]-testset-matcher[-m_model], slashes of the model replaced."""
    parts = [F.date_format(at, "yyyyMMdd_HHmmss"), *([F.lit("rr")] if repeated else []), testset, matcher]
    if model is not None:
        parts.append(F.concat(F.lit("m_"), F.replace(model, F.lit("/"), F.lit("_"))))
    return F.concat_ws("-", *parts)


def file_fields(name: Column | str) -> Column:
    """('sub-007', rest) of a name like 'x_7_rest'."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_", -1)
    return F.struct(F.format_string("sub-%03d", F.try_element_at(parts, F.lit(2)).try_cast("int")).alias("sub_id"), F.array_join(F.slice(parts, 3, 1000), "_").alias("rest"))


__all__ = ["event_text", "file_fields", "in_bounds", "param_string", "parse_events", "parse_response", "parse_sentinel_codes", "repair_date", "run_name", "zero_based"]


def display_rank(column, order: list[str]):
    """1, 2, .. in a fixed order; 0 for what it does not name."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(column) if isinstance(column, str) else column).cast("int")
