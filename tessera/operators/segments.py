"""Segments of texts: lines, windows, sentences, quotes, context, forward fill, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text

QUOTED_MOST = 210
SENTENCE_LEAST = 9


def explode_segments(rows: DataFrame, keys: list[str], segments, idx: str = "seg_idx", column: str = "text") -> DataFrame:
    """keys, idx (from 0), text."""
    return rows.select(*keys, F.posexplode(segments).alias(idx, column))


def context_windows(recall: DataFrame, keys: list[str], idx: str, size: int, start: str = "<target>", end: str = "</target>", column: str = "text") -> DataFrame:
    """keys, idx, window: the segment between its markers, and `size` segments on both sides, a line each.

    A window of its segment alone leaves it as it is; else all are stripped.
    """
    if size == 0:
        return recall.select(*keys, idx, F.concat(F.lit(start), F.col(column), F.lit(end)).alias("window"))
    near = W.partitionBy(*keys).orderBy(idx).rowsBetween(-size, size)
    around = F.collect_list(F.struct(F.col(idx).alias("i"), F.col(column).alias("t"))).over(near)
    mark = lambda s: F.when(s["i"] == F.col("_at"), F.concat(F.lit(start), text.strip(s["t"]), F.lit(end))).otherwise(text.strip(s["t"]))
    return recall.select(*keys, idx, F.col(idx).alias("_at"), around.alias("_near")).select(*keys, idx, F.array_join(F.transform("_near", mark), "\n").alias("window"))


def ordered_list(rows: DataFrame, keys: list[str], idx: str, column: str = "text") -> DataFrame:
    """keys, segments: an array in the order of idx."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, column))), lambda s: s[column]).alias("segments"))


def forward_fill(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def count_within(rows: DataFrame, keys: list[str], order: str, name: str = "n") -> DataFrame:
    """1, 2, .. in each group."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order)))


def continue_run(rows: DataFrame, run: str, number: str, first=1, second=2) -> DataFrame:
    """Numbers of the second run go on after the last of the first."""
    last = rows.where(F.col(run) == first).agg(F.coalesce(F.max(number), F.lit(0)).alias("_last"))
    joined = rows.crossJoin(F.broadcast(last))  # one row
    return joined.withColumn(number, F.when(F.col(run) == second, F.col(number) + F.col("_last")).otherwise(F.col(number))).drop("_last")


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def by_subject(rows: DataFrame, keys: list[str], subject: str, idx: str, column: str = "text") -> DataFrame:
    """keys, subject, segments: each subject's segments in order, a row a subject. (A document of all of them is written by sources.documents.)"""
    return ordered_list(rows, [*keys, subject], idx, column)


def _sums(values, start: int = 0):
    """0 and the running sums of an array of ints."""
    return F.aggregate(values, F.array(F.lit(start)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def quoted_spans(sentences, most: int = QUOTED_MOST):
    """Arrays (first, last) of the sentences that become one segment each.

    Where a quotation is open after a sentence, the span goes on to the first sentence after
    which as many marks were opened as closed, or to the last one. A span of `most` characters or
    more is given up: its first sentence stands alone, and what follows is read as inside a
    quotation. Spans come from running sums of marks and lengths; one fold walks over them.
    """
    marks = F.transform(sentences, lambda x: (F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))).cast("int"))
    # a span's text has a space between sentences
    upto, length = _sums(marks), _sums(F.transform(sentences, lambda x: F.char_length(x) + 1))
    state = F.struct(F.lit(0).alias("next"), F.lit(0).alias("inside"), F.array().cast("array<array<int>>").alias("spans"), upto.alias("marks"), length.alias("length"))
    n = F.size(sentences)

    def step(s, k):
        size = lambda last: F.get(s["length"], last + 1) - F.get(s["length"], k) - 1
        even = lambda last: (F.get(s["marks"], last + 1) - F.get(s["marks"], k)) % 2 == 0
        ahead = F.sequence(k, F.least(n - 1, k + most))
        last = F.coalesce(F.get(F.filter(ahead, lambda j: even(j) | (size(j) >= most)), F.lit(0)), F.element_at(ahead, -1))
        opens = (F.get(s["marks"], k + 1) - F.get(s["marks"], k) + s["inside"]) % 2 == 1
        too_long = opens & (size(last) >= most)
        stop = F.when(opens & ~too_long, last).otherwise(k)
        skip = k < s["next"]
        return F.struct(
            F.when(skip, s["next"]).otherwise(stop + 1).alias("next"),
            F.when(skip, s["inside"]).otherwise(too_long.cast("int")).alias("inside"),
            F.when(skip, s["spans"]).otherwise(F.concat(s["spans"], F.array(F.array(k, stop)))).alias("spans"),
            s["marks"].alias("marks"),
            s["length"].alias("length"),
        )

    walked = F.aggregate(F.sequence(F.lit(0), n - 1), state, step)["spans"]
    return F.when(n > 0, walked).otherwise(F.array().cast("array<array<int>>"))


def quotes_kept_whole(sentences, most: int = QUOTED_MOST):
    """The sentences, quotations of fewer than `most` characters merged."""
    return F.transform(quoted_spans(sentences, most), lambda x: F.array_join(F.slice(sentences, x[0] + 1, x[1] - x[0] + 1), " "))


def sentence_segments(rows: DataFrame, keys: list[str], column: str = "text", least: int = SENTENCE_LEAST) -> DataFrame:
    """keys, seg_idx, text: sentences, quotations kept whole, those of `least` characters or fewer dropped."""
    split = rows.select(*keys, text.sentences(column).alias("_s")).where(F.size("_s") > 0)
    return explode_segments(split, keys, F.filter(quotes_kept_whole(F.col("_s")), lambda x: F.char_length(x) > least))


def cover_failures(transcript, segments, slack: int = 2):
    """A map of the segments that do not follow verbatim to the reason: 'missing', 'skipped' or 'unreachable'."""
    return text.cover(transcript, segments, slack)["failures"]


def validated(rows: DataFrame, transcript: str = "text", segments: str = "segments") -> DataFrame:
    """rows with fail_idx (-1 if all segments follow), valid, and failures (segment to reason) after recovery; one pass."""
    checked = rows.withColumn("_cover", text.cover(transcript, F.col(segments)))
    return checked.withColumns({"fail_idx": F.col("_cover.fail_idx"), "valid": F.col("_cover.fail_idx") < 0, "failures": F.col("_cover.failures")}).drop("_cover")


def parse_segment_reply(reply):
    """The array of a model's JSON reply, with or without a code fence; NULL if it is none."""
    plain = text.strip(reply)
    fenced = F.regexp_extract(plain, r"(?s)^```(?:json)?(.*?)(?:```|$)", 1)
    body = text.strip(F.when(plain.startswith("```"), fenced).otherwise(plain))
    return F.when(body.startswith("["), F.from_json(body, "array<string>"))


def labelled(rows: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Rows whose label is one of a few names, white space and case aside."""
    return rows.where(F.lower(text.strip(F.col(label))).isin([x.strip().lower() for x in names]))


def text_cells(rows: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose cell holds text, stripped. Of a spreadsheet's cells (kind, text) numbers, dates and the like go by their kind; text stays, whatever it looks like."""
    kind = rows.schema[column].dataType.typeName()
    typed = F.when(F.col(column)["kind"] == "text", F.col(column)["text"]) if kind == "struct" else F.col(column).cast("string")
    return rows.withColumn(column, text.strip(typed)).where(F.col(column) != "")


def recalls_of_groups(recalls: DataFrame, files: DataFrame, label: str, subject: str) -> DataFrame:
    """Recalls with the group that their file's label names: one equi-join on (label, subject), whatever the number of groups and subjects."""
    return recalls.join(files.select(label, subject, *(c for c in files.columns if c not in recalls.columns)).dropDuplicates([label, subject]), [label, subject])
