"""Text columns: white space, lines, tokens, windows of words, numbered lists, verbatim cover."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's notions of white space and of line ends, as Java regexes.
SPACE = r"[\s\x1c-\x1f]"
_NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\u0085\\u2028\\u2029]"


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column | str) -> Column:
    """No character that is not white space."""
    return ~F.col(text).rlike(_NOT_SPACE) if isinstance(text, str) else ~text.rlike(_NOT_SPACE)


def collapse_space(text: Column | str) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, f"(?U){SPACE}+", " ")


def lines(text: Column | str) -> Column:
    """The lines that are not blank, as they are."""
    return F.filter(F.split(text, LINE_END, -1), lambda x: ~is_blank(x))


def newline_segments(text: Column | str) -> Column:
    """As lines(), but only newlines divide."""
    return F.filter(F.split(text, "\n", -1), lambda x: ~is_blank(x))


def tokens(text: Column | str) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), f"(?U){SPACE}+", -1), lambda x: x != ""))


def words(text: Column | str) -> Column:
    return F.filter(F.split(text, f"(?U){SPACE}+", -1), lambda x: x != "")


def gaps(text: Column | str) -> Column:
    """The runs of white space."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?U){SPACE}+"), F.lit(0)), F.array().cast("array<string>"))


def word_windows(words: Column, width: int = 55, step: int = 21) -> Column:
    """Windows of words, the last ones shorter; none without words."""
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))
    made = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(width)), " "))
    return F.when(F.size(words) > 0, made).otherwise(F.array().cast("array<string>"))


def normalise(text: Column | str) -> Column:
    """Lower case, without possessives and without marks other than full stops."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("'s"), F.lit("")), r"(?U)[^.\w\s\x1c-\x1f]+", "")


def window_words(text: Column | str) -> Column:
    """The words that word windows of a normalised story hold: without newlines and full stops."""
    return words(F.regexp_replace(F.regexp_replace(normalise(text), "\n", " "), r"\.", ""))


def straight_quotes(text: Column | str) -> Column:
    return strip(F.translate(text, "“”‘’\n", "\"\"'' "))


def sentences(text: Column | str) -> Column:
    """A plain splitter: after . ! or ? and white space."""
    return F.filter(F.split(strip(text), rf"(?U)(?<=[.!?]){SPACE}+", -1), lambda x: x != "")


def numbered(segments: Column) -> Column:
    """1. first, a line each."""
    return F.array_join(F.transform(segments, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), strip(x))), "\n")


def full_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, strip), " ")


def _collapsed(text: str) -> str:
    """As collapse_space(), of one Python string."""
    words = text.split()
    if not words:
        return " " if text else ""
    return (" " if text[0].isspace() else "") + " ".join(words) + (" " if text[-1].isspace() else "")


def _walk(whole: str, segments: list[str | None], slack: int) -> list[tuple[int, str]]:
    """(segment, reason) of those that do not follow, with the search resumed at the first later segment that stands anywhere ahead."""
    place, gap, out, absent = 0, None, [], set()
    for i, s in enumerate(segments):
        if s is None or s in absent:
            at = -1
        elif gap is None:
            at = whole.find(s, place, place + len(s) + slack)
        else:
            at = whole.find(s, place)
            if at < 0:
                absent.add(s)  # nor is it anywhere further ahead
        if at >= 0:
            place, gap = at + len(s), None
        elif gap is None:
            gap = i
            out.append((i, "missing"))
        else:
            out.append((i, "skipped"))
    return [(i, "unreachable" if gap is not None and i > gap else why) for i, why in out]


def cover(text: Column | str, segments: Column | str, slack: int = 2) -> Column:
    """fail_idx and failures of segments that should follow a text verbatim, white space collapsed.

    A segment that is not within `slack` characters after the one before is 'missing'; fail_idx is the first such, -1 if there is
    none. From there on, the first later segment that stands anywhere ahead is where reading goes on; those passed over
    are 'skipped', or 'unreachable' if no such segment comes. What is left of the text after the last one is accepted. One pass
    over text and segments in Arrow batches: the place is a number, so a step costs the length of its segment; only the search
    for where to go on reads further.
    """
    kind = pa.struct([("fail_idx", pa.int32()), ("failures", pa.map_(pa.int32(), pa.string()))])

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for whole, parts in zip(texts, lists, strict=True):
            if whole.is_valid and parts.is_valid:
                failures = _walk(_collapsed(whole.as_py()), [x if x is None else _collapsed(x) for x in parts.as_py()], slack)
                out.append({"fail_idx": failures[0][0] if failures else -1, "failures": failures})
            else:
                out.append(None)
        return pa.array(out, kind)

    check = F.arrow_udf(run, "struct<fail_idx:int,failures:map<int,string>>")
    return check(text, segments)


def verbatim_cover(text: Column | str, segments: Column | str, slack: int = 2) -> Column:
    """The index of the first segment that does not follow the one before; -1 if all do."""
    return cover(text, segments, slack)["fail_idx"]
