"""Large recall documents read in parallel: one JSON document in as many tasks as its bytes have splits.

Spark's text reader cuts a file at quotation marks, at any split of it, so that a record is either what
stands between two strings or (a piece of) a string. What a record is depends on all before it. So
three scans read it: the first finds, for each split and for both things its first record can be, how the
split leaves things (inside a string or not, how deep). Strung together on the driver, a few numbers
a split, these give each split's state at its start. The second finds, from these, the last subject and the
number of its segments in each split, and strings cut by its end. The third then yields the segments with
their subjects and numbers, whichever split they are in: a subject may be as large as the document.

Results are those of the reader of small documents: strings that are not blank, in order; duplicate or empty subjects,
subjects without a list, recalls that are no object and documents that do not close raise ValueError.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash

OUT, FRESH, WITHIN = 0, 1, 2  # between strings, at the start of a string, further inside one
_TOKEN = re.compile(r"[{}\[\],:]|[^\s{}\[\],:]+")
_ROWS = pa.schema([("path", pa.string()), ("sub_id", pa.string()), ("idx", pa.int32()), ("text", pa.string())])
NAMED, METHOD = -1, -2


def _goes_on(piece: str) -> bool:
    """Whether the mark after a piece of a string is escaped."""
    return (len(piece) - len(piece.rstrip("\\"))) % 2 == 1


def _decoded(raw: str) -> str:
    if "\\" not in raw:
        return raw
    return json.loads(f'"{raw}"', strict=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@dataclass
class Place:
    """Where reading is: what a record is, depth, the token before, and (None: as before this split) the kinds of the three outer containers, key and subject, and segments counted."""

    state: int = OUT
    depth: int = 0
    before: str = ""
    kinds: list = field(default_factory=lambda: [None] * 3)
    top: str | None = None
    sub: str | None = None
    kept: int = 0
    fresh: bool = False
    pieces: list = field(default_factory=list)

    def between(self, record: str) -> None:
        """A record outside strings."""
        for m in _TOKEN.finditer(record):
            token = self.before = m.group()
            if token in "{[":
                self.depth += 1
                if self.depth <= 3:
                    self.kinds[self.depth - 1] = token
                if self.depth == 3:
                    self.kept, self.fresh = 0, True
            elif token in "}]":
                self.depth -= 1
        self.state = FRESH

    def string(self, raw: str, out=None, known: bool = False) -> None:
        """A whole string. With known, nothing is left open by the splits before."""
        may = lambda have, want: have == want or (have is None and not known)
        is_key = self.before in ("{", ",")
        if self.depth == 1 and may(self.kinds[0], "{"):
            if is_key:
                self.top, self.sub = _decoded(raw), None
            elif self.top == "segmentation_method" and out is not None:
                out(None, METHOD, _decoded(raw))
        elif self.depth == 2 and is_key and may(self.kinds[1], "{") and may(self.top, "recalls"):
            self.sub = _decoded(raw)
            if out is not None:
                out(self.sub, NAMED, None)
        elif self.depth == 3 and may(self.kinds[2], "[") and may(self.kinds[1], "{") and may(self.top, "recalls"):
            text = _decoded(raw)
            if text.strip():
                if out is not None:
                    out(self.sub, self.kept, text)
                self.kept += 1

    def read(self, record: str, out=None, known: bool = False) -> None:
        if self.state == OUT:
            self.between(record)
        elif _goes_on(record):
            self.pieces.append(f'{record}"')
            self.state = WITHIN
        else:
            raw = "".join([*self.pieces, record])
            self.pieces, self.state = [], OUT
            self.string(raw, out, known)


def _splits(batches):
    """(path, start of the split, its records) as they come."""
    now, held = None, []
    for b in batches:
        for path, start, record in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (path, start) != now:
                if now is not None:
                    yield *now, held
                now, held = (path, start), []
            held.append(record)
    if now is not None:
        yield *now, held


def _shape(batches):
    """For each split and each state it can begin in: state, depth and token it ends with."""
    for path, start, records in _splits(batches):
        rows = []
        for state in (OUT, FRESH):
            depth, before = 0, ""
            for r in records:
                if state == OUT:
                    for m in _TOKEN.finditer(r):
                        before = m.group()
                        depth += (before in "{[") - (before in "}]")
                    state = FRESH
                else:
                    state = WITHIN if _goes_on(r) else OUT
            rows.append({"state": state, "depth": depth, "before": before[:1]})
        yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "ways": rows}], pa.schema([("path", pa.string()), ("start", pa.int64()), ("ways", pa.list_(pa.struct([("state", pa.int32()), ("depth", pa.int32()), ("before", pa.string())])))]))


def _summary(begins):
    def run(batches):
        for path, start, records in _splits(batches):
            state, depth, before = begins.value[path, start]
            place, k, head = Place(state, depth, before), 0, []
            if state == WITHIN:  # the rest of a string of a split before
                while k < len(records) and _goes_on(records[k]):
                    head.append(f'{records[k]}"')
                    k += 1
                closed = k < len(records)
                if closed:
                    head.append(records[k])
                    k, place.state = k + 1, OUT
            else:
                closed = True
            for r in records[k:]:
                place.read(r)
            row = {"path": path, "start": start, "head": "".join(head), "closed": closed, "open": "".join(place.pieces), "before": place.before[:1], "depth": place.depth, "kinds": place.kinds, "top": place.top, "sub": place.sub, "kept": place.kept, "fresh": place.fresh}
            yield pa.RecordBatch.from_pylist([row], _SUMMARY)

    return run


_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("head", pa.string()), ("closed", pa.bool_()), ("open", pa.string()), ("before", pa.string()), ("depth", pa.int32()), ("kinds", pa.list_(pa.string())), ("top", pa.string()), ("sub", pa.string()), ("kept", pa.int32()), ("fresh", pa.bool_())])


def _segments(begins):
    def run(batches):
        for path, start, records in _splits(batches):
            place, tail = begins.value[path, start]
            k, rows = 0, []
            out = lambda sub, idx, text: rows.append((path, sub, idx, text))  # noqa: B023, E731
            if place.state == WITHIN:
                while k < len(records) and _goes_on(records[k]):
                    k += 1
                if k < len(records):
                    k, place.state = k + 1, OUT
            for r in records[k:]:
                place.read(r, out, known=True)
            if place.pieces:
                place.string("".join(place.pieces) + tail, out, known=True)
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _ROWS, strict=True)], schema=_ROWS)

    return run


def _strung(found: list, path: str) -> dict:
    """Each split's start: state, depth and token before, from what the first scan found, in order."""
    state, depth, before, out = OUT, 0, "", {}
    for r in found:
        out[path, r["start"]] = (state, depth, before)
        way = r["ways"][state != OUT]
        state, depth, before = way["state"], depth + way["depth"], way["before"] or before
    if state != FRESH or depth:
        raise ValueError(f"not a JSON document: {path}")
    return out


def _resumed(found: list, begins: dict, path: str) -> dict:
    """Each split's whole state at its start, and the end of a string that its end cuts, from what the second scan found, in order."""
    tails, rest = {}, ""
    for r in reversed(found):
        tails[r["start"]] = rest
        rest = r["head"] if r["closed"] else r["head"] + rest
    out, now = {}, Place()
    for r in found:
        state, depth, before = begins[path, r["start"]]
        out[path, r["start"]] = (Place(state, depth, before, list(now.kinds), now.top, now.sub, now.kept), tails[r["start"]])
        now.kinds = [k or old for k, old in zip(r["kinds"], now.kinds, strict=True)]
        if r["top"] is not None:
            now.top, now.sub = (r["top"] if now.kinds[0] == "{" else None), None
        now.sub = now.sub if r["sub"] is None else r["sub"]
        now.kept = r["kept"] + (0 if r["fresh"] else now.kept)
        if r["open"]:
            now.depth, now.before = r["depth"], r["before"] or before
            now.string(r["open"] + tails[r["start"]], known=True)
    return out


def _split_rows(spark: SparkSession, paths: list[str] | str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """path, sub_id, idx, text of recall documents, each read in parallel, written once to the shared folder; and path, method of those that name one. Subjects are told apart by the keys."""
    records = spark.read.option("lineSep", '"').text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    share = spark.sparkContext.broadcast

    def in_order(df: DataFrame) -> dict[str, list]:
        by_path: dict[str, list] = {}
        for r in df.orderBy("path", "start").collect():  # a row a split
            by_path.setdefault(r["path"], []).append(r)
        return by_path

    shapes = in_order(records.mapInArrow(_shape, "path string, start long, ways array<struct<state:int,depth:int,before:string>>"))
    begins = {k: v for path, found in shapes.items() for k, v in _strung(found, path).items()}
    parts = in_order(records.mapInArrow(_summary(share(begins)), "path string, start long, head string, closed boolean, open string, before string, depth int, kinds array<string>, top string, sub string, kept int, fresh boolean"))
    resumed = {k: v for path, found in parts.items() for k, v in _resumed(found, begins, path).items()}
    rows = stash(records.mapInArrow(_segments(share(resumed)), "path string, sub_id string, idx int, text string"))
    named = rows.where(F.col("idx") == NAMED).groupBy(*keys).agg(F.count("*").alias("n"))
    twice = named.where("n > 1").first()
    if twice is not None:
        raise ValueError(f"Duplicate subject {twice['sub_id']}")
    if {r["path"] for r in rows.where(F.col("idx") == NAMED).select("path").distinct().collect()} != set(shapes):
        raise ValueError("recalls must be an object of subjects")
    kept = rows.where("idx >= 0")
    empty = named.join(kept.select(*keys).distinct(), keys, "left_anti").first()
    if empty is not None:
        raise ValueError(f"no segments for {empty['sub_id']}")
    return kept, rows.where((F.col("idx") == METHOD) & (F.col("text") != "")).groupBy("path").agg(F.max("text").alias("method"))


def read_split_recalls(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """sub_id, recall_seg_method, recall_idx, text of recall documents, each read in parallel; a subject is in one of them."""
    kept, methods = _split_rows(spark, paths, ["sub_id"])
    first = kept.agg(F.min("path").alias("path")).join(methods, "path", "left").first()
    return kept.select("sub_id", F.lit(first["method"] or "json").alias("recall_seg_method"), F.col("idx").alias("recall_idx"), "text")


def read_split_documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, method, sub_id, recall_idx, text of recall documents that may have the same subjects."""
    kept, methods = _split_rows(spark, paths, ["path", "sub_id"])
    plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))).alias("path")  # a URI's escapes, where a plus is itself
    return kept.join(methods, "path", "left").select(plain, F.coalesce("method", F.lit("json")).alias("method"), "sub_id", F.col("idx").alias("recall_idx"), "text")
