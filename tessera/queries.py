"""The library's queries over the driver's tables, each beside its DuckDB equivalent.

Stories are benchmark items or the lines of a benchmark item, recalls are conversations (a
subject is a conversation, a segment is a turn), ratings are labels, responses are made
from line items. All run on whole tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import codes, metrics, text
from tessera.operators import matching, scoring, segments
from tessera.plans import prompts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Parts of the DuckDB side: white space, strip, lines, metrics.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_STRIP = rf"^{_WS}+|{_WS}+$"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '{_STRIP}', '', 'g')"


def _sql_lines(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_LINES}'), lambda v: {_sql_strip('v')} <> '')"


def _sql_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '{_WS}+'), lambda v: v <> ''))"


def _sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_WS}+'), lambda v: v <> '')"


_P, _R = "coalesce(tp / nullif(tp + fp, 0), 0.0)", "coalesce(tp / nullif(tp + fn, 0), 0.0)"
_F1 = f"coalesce(2 * ({_P}) * ({_R}) / nullif(({_P}) + ({_R}), 0), 0.0)"
_PHI = "case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then greatest(-1.0, least(1.0, (tp * tn - fp * fn) / (sqrt((tp + fp)::double * (tp + fn)) * sqrt((tn + fp)::double * (tn + fn))))) end"
_ACC = "coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0)"
#: y and the model's say over n_chars, by source; the rated documents of a source are one recall's cells.
_RATED = "select d.source, d.lang, d.doc_id, d.n_chars, l.quality y from documents d join labels l using (doc_id)"
_REPEATS = "(values (0, 200), (1, 300), (2, 500), (3, 800), (4, 1000), (5, 1500)) r(repeat_idx, least)"
REPEATS = [(0, 200), (1, 300), (2, 500), (3, 800), (4, 1000), (5, 1500)]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that engines agree whatever their order of summation; NaN as NULL."""
    return df.select(*(F.nanvl(F.round(c, digits), F.lit(None).cast("double")).alias(c) if t == "double" else c for c, t in df.dtypes))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Matches and their scores


def _matches(spark, sf_dir, least):
    return matching.lexical_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", least)


_SQL_MATCHES = f"""
with b as (select item_id, {_sql_tokens("text")} w from benchmark), d as (select doc_id, {_sql_tokens("text")} w from documents),
x as (select doc_id, unnest(w) t from d), y as (select item_id, len(w) n, unnest(w) t from b),
m as (select doc_id, item_id, count(*) overlap, count(*) / any_value(n) score from x join y using (t) group by doc_id, item_id)
"""


@query(_SQL_MATCHES + "select doc_id, item_id, overlap, round(score, 9) score from m where score >= 0.8")
def lexical_match_cells(spark, sf_dir):
    return rounded(_matches(spark, sf_dir, 0.8))


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def containment_cells(spark, sf_dir):
    return matching.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def _lang_counts(spark, sf_dir, least):
    docs = table(spark, sf_dir, "documents")
    langs = docs.select("doc_id", "lang")
    items = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n_items"))
    dims = docs.groupBy("lang").agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(items)).select("lang", (F.col("n_docs") * F.col("n_items")).alias("n_cells"))
    model = _matches(spark, sf_dir, least).join(langs, "doc_id")
    human = matching.containment(docs, table(spark, sf_dir, "benchmark"), "doc_id", "item_id").join(langs, "doc_id")
    return scoring.confusion_counts(model, human, dims, ["lang"], ["doc_id", "item_id"])


def _sql_lang(least):
    return f"""{_SQL_MATCHES}, g as (select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)),
c as (select doc_id, m.doc_id is not null p, g.doc_id is not null h from (select * from m where score >= {least}) m full join g using (doc_id, item_id)),
k as (select lang, count_if(p and h) tp, count_if(p and not h) fp, count_if(h and not p) fn from c join documents using (doc_id) group by lang),
z as (select lang, coalesce(tp, 0) tp, coalesce(fp, 0) fp, coalesce(fn, 0) fn, n * (select count(*) from benchmark) - coalesce(tp, 0) - coalesce(fp, 0) - coalesce(fn, 0) tn
from (select lang, count(*) n from documents group by lang) left join k using (lang))
select lang, tp, fp, fn, tn, round(case when tp + fp = 0 then 0 else {_P} end, 9) "precision", round(case when tp + fp = 0 then 0 else {_R} end, 9) recall, round(case when tp + fp = 0 then 0 else {_F1} end, 9) f1,
round(case when tp + fp = 0 then 0 else {_PHI} end, 9) pearson, round(case when tp + fp = 0 then 0 else {_ACC} end, 9) accuracy from z"""


@query(_sql_lang(0.8))
def match_scores_by_lang(spark, sf_dir):
    return rounded(scoring.score(_lang_counts(spark, sf_dir, 0.8)))


@query(_sql_lang(0.5))
def match_scores_loose(spark, sf_dir):
    """The same with half the words: false positives show."""
    return rounded(scoring.score(_lang_counts(spark, sf_dir, 0.5)))


@query(_SQL_MATCHES + "select doc_id, list_sort(list(item_id)) story_idxs, count(*) n from m where score >= 0.5 group by doc_id")
def match_lists(spark, sf_dir):
    cells = _matches(spark, sf_dir, 0.5).select("doc_id", F.col("item_id").alias("story_idx"))
    return matching.to_matches(cells, ["doc_id"]).withColumn("n", F.size("story_idxs").cast("long"))


# Lines, windows, prompts


@query(f"select doc_id, (unnest(range(len(l))))::int seg_idx, unnest(l) text from (select doc_id, {_sql_lines('text')} l from documents)")
def doc_line_segments(spark, sf_dir):
    return segments.explode_segments(table(spark, sf_dir, "documents"), ["doc_id"], text.lines("text"))


@query(f"select doc_id, len(l) n_segments, coalesce(list_sum(list_transform(l, lambda v: len(v))), 0)::bigint n_chars from (select doc_id, {_sql_lines('text')} l from documents)")
def segment_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.lines("text").alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_segments"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("n_chars"))


@query(f"select doc_id, len(list_filter(string_split(text, chr(10)), lambda v: {_sql_strip('v')} <> '')) n_segments from documents")
def newline_segment_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.newline_segments("text")).cast("long").alias("n_segments"))


def _recall(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


@query(f"""select conv_id, turn, array_to_string(list_transform(w, lambda s: case when s.i = turn then '<target>' || {_sql_strip("s.t")} || '</target>' else {_sql_strip("s.t")} end), chr(10)) "window" from (
select conv_id, turn, list({{'i': turn, 't': text}}) over (partition by conv_id order by turn rows between 2 preceding and 2 following) w from conversations)""")
def recall_context_window(spark, sf_dir):
    return segments.context_windows(_recall(spark, sf_dir), ["conv_id"], "turn", 2)


@query("select conv_id, turn, '<target>' || text || '</target>' \"window\" from conversations")
def recall_window_zero(spark, sf_dir):
    return segments.context_windows(_recall(spark, sf_dir), ["conv_id"], "turn", 0)


_SQL_STORY = f"select item_id, {_sql_lines('text')} l from benchmark"


def _story(spark, sf_dir):
    return segments.explode_segments(table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"], text.lines("text"), "story_idx")


@query(
    f"select item_id, array_to_string(list_transform(l, lambda v, i: i::varchar || '. ' || {_sql_strip('v')}), chr(10)) numbered, array_to_string(list_transform(l, lambda v: {_sql_strip('v')}), ' ') full_text from ({_SQL_STORY}) where len(l) > 0"
)
def story_numbered_list(spark, sf_dir):
    lists = segments.ordered_list(_story(spark, sf_dir), ["item_id"], "story_idx")
    return lists.select("item_id", text.numbered(F.col("segments")).alias("numbered"), text.full_text(F.col("segments")).alias("full_text"))


def _sql_prompt(name: str) -> str:
    t = prompts.TEMPLATES[name]
    quote = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    part = lambda title, body: f"{quote('<' + title.lower().replace(' ', '_') + '>' + chr(10) if t.tagged else title + ':' + chr(10))} || {body} || {quote(chr(10) + '</' + title.lower().replace(' ', '_') + '>' + chr(10) * 2 if t.tagged else chr(10) * 2)}"
    full = part("Full text", f"array_to_string(list_transform(l, lambda v: {_sql_strip('v')}), ' ')") + " || " if t.story else ""
    numbered = part("Numbered segments", f"array_to_string(list_transform(l, lambda v, i: i::varchar || '. ' || {_sql_strip('v')}), chr(10))")
    marks = f"The marked part stands between {t.start.strip()} and {t.end.strip()}."
    ask = f"{prompts._REASONS} {prompts._ANSWER}" if t.reasons else prompts._ANSWER
    window = f"array_to_string(list_transform(w, lambda s: case when s.i = turn then {quote(t.start)} || {_sql_strip('s.t')} || {quote(t.end)} else {_sql_strip('s.t')} end), chr(10))"
    return f"""select conv_id, turn, n_story, md5(prompt) prompt_md5, len(prompt) n_chars, greatest(1, ceil(len(prompt) / 4))::bigint est_tokens from (
select conv_id, turn, len(l)::int n_story, {quote(prompts._TASK + " " + marks + chr(10) * 2)} || {full}{numbered} || {part("Recall", window)} || {quote(ask)} prompt from (
select conv_id, turn, conv_id % 40 item_id, list({{'i': turn, 't': text}}) over (partition by conv_id order by turn rows between 5 preceding and 5 following) w from conversations) join ({_SQL_STORY}) using (item_id) where len(l) > 0)"""


def _prompts(spark, sf_dir, name):
    recall = _recall(spark, sf_dir).withColumn("item_id", F.col("conv_id") % 40)
    made = prompts.match_prompts(_story(spark, sf_dir), recall, 5, name, "item_id", ("conv_id",), "turn")
    return made.select("conv_id", "turn", "n_story", F.md5("prompt").alias("prompt_md5"), F.char_length("prompt").cast("long").alias("n_chars"), prompts.estimated_tokens("prompt").alias("est_tokens"))


def _add_prompts():
    short = {"primary": "prompt_primary", "primary_no_story": "prompt_no_story", "primary_no_cot": "prompt_no_cot", "primary_no_story_no_cot": "prompt_no_story_no_cot", "secondary": "prompt_secondary"}
    for name, key in short.items():
        QUERIES[key] = lambda spark, sf_dir, name=name: _prompts(spark, sf_dir, name)
        SQL[key] = _sql_prompt(name)


_add_prompts()


# Responses and attempts

_SQL_RAW = """select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'I cannot say ' || l_linenumber::varchar when l_linestatus = 'O' and l_linenumber % 5 = 0 then 'none <NONE> <2>'
when l_linenumber % 7 = 3 then '<99999999999999999999999>' when l_linenumber % 4 = 1 then 'so < ' || l_suppkey::varchar || ',' || chr(9) || l_linenumber::varchar || ' , ' || l_suppkey::varchar || '> and <1>'
else '<' || l_linenumber::varchar || ', 0' || (l_quantity::int)::varchar || '>' end raw from lineitem"""


def _responses(spark, sf_dir):
    c, s = F.col, lambda x: F.col(x).cast("string")
    raw = (
        F.when(c("l_returnflag") == "R", F.concat(F.lit("I cannot say "), s("l_linenumber")))
        .when((c("l_linestatus") == "O") & (c("l_linenumber") % 5 == 0), F.lit("none <NONE> <2>"))
        .when(c("l_linenumber") % 7 == 3, F.lit("<99999999999999999999999>"))
        .when(c("l_linenumber") % 4 == 1, F.concat(F.lit("so < "), s("l_suppkey"), F.lit(",\t"), s("l_linenumber"), F.lit(" , "), s("l_suppkey"), F.lit("> and <1>")))
        .otherwise(F.concat(F.lit("<"), s("l_linenumber"), F.lit(", 0"), c("l_quantity").cast("int").cast("string"), F.lit(">")))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("response"))


_SQL_PARSED = f"""select *, case when contains(raw, '<NONE>') then []::bigint[] when inner_ <> '' then list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(inner_, ','),
lambda v: {_sql_strip("v")}), lambda v: regexp_full_match(v, '[0-9]+')), lambda v: coalesce(try_cast(v as bigint), 9223372036854775807)))) end parsed
from (select *, regexp_extract(raw, '<((?:[0-9,]|{_WS})+)>', 1) inner_ from ({_SQL_RAW}))"""
_SQL_VALID = f"select *, coalesce(len(list_filter(parsed, lambda v: v < 1 or v > 30)) = 0, false) valid from ({_SQL_PARSED})"
_LIST_TEXT = "'[' || array_to_string({}, ',') || ']'"


def _list_text(c):
    return F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ","), F.lit("]"))


@query(f"select l_orderkey, l_linenumber, {_LIST_TEXT.format('parsed')} parsed, count(*) n from ({_SQL_PARSED}) group by all")
def parse_response(spark, sf_dir):
    rows = _responses(spark, sf_dir).withColumn("parsed", codes.parse_response("response"))
    return rows.groupBy("l_orderkey", "l_linenumber", _list_text("parsed").alias("parsed")).agg(F.count("*").alias("n"))


@query(f"select l_linenumber, valid, count(*) n, count(parsed) n_parsed from ({_SQL_VALID}) group by all")
def response_bounds(spark, sf_dir):
    rows = matching.parse_attempts(_responses(spark, sf_dir), 30)
    return rows.groupBy("l_linenumber", "valid").agg(F.count("*").alias("n"), F.count("parsed").alias("n_parsed"))


_SQL_ATTEMPTS = f"select *, row_number() over (partition by l_orderkey order by l_linenumber, raw) - 1 attempt from ({_SQL_VALID})"
_SQL_FIRST = f"""select l_orderkey, coalesce(arg_min(list_sort(list_transform(parsed, lambda v: v - 1)), attempt) filter (valid), []::bigint[]) story_idxs, coalesce(min(attempt) filter (valid) + 1, count(*)) n_attempts, max(valid::int) any_valid
from ({_SQL_ATTEMPTS}) where attempt < 3 group by l_orderkey"""


def _first_valid(spark, sf_dir):
    numbered = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "response")) - 1
    return matching.first_valid(matching.parse_attempts(_responses(spark, sf_dir).withColumn("attempt", numbered), 30), ["l_orderkey"], 3)


@query(f"select l_orderkey, {_LIST_TEXT.format('story_idxs')} story_idxs, n_attempts from ({_SQL_FIRST})")
def first_valid_attempt(spark, sf_dir):
    return _first_valid(spark, sf_dir).select("l_orderkey", _list_text("story_idxs").alias("story_idxs"), "n_attempts")


@query(f"select l_orderkey, {_LIST_TEXT.format('story_idxs')} story_idxs, n_attempts, any_valid from ({_SQL_FIRST})")
def streamed_first_attempts(spark, sf_dir):
    """The same attempts as files arrive, in several batches of a stateful stream; each order's last verdict."""
    from tessera.sources.shared import shared_dir
    from tessera.streaming import retries

    top = shared_dir(spark)
    numbered = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "response")) - 1
    made = _responses(spark, sf_dir).select("l_orderkey", numbered.alias("attempt"), "response")
    # dealt by attempt and order: a later attempt may well arrive before an earlier one
    made.repartition(24, "attempt", "l_orderkey").write.parquet(f"{top}/in")
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 12).parquet(f"{top}/in")
    verdicts = retries.first_valid_stream(stream, ["l_orderkey"], F.lit(30), max_retries=3)
    retries.write_verdicts(verdicts, f"{top}/out", f"{top}/state").awaitTermination()
    last = retries.latest(spark.read.schema(verdicts.schema).parquet(f"{top}/out"), ["l_orderkey"])
    return last.select("l_orderkey", _list_text("story_idxs").alias("story_idxs"), "n_attempts", "any_valid")


@query(f"select n_attempts, any_valid, count(*) n from ({_SQL_FIRST}) group by all")
def retry_histogram(spark, sf_dir):
    return _first_valid(spark, sf_dir).groupBy("n_attempts", "any_valid").agg(F.count("*").alias("n"))


# Scores


def _rated(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id")


def _counts(spark, sf_dir, by):
    return _rated(spark, sf_dir).groupBy(by).agg(*metrics.confusion(F.col("y"), (F.col("n_chars") > 300).cast("int")))


def _sql_counts(by):
    return f"select {by}, count_if(y = 1 and n_chars > 300) tp, count_if(y = 0 and n_chars > 300) fp, count_if(y = 1 and n_chars <= 300) fn, count_if(y = 0 and n_chars <= 300) tn from ({_RATED}) group by {by}"


@query(f'select lang, tp, fp, fn, tn, round({_P}, 9) "precision", round({_R}, 9) recall, round({_F1}, 9) f1, round({_ACC}, 9) accuracy from ({_sql_counts("lang")})')
def binary_scores(spark, sf_dir):
    rows = _counts(spark, sf_dir, "lang")
    return rounded(rows.select("*", metrics.precision("tp", "fp").alias("precision"), metrics.recall("tp", "fn").alias("recall"), metrics.f1("tp", "fp", "fn").alias("f1"), metrics.accuracy("tp", "fp", "fn", "tn").alias("accuracy")))


@query(f"select source, round({_PHI}, 9) pearson from ({_sql_counts('source')})")
def pearson_phi(spark, sf_dir):
    return rounded(_counts(spark, sf_dir, "source").select("source", metrics.pearson("tp", "fp", "fn", "tn").alias("pearson")))


_SQL_SCORED = f"""select *, case when tp + fp = 0 then 0 else {_P} end p, case when tp + fp = 0 then 0 else {_R} end r, case when tp + fp = 0 then 0 else {_F1} end f1, case when tp + fp = 0 then 0 else coalesce({_PHI}, 'nan'::double) end phi,
case when tp + fp = 0 then 0 else {_ACC} end acc from {{}} where tp + fn > 0"""


@query(
    f"""select count(*) n_recalls, round(avg(p), 9) "precision", round(avg(r), 9) recall, round(2 * avg(p) * avg(r) / (avg(p) + avg(r)), 9) f1, case when count_if(isnan(phi)) > 0 then null else round(avg(case when not isnan(phi) then phi end), 9) end pearson, round(avg(acc), 9) accuracy
from ({_SQL_SCORED.format("(" + _sql_counts("source") + ")")})"""
)
def macro_full_eval(spark, sf_dir):
    return rounded(scoring.macro(scoring.score(scoring.rated_only(_counts(spark, sf_dir, "source")))))


_SQL_REPEAT_COUNTS = f"(select source, repeat_idx, count_if(y = 1 and n_chars > least) tp, count_if(y = 0 and n_chars > least) fp, count_if(y = 1 and n_chars <= least) fn, count_if(y = 0 and n_chars <= least) tn from ({_RATED}) cross join {_REPEATS} group by all)"


def _says(spark, sf_dir):
    """The documents each repeat marks."""
    rows = _rated(spark, sf_dir)
    repeats = F.array(*(F.struct(F.lit(i).alias("repeat_idx"), F.lit(n).alias("least")) for i, n in REPEATS))
    return rows.select("*", F.explode(repeats).alias("r")).select("source", "doc_id", "y", "n_chars", "r.*")


def _repeat_counts(spark, sf_dir):
    return _says(spark, sf_dir).groupBy("source", "repeat_idx").agg(*metrics.confusion(F.col("y"), (F.col("n_chars") > F.col("least")).cast("int")))


@query(
    f"""select source, count(*) n_repeats, round(avg(p), 9) precision_mean, round(stddev_pop(p), 9) precision_std, round(avg(r), 9) recall_mean, round(stddev_pop(r), 9) recall_std, round(avg(f1), 9) f1_mean, round(stddev_pop(f1), 9) f1_std
from ({_SQL_SCORED.format(_SQL_REPEAT_COUNTS)}) group by source"""
)
def repeat_summary(spark, sf_dir):
    return rounded(scoring.repeat_summary(scoring.score(scoring.rated_only(_repeat_counts(spark, sf_dir))), "source"))


@query(f'select round(avg(p), 9) "precision", round(avg(r), 9) recall, round(avg(f1), 9) f1 from (select source, avg(p) p, avg(r) r, avg(f1) f1 from ({_SQL_SCORED.format(_SQL_REPEAT_COUNTS)}) group by source)')
def repeat_overall(spark, sf_dir):
    return rounded(scoring.overall(scoring.repeat_summary(scoring.score(scoring.rated_only(_repeat_counts(spark, sf_dir))), "source")))


@query(f"select count(*) n_total, count_if(tp + fn > 0) n_evaluated, count_if(tp + fn = 0) n_skipped, count_if(tp + fn > 0 and tp + fp > 0) n_shown from {_SQL_REPEAT_COUNTS}")
def evaluation_counts(spark, sf_dir):
    counts = scoring.score(_repeat_counts(spark, sf_dir))
    return scoring.report_counts(counts)


_SQL_GRID = "(select distinct least(conv_id % 7, 5) g, turn recall_idx, length(text) % 4 story_idx from conversations)"


@query(
    f"""select d.g, s story_idx, r recall_idx, (exists (select 1 from {_SQL_GRID} h where h.g = d.g and h.story_idx = s and h.recall_idx = r))::int "value"
from (select g, max(recall_idx) n from {_SQL_GRID} group by g) d, range(4) a(s), range(100) b(r) where r <= n"""
)
def dense_matrix(spark, sf_dir):
    cells = table(spark, sf_dir, "conversations").select(F.least(F.col("conv_id") % 7, F.lit(5)).alias("g"), F.col("turn").alias("recall_idx"), (F.char_length("text") % 4).cast("long").alias("story_idx"))
    dims = cells.groupBy("g").agg(F.lit(4).cast("long").alias("n_story"), (F.max("recall_idx") + 1).alias("n_recall"))
    return matching.dense(cells, dims, ["g"])


# Reliability and figures


def _pairs(spark, sf_dir):
    says = _says(spark, sf_dir)
    cells = says.where("n_chars > least").select("source", "repeat_idx", "doc_id")
    return scoring.repeat_pairs(cells, "source", "repeat_idx", ["doc_id"], says.select("source", "repeat_idx").distinct()), says


_SQL_SAYS = f"select source, doc_id, repeat_idx, (n_chars > least)::int v from ({_RATED}) cross join {_REPEATS}"
_SQL_PAIRS = f"""select a.source, a.repeat_idx i, b.repeat_idx j, sum(a.v * b.v) tp, sum((1 - a.v) * b.v) fp, sum(a.v * (1 - b.v)) fn, sum((1 - a.v) * (1 - b.v)) tn
from ({_SQL_SAYS}) a join ({_SQL_SAYS}) b on a.source = b.source and a.doc_id = b.doc_id and a.repeat_idx < b.repeat_idx group by all"""


@query(f"select round(coalesce(avg(f), 0), 9) pairwise_f1 from (select source, avg({_F1}) f from ({_SQL_PAIRS}) group by source)")
def pairwise_f1(spark, sf_dir):
    return rounded(scoring.pairwise_f1(_pairs(spark, sf_dir)[0], "source"))


@query(f"select source, round(avg(coalesce({_PHI}, 0)), 9) pearson from ({_SQL_PAIRS}) where j < 5 group by source")
def pairwise_pearson(spark, sf_dir):
    pairs, says = _pairs(spark, sf_dir)
    dims = says.where("repeat_idx = 0").groupBy("source").agg(F.count("*").alias("n_cells"))
    return rounded(scoring.pairwise_pearson(pairs, dims, "source"))


@query(
    f"""with k as (select doc_id, sum(v) k, count(*) m from ({_SQL_SAYS}) group by doc_id), o as (select sum(k * (m - k) * 2.0 / (m - 1)) o_ab, sum(k)::double n1, sum(m - k)::double n0 from k)
select round(1 - (n1 + n0 - 1) * o_ab / (2 * n0 * n1), 9) alpha from o"""
)
def krippendorff_alpha(spark, sf_dir):
    cells = _says(spark, sf_dir).where("n_chars > least")
    n = _rated(spark, sf_dir).count()
    return rounded(scoring.krippendorff_alpha(cells, ["source", "doc_id"], len(REPEATS), n))


@query(f"select repeat_idx, count(f1) n, round(avg(f1), 9) mean, round(coalesce(stddev_samp(f1), 0) / sqrt(count(f1)), 9) sem from ({_SQL_SCORED.format(_SQL_REPEAT_COUNTS)}) group by repeat_idx")
def sem_by_group(spark, sf_dir):
    return rounded(scoring.mean_and_sem(scoring.score(scoring.rated_only(_repeat_counts(spark, sf_dir))), ["repeat_idx"], "f1"))


@query(
    f"""select repeat_idx, arg_min(source, (o, source)) source, round(arg_min(f1, (o, source)), 9) f1 from (select *, round(abs(f1 - avg(f1) over (partition by repeat_idx)), 9) o from ({_SQL_SCORED.format(_SQL_REPEAT_COUNTS)})) group by repeat_idx"""
)
def closest_to_mean(spark, sf_dir):
    return rounded(scoring.closest_to_mean(scoring.score(scoring.rated_only(_repeat_counts(spark, sf_dir))), ["repeat_idx"], "source", "f1"))


@query(f"select source, case when m = 1 and h = 1 then 3 when m = 1 then 2 when h = 1 then 1 else 0 end overlay, count(*) n from (select source, (n_chars > 300)::int m, y h from ({_RATED})) group by all having overlay > 0")
def overlay_classes(spark, sf_dir):
    rows = _rated(spark, sf_dir)
    marked = scoring.overlay(rows.where("n_chars > 300"), rows.where("y = 1"), ["source", "doc_id"])
    return marked.groupBy("source", "overlay").agg(F.count("*").alias("n"))


# Normalising and segmenting

_SQL_NORMAL = r"regexp_replace(replace(lower({}), '''s', ''), '[^.\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '', 'g')"


@query(f"select doc_id, md5({_SQL_NORMAL.format('text')}) normal_md5 from documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalise("text")).alias("normal_md5"))


@query(f"select doc_id, md5(regexp_replace(text, '{_WS}+', ' ', 'g')) flat_md5, len({_sql_strip('text')}) n_stripped from documents")
def collapse_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse_space("text")).alias("flat_md5"), F.char_length(text.strip("text")).cast("long").alias("n_stripped"))


@query(f"select conv_id, turn, {_sql_strip(chr(39).join(['translate(text || ', ' “a” ‘b’', ' || chr(10), ', '“”‘’', ' || chr(10), ', chr(34) * 2 + chr(39) * 4 + ' ', ')']))} plain from conversations")
def quote_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.lit(" “a” ‘b’\n")))
    return rows.select("conv_id", "turn", text.straight_quotes("text").alias("plain"))


@query(
    f"""select doc_id, i::int window_idx, md5(array_to_string(w[s + 1 : s + 55], ' ')) window_md5 from (select doc_id, w, unnest(range(0, len(w), 21)) s, unnest(range(len(range(0, len(w), 21)))) i
from (select doc_id, {_sql_words("replace(replace(" + _SQL_NORMAL.format("text") + ", chr(10), ' '), '.', '')")} w from documents))"""
)
def sliding_word_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.window_words("text").alias("w"))
    return rows.select("doc_id", F.posexplode(text.word_windows(F.col("w"))).alias("window_idx", "x")).select("doc_id", "window_idx", F.md5("x").alias("window_md5"))


@query(f"select doc_id, len(list_filter(string_split_regex(regexp_replace({_sql_strip('text')}, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda v: v <> '')) n_sentences from documents")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences("text")).cast("long").alias("n_sentences"))


#: Documents' lines: as they are, one changed, one left out, all stripped, two changed in a row, all from the third on changed.
_SPOILED = f"""select doc_id, coalesce(text, '') t, case doc_id % 6 when 1 then list_transform(l, lambda v, i: case when i = 2 then v || chr(2) else v end) when 2 then l[:1] || l[3:] when 3 then list_transform(l, lambda v: {_sql_strip("v")})
when 4 then list_transform(l, lambda v, i: case when i in (2, 3) then v || chr(2) else v end) when 5 then list_transform(l, lambda v, i: case when i > 2 then v || chr(2) else v end) else l end l
from (select doc_id, text, coalesce({_sql_lines("text")}, []) l from documents)"""
#: The rule step by step: segment i is looked for from the place after the one before, two characters further at most; once the place is lost, anywhere ahead.
_SQL_COVER = f"""with recursive d as materialized (select doc_id, regexp_replace(t, '{_WS}+', ' ', 'g') t, list_transform(l, lambda v: regexp_replace(v, '{_WS}+', ' ', 'g')) l from ({_SPOILED})),
r as (select doc_id, 0 i, 0::bigint place, -1 lost, false found from d union all
select doc_id, i + 1, case when p > 0 then place + p + len(l[i + 1]) - 1 else place end, case when p > 0 then -1 when lost < 0 then i else lost end, p > 0
from (select r.*, l, strpos(case when lost < 0 then substr(t, place + 1, len(l[i + 1]) + 2) else substr(t, place + 1) end, l[i + 1]) p from r join d using (doc_id) where i < len(l))),
last as (select doc_id, arg_max(lost, i) lost from r group by doc_id),
why as (select doc_id, i - 1 seg, case when r.lost = i - 1 then 'missing' when last.lost >= 0 and i - 1 > last.lost then 'unreachable' else 'skipped' end why from r join last using (doc_id) where i > 0 and not found),
cover as (select d.doc_id, coalesce(min(seg), -1)::int fail_idx, coalesce(string_agg(seg::varchar || ' ' || why, ',' order by seg), '') reasons from d left join why using (doc_id) group by d.doc_id)"""


@query(_SQL_COVER + " select doc_id, fail_idx from cover")
def verbatim_cover(spark, sf_dir):
    """Whether lines cover their document, whole documents: some are spoiled."""
    return _spoiled_lines(spark, sf_dir).select("doc_id", text.verbatim_cover("text", F.col("l")).alias("fail_idx"))


def _spoiled_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("l", text.lines("text"))
    at = F.col("doc_id") % 6
    changed = lambda some: F.transform("l", lambda x, i: F.when(some(i), F.concat(x, F.lit("\x02"))).otherwise(x))
    without = F.filter("l", lambda x, i: i != 1)
    spoiled = F.when(at == 1, changed(lambda i: i == 1)).when(at == 2, without).when(at == 3, F.transform("l", text.strip)).when(at == 4, changed(lambda i: i.isin(1, 2))).when(at == 5, changed(lambda i: i > 1))
    return rows.withColumn("l", spoiled.otherwise(F.col("l")))


@query(
    _SQL_COVER
    + """ select doc_id, case when doc_id % 5 = 3 then 'unparsed' when fail_idx >= 0 then 'invalid' else 'ok' end status, case when doc_id % 5 = 3 then 0 else len(l) end::int n_segments, case when doc_id % 5 = 3 then -1 else fail_idx end::int fail_idx,
case when doc_id % 5 = 3 then '' else reasons end reasons from cover join d using (doc_id)"""
)
def model_segmentation(spark, sf_dir):
    """A recorded model's segments of whole documents, parsed and validated, with the reason of each failure."""
    from tessera.plans.backends import Replay
    from tessera.plans.segmentation import segment_texts

    rows = _spoiled_lines(spark, sf_dir)
    reply, at = F.to_json("l"), F.col("doc_id") % 5
    reply = F.when(at == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).when(at == 2, F.concat(F.lit(" \n"), reply, F.lit("\n"))).when(at == 3, F.concat(F.lit("Here: "), reply)).otherwise(reply)
    backend = Replay(rows.select("doc_id", F.lit(0).alias("attempt"), reply.alias("response")), ["doc_id"])
    out = segment_texts(rows, ["doc_id"], backend)
    why = F.array_join(F.transform(F.array_sort(F.map_entries("failures")), lambda x: F.concat_ws(" ", x["key"].cast("string"), x["value"])), ",")
    return out.select("doc_id", "status", F.size("segments").alias("n_segments"), "fail_idx", why.alias("reasons"))


@query("""select turn, list_sort(list_distinct(list(length(text) % 10))) lengths from conversations group by turn""")
def sorted_distinct(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("turn").agg(F.array_sort(F.array_distinct(F.collect_list((F.char_length("text") % 10).cast("long")))).alias("lengths"))


# Importers

_EVENT_RAW = "case when o_orderkey % 5 = 0 then lpad((o_custkey % 400)::varchar, 3, '0') || lpad((o_orderkey % 300)::varchar, 3, '0') || '007' when o_orderkey % 5 = 1 then (o_custkey % 40)::varchar || '.' || (o_orderkey % 30)::varchar || ', 3' when o_orderkey % 5 = 2 then (o_custkey % 50)::varchar when o_orderkey % 5 = 3 then '' else '1234567' end"


def _events(spark, sf_dir):
    raw = _EVENT_RAW.replace("(o_custkey % 400)::varchar", "string(o_custkey % 400)").replace("(o_orderkey % 300)::varchar", "string(o_orderkey % 300)")
    for part in ("o_custkey % 40", "o_orderkey % 30", "o_custkey % 50"):
        raw = raw.replace(f"({part})::varchar", f"string({part})")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(raw).alias("raw"))


@query(
    f"""select o_orderkey, {_LIST_TEXT.format("v")} events from (select o_orderkey, list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(list_filter(list_transform(string_split(replace(raw, '.', ','), ','), lambda x: trim(x)),
lambda x: x <> ''), lambda x: case when x::bigint <= 100000 then [x] when len(x) % 3 = 0 then regexp_extract_all(x, '[0-9]{{3}}') else []::varchar[] end)), lambda x: x::bigint - 1), lambda x: x >= 0 and x < 250))) v from (select o_orderkey, {_EVENT_RAW} raw from orders))"""
)
def event_code_parse(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("e", codes.parse_events("raw", 250))
    return rows.select("o_orderkey", _list_text("e").alias("events"))


_CODES = "(o_custkey % 20)::varchar || ',900,' || (o_orderkey % 60 - 5)::varchar || ',,x,800,' || (o_custkey % 20)::varchar"


def _sql_codes(sentinels):
    return _LIST_TEXT.format(f"list_transform(list_filter(list_transform(string_split({_CODES}, ','), lambda x: try_cast(x as bigint)), lambda x: x is not null and x not in ({sentinels}) and x between 1 and 850), lambda x: x - 1)")


@query(f"select o_orderkey, {_sql_codes('900')} seg_c, {_sql_codes('900, 999, 800')} seg_b from orders")
def sentinel_code_parse(spark, sf_dir):
    raw = F.concat((F.col("o_custkey") % 20).cast("string"), F.lit(",900,"), (F.col("o_orderkey") % 60 - 5).cast("string"), F.lit(",,x,800,"), (F.col("o_custkey") % 20).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    rows = rows.withColumns({"c": codes.parse_sentinel_codes("raw", 850, (900,)), "b": codes.parse_sentinel_codes("raw", 850, (900, 999, 800))})
    return rows.select("o_orderkey", _list_text("c").alias("seg_c"), _list_text("b").alias("seg_b"))


@query(
    """select event_id, user_id, last_value(case when event_id % 3 = 0 then event_type end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) event_type from events"""
)
def ffill_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("event_type"))
    return segments.forward_fill(rows, ["user_id"], "event_id", ["event_type"])


@query("select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by event_id)::int n from events")
def cumcount_events(spark, sf_dir):
    return segments.count_within(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("select conv_id, run, case when run = 2 then turn + (select max(turn) from conversations where conv_id % 2 = 0) else turn end turn, md5(text) text_md5 from (select *, conv_id % 2 + 1 run from conversations)")
def run_offset(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") % 2 + 1).alias("run"), "turn", F.md5("text").alias("text_md5"))
    return segments.continue_run(rows, "run", "turn")


@query("select item_id, conv_id from (select conv_id % 40 item_id, conv_id, row_number() over (partition by conv_id % 40 order by conv_id) n from (select distinct conv_id from conversations)) where n = 1")
def first_subject(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 40).alias("item_id"), "conv_id").distinct()
    return segments.first_of_each(rows, ["item_id"], "conv_id")


def _digests(batches):
    """role, n_subjects, n_segments, text_md5 from subjects in order: a role's texts pass by, none is held."""
    names = ["role", "n_subjects", "n_segments", "text_md5"]
    schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)))
    role = subjects = segments = digest = None

    def told():
        return pa.record_batch([[role], [subjects], [segments], [digest and digest.hexdigest()]], schema=schema)

    for b in batches:
        for r, subject, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if subjects is None or r != role:
                if subjects is not None:
                    yield told()
                role, subjects, segments, digest = r, 0, 0, None
            subjects += subject is not None
            segments += n
            if text is not None:
                if digest is None:
                    digest = hashlib.md5()
                else:
                    digest.update(b"\x1e")
                digest.update(text.encode())
    if subjects is not None:
        yield told()


@query("select role, count(distinct conv_id) n_subjects, count(*) n_segments, md5(string_agg(text, chr(30) order by conv_id, turn)) text_md5 from conversations group by role")
def subject_lists(spark, sf_dir):
    """Each subject's segments in order, and all subjects of a role in order as one digest."""
    rows = segments.by_subject(table(spark, sf_dir, "conversations"), ["role"], "conv_id", "turn")
    told = F.filter("segments", lambda x: x.isNotNull())
    texts = rows.select("role", "conv_id", F.size("segments").cast("long").alias("n"), F.when(F.size(told) > 0, F.array_join(told, "\x1e")).alias("text"))
    dealt = texts.repartition("role").sortWithinPartitions("role", F.asc_nulls_last("conv_id"))
    return dealt.mapInArrow(_digests, "role string, n_subjects long, n_segments long, text_md5 string")


@query("select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then '' when l_linenumber % 3 = 1 then month(l_shipdate)::varchar || ',' || day(l_shipdate)::varchar else l_suppkey::varchar || ',4' end code, count(*) n from lineitem group by all")
def excel_date_repair(spark, sf_dir):
    cell = F.when(F.col("l_linenumber") % 3 == 1, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).when(F.col("l_linenumber") % 3 == 2, F.concat(F.col("l_suppkey").cast("string"), F.lit(",4")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codes.repair_date(cell).alias("code")).groupBy("l_orderkey", "l_linenumber", "code").agg(F.count("*").alias("n"))


@query("select p_partkey, 'sub-' || lpad((p_partkey % 1000)::varchar, 3, '0') sub_id, p_partkey::varchar || '_x' rest from part")
def filename_fields(spark, sf_dir):
    name = F.concat(F.lit("rec_"), (F.col("p_partkey") % 1000).cast("string"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("_x.csv"))
    return table(spark, sf_dir, "part").select("p_partkey", codes.file_fields(name).alias("f")).select("p_partkey", "f.*")


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def static_code_map(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(names, "n_regionkey").select("n_nationkey", "n_name", "r_name")


# Usage, names, set operations

_PRICES = [("1-URGENT", 5.0, 20.0), ("2-HIGH", 0.5, 2.0), ("5-LOW", 0.25, 1.0)]


@query(
    """select o_orderpriority model, sum(o_custkey)::bigint in_tokens, sum(o_orderkey % 1000)::bigint out_tokens, round(sum((o_custkey * coalesce(i, 0.0) + (o_orderkey % 1000) * coalesce(o, 0.0)) / 1e6), 6) cost
from orders left join (values ('1-URGENT', 5.0, 20.0), ('2-HIGH', 0.5, 2.0), ('5-LOW', 0.25, 1.0)) p(o_orderpriority, i, o) using (o_orderpriority) group by 1"""
)
def usage_cost(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("in_tokens"), (F.col("o_orderkey") % 1000).alias("out_tokens"))
    prices = spark.createDataFrame(_PRICES, "model string, price_in double, price_out double")
    return rounded(scoring.usage_totals(log, prices, ["model"]), 6)


@query("select distinct 'lexical-' || role || '-' || source param from (select distinct role from conversations), (select distinct source from documents)")
def param_string(spark, sf_dir):
    roles, sources = table(spark, sf_dir, "conversations").select("role").distinct(), table(spark, sf_dir, "documents").select("source").distinct()
    return roles.crossJoin(sources).select(codes.param_string(F.lit("lexical"), F.col("role"), F.col("source")).alias("param")).distinct()


@query("select event_id, strftime(ts, '%Y%m%d_%H%M%S') || '-rr-alice-' || event_type || '-m_org_' || event_type run from events")
def run_directory_name(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", codes.run_name(F.col("ts"), F.lit("alice"), F.col("event_type"), F.concat(F.lit("org/"), F.col("event_type")), True).alias("run"))


@query("select doc_id, source from documents where doc_id in (select doc_id from labels)")
def rated_subjects_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("select conv_id::varchar sub_id, count(*) n from conversations group by 1 union all select 'item' || item_id::varchar, len(" + _sql_lines("text") + ") from benchmark")
def union_disjoint(spark, sf_dir):
    from tessera.sources.segments import union_recalls

    a = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("sub_id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("sub_id"), F.explode(text.lines("text")).alias("text"))
    return union_recalls([a, b]).groupBy("sub_id").agg(F.count("*").alias("n"))


@query("select doc_id, lang, list_position(['fr', 'en', 'de'], lang)::int rank from documents")
def display_order(spark, sf_dir):
    """Rows in a fixed order of a category; others have no rank."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif(codes.display_rank("lang", ["fr", "en", "de"]), F.lit(0)).alias("rank"))


@query("select conv_id, list_slice(list(turn order by turn), 1, 3) || [-1] preview from conversations group by conv_id having count(*) > 3")
def preview_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).where("size(t) > 3")
    return rows.select("conv_id", F.concat(F.slice("t", 1, 3), F.array(F.lit(-1).cast("long"))).alias("preview"))


# Files: the driver's tables written as stories, recalls and ratings, and read again


def _stories(spark, sf_dir):
    """Lines of benchmark items as stories of 40 items each, their conversations as recalls, and ratings."""
    story = segments.explode_segments(table(spark, sf_dir, "benchmark"), ["item_id"], text.lines("text"))
    recall = table(spark, sf_dir, "conversations").where(~text.is_blank("text")).select(F.col("conv_id").cast("string").alias("sub_id"), F.col("turn").alias("recall_idx"), "text")
    return story, recall


_SQL_RECALLS = f"select conv_id::varchar sub_id, (row_number() over (partition by conv_id order by turn) - 1)::int recall_idx, md5(text) text_md5 from conversations where {_sql_strip('text')} <> ''"


@query(_SQL_RECALLS)
def recall_json_round_trip(spark, sf_dir):
    """Recalls of all conversations written as a folder of documents, read by the JSON reader."""
    from tessera.sources import segments as src
    from tessera.sources import shared, sinks

    _, recall = _stories(spark, sf_dir)
    top = shared.shared_dir(spark)
    sinks.write_recalls(recall, top, "turns", F.concat(F.lit("part "), (F.crc32("sub_id") % 7).cast("string"), F.lit(".json")))
    return src.read_recalls(spark, top).select("sub_id", "recall_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(_SQL_RECALLS)
def recall_json_splits(spark, sf_dir):
    """Recalls of all conversations written as one document, read in parallel by splits of it."""
    from tessera.sources import segments as src
    from tessera.sources import shared, sinks

    _, recall = _stories(spark, sf_dir)
    path = f"{shared.shared_dir(spark)}/recalls.json"
    sinks.write_recalls(recall, path, "turns")
    return src.read_recalls(spark, path, split_over=0).select("sub_id", "recall_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    f"""select 'tale %' || (sub_id::bigint % 5)::varchar story_name, sub_id, recall_idx, recall_idx % 3 = 0 rated, text_md5, n_story from ({_SQL_RECALLS})
join (select item_id % 5 tale, sum(len({_sql_lines("text")}))::bigint n_story from benchmark group by tale) on tale = sub_id::bigint % 5 where sub_id::bigint % 2 = 0"""
)
def benchmark_story_round_trip(spark, sf_dir):
    """A benchmark tree of several stories, with recalls and ratings of every other conversation, written in one job and read by one scan a part: unrated subjects are left out."""
    from tessera.sources import segments as src
    from tessera.sources import shared, sinks

    story, recall = _stories(spark, sf_dir)
    tale = lambda c: F.concat(F.lit("tale %"), (c % 5).cast("string")).alias("story_name")
    story = story.select(tale(F.col("item_id")), F.struct("item_id", "seg_idx").alias("story_idx"), "text")
    numbered = segments.count_within(recall, ["sub_id"], "recall_idx", "n").select(tale(F.col("sub_id").cast("long")), "sub_id", (F.col("n") - 1).alias("recall_idx"), "text")
    ratings = numbered.where("cast(sub_id as bigint) % 2 = 0").select("story_name", "sub_id", "recall_idx", F.when(F.col("recall_idx") % 3 == 0, F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("story_idxs"))
    top = shared.shared_dir(spark)
    sinks.write_benchmark(story, numbered, ratings, f"{top}/set", method="turns")
    got = src.read_benchmark(spark, top, "set", ("turns.json",) * 3)
    n_story = got["story"].groupBy("story_name").agg(F.count("*").alias("n_story"))
    marks = got["ratings"].select("story_name", "sub_id", "recall_idx", (F.size("story_idxs") > 0).alias("rated"))
    rows = got["recall"].join(marks, ["story_name", "sub_id", "recall_idx"]).join(n_story, "story_name")
    return rows.select("story_name", "sub_id", "recall_idx", "rated", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_story")


@query(f"select item_id, (unnest(range(len(l))) + 1)::int recall_segment, md5(unnest(l)) text_md5 from (select item_id, {_sql_lines('text')} l from benchmark)")
def segment_csv_round_trip(spark, sf_dir):
    """Lines of items as segment CSV files, read by the CSV reader."""
    from tessera.sources import shared, sinks

    story, _ = _stories(spark, sf_dir)
    top = shared.shared_dir(spark)
    sinks.write_segment_csv(story.withColumnRenamed("item_id", "stem"), top)
    rows = spark.read.schema("recall_segment int, story_segment string, text string, stem string").csv(top, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.select(F.col("stem").cast(story.schema["item_id"].dataType).alias("item_id"), "recall_segment", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    """select item_id, 'Sheet ' || (item_id % 6)::varchar || '.xlsx' file, (row_number() over (partition by item_id % 6 order by item_id) + 1)::int sheet_row, md5(coalesce(text, '')) text_md5, item_id::varchar || '-01-02' as_text, case when item_id % 3 = 0 then ((item_id % 12) + 1)::varchar || ',' || ((item_id % 28) + 1)::varchar when item_id % 3 = 1 then (item_id % 9 + 1)::varchar || ',4' else '' end code,
item_id / 8.0 eighth, item_id % 2 = 0 even, (case when item_id % 3 = 0 then 'date' when item_id % 3 = 1 then 'text' else 'none' end) code_kind from benchmark"""
)
def sheet_round_trip(spark, sf_dir):
    """Items as spreadsheets, made and read by the executors: text that looks like a date stays text, codes that a sheet took for dates are repaired by their kind."""
    from tessera.sources import shared, sheets

    item = F.col("item_id")
    code = F.when(item % 3 == 1, F.concat((item % 9 + 1).cast("string"), F.lit(",4")))
    day = F.when(item % 3 == 0, F.make_timestamp(F.lit(2020), item % 12 + 1, item % 28 + 1, F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Sheet "), (item % 6).cast("string"), F.lit(".xlsx")).alias("file"), "text", F.concat(item.cast("string"), F.lit("-01-02")).alias("as_text"), code.alias("code"), day.alias("day"), (item / 8).alias("eighth"), (item % 2 == 0).alias("even"))
    top = shared.shared_dir(spark)
    sheets.write_sheets(rows, top, "file", ["item_id"], ["item_id", "text", "as_text", "code", "day", "eighth", "even"])
    got = sheets.read_sheets(spark, top).withColumn("item", F.coalesce(F.col("cells")["code"], F.col("cells")["day"]))
    return got.select(
        sheets.cell("item_id", "number").cast("bigint").alias("item_id"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("row").alias("sheet_row"), F.md5(F.coalesce(sheets.cell("text", "text"), F.lit("")).cast("binary")).alias("text_md5"),
        sheets.cell("as_text", "text").alias("as_text"), codes.repair_cell(F.col("item")).alias("code"), sheets.cell("eighth", "number").cast("double").alias("eighth"), sheets.cell("even", "bool").cast("boolean").alias("even"), F.coalesce(F.col("item")["kind"], F.lit("none")).alias("code_kind"),
    )


@query("select vec_id, label, len(embedding)::int width, md5(array_to_string(list_transform(embedding, lambda x: round(x::double * 1000)::bigint), ',')) values_md5 from embeddings")
def array_round_trip(spark, sf_dir):
    """Embeddings as structured .npy files, written by the executors and read by ranges of rows."""
    from tessera.sources import arrays, shared

    top = shared.shared_dir(spark)
    arrays.write_arrays(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), top, most_rows=700)
    got = arrays.read_arrays(spark, top, part_bytes=1 << 16)
    thousandths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string"))
    return got.select("vec_id", "label", F.size("embedding").alias("width"), F.md5(F.array_join(thousandths, ",").cast("binary")).alias("values_md5"))


_ENCODED = "case when not regexp_matches(text, '[^\\x00-\\x7F]') then 'US-ASCII' when doc_id % 3 = 0 then 'UTF-8' when doc_id % 3 = 1 then 'windows-1252' else 'macintosh' end"


@query(f"select encoding, count(*) n, true found from (select {_ENCODED} encoding from documents where text <> '') group by encoding")
def detected_encodings(spark, sf_dir):
    """Whole documents in one of three encodings by doc_id: whether of each at least 99 in 100 are found and decoded to the text they were made of."""
    from tessera.sources import encodings

    def run(texts: pa.Array, turns: pa.Array) -> pa.Array:
        names = ("utf-8", "cp1252", "mac_roman")
        return pa.array([t.as_py().encode(names[k.as_py()]) for t, k in zip(texts, turns, strict=True)], pa.binary())

    encode = F.arrow_udf(run, "binary")
    rows = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.col("text").rlike("[^\\x00-\\x7F]").alias("high"), encode("text", (F.col("doc_id") % 3).cast("int")).alias("content"))
    own = F.when(~F.col("high"), "US-ASCII").when(F.col("doc_id") % 3 == 0, "UTF-8").when(F.col("doc_id") % 3 == 1, "windows-1252").otherwise("macintosh")
    got = encodings.decoded(rows, encodings.learn(rows))
    right = (F.col("encoding") == own) & (F.md5(F.col("text").cast("binary")) == F.col("md5"))
    return got.groupBy(own.alias("own")).agg(F.count("*").alias("n"), (F.avg(right.cast("double")) >= 0.99).alias("found")).withColumnRenamed("own", "encoding")


_SQL_ABBREVIATIONS = rf"""t as (select unnest(list_transform({_sql_words("text")}, lambda v: lower(v))) token from documents),
u as (select regexp_replace(token, '\.$', '') word, token like '%.' stop from t where regexp_matches(token, '^\p{{L}}[\p{{L}}.]*$')),
c as (select word, count_if(stop) n_stop, count_if(not stop) n_bare, len(word) - len(replace(word, '.', '')) inner_stops from u group by word),
p as (select sum(n_stop) / sum(n_stop + n_bare) share from c),
a as (select word from (select word, -2 * (n_stop * ln(share) + n_bare * ln(1 - share) - n_stop * ln(0.99) - n_bare * ln(1 - 0.99)) * exp(-(len(word) - inner_stops)::double) * (inner_stops + 1) * pow((len(word) - inner_stops)::double, -n_bare::double) score from c, p where n_stop > 0)
where score >= 0.3 order by score desc, word limit 1000)"""


@query(
    rf"""with {_SQL_ABBREVIATIONS}, s as (select doc_id, list_filter(string_split_regex(regexp_replace({_sql_strip("text")}, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda v: v <> '') l from documents),
e as (select doc_id, unnest(l[:-2]) x from s)
select doc_id, len(l) - coalesce(k, 0) n_sentences from s left join (select doc_id, count(*) k from e join a on a.word = lower(regexp_extract(x, '([^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+)\.$', 1)) group by doc_id) using (doc_id)"""
)
def learnt_sentence_counts(spark, sf_dir):
    """Sentences of whole documents, where abbreviations learnt from all of them end none."""
    from tessera.operators import sentences

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(sentences.split_sentences("text", sentences.learn_abbreviations(docs))).cast("long").alias("n_sentences"))


#: Cosines of the vectors with ids divisible by 100 and all others; rounded as Spark and DuckDB sum in different orders.
_SQL_COSINES = "select q.vec_id query_id, v.vec_id vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) score from embeddings q join embeddings v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id"


def _near_vectors(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    from tessera.operators import vectors

    every = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = every.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.vector_matches(every, asked, "vec_id", "query_id", least=least, miss=0).where("vec_id <> query_id")


@query(f"select query_id, vec_id, round(score, 9) score from ({_SQL_COSINES}) where score >= 0.3")
def vector_matches(spark, sf_dir):
    """All vectors within a cosine of 0.3 of each asked one. At such a bound most pairs share a bucket of signatures, so all pairs are compared."""
    return rounded(_near_vectors(spark, sf_dir, 0.3))


@query(f"select query_id, arg_min(vec_id, {{'a': -score, 'b': vec_id}}) vec_id, round(max(score), 9) score from ({_SQL_COSINES}) where score >= 0.3 group by query_id")
def vector_best_match(spark, sf_dir):
    """The nearest vector of each asked one, if one is within 0.3."""
    from tessera.operators import vectors

    return rounded(vectors.best_matches(_near_vectors(spark, sf_dir, 0.3), ["query_id"], "vec_id"))


@query(
    """select count(*)::bigint n_attempts, count_if(o_orderkey % 3 <> 0)::bigint n_valid, count_if(o_orderkey % 5 <> 0)::bigint n_metered, sum(case when o_orderkey % 5 <> 0 then o_custkey end)::bigint in_tokens,
sum(case when o_orderkey % 5 <> 0 then o_orderkey % 1000 end)::bigint out_tokens, round(n_metered * 0.5, 6)::double as seconds, round(out_tokens / (n_metered * 0.5), 6) as tokens_per_second, (max(o_orderkey % 777))::double peak_mb, round((in_tokens * 0.5 + out_tokens * 2.0) / 1e6, 6) cost from orders"""
)
def observed_usage(spark, sf_dir):
    """Totals over all orders as attempts, observed while they are written; every fifth tells no tokens."""
    from tessera.plans.usage import Meter
    from tessera.sources.shared import scratch

    told, meter = F.col("o_orderkey") % 5 != 0, Meter()
    log = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 3 != 0).alias("valid"), F.when(told, F.col("o_custkey")).alias("in_tokens"), (F.col("o_orderkey") % 1000).alias("out_tokens"), F.lit(0.5).alias("seconds"), (F.col("o_orderkey") % 777).cast("double").alias("peak_mb")
    )
    with scratch():
        meter.written(log)
    kinds = "n_attempts long, n_valid long, n_metered long, in_tokens long, out_tokens long, seconds double, tokens_per_second double, peak_mb double, cost double"
    return rounded(spark.createDataFrame([meter.totals(0.5, 2.0)], kinds), 6)
