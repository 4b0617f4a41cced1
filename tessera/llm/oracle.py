"""DuckDB equivalents of the corpus queries that SQL can express. (Not: learned models, tokenizers, k-d trees, packing.)"""

from __future__ import annotations

from .host_rules import DEVIATIONS, LEAST_RATE, MIN_WORDS, MOST_RATE, MOST_STRENGTH, REPEAT_PERCENT
from .line_dedup import MIN_WORDS as LINE_WORDS
from .line_dedup import NEAR_WORDS

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


OP1 = f"""
with d as (select doc_id, {_words("coalesce(text, '')")} w from documents where doc_id is not null),
win as (select doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 18)) s from d)),
later as (select doc_id, s from (select *, row_number() over (partition by h order by doc_id, s) n from win) where n > 1),
word as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i from d),
marked as (select word.*, max(case when later.s is not null then i end) over (partition by word.doc_id order by i rows between unbounded preceding and current row) last_start from word left join later on later.doc_id = word.doc_id and later.s = i),
kept as (select doc_id, count_if(last_start > i - 20) n_removed, string_agg(x, ' ' order by i) filter (last_start is null or last_start <= i - 20) t from marked group by doc_id)
select doc_id, len(w) n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)"""

_OP5_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""
with b as (select item_id, {_OP5_WORDS} w from benchmark where item_id is not null),
iw as (select distinct item_id, m, array_to_string(w[s : s + m - 1], ' ') k from (select item_id, w, least(len(w), 10) m, unnest(range(1, len(w) - least(len(w), 10) + 2)) s from b where len(w) > 0)),
d as (select doc_id, {_OP5_WORDS} w from documents where doc_id is not null),
dw as (select doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') k from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) s from d, (select distinct m from iw) where len(w) >= m)),
hit as (select doc_id, m, s, item_id from dw join iw using (m, k)),
n as (select doc_id, count(distinct i) n_hit from (select doc_id, unnest(range(s, s + m)) i from (select distinct doc_id, s, m from hit)) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) t from (select distinct doc_id, item_id from hit) group by doc_id)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(t, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join n using (doc_id) left join items using (doc_id)"""

OP6 = rf"""
with d as (select doc_id, source, coalesce(text, '') t, {_words("coalesce(text, '')")} w from documents where doc_id is not null),
tri as (select doc_id, s, array_to_string(w[s : s + 2], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 1)) s from d)),
again as (select doc_id, s from (select *, count(*) over (partition by doc_id, k) n from tri) where n > 1),
rep as (select doc_id, count(distinct i) n from (select doc_id, unnest([s, s + 1, s + 2]) i from again) group by doc_id),
x as (select doc_id, source, len(w) n_words, coalesce(list_sum(list_transform(w, lambda v: len(v))), 0)::bigint word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
len(list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')))) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
from d left join rep using (doc_id)),
y as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words base_failed from x),
h as (select source, count(*) n, count_if(base_failed) f from y group by source),
p as (select avg(f / n) m, avg(f / n) * (1 - avg(f / n)) w, coalesce(var_samp(f / n), 0) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) between_ from h),
q as (select m, w, case when between_ > 0 and w > 0 then least(greatest(w / between_ - 1, 2), {MOST_STRENGTH}) else {MOST_STRENGTH} end k from p),
v as (select source, (f + m * k) / (n + k) >= least(greatest(m + {DEVIATIONS} * sqrt(w / (k + 1)), {LEAST_RATE}), {MOST_RATE}) bad from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad kept from y join v on y.source is not distinct from v.source"""

OP8 = f"""
with recursive d as (select doc_id, {_words(_FOLD)} w from documents where doc_id is not null),
s as (select distinct doc_id, array_to_string(case when len(w) < 5 then w else w[i : i + 4] end, ' ') k from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) as (select doc_id, doc_id from d union select r.a, e.b from r join e on e.a = r.b),
l as (select a, count(*) n_links from e group by a)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, min(r.b)) component_id, coalesce(l.n_links, 0) n_links from d left join n using (doc_id) left join l on l.a = d.doc_id join r on r.a = d.doc_id group by d.doc_id, n.n, l.n_links"""

OP9 = f"""
with l as (select doc_id, unnest(range(len(x))) line, unnest(x) t from (select doc_id, string_split(text, chr(10)) x from documents where doc_id is not null)),
w as (select doc_id, line, {_words("t")} w from l where len({_words("t")}) >= {LINE_WORDS}),
v as (select doc_id, line, -1 pos, md5(array_to_string(w, ' ')) k, len(w) n from w union all
select doc_id, line, i, md5(array_to_string(w[1 : i - 1] || w[i + 1 :], ' ')), len(w) from (select *, unnest(range(1, len(w) + 1)) i from w where len(w) >= {NEAR_WORDS})),
f as (select *, doc_id * 1000000 + line place, min(doc_id * 1000000 + line) over (partition by k, pos) same, min(case when pos = -1 and n >= {NEAR_WORDS} then doc_id * 1000000 + line end) over (partition by k) whole,
min(case when pos <> -1 and n > {NEAR_WORDS} then doc_id * 1000000 + line end) over (partition by k) longer from v),
gone as (select distinct doc_id, line from f where same < place or (pos = -1 and n >= {NEAR_WORDS} and longer < place) or (pos <> -1 and n > {NEAR_WORDS} and whole < place))
select d.doc_id, len(string_split(coalesce(text, ''), chr(10))) n_lines, count(line) n_removed, coalesce(string_agg(line::varchar, ',' order by line), '') removed_lines from documents d left join gone using (doc_id) where d.doc_id is not null group by d.doc_id, text"""

_OP11_TERMS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = f"""
with d as (select row_number() over () r, doc_id, {_OP11_TERMS} w from documents where doc_id is not null),
n as (select r, doc_id, len(w)::bigint n from d where len(w) > 0),
s as (select count(*) docs, sum(n)::bigint terms from n),
i as (select item_id, t, count(*) times from (select item_id, unnest({_OP11_TERMS}) t from (select distinct item_id, text from benchmark where item_id is not null)) group by all),
p as (select r, t, count(*) tf from (select r, unnest(w) t from d) where t in (select t from i) group by all),
f as (select t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint weight from p, s group by t, docs),
x as (select r, doc_id, 100 - 75 + (75 * n * docs) // terms m from n, s),
score as (select item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from i join f using (t) join p using (t) join x using (r) group by item_id, r, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int "rank", doc_id, score from score where score > 0 qualify "rank" <= 10"""

SQL = {"op1_substring_dedup": OP1, "op5_winnowing_decontamination": OP5, "op6_host_rules": OP6, "op8_ngram_jaccard_join": OP8, "op9_line_dedup": OP9, "op11_lexical_search": OP11}
