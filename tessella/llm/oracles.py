"""SQL of the operators whose results exact joins and sums give too: overlaps with items, links by n-gram sets, distances.

The first two are brute force without the operators' hashes, so that equal results show their recall.
"""

from __future__ import annotations

from .decontamination import SEGMENT, SHORT, SPAN, SUBSTITUTIONS, WINDOW
from .near import SIMILARITY, WORDS
from .quality import COMMON, LEAST_CHARS_COMPARED, LEAST_REFERENCE_WORDS, LEAST_WORDS_COMPARED, MOST_CHARS_DISTANCE, MOST_WORDS_DISTANCE

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

#: Of WINDOW words in a row with SUBSTITUTIONS others, some three in a row agree; so do they in the shorter windows of short segments.
DECONTAMINATION_SQL = f"""
with d as (
  select doc_id, row_number() over () as row, {_WORDS} as w from documents
), items as (
  select distinct item_id, {_WORDS} as w from benchmark
), s as (
  select row_number() over () as segment, item_id, len(w) as item_words, first, w[first + 1 : first + {SEGMENT}] as w
  from items, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1, {SEGMENT - WINDOW + 1})) f(first) where len(w) >= {SPAN}
), sg as (
  select segment, i, w[i : i + 2] as g from s, unnest(range(1, len(w) - 1)) r(i) where len(w) >= {SPAN}
), dg as (
  select row, i, w[i : i + 2] as g from d, unnest(range(1, greatest(len(w) - 1, 1))) r(i)
), hits as (
  select distinct row, segment, dg.i - sg.i as diagonal from dg join sg using (g)
), laid as (
  select doc_id, item_id, item_words, diagonal - first as start,
    list_transform(range(1, len(s.w) + 1), lambda j: case when diagonal + j >= 1 and d.w[greatest(diagonal + j, 1)] = s.w[j] then 1 else 0 end) as m
  from hits join d using (row) join s using (segment)
), close as (
  select doc_id, item_id, item_words, start, list_sum(m)::integer as matched from laid
  where len(list_filter(range(1, len(m) - least(len(m), {WINDOW}) + 2), lambda i: list_sum(m[i : i + least(len(m), {WINDOW}) - 1]) >= least(len(m), {WINDOW}) - {SUBSTITUTIONS})) > 0
), short as (
  select doc_id, item_id, len(items.w) as item_words, i - 1 as start, len(items.w) as matched
  from items join (select d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) as i from d where exists (select 1 from items where len(w) between {SHORT} and {SPAN - 1})) p on p.w[i : i + len(items.w) - 1] = items.w
  where len(items.w) between {SHORT} and {SPAN - 1}
), found as (
  select doc_id, item_id, item_words, matched, start from close union all select doc_id, item_id, item_words, matched, start from short
)
select doc_id, item_id, item_words::integer as item_words, matched::integer as matched, start::integer as start from found
qualify row_number() over (partition by doc_id, item_id order by matched desc, start, item_words desc) = 1
"""

NEAR_SQL = f"""
with recursive d as (
  select doc_id, {_WORDS} as w from documents
), classes as (
  select array_to_string(w, ' ') as t, any_value(w) as w, count(*) as n, min(doc_id) as first, row_number() over (order by min(doc_id)) as cid from d where len(w) > 0 group by 1
), grams as (
  select distinct cid, case when len(w) < {WORDS} then t else array_to_string(w[i : i + {WORDS - 1}], ' ') end as g
  from classes, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) r(i)
), sizes as (
  select cid, count(*) as size from grams group by cid
), common as (
  select a.cid as a, b.cid as b, count(*) as k from grams a join grams b on a.g = b.g and a.cid < b.cid group by 1, 2
), links as (
  select a, b from common join sizes x on x.cid = a join sizes y on y.cid = b where k * {1 + SIMILARITY} >= {SIMILARITY} * (x.size + y.size) - 1e-9
), either as (
  select a, b from links union all select b, a from links
), reached(cid, root) as (
  select cid, cid from classes union select either.b, reached.root from reached join either on either.a = reached.cid
), least as (
  select reached.cid, min(first) as class_id from reached join classes on classes.cid = reached.root group by 1
), linked as (
  select a as cid, sum(n) as links from either join classes on classes.cid = b group by 1
)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id, coalesce(n, 1)::bigint as n_copies, (coalesce(links, 0) + coalesce(n, 1) - 1)::bigint as n_links
from d left join classes on len(d.w) > 0 and classes.t = array_to_string(d.w, ' ') left join least using (cid) left join linked using (cid)
"""

_CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{N}", r"[\p{P}\p{S}]", r"[\x20\x09-\x0D]")
_COUNTED = ", ".join(f"len(regexp_extract_all(text, '{c}'))" for c in _CLASSES)


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    term = lambda x: f"case when {x} > 0 then {x} * ln(2 * {x} / (x[1] + x[2])) else 0 end"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: ({term('x[1]')} + {term('x[2]')}) / 2)), 0) / ln(2))"


#: Key `l:` with the language, or `*` for all documents together.
QUALITY_SQL = rf"""
with base as ({{base}}), t as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text, 'l:' || lang as lang from documents
), w as (
  select row, lang, unnest(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as word from t
), n_of as (
  select row, count(*) as n from w group by row
), c as (
  select row, lang, length(text) as n_chars, [{_COUNTED}] as k from t
), cl as (
  select row, lang, n_chars, list_append(k, n_chars - list_sum(k))::double[] as k from c
), keyed as (
  select key, word, count(*) as k from (select lang as key, word from w where lang is not null union all select '*', word from w) group by all
), totals as (
  select key, sum(k) as n from keyed group by key
), best as (
  select key, word, k, row_number() over (partition by key order by k desc, word) as r from keyed qualify r <= {COMMON}
), refs as (
  select t.key, list(b.word order by r) as words, list(b.k / t.n order by r) as shares from totals t join best b using (key) group by t.key
), sums as (
  select key, list_transform(range(1, 7), lambda i: case i when 1 then s1 when 2 then s2 when 3 then s3 when 4 then s4 when 5 then s5 else s6 end / greatest(s1 + s2 + s3 + s4 + s5 + s6, 1)) as shares
  from (select key, sum(k[1]) as s1, sum(k[2]) as s2, sum(k[3]) as s3, sum(k[4]) as s4, sum(k[5]) as s5, sum(k[6]) as s6
    from (select lang as key, k from cl where lang is not null union all select '*', k from cl) group by key)
), own as (
  select cl.row, case when o.n >= {LEAST_REFERENCE_WORDS} then cl.lang else '*' end as key, n_chars, k, coalesce(n_of.n, 0) as n
  from cl left join totals o on o.key = cl.lang left join n_of using (row)
), counted as (
  select own.row, best.r, count(w.word) as k from own join best on best.key = own.key left join w on w.row = own.row and w.word = best.word where own.n >= {LEAST_WORDS_COMPARED} group by all
), mine as (
  select counted.row, list(counted.k / own.n order by r) as shares from counted join own using (row) group by counted.row
), far as (
  select own.row,
    case when n_chars >= {LEAST_CHARS_COMPARED} then {_distance("list_transform(own.k, lambda x: x / n_chars)", "sums.shares")} end as dc,
    case when n >= {LEAST_WORDS_COMPARED} then {_distance("list_append(mine.shares, greatest(1 - list_sum(mine.shares), 0))", "list_append(refs.shares, 1 - list_sum(refs.shares))")} end as dw
  from own left join sums on sums.key = own.key left join refs on refs.key = own.key left join mine using (row)
)
select base.*, not base_failed and not coalesce(dc > {MOST_CHARS_DISTANCE}, false) and not coalesce(dw > {MOST_WORDS_DISTANCE}, false) as kept,
  round(dc, 6) as chars_distance, round(dw, 6) as words_distance
from base join t using (doc_id) join far using (row)
"""
