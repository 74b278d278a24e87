"""DuckDB SQL of those queries that SQL can express, over views of the same tables.

Each states the query's result plainly (all pairs, whole groups) and so suits small tables only.
"""

from __future__ import annotations

from tracelight.llm import licenses
from tracelight.llm.line_dedup import LEAST_PAGES, RATIO
from tracelight.llm.poisson_mix import PART, SEED
from tracelight.llm.pstable import COSINE

_USABLE = "vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

OP1 = f"""
with recursive g as (
  select vec_id, label, embedding::double[] as e from embeddings
  where {_USABLE} and label is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b, a.e = b.e as same
  from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach as (
  select a, b from links
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), per as (
  select a, count(*) as n_links, count(*) filter (where same) as copies from links group by a
), low as (
  select a, min(b) as b from reach group by a
)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, least(v.vec_id, coalesce(low.b, v.vec_id)) as component_id,
  v.vec_id is null or v.vec_id <= coalesce(low.b, v.vec_id) as kept, (coalesce(copies, 0) + 1)::bigint as n_copies
from embeddings v left join per on per.a = v.vec_id left join low on low.a = v.vec_id
"""

def _quoted(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


_PHRASES = ", ".join(
    f"({number}, {_quoted(licenses.phrase_words(text))}, '{label}', {str(base).lower()})"
    for number, (text, label, base) in enumerate([*((t, x, True) for t, x in licenses.BASE.items()), *((t, x, False) for t, x in licenses.TEMPLATES.items())])
)

OP5 = f"""
with phrases(template, words, label, base) as (values {_PHRASES}),
d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), places as (
  select r, w, unnest(range(len(w))) as pos from d
), stands as (
  select r, pos, label from places join phrases on base and w[pos + 1] = words[1] and list_slice(w, pos + 1, pos + len(words)) = words
), base_of as (
  select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list_sort(list(distinct label)) as base_labels from stands group by r
), grams as (
  select template, label, len(words) - {licenses.LONG - 1} as grams, p as place, list_slice(words, p + 1, p + {licenses.LONG}) as gram
  from (select *, unnest(range(len(words) - {licenses.LONG - 1})) as p from phrases where not base)
), votes as (
  select r, template, label, grams, pos - place as diagonal, count(distinct place) as places
  from (select r, pos, list_slice(w, pos + 1, pos + {licenses.LONG}) as gram from places) join grams using (gram) group by all
), runs as (
  select *, sum(fresh) over (partition by r, template order by diagonal) as run
  from (select *, case when diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {licenses.NEAR} then 1 else 0 end as fresh from votes)
), spans as (
  select r, label, sum(places) as votes, any_value(grams) as grams from runs group by r, template, label, run having sum(places) >= {licenses.SHARE}::double * any_value(grams)
), long_of as (
  select r, list(distinct label) as labels, max(least(votes / grams, 1.0::double)) as score from spans group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, array_to_string(coalesce(base_labels, []), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ',') as labels,
  case when n_base > 0 then 1.0::double else coalesce(score, 0.0)::double end as score
from d left join base_of using (r) left join long_of using (r)
"""

OP7 = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)) as v from embeddings where {_USABLE}
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""

#: Target weights of sources in the registered mixture; other sources weigh 1.
WEIGHTS = {"src0": 4.0, "src1": 2.5, "src2": 0.25, "src3": 0.0}
_WEIGHT = "case source " + " ".join(f"when '{k}' then {v}::double" for k, v in WEIGHTS.items()) + " else 1.0::double end"

OP9 = f"""
with recursive weighed as (
  select source, any_value({_WEIGHT}) as w, count(*) as n from documents group by source
), total as (
  select sum(n)::double as n, sum(w) as w from weighed
), per as (
  select source, weighed.w * (total.n / total.w) / weighed.n as whole from weighed, total
), part as (
  select source, greatest(1, ceil(whole / {PART}))::integer as parts, whole / parts as rate from per
), steps as (
  select source, parts, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from part
  union all
  select source, parts, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from steps where k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)
), cdf as (
  select source, any_value(parts) as parts, list(c order by k) as cdf from steps group by source
), keyed as (
  select d.*, parts, cdf, concat_ws('|', '{SEED}', coalesce(doc_id::varchar, ''), md5(coalesce(text, ''))) as key
  from documents d join cdf on d.source is not distinct from cdf.source
), drawn as (
  select *, case when parts = 1 then [key] else list_transform(range(1, parts + 1), lambda i: key || '|' || i) end as keys from keyed
), numbers as (
  select *, list_transform(keys, lambda x: (('0x' || substr(md5(x), 1, 13))::bigint::double + 0.5::double) / {float(1 << 52)}::double) as us from drawn
), counted as (
  select *, list_sum(list_transform(us, lambda u: least(len(list_filter(cdf, lambda c: c < u)), len(cdf) - 1)))::bigint as copies from numbers
)
select doc_id, text, lang, source, n_chars, unnest(range(copies)) as copy_no from counted
"""

OP10 = f"""
with d as (
  select row_number() over () as page, doc_id, source, text, string_split(text, chr(10)) as parts from documents
), hosts as (
  select source, count(*) as pages from d group by source
), lines as (
  select page, source, unnest(list_distinct(parts)) as line from d
), seen as (
  select source, line, count(*) as pages from lines where trim(line, ' ') <> '' group by source, line
), gone as (
  select s.source, list(s.line) as lines from seen s join hosts h on s.source is not distinct from h.source
  where s.pages >= {LEAST_PAGES} and s.pages > {RATIO}::double * h.pages group by s.source
), kept as (
  select d.*, list_filter(parts, lambda x: not list_contains(coalesce(gone.lines, []), x)) as stay
  from d left join gone on d.source is not distinct from gone.source
)
select doc_id, source, coalesce(len(parts), 0)::bigint as n_lines, coalesce(len(parts) - len(stay), 0)::bigint as n_dropped,
  case when text is not null then coalesce(array_to_string(stay, chr(10)), '') end as text
from kept
"""

SQL = {"op1_embedding_near_dedup": OP1, "op5_license_scan": OP5, "op7_exact_topk": OP7, "op9_mixing": OP9, "op10_line_dedup": OP10}
