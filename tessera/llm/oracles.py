"""SQL of the registered queries that SQL can express, written on its own.

Tokenizers, fitted models and packing have none.  The quantile sketches of
op6 hold every value of groups below ``SKETCH_K``, so that sorted lists give
the same fences on the tables that the SQL is run on.
"""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, {_WORD}) as ws from documents),
sh as (select doc_id, unnest(case when len(ws) = 0 or ws is null then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
  else list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) end) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) as component_id, coalesce(k.n_links, 0) as n_links
from documents d left join n on n.doc_id = d.doc_id left join (select a, min(b) as low from reach group by a) r on r.a = d.doc_id
left join (select a, count(*) as n_links from links group by a) k on k.a = d.doc_id"""

EMBEDDINGS = """with recursive v as (select vec_id, [cast(x as double) for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as norm from v),
links as (select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select d.vec_id, coalesce(k.n_links, 0) as n_links, least(d.vec_id, coalesce(r.low, d.vec_id)) as component_id, d.vec_id <= coalesce(r.low, d.vec_id) as kept
from embeddings d left join (select a, min(b) as low from reach group by a) r on r.a = d.vec_id
left join (select a, count(*) as n_links from links group by a) k on k.a = d.vec_id"""

#: Ratio -> (its SQL, slack), in the order of the reasons.
_RATIOS = {
    "symbol_ratio": ("n_symbols / greatest(word_chars, 1)", 0.04),
    "dup_line_ratio": ("n_dup_lines / greatest(n_lines, 1)", 0.4),
    "repeat_ratio": ("n_repeat_words / greatest(n_words, 1)", 0.35),
    "mark_ratio": ("n_marks / greatest(n_words, 1)", 0.05),
    "upper_ratio": ("n_upper / greatest(word_chars, 1)", 0.2),
    "mean_word": ("word_chars / greatest(n_words, 1)", 1.5),
}


def _quality() -> str:
    at = lambda c, p: f"list_sort(list({c}))[greatest(1, cast(ceil({p} * count(*)) as int))]"
    quartiles = ", ".join(f"{at(c, p)} as {c}_{n}" for c in _RATIOS for p, n in ((0.25, "low"), (0.75, "high")))
    mixed = lambda c, n: f"((g.n * g.{c}_{n} + 200 * l.{c}_{n}) / (g.n + 200))"
    spread = lambda c: f"4.0::double * ({mixed(c, 'high')} - {mixed(c, 'low')})"
    beyond = ["case when base_failed then 'base' end"]
    beyond += [f"case when r.{c} > {mixed(c, 'high')} + {spread(c)} + {slack}::double then '{c}' end" for c, (_, slack) in _RATIOS.items()]
    beyond.append(f"case when r.mean_word < {mixed('mean_word', 'low')} - {spread('mean_word')} - 1.5::double then 'mean_word_low' end")
    return f"""with t as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws, [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, {_WORD})] as ls from documents),
win as (select doc_id, unnest(range(1, len(ws) - 1)) as i, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) as s from t where len(ws) >= 3),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as c from win) where c > 1),
rep as (select doc_id, count(distinct i + k) as n from twice, range(3) r(k) group by doc_id),
st as (select t.doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, len(ls) as n_lines,
  len(regexp_extract_all(text, '[!?]{{2,}}')) as n_marks, len(regexp_extract_all(text, '[A-Z]')) as n_upper from t left join rep on rep.doc_id = t.doc_id),
r as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {", ".join(f"{sql} as {c}" for c, (sql, _) in _RATIOS.items())} from st),
g as (select lang, source, count(*) as n, {quartiles} from r where not base_failed group by lang, source),
l as (select lang, {quartiles} from r where not base_failed group by lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reasons = '' as kept, reasons
from (select r.*, concat_ws(',', {", ".join(beyond)}) as reasons from r left join g on r.lang is not distinct from g.lang and r.source is not distinct from g.source left join l on r.lang is not distinct from l.lang)"""


ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": JACCARD, "op4_embedding_dedup": EMBEDDINGS, "op6_quality_rules": _quality()}
