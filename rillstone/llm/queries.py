"""The queries of this subpackage and their SQL, by name.

SQL can't express the rest: op1 (tree scoring), op2, op6 and op7 (tokenizers), op4 (XXH64), op9 (iterated learning) and op10 (fitted
filters) are tested against brute force, exact round trips or held-out rows in tests/llm.
"""

from __future__ import annotations

from .embedding_dedup import op8_embedding_dedup
from .html_extract import op1_html_extract
from .language_id import op10_language_id
from .packing import op2_packing
from .pii import op9_pii
from .quality import op3_quality
from .sentencepiece_codec import op6_sentencepiece
from .simhash import op4_simhash
from .substring_dedup import op5_substring_dedup
from .token_counts import op7_token_counts

QUERIES = {f.__name__: f for f in (op1_html_extract, op2_packing, op3_quality, op4_simhash, op5_substring_dedup, op6_sentencepiece, op7_token_counts, op8_embedding_dedup, op9_pii, op10_language_id)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op3_quality": rf"""
with d as (select doc_id, coalesce(text, '') as t, {WORDS} as ws from documents),
m as (
    select doc_id, t, ws, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from d
),
tri as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as times from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) >= 3)),
rep as (select doc_id, count(distinct k) as n from (select doc_id, unnest([i, i + 1, i + 2]) as k from tri where times > 1) group by doc_id),
x as (
    select m.doc_id, n_words, word_chars, n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
        strlen(regexp_replace(array_to_string(ws, ''), '[^A-Z]', '', 'g')) as n_upper
    from m left join rep on rep.doc_id = m.doc_id
),
y as (
    select *,
        case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 10 * n_symbols > n_words then 4 else 0 end
        + case when n_lines >= 5 and 10 * n_dup_lines > 3 * n_lines then 8 else 0 end + case when word_chars > 15 * n_words then 16 else 0 end
        + case when word_chars < 2 * n_words then 32 else 0 end + case when 10 * n_upper > 6 * word_chars then 64 else 0 end as failed
    from x
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
    n_repeat_words::bigint as n_repeat_words, failed & 3 <> 0 as base_failed, failed & 63 = 0 as kept, failed::bigint as failed
from y
""",
    "op5_substring_dedup": rf"""
with w as (select doc_id, {WORDS} as ws from documents),
p as (select doc_id, i, array_to_string(ws[i : i + 34], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)),
hit as (select doc_id, i from (select doc_id, i, count(*) over (partition by s) as n from p) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as k from hit),
word as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as k from w),
kept as (select doc_id, string_agg(x, ' ' order by k) as t from word anti join gone using (doc_id, k) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join (select doc_id, count(*) as n from gone group by doc_id) as g on g.doc_id = w.doc_id left join kept on kept.doc_id = w.doc_id
""",
    "op8_embedding_dedup": """
with recursive v as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pair as (select a.vec_id as a, b.vec_id as b from v as a join v as b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from reach as r join pair as p on p.a = r.b)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.c as component_id, e.vec_id = c.c as kept
from embeddings as e left join (select a, count(*) as n from pair group by a) as n on n.a = e.vec_id left join (select a, min(b) as c from reach group by a) as c on c.a = e.vec_id
""",
}
