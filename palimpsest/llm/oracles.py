"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from palimpsest.llm import url_lists

SUBSTRING = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
least as (select k, min(doc_id) as m from win group by k),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join least using (k) where m < doc_id),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select word.doc_id, string_agg(x, ' ' order by word.p) as t, count(*) as n from word left join gone on gone.doc_id = word.doc_id and gone.p = word.p where gone.p is null group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""

NGRAM_JOIN = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
sides as (select a, b from link union select b, a from link),
reach(a, b) as (select a, b from sides union select r.a, e.b from reach r join sides e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce((select min(b) from reach where reach.a = d.doc_id), d.doc_id)) as component_id from d left join n using (doc_id)
"""

CONTAMINATION = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bm as (select item_id, w, least(13, len(w)) as m from b where len(w) > 0),
bw as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as k from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as i from bm)),
dw as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as k from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d cross join (select distinct m from bw))),
hit as (select doc_id, m, i, item_id from dw join bw using (m, k)),
nh as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + m)) as p from hit) group by 1),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as s from hit group by 1),
whole as (select item_id, row_number() over () as t, w, len(w) + 5 as span, len(list_distinct(w)) as need from b where item_id is not null and len(w) > 0),
term as (select distinct t, x from (select t, unnest(w) as x from whole)),
place as (select doc_id, unnest(w) as x, unnest(range(len(w))) as p from d),
met as (select doc_id, t, x, p from place join term using (x)),
full_set as (select doc_id, t from met join whole using (t) group by doc_id, t, need having count(distinct x) = need),
stretch as (select doc_id, item_id, need, count(distinct x) over (partition by doc_id, t order by p range between span - 1 preceding and current row) as c from met join full_set using (doc_id, t) join whole using (t)),
near as (select doc_id, count(distinct item_id) as n_near from stretch where c = need group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_near, 0) as n_near
from d left join nh using (doc_id) left join it using (doc_id) left join near using (doc_id)
"""

VARIANTS = r"""
with recursive t as (select [list_reduce(range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) for i in range(256)] as crc),
d as (select coalesce(doc_id::varchar, '') as i, regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+') as w from documents),
u as (select i, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from d), r as (select i, w, count(*) as n from u group by all),
b as (select w, n, list_concat([unicode(c) for c in string_split(i || ':', '')], flatten([case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end for c in string_split(w, '')])) as bytes from r),
h as (select w, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1]), 4294967295), 4294967295) as h from b, t),
m as (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from h),
words as (select word, sum(n)::bigint as n from m where length(word) >= 7 group by word having sum(n) >= 2),
cut as (select word, n, p, substr(word, 1, p) || substr(word, p + 2) as k from (select word, n, unnest(range(length(word))) as p from words)),
near as (select a.word, b.word as other, b.n as other_n from cut a join cut b on a.k = b.k and a.p = b.p and a.word != b.word
  union select a.word, b.word, b.n from cut a join words b on a.k = b.word union select b.word, a.word, a.n from cut a join words b on a.k = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
f as (select word, n, coalesce(n_near, 0)::bigint as n_near, case when other_n >= 10 * n then other end as form, case when other_n >= 10 * n then other_n end as form_n from words left join best using (word)),
chain(word, root, step) as (select word, word, 0 from f union all select c.word, f.form, c.step + 1 from chain c join f on f.word = c.root where f.form is not null)
select f.word, form, root, n, n_near, form_n from f join (select word, arg_max(root, step) as root from chain group by word) using (word)
"""

SQL = {"op1_substring_dedup": SUBSTRING, "op2_ngram_jaccard": NGRAM_JOIN, "op3_url_lists": url_lists.ORACLE, "op9_decontaminate": CONTAMINATION, "op11_spelling_variants": VARIANTS}
