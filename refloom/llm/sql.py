"""DuckDB SQL that gives the rows of the queries, written independently of them.

op1's mined rules, op2's shuffle, op3, op7, op9 and the pipeline have none: they
are tested against brute force instead.
"""

_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) as w from documents),
b as (select item_id::varchar as item, regexp_extract_all({_LOWER}, {_PLAIN}) as w from benchmark),
g as (
  select distinct item, least(len(w), 10) as n, w[i : i + least(len(w), 10) - 1] as gram
  from b, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as u(i) where len(w) > 0),
n as (select distinct n from g),
x as (
  select doc_id, i, n.n, w[i : i + n.n - 1] as gram
  from d, n, unnest(generate_series(1, len(w) - n.n + 1)) as u(i)),
h as (select x.doc_id, x.i, x.n, g.item from x join g on x.n = g.n and x.gram = g.gram),
p as (select doc_id, count(distinct i + k)::bigint as n_hit from h, unnest(generate_series(0, h.n - 1)) as u(k) group by doc_id),
q as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p on d.doc_id = p.doc_id left join q on d.doc_id = q.doc_id
"""


def _op5() -> str:
    from refloom.llm.licenses import PHRASES, TEMPLATES, THRESHOLD

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({quote(label)}, {quote(text)})" for label, text in TEMPLATES)
    places = " union all ".join(
        f"select doc_id, (i - 1)::bigint as wpos, {quote(label)} as label from d, unnest(generate_series(1, len(w))) as u(i) where w[i : i + {len(p.split()) - 1}] = [{', '.join(map(quote, p.split()))}]"
        for p, label in PHRASES.items()
    )
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all({_LOWER}, {_PLAIN}) as w from documents),
t as (select label, list_distinct(w) as w, len(w) as span from (select label, regexp_extract_all({_LOWER}, {_PLAIN}) as w from (values {templates}) as v(label, text))),
c as (select doc_id, d.w, label, t.w as tw, span from d join t on len(list_intersect(list_distinct(d.w), t.w)) >= ceil(len(t.w) * {THRESHOLD} - 1e-9)),
o as (select doc_id, label, len(tw) as n, len(list_intersect(w[i : i + span - 1], tw)) as o from c, unnest(generate_series(1, len(w))) as u(i) where list_contains(tw, w[i])),
f as (select doc_id, label, max(o / n) as c from o where o >= ceil(n * {THRESHOLD} - 1e-9) group by 1, 2),
p as ({places}),
b as (select doc_id, count(*)::bigint as n_base, min(wpos) as first_word, max(wpos) as last_word,
             string_agg(distinct label, ',' order by label) as base_labels from p group by 1),
a as (select doc_id, string_agg(distinct label, ',' order by label) as labels
      from (select doc_id, label from p union select doc_id, label from f) group by 1),
m as (select doc_id, max(c) as best from f group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(best, 0)::double end as score
from d left join b using (doc_id) left join a using (doc_id) left join m using (doc_id)
"""


OP6_BASE32 = """list_reduce(list_transform(generate_series(0, 31),
  lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(h, 1 + (i * 5) // 4, 2))::bigint >> (8 - 5 - (i * 5) % 4)) & 31)::int]), lambda a, b: a || b)"""

OP6 = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) || '0' as h from pages),
f as (select *, max(page_id) over (partition by html) as first from p)
select page_id, strlen(html)::bigint as payload_bytes, {OP6_BASE32} as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from f
"""

OP8 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(generate_series(1, len(c.v)), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, (row_number() over o)::int as rank, vec_id, score from s
window o as (partition by query_id order by score desc, vec_id)
qualify row_number() over o <= 20
"""

#: All products: op12 finds all of these where its window covers the table.
OP12 = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(c.v)), lambda i: q.v[i] * c.v[i])) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, (row_number() over o)::int as rank, vec_id, score from s
window o as (partition by query_id order by score desc, vec_id)
qualify row_number() over o <= 20
"""

OP10 = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
x as (select doc_id, i, w[i : i + 12] as g from d, unnest(generate_series(1, len(w) - 12)) as u(i)),
m as (select g, min(doc_id) as first from x group by g),
h as (select x.doc_id, x.i from x join m on x.g = m.g and m.first < x.doc_id),
c as (select distinct doc_id, i + k as wpos from h, unnest(generate_series(0, 12)) as u(k)),
r as (select doc_id, list(wpos) as gone from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: not coalesce(list_contains(gone, i), false)), ' ')) as kept_sha256
from d left join r using (doc_id)
"""

#: The checksum by its table of 256 entries, byte by byte.
_CRC = """list_reduce(list_concat([4294967295::bigint], list_transform(generate_series(1, strlen(k)::bigint), lambda i: ('0x' || substr(hex(k), 2 * i - 1, 2))::bigint)),
  lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))"""

OP11 = rf"""
with t as (select list_transform(generate_series(0, 255), lambda i: list_reduce(list_concat([i::bigint], generate_series(0, 7)),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as entries),
r as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents),
l as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from r group by 1, 2),
k as (select run, n, coalesce(doc_id::varchar, '') || ':' || run as k from l),
c as (select run, n, xor({_CRC}, 4294967295) as h from k, t),
d as (select case when h % 97 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run) + 2)::bigint) else run end as word, n from c),
w as (select word, sum(n)::bigint as n from d group by word having length(word) >= 5 and sum(n) >= 3),
x as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as v from w, unnest(generate_series(1, length(word))) as u(i)),
p as (
  select x.word, w.word as near, w.n as near_n from x join w on x.v = w.word
  union select w.word, x.word, x.n from x join w on x.v = w.word
  union select a.word, b.word, b.n from x a join x b on a.v = b.v and a.i = b.i and a.word <> b.word),
b as (select *, row_number() over (partition by word order by near_n desc, near) as o, count(*) over (partition by word) as n_near from p),
f as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end::bigint as form_n
  from w left join (from b where o = 1) b using (word)),
z as (with recursive z as (select word, word as root, form from f union all select z.word, f.word, f.form from z join f on z.form = f.word) select word, root from z where form is null)
select word, form, root, n, n_near, form_n from f join z using (word)
"""

OP13 = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select k, lang, source, unnest(w) as term from d),
v as (select lang, term from t group by 1, 2 having count(distinct k) >= 10),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join v using (lang, term) group by all),
s as (select lang, count(*) as v from v group by 1),
a as (select g.lang, g.source, v.term, coalesce(c.n, 0) as n from g join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = v.term),
p as (select a.*, 1 + ((1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v))::bigint as p from a join s using (lang)),
l as (select lang, term, sum(n) as n from a group by all),
q as (select lang, term, 1 + ((1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v))::bigint as q from l join s using (lang)),
pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(f, 0)::bigint as value
  from g x join g y on x.lang = y.lang and x.source <> y.source
  left join (select x.lang, x.source, y.source as other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as f from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) z
    on z.lang = x.lang and z.source = x.source and z.other = y.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q)
select *, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select *, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms qualify row_number() over (partition by lang, source order by value desc, item) <= 10
"""

SQL = {
    "op4_decontamination": OP4,
    "op5_licenses": _op5(),
    "op6_warc": OP6,
    "op8_topk": OP8,
    "op10_substrings": OP10,
    "op11_spelling": OP11,
    "op12_curves": OP12,
    "op13_divergence": OP13,
}
