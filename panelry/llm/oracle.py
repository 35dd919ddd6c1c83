"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

_TOP_K = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) w
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (
  select q.vec_id query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) score
  from usable q join usable c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) "rank" from scores)
select query_id, cast("rank" as integer) "rank", vec_id, score from ranked where "rank" <= 10
"""

_URLS = """
with parts as (
  select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end rest from pages
),
named as (
  select page_id, regexp_extract(rest, '^([^/?#]*)', 1) raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from parts
),
cased as (
  select page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(path, '') path from named
),
rules(verdict, h, p) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
),
hits as (
  select page_id, arg_max(h || p, length(h || p)) "rule", arg_max(verdict, length(h || p)) verdict
  from cased join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select page_id, host, path, "rule", coalesce(verdict, 'allow') verdict from cased left join hits using (page_id)
"""

_VECTORS = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) x from embeddings
),
usable as (
  select vec_id, label, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) n from v
  where x is not null and label is not null and len(list_filter(x, lambda a: a is null or not isfinite(a))) = 0
    and list_sum(list_transform(x, lambda a: a * a)) > 0
),
links as (
  select a.vec_id a, b.vec_id b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
  where list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) / (a.n * b.n) >= 0.93
),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
groups as (select a vec_id, min(b) low from reach group by a),
counts as (select a vec_id, count(*) n from links group by a)
select vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(low, vec_id)) component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) kept
from embeddings left join counts using (vec_id) left join groups using (vec_id)
"""

_DOCUMENTS = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents
),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(
      case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) s
    from words)
),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
shared as (
  select a.doc_id a, b.doc_id b, count(*) m from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * m >= 85 * (x.n + y.n - m)
),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
groups as (select a doc_id, min(b) low from reach group by a)
select doc_id, coalesce(n, 0) n_shingles, least(doc_id, coalesce(low, doc_id)) component_id,
  doc_id = least(doc_id, coalesce(low, doc_id)) kept
from documents left join sizes using (doc_id) left join groups using (doc_id)
"""


def crc32_views(source: str) -> str:
    """Views that end in ``sums`` (s, crc): the checksum of every string of the view ``source`` (s, distinct).

    A checksum is linear in its bytes, so it is the exclusive or of a value per byte and distance from the end.
    """
    return rf"""
bits(b, k, v) as (
  select b, 0, cast(b as bigint) from range(256) t(b)
  union all select b, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8
),
crc_table as (select b, v from bits where k = 8),
spelt as (select s, hex(encode(s)) h, octet_length(encode(s)) m from {source}),
reach as (select max(m) most from spelt),
ends(p, b, v) as (
  select 0, b, v from crc_table
  union all select p + 1, e.b, xor(e.v >> 8, t.v) from ends e join crc_table t on t.b = e.v & 255 where p < (select most from reach)
),
blank(p, v) as (
  select 0, cast(4294967295 as bigint)
  union all select p + 1, xor(e.v >> 8, t.v) from blank e join crc_table t on t.b = e.v & 255 where p < (select most from reach)
),
octets as (select s, m - i p, cast('0x' || h[2 * i - 1 : 2 * i] as bigint) b from (select *, unnest(range(1, m + 1)) i from spelt)),
folded as (select s, bit_xor(v) v from octets join ends using (p, b) group by s),
sums as (select s, xor(xor(coalesce(f.v, 0), blank.v), 4294967295) crc from spelt left join folded f using (s) join blank on blank.p = m)"""


_LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULES = rf"""
with recursive texts as (
  select row_number() over () id, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
),
places as (select id, doc_id, unnest(w) s, unnest(range(1, len(w) + 1)) i from texts),
vocabulary as (select distinct s from places),
{crc32_views('vocabulary')},
grams as (
  select id, doc_id, i, crc, coalesce(lead(crc) over (partition by id order by i), 0) after from places join sums using (s)
),
buckets as (
  select id, doc_id, crc % 16384 b from grams union all select id, doc_id, (31 * crc + after) % 16384 from grams
),
trusted as (select distinct doc_id from labels where quality = 1 and doc_id is not null),
counts as (
  select b, coalesce(r, 0) r, coalesce(t, 0) t from range(16384) x(b) left join (select b, count(*) r from buckets group by b) using (b)
  left join (select b, count(*) t from buckets semi join trusted using (doc_id) group by b) using (b)
),
totals as (select sum(r) all_r, sum(t) all_t from counts),
weights as (select b, ln((t + 1) / (all_t + 16384)) - ln((r + 1) / (all_r + 16384)) weight from counts, totals),
scores as (select id, avg(weight) score from buckets join weights using (b) group by id),
windows as (select id, unnest(range(1, len(w) - 3)) i, w from texts),
found as (select id, i, w[i : i + 4] five from windows),
repeated as (select id, i from found join (select id, five from found group by all having count(*) > 1) using (id, five)),
covered as (select id, count(distinct i + k) n from repeated, range(5) t(k) group by id),
lines as (select id, unnest(string_split(t, chr(10))) line from texts),
repeats as (select id, count(*) - count(distinct line) n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by id),
based as (
  select id, doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(coalesce(r.n, 0) as bigint) n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) n_repeat_words, coalesce(score, 0) score
  from texts left join repeats r using (id) left join covered c using (id) left join scores using (id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and score >= -0.2 kept
from based
"""

_PHRASES = rf"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWERED.format('text')}, '[.,;:!?\x0A-\x0D]')) p from documents
),
words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces),
sizes as (select lang, cast(sum(len(w)) as bigint) n from words group by lang),
grams as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from words, range(1, 6) t(k))
),
frequent as (select lang, k, phrase, count(*) f from grams group by all having count(*) >= 100),
free as (
  select * from frequent c where k > 1 and not exists (
    select 1 from frequent x where x.lang = c.lang and x.k > c.k and x.f >= c.f and contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
),
cuts as (select lang, phrase, f a, string_split(phrase, ' ') w, unnest(range(1, k)) j from free),
scored as (
  select c.lang, c.phrase, a, x.f l, y.f r, n, j, cast((1000::hugeint * a * n) // (x.f::hugeint * y.f) as bigint) score
  from cuts c join sizes using (lang) join frequent x on x.lang = c.lang and x.phrase = array_to_string(w[1 : j], ' ')
    join frequent y on y.lang = c.lang and y.phrase = array_to_string(w[j + 1 :], ' ')
),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) "rank" from weakest)
select lang, "rank", phrase, a, l, r, n, score from ranked where "rank" <= 2000
"""

_SPELLING = rf"""
with recursive runs as (
  select doc_id, {_LOWERED.format('run')} run
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) run from documents) where length(run) >= 7
),
named as (select coalesce(cast(doc_id as varchar), '') || ':' || run s, run, count(*) m from runs group by all),
{crc32_views('named')},
damaged as (
  select case when crc % 31 = 0 then run[: crc % length(run)] || run[crc % length(run) + 2 :] else run end word, m
  from named join sums using (s)
),
observed as (select word, cast(sum(m) as bigint) n from damaged where length(word) >= 7 group by word having sum(m) >= 2),
shorter as (
  select word, n, i, word[: i - 1] || word[i + 1 :] rest from (select word, n, unnest(range(1, length(word) + 1)) i from observed)
),
pairs as (
  select a.word, b.word other, b.n m from shorter a join shorter b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select s.word, o.word, o.n from shorter s join observed o on s.rest = o.word
  union select o.word, s.word, s.n from shorter s join observed o on s.rest = o.word
),
best as (select word, count(*) n_near, max(m) most from pairs group by word),
first as (select p.word, min(other) other from pairs p join best b on p.word = b.word and p.m = b.most group by p.word),
formed as (
  select o.word, case when most >= 10 * n then other end form, n, coalesce(n_near, 0) n_near, case when most >= 10 * n then most end form_n
  from observed o left join best using (word) left join first using (word)
),
walk(word, root, step) as (
  select word, word, 0 from formed union all select w.word, f.form, step + 1 from walk w join formed f on f.word = w.root where f.form is not null
),
roots as (select word, arg_max(root, step) root from walk group by word)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""

ORACLES = {
    "op1_topk_search": _TOP_K,
    "op2_minhash_dedup": _DOCUMENTS,
    "op4_url_filter": _URLS,
    "op7_embedding_dedup": _VECTORS,
    "op11_quality_rules": _RULES,
    "op12_collocations": _PHRASES,
    "op13_spelling": _SPELLING,
}
