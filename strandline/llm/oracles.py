"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

#: The patterns of the secret scan, stated anew: kind, number, pattern.
_SECRETS = (
    ("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", 1, "AKIA[A-Z0-9]+"),
    ("hex", 2, "[0-9a-f]+"),
    ("random", 3, "[A-Za-z0-9+/_-]{20,}={0,2}"),
    ("account", 4, r"""(?i:user(?:name)?|login|client_?id|account)["\']?\x20*[:=]\x20*["\']?[A-Za-z0-9._@-]{3,}"""),
    ("endpoint", 5, "(?:https?|ftp|s3|jdbc|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9.:/_%?=&@-]+"),
    ("blank", -1, r"\n[\x20\t\r]*\n"),
)
_quoted = lambda pattern: "'" + pattern.replace("\\'", "'").replace("'", "''") + "'"
_SECRET_MATCHES = " union all ".join(f"select r, {no} no, '{kind}' kind, regexp_extract_all(t, {_quoted(p)}) f, string_split_regex(t, {_quoted(p)}) g from d" for kind, no, p in _SECRETS)

#: The patterns of personal data, stated anew.
_PERSONAL = (
    ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", 2, r"[0-9]([\x20-]?[0-9])+"),
    ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_PERSONAL_MATCHES = " union all ".join(f"select r, {no} no, '{kind}' kind, regexp_extract_all(t, {_quoted(p)}) f, string_split_regex(t, {_quoted(p)}) g from d" for kind, no, p in _PERSONAL)
_LUHN = "list_sum(list_transform(range(1, length(x) + 1), lambda i: case when (length(x) - i) % 2 = 1 then 2 * x[i]::int - case when x[i] > '4' then 9 else 0 end else x[i]::int end)) % 10 = 0"
_CRC = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end))"

SQL = {
    "op1_decontamination": rf"""
with d as (select doc_id, {_ITEM_WORDS} ws from documents),
b as (select item_id, {_ITEM_WORDS} ws from benchmark),
bl as (select item_id, ws, least(10, len(ws)) n from b where len(ws) > 0),
bq as (select item_id, ws, n, unnest(range(0, len(ws) - n + 1)) q from bl),
bw as (select distinct item_id, n, array_to_string(ws[q + 1 : q + n], ' ') w from bq),
dl as (select doc_id, ws, n from d, (select distinct n from bw) where len(ws) >= n),
dp as (select doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) p from dl),
h as (select doc_id, p, n, item_id from (select doc_id, p, n, array_to_string(ws[p + 1 : p + n], ' ') w from dp) join bw using (n, w)),
hw as (select doc_id, count(distinct i) n_hit from (select doc_id, unnest(range(p, p + n)) i from h) group by doc_id),
hi as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from h group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
""",
    "op2_ngram_jaccard_join": rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') ws from documents),
x as (select doc_id, ws, least(5, len(ws)) n from d where len(ws) > 0),
y as (select doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) i from x),
s as (select distinct doc_id, array_to_string(ws[i + 1 : i + n], ' ') sh from y),
c as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from p join c ca on ca.doc_id = a join c cb on cb.doc_id = b where 100 * k >= 75 * (ca.n + cb.n - k)),
r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, e.b from r join e on e.a = r.other)
select d.doc_id, coalesce(c.n, 0)::bigint n_shingles, m.component_id
from d left join c using (doc_id) join (select doc_id, min(other) component_id from r group by doc_id) m using (doc_id)
""",
    "op3_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
""",
    "op4_substring_dedup": rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') ws from documents),
p as (select doc_id, unnest(range(0, len(ws) - 12)) p from d where len(ws) >= 13),
w as (select doc_id, p, md5_number(array_to_string(ws[p + 1 : p + 13], ' ')) h from p join d using (doc_id)),
f as (select h, min(doc_id) least from w group by h),
g as (select distinct doc_id, unnest(range(p, p + 13)) i from w join f using (h) where least < doc_id),
a as (select doc_id, unnest(ws) w, unnest(range(0, len(ws))) i from d),
k as (select doc_id, string_agg(w, ' ' order by i) kept, count(*) n from (select a.* from a left join g using (doc_id, i) where g.doc_id is null) group by doc_id)
select doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
from d left join k using (doc_id)
""",
    "op5_suffix_array_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
n as (select doc_id, x, len(x) // 2 n from d),
p as (select doc_id, unnest(range(0, n - 49)) p from n where n >= 50),
w as (select doc_id, p, md5_number(substring(x, 2 * p + 1, 100)) h from p join n using (doc_id)),
f as (select h, min(doc_id) least from w group by h),
g as (select doc_id, p from w join f using (h) where least < doc_id),
i as (select doc_id, p, p + 50 e, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end fresh from g),
r as (select doc_id, p, e, sum(fresh) over (partition by doc_id order by p) run from i),
s as (select doc_id, run, min(p) b, max(e) e from r group by doc_id, run),
q as (select doc_id, b, e, lag(e, 1, 0) over (partition by doc_id order by b) before from s),
k as (select doc_id, sum(e - b) gone, count(*) runs, string_agg(substring(x, 2 * before + 1, 2 * (b - before)), '' order by b) || any_value(substring(x, 2 * last + 1)) kept
  from q join n using (doc_id) join (select doc_id, max(e) last from q group by doc_id) using (doc_id) group by doc_id)
select doc_id, n::bigint n_bytes, coalesce(gone, 0)::bigint n_removed, coalesce(runs, 0)::bigint n_spans, sha256(unhex(coalesce(kept, x))) kept_sha256
from n left join k using (doc_id)
""",
    "op7_secrets": f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
m as ({_SECRET_MATCHES}),
x as (select r, no, kind, unnest(f) v, unnest(range(1, len(f) + 1)) i, unnest(list_transform(g[1:len(f)], lambda y: length(y))) gap from m where len(f) > 0),
y as (select r, no, kind, v, sum(gap + length(v)) over (partition by r, no order by i) e from x),
p as (select r, no, kind, v, (e - length(v))::int s, e::int e from y where no <> 0 or length(regexp_extract(v, {_quoted(_SECRETS[0][2])}, 2)) >= 12),
base as (select r, no, kind, s, e from p where no = 0 or (no = 1 and length(v) >= 18) or (no = 2 and length(v) >= 16)),
weak as (select r, no, kind, s, e from p where no in (4, 5) or (no = 3 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]'))),
free as (select * from weak w where not exists (select 1 from base b where b.r = w.r and b.s < w.e and w.s < b.e)),
every as (select *, (select count(*) from p l where l.r = q.r and l.no = -1 and l.e <= q.s) scope from (select * from base union all select * from free) q),
linked as (select distinct w.r, w.no, w.kind, w.s, w.e from every w join every b on w.r = b.r and w.scope = b.scope and greatest(b.s - w.e, w.s - b.e) <= 200
  and ((w.no = 3 and b.no in (1, 4, 5)) or (w.no in (4, 5) and b.no in (0, 2, 3)))),
label as (select r, string_agg(kind || ':' || s || ':' || e, ',' order by s, no, e) spans from (select * from base union all select * from linked) group by r),
own as (select r, count_if(no = 0) n0, count_if(no = 1) n1, count_if(no = 2) n2, string_agg(kind || ':' || s || ':' || e, ',' order by s, no, e) spans from base group by r)
select doc_id, coalesce(n0, 0)::bigint n_assign, coalesce(n1, 0)::bigint n_access, coalesce(n2, 0)::bigint n_hex, sha256(coalesce(own.spans, '')) base_sha256, coalesce(label.spans, '') spans
from d left join own using (r) left join label using (r)
""",
    "op11_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, a.label own, c.vec_id, c.label, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: a.v[i] * c.v[i]))::bigint score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select anchor_id, vec_id positive_id, score positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) r from s where label = own),
n as (select anchor_id, positive_id, positive_score, s.vec_id negative_id, s.score negative_score,
  row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id)::int rank
  from p join s using (anchor_id) where r <= 5 and s.label <> s.own and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
""",
    "op12_chat_format": rf"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
f as (select *, len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) more from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(length(role) + length(text) + more + {len("<|im_start|>" + "<|im_end|>") + 2})::bigint formatted_chars
from f group by conv_id
""",
    "op13_lexical_search": rf"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') ws from documents),
d as (select row_number() over () r, doc_id, ws, len(ws)::bigint n from t where len(ws) > 0),
q as (select item_id, w from (select item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) w from benchmark)),
l as (select count(*)::bigint nn, sum(n)::bigint ll from d),
tf as (select r, w, count(*)::bigint tf from (select r, unnest(ws) w from d) where w in (select w from q) group by r, w),
wt as (select w, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint weight from (select w, count(*) df from tf group by w), l),
x as (select r, doc_id, 25 + ((75 * n * nn) // ll) m from d, l),
s as (select item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from q join wt using (w) join tf using (w) join x using (r) group by item_id, r, doc_id),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int rank from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10
""",
    "mixing_targets": rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint size from documents),
s as (select source, sum(size)::bigint words, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] weight from d group by source),
o as (select *, 2 * words / weight part, row_number() over (order by 2 * words / weight, weight, source nulls last) k from s),
a as (select *, 1.5::double * sum(words) over () - coalesce(sum(2 * words) over (order by k rows between unbounded preceding and 1 preceding), 0) left_over,
  sum(weight) over (order by k rows between current row and unbounded following) open_weight from o),
c as (select min(k) k from a where left_over * weight / open_weight <= 2 * words),
f as (select a.left_over, a.open_weight, c.k from c join a using (k)),
t as (select source, words, case when k >= (select k from f) then (select left_over from f) * weight / (select open_weight from f) else (2 * words)::double end target from a)
select doc_id, size, words source_size, target::double target from d join t on d.source is not distinct from t.source
""",
    "language_folds": rf"""
select doc_id, coalesce(xor({_CRC}, 4294967295::bigint) % 5 = 0, false) held_out, not regexp_matches(coalesce(text, ''), '\p{{L}}') undetermined from documents
""",
    "token_text_bytes": "select doc_id, coalesce(strlen(text), 0)::bigint n_bytes, false more_tokens_than_bytes from documents",
    "pii_base_spans": f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
m as ({_PERSONAL_MATCHES}),
u as (select r, no, kind, unnest(f) v, unnest(range(1, len(f) + 1)) i, unnest(list_transform(g[1:len(f)], lambda y: length(y))) gap from m where len(f) > 0),
y as (select r, no, kind, v, regexp_replace(v, '[^0-9]', '', 'g') x, sum(gap + length(v)) over (partition by r, no order by i) e from u),
p as (select r, no, kind, (e - length(v))::int s, e::int e from y where no = 0
  or (no = 1 and len(list_filter(string_split(v, '.'), lambda n: length(ltrim(n, '0')) > 3 or (length(ltrim(n, '0')) = 3 and ltrim(n, '0') > '255'))) = 0)
  or (no = 2 and length(x) between 16 and 19 and {_LUHN}) or (no = 3 and length(x) between 8 and 15)),
own as (select r, count_if(no = 0) n0, count_if(no = 1) n1, count_if(no = 2) n2, count_if(no = 3) n3, string_agg(kind || ':' || s || ':' || e, ',' order by no, s) spans from p group by r)
select doc_id, coalesce(n0, 0)::bigint n_email, coalesce(n1, 0)::bigint n_ip, coalesce(n2, 0)::bigint n_card, coalesce(n3, 0)::bigint n_phone, sha256(coalesce(spans, '')) base_sha256
from d left join own using (r)
""",
}
