"""DuckDB SQL for the rows of the queries that SQL can express."""

EXACT = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
g as (select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size, sha256(body) as text_sha256 from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""

CHAT = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) is distinct from role as opens,
    length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<|', ''))) // 2 as text_chars,
    length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<|', ''))) // 2 + 3 * (length(role) - length(replace(role, chr(10), ''))) as role_chars
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(text_chars + case when opens then role_chars + 13 + 11 else 8 end) as bigint) as formatted_chars
from e group by conv_id
"""

_STOP = (
    "'the','of','and','to','in','that','is','was','for','with','on','are','as','by','at','from','this','it','an','be',"
    "'der','die','das','und','zu','den','von','mit','ist','nicht','ein','eine','im','auf','es',"
    "'le','la','les','de','des','du','et','un','une','en','que','qui','dans','pour','est','avec',"
    "'el','los','las','del','y','una','por','con','para','se','lo'"
)
QUALITY = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(regexp_split_to_array(translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?()"''', ''), '[\x20\x09-\x0D]+'), lambda x: x in ({_STOP})) as stops,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
r as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
c as (select doc_id, sum(least(3, coalesce(nxt - i, 3))) as n from r group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words, len(ls) as n_lines, len(stops) as n_stop
  from w left join c on w.doc_id = c.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
    and word_chars / n_words::double between 2.0 and 16.0 and n_symbols / n_words::double <= 0.25
    and n_stop / n_words::double >= 0.01 and n_dup_lines / n_lines::double <= 0.6 as kept
from m
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as keep from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> keep then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> keep then keep end as refers_to from g
"""

PHRASES = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') as ws from d),
t as (select lang, cast(sum(len(ws)) as bigint) as n from p group by lang),
g as (select lang, m, ws[i:i + m - 1] as ph from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from p, (select unnest([1, 2, 3, 4, 5]) as m) where len(ws) >= m)),
f as (select lang, m, ph, count(*) as a from g group by lang, m, ph having count(*) >= 100),
k as (select f.lang, f.m, f.ph, f.a, unnest(range(1, f.m)) as k from f where f.m >= 2),
c as (select k.*, x.a as l, y.a as r, t.n, (1000::hugeint * k.a * t.n) // (x.a::hugeint * y.a) as score
  from k join t on t.lang = k.lang join f x on x.lang = k.lang and x.ph = k.ph[1:k.k] join f y on y.lang = k.lang and y.ph = k.ph[k.k + 1:k.m]),
b as (select * from c qualify row_number() over (partition by lang, ph order by score, k) = 1),
inside as (select lang, ph[1:m - 1] as ph, a from f where m > 2 union all select lang, ph[2:m], a from f where m > 2),
u as (select b.* from b where not exists (select 1 from inside i where i.lang = b.lang and i.ph = b.ph and i.a >= b.a)),
o as (select lang, array_to_string(ph, ' ') as phrase, a, l, r, n, score from u)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score
from o qualify rank <= 2000
"""

TRIE = """
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as d, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
h as (select c, n, c - c % 5 as b, xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(c::varchar, ''), lambda ch: list_transform(range(0, 8), lambda j: (ord(ch)::bigint >> j::bigint) & 1))),
    lambda x, y: case when xor(x, y) & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end), 4294967295::bigint) % 9 as h from (select c, count(*) as n from t group by c)),
r as (select h.c, t.d, role, text from h join t on t.c = h.b where t.d <= h.h
  union all select h.c, least(h.h, coalesce(z.n, 0)) + t.d - h.h, role, text from h join t on t.c = h.c left join h z on z.c = h.b where t.d > h.h),
s as (select h.c, coalesce(list({'r': role, 't': text} order by d) filter (where d is not null), []) as q from h left join r on r.c = h.c group by h.c),
p as (select c, k as depth, q[1:k] as pre, len(q) = k as done from (select c, q, unnest(range(0, len(q) + 1)) as k from s)),
v as (select pre, depth, min(c) as conv_id, count(*) as n_convs, case when depth = 0 then 0 else strlen(pre[depth].t) end as bytes,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where done), '')) as ends_sha256 from p group by pre, depth),
k as (select pre[1:depth - 1] as pre, count(*) as n from v where depth > 0 group by 1),
u as (select pre[1:i] as pre, sum((n_convs - 1) * bytes) as saved, count(*) filter (where leaf) as leaves
  from (select v.pre, n_convs, bytes, k.n is null as leaf, unnest(range(0, depth + 1)) as i from v left join k on k.pre = v.pre) group by 1)
select v.conv_id, v.depth, w.conv_id as parent_conv_id, v.n_convs, coalesce(k.n, 0) as n_children, u.leaves as n_leaves, cast(u.saved as bigint) as saved_tokens, v.ends_sha256
from v join u on u.pre = v.pre left join k on k.pre = v.pre left join v w on v.depth > 0 and w.pre = v.pre[1:v.depth - 1]
"""

URL_RULES = """
with p as (select page_id, coalesce(url, '') as u from pages),
q as (select page_id, case when strpos(u, '://') > 0 then substr(u, strpos(u, '://') + 3) else '' end as rest from p),
r as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from q),
k as (select * from (values ('com', '/en/'), ('example.com', '/en/7'), ('net', '/de/'), ('example.net', '/de/8'), ('org', '/es/')) as t(h, s))
select page_id, host, path, (select arg_max(h || s, length(h || s)) from k where (host = h or ends_with(host, '.' || h)) and starts_with(path, s)) as rule from r
"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
SECRETS = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
k as (select * from (values ('assign', 0), ('access', 1), ('hex', 2)) as t(kind, o)),
h as (select doc_id, kind, o, case o when 0 then regexp_split_to_array(text, '{_ASSIGN}') when 1 then regexp_split_to_array(text, 'AKIA[A-Z0-9]+') else regexp_split_to_array(text, '[0-9a-f]+') end as p,
    case o when 0 then regexp_extract_all(text, '{_ASSIGN}') when 1 then regexp_extract_all(text, 'AKIA[A-Z0-9]+') else regexp_extract_all(text, '[0-9a-f]+') end as m from d, k),
l as (select doc_id, kind, o, m, list_transform(p, lambda x: length(x)) as g, list_transform(m, lambda x: length(x)) as w,
    case o when 0 then list_transform(m, lambda x: length(regexp_extract(x, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8) when 1 then list_transform(m, lambda x: length(x) >= 16) else list_transform(m, lambda x: length(x) >= 32) end as good from h),
s as (select doc_id, kind, o, i, list_sum(g[1:i]) + coalesce(list_sum(w[1:i - 1]), 0) as a, w[i] as n from (select *, unnest(list_filter(range(1, len(m) + 1), lambda i: good[i])) as i from l)),
r as (select doc_id, count(*) filter (where o = 0) as n_assign, count(*) filter (where o = 1) as n_access, count(*) filter (where o = 2) as n_hex,
    string_agg(kind || ':' || cast(a as bigint) || ':' || cast(a + n as bigint), ',' order by a, o) as spans from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join r on r.doc_id = d.doc_id
"""

ORACLES = {"op1_exact_dedup": EXACT, "op4_chat_format": CHAT, "op6_quality": QUALITY, "op11_warc": WARC, "op12_phrases": PHRASES, "op13_trie": TRIE, "url_rules": URL_RULES, "secret_counts": SECRETS}
