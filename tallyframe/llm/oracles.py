"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5 = rf"""with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select *, {WORDS.format('text')} as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
windows as (select r, i, array_to_string(words[i:i+7], ' ') as s from (select r, words, unnest(range(1, greatest(len(words) - 6, 1))) as i from w)),
twice as (select r, i from (select *, count(*) over (partition by r, s) as c from windows) where c > 1),
covered as (select r, count(distinct i + k) as n from twice cross join range(8) t(k) group by 1),
m as (select w.r, doc_id, source, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from w left join covered c on c.r = w.r),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, n_symbols > 0.1 * n_words or n_dup_lines > 0.3 * n_lines or not (word_chars / greatest(n_words, 1) between 2.0 and 12.0) as soft_failed from m),
h as (select source, count(*) as n, count(*) filter (base_failed or soft_failed) as bad from f group by 1),
p as (select avg(bad / n) as m, greatest(0.0, coalesce(var_samp(bad / n) - avg((bad / n) * (1 - bad / n) / n), 0.0)) as v from h),
s as (select m, greatest(1.0, least(10000.0, coalesce(m * (1 - m) / nullif(v, 0) - 1, 10000.0))) as s from p),
shrunk as (select source, (bad + m * s) / (n + s) as rate, n, m, s from h cross join s),
rates as (select source, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1)) > least(m + 1.645 * sqrt(m * (1 - m) / (s + 1)), 0.5) as host_bad from shrunk)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (soft_failed and host_bad) as kept, soft_failed, host_bad, round(rate, 9) as host_rate from f join rates on f.source is not distinct from rates.source"""

OP8 = r"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, case when regexp_matches(text, '(?s)\\.') or contains(text, '### ') or contains(text, '</turn>') then replace(replace(replace(replace(text, '\', '\\'), '#', '\#'), ': ', ':\ '), '</turn>', '<\/turn>') else text end as body from t),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as source, coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss, cast(sum(4 + length(role) + 2 + length(body) + 8) as bigint) as formatted_chars from e group by 1)
select conv_id, n_turns, sha256(source) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, true as round_trip from g"""

OP9 = rf"""with recursive w as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i+4], ' ') as x from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
sides as (select a, b from links union select b, a from links),
reach as (select a, b from sides union select r.a, s.b from reach r join sides s on r.b = s.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) as component_id, least(w.doc_id, coalesce(m.least, w.doc_id)) = w.doc_id as kept
from w left join n on n.doc_id = w.doc_id left join (select a, min(b) as least from reach group by 1) m on m.a = w.doc_id"""

OP12 = r"""with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select c, count(*) as n from t group by 1),
h as (select c, c - c % 20 as base, xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(cast(c as varchar), ''), lambda x: [ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) % 4 as h from ids),
lent as (select h.c, h.h, h.base, least(h.h, coalesce(ids.n, 0)) as lent from h left join ids on ids.c = h.base),
seq as (select l.c, t.pos, t.role, t.text from lent l join t on t.c = l.base and t.pos <= l.h union all select l.c, t.pos - l.h + l.lent, t.role, t.text from lent l join t on t.c = l.c and t.pos > l.h),
path as (select c, 0 as d, '' as key, cast(null as varchar) as up, 0 as words from ids union all
  select c, pos, key, coalesce(lag(key) over (partition by c order by pos), '') as up, words from (select c, pos, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' order by pos) over (partition by c order by pos) as key, cast(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as bigint) as words from seq)),
node as (select key, any_value(up) as up, any_value(d) as d, any_value(words) as words, min(c) as conv_id, count(*) as n_convs from path group by 1),
kids as (select up, count(*) as n from node where up is not null group by 1),
full_node as (select node.*, coalesce(kids.n, 0) as n_children from node left join kids on kids.up = node.key),
total as (select p.key, sum(case when x.n_children = 0 then 1 else 0 end) as n_leaves, sum((x.n_convs - 1) * x.words) as saved_tokens from full_node x join path p on p.c = x.conv_id and p.d <= x.d group by 1),
ends as (select key, sha256(string_agg(cast(c as varchar), ',' order by c)) as digest from (select c, arg_max(key, d) as key from path group by 1) group by 1)
select x.conv_id, cast(x.d as bigint) as depth, u.conv_id as parent_conv_id, x.n_convs, x.n_children, cast(total.n_leaves as bigint) as n_leaves, cast(total.saved_tokens as bigint) as saved_tokens, coalesce(ends.digest, sha256('')) as ends_sha256
from full_node x left join node u on u.key = x.up join total on total.key = x.key left join ends on ends.key = x.key"""

OP11 = r"""with p as (select row_number() over () as r, page_id, url, coalesce(html, '') as html from pages),
d as (select *, count(*) over (partition by html) as n, row_number() over (partition by html order by page_id desc nulls last, url desc nulls last, r) as k, first_value(page_id) over (partition by html order by page_id desc nulls last, url desc nulls last, r) as target, sha1(html) || '00' as h from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(h, cast(1 + (5 * i) // 4 as int), 3) as int) >> cast(7 - (5 * i) % 4 as int)) & 31) as int), 1)), '') as payload_digest,
  case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then target end as refers_to from d"""

ORACLE_SQL = {"op5_host_quality": OP5, "op8_chat_formatting": OP8, "op9_minhash_near_dedup": OP9, "op11_warc_archives": OP11, "op12_conversation_trie": OP12}
