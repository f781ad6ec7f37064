"""DuckDB SQL for the registered queries of the text operators that SQL can express.

XXH64 fingerprints, fitted models, tokenizers and HTML trees are beyond SQL; tests compare those with brute force.
"""

from __future__ import annotations

from tidemark.llm.decontamination import WINDOW as PHRASE
from tidemark.llm.line_dedup import NEAR_CHARS
from tidemark.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS
from tidemark.llm.substring_dedup import WINDOW

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, {_WORDS} w from documents),
p as (select rid, unnest(w) x, generate_subscripts(w, 1) k from d),
g as (select rid, k, x || ' ' || lead(x) over q || ' ' || lead(x, 2) over q g from p window q as (partition by rid order by k)),
m as (select rid, g from g where g is not null group by 1, 2 having count(*) > 1),
c as (select rid, count(distinct k + o) n from (select g.rid, g.k, unnest([0, 1, 2]) o from g join m on m.rid = g.rid and m.g = g.g) group by 1),
l as (select rid, count(*) n, count(*) - count(distinct x) dup from (select rid, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1),
s as (select d.rid, doc_id, t, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, coalesce(l.dup, 0)::bigint n_dup_lines, coalesce(l.n, 0) n_lines, coalesce(c.n, 0)::bigint n_repeat_words
  from d left join l on l.rid = d.rid left join c on c.rid = d.rid),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not 10 * n_symbols > n_words and not 2 * len(regexp_extract_all(t, '[A-Z]')) > len(regexp_extract_all(t, '[A-Za-z]')) and not 5 * len(regexp_extract_all(t, '!')) > n_words
  and not 10 * len(regexp_extract_all(t, '[0-9]')) > 3 * word_chars and not (word_chars < 2 * n_words or word_chars > 15 * n_words) and not 2 * n_dup_lines > n_lines kept from b"""

OP4 = r"""
with t as (select conv_id, case when conv_id is null then row_number() over () end alone, turn, coalesce(role, 'unknown') r, coalesce(text, '') x from conversations union all select -7, null, 0, 'user', '\### Assistant: </turn> ok' union all select -7, null, 1, 'assistant', '\### Assistant: </turn> ok'),
o as (select *, lag(r) over q p, lead(r) over q n from t window q as (partition by conv_id, alone order by turn nulls first, r, x)),
c as (select *, length(x) + len(regexp_extract_all(x, '<\\*/(?:turn|part)>')) + len(regexp_extract_all(x, '#\\*## ')) + case when n = r then 7 else 8 end
  + case when p = r then 0 else 6 + length(replace(replace(replace(replace(r, '\', '\b'), ':', '\c'), chr(10), '\n'), '<', '\l')) end chars from o)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
  coalesce(sum(length(x)) filter (where r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (where r = 'assistant'), '')) loss_sha256, sum(chars)::bigint formatted_chars from c group by conv_id, alone"""

OP5 = rf"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) k from documents),
u as (select x, min(row(doc_id, k)) f, length(x) n from l where regexp_matches(x, '[^ \t\r\x0b\x0c]') group by 1),
h as (select x, f, n, m, side, case side when 0 then left(x, m // 2) else substr(x, n - m // 2 + 1) end s from (select *, unnest([n, n - 1]) m from u where n >= {NEAR_CHARS}) cross join (values (0), (1)) v(side)),
c as (select distinct a.x a, b.x b, a.n na, b.n nb, b.f fb from h a join h b on a.m = b.m and a.side = b.side and a.s = b.s and b.f < a.f and abs(a.n - b.n) <= 1),
q as (select a, min(fb) e from c where case when na = nb then len(list_filter(range(1, na + 1), lambda i: left(a, i::int - 1) = left(b, i::int - 1) and substr(a, i::int + 1) = substr(b, i::int + 1)))
  when na > nb then len(list_filter(range(1, na + 1), lambda i: left(a, i::int - 1) = left(b, i::int - 1) and substr(a, i::int + 1) = substr(b, i::int)))
  else len(list_filter(range(1, nb + 1), lambda i: left(a, i::int - 1) = left(b, i::int - 1) and substr(a, i::int) = substr(b, i::int + 1))) end > 0 group by 1),
z as (select l.*, u.f is not null and row(doc_id, k) > least(u.f, coalesce(q.e, u.f)) gone from l left join u on u.x = l.x left join q on q.a = l.x)
select doc_id, count(*) n_lines, count(*) filter (where gone) n_removed, sha256(coalesce(string_agg(x, chr(10) order by k) filter (where not gone), '')) kept_sha256 from z group by 1"""

_FOLDED = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
with d as (select doc_id, {_FOLDED} w from documents), i as (select item_id::varchar item_id, {_FOLDED} w from benchmark),
iw as (select item_id, unnest(range(1, greatest(len(w) - {PHRASE}, 0) + 2)) k, w, least(len(w), {PHRASE}) n from i where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') g from iw),
dk as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) k from d cross join (select distinct n from win) where len(w) >= n),
dw as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') g from dk),
hit as (select doc_id, k, dw.n, item_id from dw join win on win.g = dw.g and win.n = dw.n),
cov as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + n)) p from hit) group by 1),
its as (select doc_id, count(*) n, string_agg(item_id, ',' order by item_id) s from (select distinct doc_id, item_id from hit) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(its.n, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join cov on cov.doc_id = d.doc_id left join its on its.doc_id = d.doc_id"""

OP9 = f"""
with d as (select doc_id, {_WORDS} w from documents),
k as (select doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) k from d where len(w) >= {WINDOW}),
g as (select doc_id, k, hash(array_to_string(w[k:k + {WINDOW - 1}], ' ')) h from k),
m as (select h from g group by 1 having count(*) > 1),
c as (select distinct doc_id, unnest(range(k, k + {WINDOW})) p from g join m on m.h = g.h),
p as (select doc_id, unnest(w) x, generate_subscripts(w, 1) p from d),
s as (select p.doc_id, count(c.p) n, string_agg(x, ' ' order by p.p) filter (where c.p is null) t from p left join c on c.doc_id = p.doc_id and c.p = p.p group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(s.n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join s on s.doc_id = d.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op4_chat_format": OP4,
    "op5_line_dedup": OP5,
    "op7_decontamination": OP7,
    "op9_substring_dedup": OP9,
}
