"""DuckDB SQL for the registered study queries, over the same Parquet tables."""

from __future__ import annotations

import re

from tidemark.config import HOURLY as C
from tidemark.operators.align import BAD_PRICE, NO_NEXT, NO_PREVIOUS
from tidemark.operators.taxonomy import COMPANIONS, SUBJECTS

_SUBJECTS = ", ".join(f"('{s}', {k}, {str(s in COMPANIONS).lower()})" for k, s in enumerate(SUBJECTS, 1))

BARS = """
raw as (select event_type symbol, date_trunc('hour', ts) ts, arg_min(value, ts) open, max(value) hi, min(value) lo, arg_max(value, ts) close, count(*)::double volume from events group by 1, 2),
bars as (select symbol, ts, open, greatest(open, hi, lo, close) high, least(open, hi, lo, close) low, close, volume, ts::date session_date, hour(ts) * 60 + minute(ts) minute_of_day, ts + interval 1 hour bar_end,
  row_number() over (partition by symbol order by ts) - 1 bar_seq, row_number() over (partition by symbol, ts::date order by ts) - 1 bar_in_session, lag(close) over (partition by symbol order by ts) prev_bar_close from raw),
sess0 as (select symbol, session_date, count(*) n_bars, min(ts) first_ts, max(ts) last_ts, sum(volume) volume, arg_max(close, ts) close from bars group by 1, 2),
sess as (select *, row_number() over w - 1 session_pos, count(*) over (partition by symbol) n_sessions, sum(n_bars) over w - n_bars first_seq, sum(n_bars) over w - 1 last_seq, lag(close) over w prev_close from sess0 window w as (partition by symbol order by session_date))"""

FULL = f"""
full_s as (select *, row_number() over (partition by symbol order by session_date) - 1 full_pos from sess where n_bars = {C.bars_per_session}),
grid as (select b.symbol, b.session_date, b.ts, b.close, b.high, b.low, b.volume, f.full_pos, b.bar_in_session grid_col, lag(b.close) over (partition by b.symbol order by b.ts) grid_prev from bars b join full_s f on f.symbol = b.symbol and f.session_date = b.session_date)"""

FILINGS = f"""
subj(subject, subject_priority, is_companion) as (values {_SUBJECTS}),
filings as (select event_id NEWSID, event_type symbol, ts event_ts, 'DissemDT' ts_source, s.subject, s.subject_priority, s.is_companion,
  case when s.subject = 'Financial Results' and event_id % 2 = 0 then strftime(ts, '%Y-%m') || '-01' end fiscal_period from events join subj s on s.subject_priority = user_id % 12 + 1)"""

ALIGNED = f"""
al0 as (select f.*, p.ts pre_bar_ts0, p.close pre_close0, p.bar_seq pre_index0, p.session_date pre_date0, case when date_trunc('minute', f.event_ts) = f.event_ts then f.event_ts else date_trunc('minute', f.event_ts) + interval 1 minute end up
  from filings f asof left join bars p on f.symbol = p.symbol and f.event_ts - interval 1 hour >= p.ts),
al1 as (select a.*, n.ts nts, n.bar_seq nseq, n.session_date nd from al0 a asof left join bars n on a.symbol = n.symbol and a.up <= n.ts),
al2 as (select a.*, d.session_pos, d.n_bars, d.last_seq, d.n_sessions, o.session_date own_date, hour(event_ts) * 60 + minute(event_ts) m,
  case when nts is null then '{NO_NEXT}' when pre_bar_ts0 is null then '{NO_PREVIOUS}' when pre_close0 <= 0 then '{BAD_PRICE}' else '' end exclusion_reason
  from al1 a left join sess d on d.symbol = a.symbol and d.session_date = a.nd left join sess o on o.symbol = a.symbol and o.session_date = a.event_ts::date),
al3 as (select *, exclusion_reason in ('', '{BAD_PRICE}') ok, case when own_date is null then 'non_trading_day' when m < {C.open_minute} then 'pre_open' when m < {C.close_minute} then 'in_session' else 'after_close' end bucket from al2),
aligned as (select NEWSID, symbol, event_ts, ts_source, subject, subject_priority, is_companion, fiscal_period, exclusion_reason,
  case when ok then pre_bar_ts0 end pre_bar_ts, case when ok then pre_close0 end pre_close, case when ok then nts end effective_ts, case when ok then nseq end t0_index, case when ok then pre_index0 end pre_index,
  case when ok then nd end D0, case when ok then session_pos end d0_session_pos, case when ok then bucket end arrival_bucket,
  case when ok then case when nd = event_ts::date and bucket = 'in_session' then 'in_session' else 'at_open' end end tradable_regime,
  case when ok then date_diff('microsecond', event_ts, nts) / 60e6 end delay_minutes, case when ok then last_seq - nseq + 1 end bars_to_session_close, case when ok then n_bars end d0_session_bars,
  case when ok then n_bars < {C.bars_per_session} end d0_short_session, case when ok then pre_date0 end pre_session_date, case when ok then n_sessions - 1 - session_pos end sessions_after_d0, last_seq sess_last_index
  from al3)"""


def _anchors(name: str, source: str, hours: int) -> str:
    return f"""
{name}_o as (select *, row_number() over (partition by symbol, subject order by effective_ts, event_ts, NEWSID) rn from {source}),
{name}_r as (select symbol, subject, rn, NEWSID, effective_ts anchor from {name}_o where rn = 1
  union all select o.symbol, o.subject, o.rn, o.NEWSID, case when o.effective_ts > r.anchor + interval {hours} hour then o.effective_ts else r.anchor end from {name}_r r join {name}_o o on o.symbol = r.symbol and o.subject = r.subject and o.rn = r.rn + 1),
{name} as (select s.*, r.symbol || '|' || r.subject || '|' || strftime(r.anchor, '%Y-%m-%d %H:%M:%S') wid from {source} s join {name}_r r on r.NEWSID = s.NEWSID)"""


def clusters(hours: int = C.cluster_hours) -> str:
    return f"""
usable as (select * from aligned where exclusion_reason = ''),
subst as (select * from usable where not is_companion),{_anchors("anch", "subst", hours)},
fiscal0 as (select *, coalesce(fiscal_period, min(fiscal_period) over (partition by wid)) period from anch),
fiscal as (select *, case when period is not null then symbol || '-FP-' || period else wid end cluster_id from fiscal0),
anchors as (select symbol, cluster_id, min(effective_ts) anchor from fiscal group by 1, 2),
comp as (select * from usable where is_companion),
near0 as (select c.NEWSID, a.cluster_id, row_number() over (partition by c.NEWSID order by abs(date_diff('microsecond', c.effective_ts, a.anchor)), a.anchor desc, a.cluster_id desc) rn
  from comp c join anchors a on a.symbol = c.symbol and abs(date_diff('microsecond', c.effective_ts, a.anchor)) <= {hours}::bigint * 3600000000),
near as (select NEWSID, cluster_id from near0 where rn = 1),
orph as (select * from comp where NEWSID not in (select NEWSID from near)),{_anchors("orphc", "orph", hours)},
clustered as (select {_CL}, cluster_id from fiscal union all select {_CL_C}, n.cluster_id from comp c join near n on n.NEWSID = c.NEWSID union all select {_CL}, wid from orphc)"""


_COLUMNS = "NEWSID symbol event_ts subject subject_priority is_companion fiscal_period pre_close effective_ts t0_index D0 d0_session_pos arrival_bucket tradable_regime sess_last_index".split()
_CL, _CL_C = ", ".join(_COLUMNS), ", ".join(f"c.{x}" for x in _COLUMNS)

_FIRST = "symbol event_ts pre_close effective_ts t0_index D0 d0_session_pos arrival_bucket tradable_regime sess_last_index".split()
COLLAPSED = f"""
cr as (select *, row_number() over (partition by cluster_id order by effective_ts, event_ts, NEWSID) a, row_number() over (partition by cluster_id order by subject_priority, effective_ts, event_ts, NEWSID) b from clustered),
ev0 as (select cluster_id, max(case when a = 1 then NEWSID end) anchor_NEWSID, {", ".join(f"max(case when a = 1 then {c} end) {c}" for c in _FIRST)},
  max(case when b = 1 then subject end) subject, count(*) n_filings, sum(is_companion::int)::bigint n_companion_filings, array_to_string(list_sort(list(distinct subject)), ' | ') member_subjects,
  date_diff('microsecond', min(effective_ts), max(effective_ts)) / 3.6e9 cluster_span_hours from cr r0(NEWSID, symbol, event_ts, subject, subject_priority, is_companion, fiscal_period, pre_close, effective_ts, t0_index, D0, d0_session_pos, arrival_bucket, tradable_regime, sess_last_index, cluster_id, a, b) group by 1),
ev as (select *, count(*) over (partition by symbol order by effective_ts range between interval 60 minute preceding and interval 60 minute following) > 1 overlap_60m, count(*) over (partition by symbol, D0) > 1 overlap_same_session from ev0)"""

_NAMES = [*(f"r_{k}m" for k in C.intraday_windows), "r_to_close", *(f"r_{h}d" for h in C.horizons), *(f"drift_{h}d" for h in C.horizons)]
RETURNS = f"""
syms as (select distinct symbol from sess),
pts as (select e.cluster_id, e.symbol own, s.symbol symbol, e.event_ts, e.event_ts - interval 1 hour down, case when date_trunc('minute', e.event_ts) = e.event_ts then e.event_ts else date_trunc('minute', e.event_ts) + interval 1 minute end up from ev e cross join syms s),
pt0 as (select p.*, b.close pre from pts p asof join bars b on p.symbol = b.symbol and p.down >= b.ts),
pt1 as (select p.*, n.bar_seq i0, n.session_date d0 from pt0 p asof join bars n on p.symbol = n.symbol and p.up <= n.ts where p.pre > 0),
pt as (select p.*, s.session_pos, s.last_seq::bigint last_seq, s.close d0c from pt1 p join sess s on s.symbol = p.symbol and s.session_date = p.d0),
wk as (select p.cluster_id, p.symbol, k.k, least(p.i0 + k.k - 1, p.last_seq)::bigint seq from pt p cross join (values {", ".join(f"({k})" for k in C.intraday_windows)}) k(k)),
wc as (select w.cluster_id, w.symbol, {", ".join(f"max(case when w.k = {k} then b.close end) c_{k}m" for k in C.intraday_windows)} from wk w join bars b on b.symbol = w.symbol and b.bar_seq = w.seq group by 1, 2),
hk as (select p.cluster_id, p.symbol, h.h, (p.session_pos + h.h)::bigint pos from pt p cross join (values {", ".join(f"({h})" for h in C.horizons)}) h(h)),
hc as (select h.cluster_id, h.symbol, {", ".join(f"max(case when h.h = {h} then s.close end) c_{h}d" for h in C.horizons)} from hk h join sess s on s.symbol = h.symbol and s.session_pos = h.pos group by 1, 2),
rets as (select p.cluster_id, p.own, p.symbol, {", ".join(f"w.c_{k}m / p.pre - 1 r_{k}m" for k in C.intraday_windows)}, p.d0c / p.pre - 1 r_to_close,
  {", ".join(f"h.c_{h}d / p.pre - 1 r_{h}d" for h in C.horizons)}, {", ".join(f"h.c_{h}d / nullif(p.d0c, 0) - 1 drift_{h}d" for h in C.horizons)}
  from pt p join wc w on w.cluster_id = p.cluster_id and w.symbol = p.symbol left join hc h on h.cluster_id = p.cluster_id and h.symbol = p.symbol),
peers as (select cluster_id, {", ".join(f"max(case when symbol = own then {n} end) {n}, avg(case when symbol <> own then {n} end) peer_{n}" for n in _NAMES)} from rets group by cluster_id having bool_or(symbol = own))"""

WINDOWS = f"""
wb as (select e.cluster_id, b.bar_seq - e.t0_index j, b.volume, b.high, b.low, case when b.close / nullif(b.prev_bar_close, 0) > 0 then ln(b.close / b.prev_bar_close) ^ 2 end sq
  from ev e join bars b on b.symbol = e.symbol and b.bar_seq between e.t0_index and least(e.t0_index + {max(C.intraday_windows) - 1}, e.sess_last_index)),
win as (select cluster_id, {", ".join(f"sum(case when j < {k} then volume end) vol_{k}m, avg(case when j < {k} then (volume = 0)::int end) zero_vol_share_{k}m" for k in C.intraday_windows)},
  sqrt(coalesce(sum(case when j < {C.main_window} then sq end), 0)) rv_{C.main}, (max(case when j < {C.main_window} then high end) - min(case when j < {C.main_window} then low end)) / nullif(min(case when j < {C.main_window} then low end), 0) range_{C.main} from wb group by 1)"""

_LAST = C.bars_per_session - 1
BASELINE = f"""
bs as (select e.cluster_id, e.symbol, f.full_pos p, e.t0_index - f.first_seq c0 from ev e join full_s f on f.symbol = e.symbol and f.session_date = e.D0 where f.full_pos > 0),
cells as (select b.cluster_id, g.full_pos q, g.grid_col - b.c0 j, g.grid_col, b.c0, g.volume, g.high, g.low, g.close, g.grid_prev, case when g.close / nullif(g.grid_prev, 0) > 0 then ln(g.close / g.grid_prev) ^ 2 end sq
  from bs b join grid g on g.symbol = b.symbol and g.full_pos between b.p - {C.baseline_sessions} and b.p - 1 and g.grid_col between b.c0 and least(b.c0 + {max(C.intraday_windows) - 1}, {_LAST})),
per as (select cluster_id, q, {", ".join(f"sum(case when j < {k} then volume end) v_{k}" for k in C.intraday_windows)}, sqrt(coalesce(sum(case when j < {C.main_window} then sq end), 0)) rv,
  (max(case when j < {C.main_window} then high end) - min(case when j < {C.main_window} then low end)) / nullif(min(case when j < {C.main_window} then low end), 0) rng,
  abs(max(case when grid_col = least(c0 + {C.main_window - 1}, {_LAST}) then close end) / nullif(max(case when j = 0 then grid_prev end), 0) - 1) ret from cells group by 1, 2),
dv as (select b.cluster_id, median(f.volume) vol_base_d0 from bs b join full_s f on f.symbol = b.symbol and f.full_pos between b.p - {C.baseline_sessions} and b.p - 1 group by 1),
base as (select p.cluster_id, {", ".join(f"median(v_{k}) vol_base_{k}m" for k in C.intraday_windows)}, median(rv) rv_base, median(rng) range_base, median(ret) baseline_abs_r_{C.main}, any_value(vol_base_d0) vol_base_d0 from per p left join dv on dv.cluster_id = p.cluster_id group by 1)"""

MEASURED = f"""
ms as (select e.*, {", ".join(f"p.{n}, p.peer_{n}, p.{n} - p.peer_{n} adj_{n}" for n in _NAMES)}, {", ".join(f"w.vol_{k}m, w.zero_vol_share_{k}m, b.vol_base_{k}m, w.vol_{k}m / nullif(b.vol_base_{k}m, 0) vol_ratio_{k}m" for k in C.intraday_windows)},
  w.rv_{C.main}, w.range_{C.main}, w.rv_{C.main} / nullif(b.rv_base, 0) rv_ratio_{C.main}, w.range_{C.main} / nullif(b.range_base, 0) range_ratio_{C.main}, b.baseline_abs_r_{C.main}, s.volume vol_d0, s.volume / nullif(b.vol_base_d0, 0) vol_ratio_d0
  from ev e left join peers p on p.cluster_id = e.cluster_id left join win w on w.cluster_id = e.cluster_id left join base b on b.cluster_id = e.cluster_id left join sess s on s.symbol = e.symbol and s.session_date = e.D0)"""

PEAD = f"""
pead as (select cluster_id, symbol, D0, r_to_close R0, adj_r_to_close R0_adj, case when r_to_close <> 0 then sign(r_to_close)::double end direction, symbol || '|' || strftime(D0, '%Y-%m') block_m,
  {", ".join(f"case when r_to_close <> 0 then sign(r_to_close) end * drift_{h}d signed_drift_{h}d, case when r_to_close <> 0 then sign(r_to_close) end * adj_drift_{h}d signed_adj_drift_{h}d" for h in C.horizons)} from ms where subject = 'Financial Results' and r_to_close is not null)"""

DENSE = """
dates as (select session_date, row_number() over (order by session_date) - 1 pos from (select distinct session_date from sess)),
dense as (select s.symbol, d.session_date, d.pos, x.close from dates d cross join (select distinct symbol from sess) s left join sess x on x.symbol = s.symbol and x.session_date = d.session_date)"""


#: Steps that several later ones read.
_ONCE = ("bars", "sess", "filings", "aligned", "clustered", "ev", "pt", "rets", "grid", "full_s", "cells", "ms", "pead", "dense")


def with_(*parts: str) -> str:
    text = "with recursive " + ",".join(parts)
    return re.sub(r"\b(" + "|".join(_ONCE) + r") as \(", r"\1 as materialized (", text)


TO_ALIGNED = (BARS, FILINGS, ALIGNED)
TO_EVENTS = (*TO_ALIGNED, clusters(), COLLAPSED)
TO_MEASURED = (*TO_EVENTS, FULL, RETURNS, WINDOWS, BASELINE, MEASURED)
