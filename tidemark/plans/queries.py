"""Registered queries of the study's operators over the driver's tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import ANNOUNCEMENTS_FILE
from tidemark.config import HOURLY as C
from tidemark.functions import ols, ranks, resample, tails
from tidemark.operators import cluster, impact, panel, quality, sessions, taxonomy
from tidemark.operators.asof import asof_join
from tidemark.plans import drift, figures, pead, sensitivity, summary
from tidemark.plans import oracles as o
from tidemark.plans.study import Study
from tidemark.sources import announcements, scratch, sinks
from tidemark.sources import bars as bar_source
from tidemark.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
M = C.main
SYMBOLS = ("click", "error", "purchase", "signup", "view")


def canon(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and integers as longs, so that two engines give the same values."""
    casts = {"double": lambda c: F.round(c, digits), "int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long")}
    return df.select(*[casts[t](c).alias(c) if t in casts else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Query]:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Query:
        QUERIES[name] = lambda spark, sf_dir: canon(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


_studies: dict[tuple[str, str], Study] = {}


def study(spark: SparkSession, sf_dir: str) -> Study:
    """The study over a folder's tables; queries of one session share its written stages."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _studies:
        _studies[key] = Study(fx.hourly_bars(spark, sf_dir), fx.filings(spark, sf_dir), C)
    return _studies[key]


def forget() -> None:
    """Let the next query write its stages anew."""
    _studies.clear()


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) {n}" for n in names)


# ---------------------------------------------------------------- sources and sessions


@query("src_bars", o.with_(o.BARS) + f"select symbol, ts, {r('open', 'high', 'low', 'close', 'volume')}, session_date, minute_of_day, bar_end from bars")
def src_bars(spark, sf_dir):
    return study(spark, sf_dir).repaired


@query("src_bars_csv", o.with_(o.BARS) + f"select event_type symbol, date_trunc('hour', ts)::timestamp ts, round(arg_min(value, ts), 6) open, round(max(value), 6) high, round(min(value), 6) low, round(arg_max(value, ts), 6) \"close\", count(*)::double volume from events group by 1, 2")
def src_bars_csv(spark, sf_dir):
    """Bars written by the CSV sink, a folder a symbol, read by the CSV source and again from the cache that it fills."""
    raw = fx.hourly_bars(spark, sf_dir).select("symbol", F.col("ts").alias("date"), *bar_source.PRICES, "volume")
    folder = scratch.folder(spark, "csv")
    for symbol in SYMBOLS:  # a study's symbols, a file each
        sinks.write_csv(raw.where(F.col("symbol") == symbol).drop("symbol"), f"{folder}/{symbol}.csv")
    bars = bar_source.read_bars(spark, folder, list(SYMBOLS), C.bar_minutes)
    return bar_source.cached_bars(bars, f"{folder}/cache").select("symbol", "ts", *bar_source.PRICES, "volume")


@query("src_ann_jsonl", "select event_id::varchar NEWSID, (event_id % 7)::bigint SCRIP_CD, case when event_id % 7 < 5 then ['click', 'error', 'purchase', 'signup', 'view'][(event_id % 7)::int + 1] end symbol, case event_id % 3 when 2 then 'DT_TM' else 'DissemDT' end ts_source, case event_id % 3 when 2 then date_trunc('second', ts) + interval 90 second else date_trunc('second', ts) end event_ts, event_type NEWSSUB from events where event_id % 25 = 0")
def src_ann_jsonl(spark, sf_dir):
    """Announcements written as JSON lines with one clock unreadable on every third, and read back."""
    e = fx.table(spark, sf_dir, "events").where("event_id % 25 = 0")
    stamp = F.date_format(F.date_trunc("second", "ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    late = F.date_format((F.date_trunc("second", "ts") + F.expr("interval 90 seconds")).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    lines = e.select(F.col("event_id").cast("string").alias("NEWSID"), (F.col("event_id") % 7).alias("SCRIP_CD"), F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("NEWSSUB"), F.when(F.col("event_id") % 3 == 2, F.lit("unreadable")).otherwise(stamp).alias("DissemDT"), late.alias("DT_TM"))
    path = scratch.folder(spark, "jsonl") + "/" + ANNOUNCEMENTS_FILE
    lines.write.json(path)
    feed = announcements.unique(announcements.read_announcements(spark, path, dict(enumerate(SYMBOLS))))
    return feed.select("NEWSID", "SCRIP_CD", "symbol", "ts_source", "event_ts", "NEWSSUB")


@query("src_close_grid", o.with_(o.BARS, "g as (select distinct ts from bars), s as (select distinct symbol from bars), x as (select g.ts, s.symbol, last_value(b.close ignore nulls) over (partition by s.symbol order by g.ts) c from g cross join s left join bars b on b.symbol = s.symbol and b.ts = g.ts)") + "select ts, " + ", ".join(f"round(max(case when symbol = '{s}' then c end), 6) \"{s}\"" for s in SYMBOLS) + " from x group by ts")
def src_close_grid(spark, sf_dir):
    return bar_source.close_grid(fx.hourly_bars(spark, sf_dir), list(SYMBOLS))


@query("join_code_map", "select o_orderkey, c_mktsegment symbol from orders left join customer on c_custkey = o_custkey")
def join_code_map(spark, sf_dir):
    orders, customer = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_mktsegment").alias("symbol"))


@query("win_session_pos", o.with_(o.BARS) + "select symbol, session_date, n_bars, first_ts, last_ts, round(volume, 6) volume, round(close, 6) close, session_pos, n_sessions, first_seq::bigint first_seq, last_seq::bigint last_seq, round(prev_close, 6) prev_close from sess")
def win_session_pos(spark, sf_dir):
    return study(spark, sf_dir).sess.drop("open")


@query("win_bar_seq", o.with_(o.BARS) + "select symbol, ts, bar_seq, bar_in_session, round(prev_bar_close, 6) prev_bar_close from bars")
def win_bar_seq(spark, sf_dir):
    return study(spark, sf_dir).numbered.select("symbol", "ts", "bar_seq", "bar_in_session", "prev_bar_close")


@query("win_log_return", o.with_(o.BARS, o.FULL) + "select symbol, ts, full_pos, grid_col, round(grid_prev, 6) grid_prev, round(case when close / nullif(grid_prev, 0) > 0 then ln(close / grid_prev) end, 6) log_ret from grid")
def win_log_return(spark, sf_dir):
    s = study(spark, sf_dir)
    return sessions.log_returns(s.numbered, s.sess, C.bars_per_session).select("symbol", "ts", "full_pos", "grid_col", "grid_prev", "log_ret")


@query("win_fwd_session", o.with_(o.BARS) + "select symbol, session_date, " + ", ".join(f"round(lead(close, {h}) over (partition by symbol order by session_pos), 6) close_{h}d" for h in C.horizons) + " from sess")
def win_fwd_session(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("session_pos")
    return study(spark, sf_dir).sess.select("symbol", "session_date", *[F.lead("close", h).over(w).alias(f"close_{h}d") for h in C.horizons])


@query("win_prior_sessions", o.with_(o.BARS, o.FULL) + f"select a.symbol, a.session_date, count(b.full_pos) n_prior, round(median(b.volume), 6) median_volume from full_s a left join full_s b on b.symbol = a.symbol and b.full_pos between a.full_pos - {C.baseline_sessions} and a.full_pos - 1 group by 1, 2")
def win_prior_sessions(spark, sf_dir):
    full = sessions.full_sessions(study(spark, sf_dir).sess, C.bars_per_session)
    a = full.select("symbol", "session_date", F.explode_outer(F.when(F.col("full_pos") > 0, F.sequence(F.greatest(F.col("full_pos") - C.baseline_sessions, F.lit(0)), F.col("full_pos") - 1))).alias("q"))
    b = full.select(F.col("symbol").alias("s2"), "full_pos", "volume")
    return a.join(b, (F.col("symbol") == F.col("s2")) & (F.col("q") == F.col("full_pos")), "left").groupBy("symbol", "session_date").agg(F.count("full_pos").alias("n_prior"), F.median("volume").alias("median_volume"))


@query("win_panel_shift", o.with_(o.BARS, o.DENSE) + "select symbol, session_date, pos, round(close, 6) close, " + ", ".join(f"round(lead(close, {k}) over w / nullif(close, 0) - 1, 6) fwd_{k}" for k in C.horizons) + " from dense window w as (partition by symbol order by pos)")
def win_panel_shift(spark, sf_dir):
    return panel.forward_returns(study(spark, sf_dir).grid, C.horizons)


@query("win_rank_mid", "select l_extendedprice \"value\", count(*) ties, round(min(rk) + (count(*) - 1) / 2.0, 6) mid_rank from (select l_extendedprice, rank() over (order by l_extendedprice) rk from lineitem) group by 1")
def win_rank_mid(spark, sf_dir):
    return ranks.mid_ranks(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice")


# ---------------------------------------------------------------- data quality

_SHORT = f"short as (select symbol, count(*) n_short, string_agg(session_date::varchar || ' (' || n_bars || ')', ', ' order by session_date::varchar || ' (' || n_bars || ')') AS days from sess where n_bars < {C.bars_per_session} group by 1)"


def _dq(check: str, count: str, detail: str, action: str) -> str:
    return f"select '{check}' \"check\", symbol scope, ({count})::bigint count, {detail} detail, '{action}' \"action\" from q"


@query(
    "dq_bars",
    o.with_(o.BARS, _SHORT, """
q as (select b.symbol, count(*) n, count(distinct session_date) sessions, count(b.ts) - count(distinct b.ts) dup, count(*) filter (where open is null or high is null or low is null or close is null or volume is null) nulls,
  count(*) filter (where not coalesce(low <= least(open, close) and high >= greatest(open, close) and high >= low, false)) bad, count(*) filter (where volume = 0) zero,
  count(*) filter (where open <= 0 or high <= 0 or low <= 0 or close <= 0) low, any_value(n_short) n_short, any_value(days) AS days from bars b left join short s on s.symbol = b.symbol group by 1)""")
    + " union all ".join([
        _dq("bar_count", "n", "sessions::varchar || ' sessions'", "none"), _dq("duplicate_timestamps", "dup", "''", "first kept"), _dq("null_ohlcv", "nulls", "''", "kept as null"),
        _dq("malformed_ohlc", "bad", "''", "high and low widened"), _dq("zero_volume", "zero", "printf('%.2f', 100.0 * zero / n) || '% of bars'", "kept"),
        _dq("non_positive_price", "low", "''", "alignment excludes them"), _dq("short_sessions", "coalesce(n_short, 0)", "coalesce(days, '')", "left out of baselines")]),
)
def dq_bars(spark, sf_dir):
    return quality.bar_checks(study(spark, sf_dir).repaired, C)


@query("repair_ohlc", "select o_orderkey, round(greatest(o_totalprice, o_totalprice * 0.9, o_totalprice * 1.1), 6) high, round(least(o_totalprice, o_totalprice * 0.9, o_totalprice * 1.1), 6) low from orders")
def repair_ohlc(spark, sf_dir):
    p = F.col("o_totalprice")
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", p.alias("open"), (p * 0.9).alias("high"), (p * 1.1).alias("low"), p.alias("close"))
    return quality.repair(rows).select("o_orderkey", "high", "low")


def _feed(spark, sf_dir):
    """Announcements with two clocks and titles, made of events: the second clock lags or is absent by event."""
    e = fx.table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 3 == 0, F.col("ts")).when(F.col("event_id") % 3 == 1, F.col("ts") + F.expr("interval 90 seconds"))
    return e.select(F.col("event_id").alias("NEWSID"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("symbol"), F.col("user_id").cast("string").alias("NEWSSUB"), F.lit("h").alias("HEADLINE"), F.col("ts").alias("DissemDT"), late.alias("DT_TM"), F.col("ts").alias("event_ts"), F.lit("DissemDT").alias("ts_source"))


_FEED = "feed as (select event_id NEWSID, case when event_type <> 'view' then event_type end symbol, user_id::varchar NEWSSUB, ts DissemDT, case event_id % 3 when 0 then ts when 1 then ts + interval 90 second end DT_TM, ts event_ts from events)"


def _da(check: str, count: str, detail: str, action: str, source: str = "feed, span", scope: str = "'all'") -> str:
    return f"select '{check}' \"check\", {scope} scope, {count} count, {detail} detail, '{action}' \"action\" from {source}"


_MIN = "hour(event_ts) * 60 + minute(event_ts)"


@query(
    "dq_announcements",
    o.with_(o.BARS, _FEED, "span as (select min(ts) lo, max(ts) hi from bars)", "gaps as (select date_diff('microsecond', lag(event_ts) over (partition by symbol, NEWSSUB order by event_ts, NEWSID), event_ts) g from feed where symbol is not null)")
    + " union all ".join([
        _da("announcement_count", "count(*)", "''", "none"), _da("duplicate_newsid", "count(NEWSID) - count(distinct NEWSID)", "''", "first kept"),
        _da("near_duplicates", "count(*)", "'gap under 300 s'", "clustering absorbs them", "gaps where g < 300000000"), _da("unmapped_symbol", "count(*) filter (where symbol is null)", "''", "alignment excludes them"),
        _da("timestamp_source", "count(*)", "''", "none", scope="'DissemDT'"), _da("timestamp_disagreement", "count(*) filter (where not coalesce(DissemDT = DT_TM, false))", "'DissemDT and DT_TM'", "DissemDT used"),
        _da("out_of_coverage", "count(*) filter (where event_ts < lo or event_ts > hi + interval 1 day)", "''", "alignment excludes them"), _da("arrival_pre_open", f"count(*) filter (where {_MIN} < {C.open_minute})", "''", "none"),
        _da("arrival_in_session", f"count(*) filter (where {_MIN} >= {C.open_minute} and {_MIN} < {C.close_minute})", "''", "none"), _da("arrival_after_close", f"count(*) filter (where {_MIN} >= {C.close_minute})", "''", "none"),
        _da("arrival_weekend", "count(*) filter (where dayofweek(event_ts) in (0, 6))", "''", "none")]),
)
def dq_announcements(spark, sf_dir):
    return quality.announcement_checks(_feed(spark, sf_dir), study(spark, sf_dir).repaired, C)


@query("dq_near_dup", o.with_(_FEED, "g as (select *, date_diff('microsecond', lag(event_ts) over (partition by symbol, NEWSSUB order by event_ts, NEWSID), event_ts) gap from feed where symbol is not null)") + "select NEWSID, symbol, NEWSSUB, event_ts from g where gap < 3600000000")
def dq_near_dup(spark, sf_dir):
    return quality.near_duplicates(_feed(spark, sf_dir), 3600).select("NEWSID", "symbol", "NEWSSUB", "event_ts")


# ---------------------------------------------------------------- joins and alignment


@query("align_asof_pre", o.with_(o.BARS, o.FILINGS) + "select f.NEWSID, p.ts pre_ts, round(p.close, 6) pre_close from filings f asof left join bars p on f.symbol = p.symbol and f.event_ts - interval 1 hour >= p.ts")
def align_asof_pre(spark, sf_dir):
    s = study(spark, sf_dir)
    rows = s.filings.select("NEWSID", "symbol", (F.col("event_ts") - F.expr("interval 1 hour")).alias("t"))
    return asof_join(rows, s.numbered, "symbol", "t", "ts", ["ts", "close"], "backward", "p").select("NEWSID", F.col("p.ts").alias("pre_ts"), F.col("p.close").alias("pre_close"))


@query("align_asof_next", o.with_(o.BARS, o.FILINGS) + "select f.NEWSID, p.ts next_ts, round(p.close, 6) next_close from filings f asof left join bars p on f.symbol = p.symbol and f.event_ts <= p.ts")
def align_asof_next(spark, sf_dir):
    s = study(spark, sf_dir)
    return asof_join(s.filings.select("NEWSID", "symbol", "event_ts"), s.numbered, "symbol", "event_ts", "ts", ["ts", "close"], "forward", "p").select("NEWSID", F.col("p.ts").alias("next_ts"), F.col("p.close").alias("next_close"))


@query("align_events", o.with_(*o.TO_ALIGNED) + f"select NEWSID, symbol, event_ts, exclusion_reason, pre_bar_ts, {r('pre_close')}, effective_ts, t0_index, pre_index, D0, d0_session_pos, arrival_bucket, tradable_regime, {r('delay_minutes')}, bars_to_session_close::bigint bars_to_session_close, d0_session_bars, d0_short_session, pre_session_date, sessions_after_d0, " + ", ".join(f"coalesce(bars_to_session_close < {k}, false) truncated_{k}m" for k in C.intraday_windows) + f", coalesce(sessions_after_d0 < {max(C.horizons)}, false) incomplete_{max(C.horizons)}d from aligned")
def align_events(spark, sf_dir):
    return study(spark, sf_dir).aligned.drop("ts_source", "subject", "subject_rule", "subject_priority", "is_companion", "fiscal_period", "sess_last_index")


@query("join_left_newsid", o.with_(*o.TO_ALIGNED) + "select f.NEWSID, f.subject, a.exclusion_reason, a.effective_ts from filings f left join aligned a on a.NEWSID = f.NEWSID")
def join_left_newsid(spark, sf_dir):
    s = study(spark, sf_dir)
    a = s.aligned.select(F.col("NEWSID").alias("n2"), "exclusion_reason", "effective_ts")
    return s.filings.select("NEWSID", "subject").join(a, F.col("NEWSID") == F.col("n2"), "left").drop("n2")


@query("flagship", o.with_(*o.TO_ALIGNED) + f"select a.symbol, a.tradable_regime, count(*) n_filings, round(median(abs(b.close / a.pre_close - 1)), 6) median_abs_return, round(avg(a.delay_minutes), 6) mean_delay from aligned a join bars b on b.symbol = a.symbol and b.bar_seq = least(a.t0_index + {C.main_window - 1}, a.sess_last_index) where exclusion_reason = '' group by 1, 2")
def flagship(spark, sf_dir):
    """Median absolute return over the main window by symbol and regime."""
    s = study(spark, sf_dir)
    ends = s.numbered.select(F.col("symbol").alias("s2"), F.col("bar_seq").alias("q2"), "close")
    rows = s.aligned.where("exclusion_reason = ''").withColumn("end", F.least(F.col("t0_index") + C.main_window - 1, F.col("sess_last_index")))
    rows = rows.join(ends, (F.col("symbol") == F.col("s2")) & (F.col("end") == F.col("q2")))
    return rows.groupBy("symbol", "tradable_regime").agg(F.count("*").alias("n_filings"), F.median(F.abs(F.try_divide("close", "pre_close") - 1)).alias("median_abs_return"), F.avg("delay_minutes").alias("mean_delay"))


# ---------------------------------------------------------------- taxonomy

_ANNOUNCED = [
    ("1", "Outcome of Board Meeting", "Unaudited financial results for the quarter ended September 30, 2023", "Board approved"),
    ("2", "Outcome of Board Meeting", "Financial results and interim dividend", None),
    ("3", "Outcome of Board Meeting", "Outcome", "As attached"),
    ("4", "General", "Newspaper publication of financial results", None),
    ("5", "General", "Company emerges as the lowest bidder (L1)", None),
    ("6", "General", "Disclosure", "Announcement as attached"),
    ("7", "Financial Results", "Results for the year ending 31st March 2024", None),
    ("8", "Acquisition", None, None),
    ("9", None, "Grant of units under ESOP", "x"),
    ("10", "General", "Press release on AGM", None),
    ("11", "Financial Results", "Results for quarter ended on June 30, 2024", "ended Sept 30 2024"),
    ("12", "Credit Rating", "", ""),
    ("13", "General", "Reg 74 certificate", None),
    ("14", "Outcome without intimation", "CRISIL credit rating action", None),
    ("15", "General", "Clarification   sought on\tnews", None),
]


def _announced(spark):
    return spark.createDataFrame(_ANNOUNCED, "NEWSID string, SUBCATNAME string, NEWSSUB string, HEADLINE string")


def _lit(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _case(rules) -> str:
    """RE2 bounds words by ASCII letters only; the rules bound them by letters of any script."""
    wide = [(s, re.sub(r"\\b(\w+)\\b", r"(?:^|[^\\p{L}\\p{N}_])\1(?:[^\\p{L}\\p{N}_]|$)", p)) for s, p in rules]
    return "case " + " ".join(f"when regexp_matches(t, '{p}', 'i') then '{s}'" for s, p in wide) + " end"


_INSIDE = [x for x in taxonomy.KEYWORDS if taxonomy.SUBJECTS.index(x[0]) < taxonomy.LEAST_SUBSTANTIVE]
_TAX = (
    "ann(NEWSID, SUBCATNAME, NEWSSUB, HEADLINE) as (values " + ", ".join("(" + ", ".join(map(_lit, row)) + ")" for row in _ANNOUNCED) + "), "
    "sub(sc, mapped) as (values " + ", ".join(f"({_lit(c)}, {_lit(s)})" for s, cs in taxonomy.SUBCATEGORIES.items() for c in cs) + "), "
    r"t0 as (select a.*, mapped, regexp_replace(coalesce(NEWSSUB, '') || ' || ' || coalesce(HEADLINE, ''), '\s+', ' ', 'g') t from ann a left join sub on sc = SUBCATNAME), "
    f"t1 as (select *, case when mapped = '{taxonomy.CONTAINER}' then {_case(_INSIDE)} end ins, case when mapped is null then {_case(taxonomy.KEYWORDS)} end wrd from t0), "
    "t2 as (select *, coalesce(ins, mapped, wrd, 'Other / Unclassified') subject, case when ins is not null then 'outcome-resolved:' || ins when mapped is not null then 'subcategory' when wrd is not null then 'keyword:' || wrd else 'unmatched' end subject_rule from t1)"
)
_P1, _P2 = (p.removeprefix("(?iu)") for p in taxonomy.PERIODS)
_PERIOD = f"""coalesce(try_strptime(nullif(regexp_replace(replace(regexp_extract(t, '{_P1}', 1, 'i'), ',', ''), 'Sept ', 'Sep ', 'i'), ''), ['%B %d %Y', '%b %d %Y']),
 try_strptime(nullif(regexp_replace(replace(regexp_extract(t, '{_P2}', 1, 'i'), ',', ''), '^([0-9]+)(st|nd|rd|th)', '\\1', 'i'), ''), ['%d %B %Y', '%d %b %Y']))"""


@query("tax_classify", f"with {_TAX} select NEWSID, subject, subject_rule, (list_position([{', '.join(map(_lit, taxonomy.SUBJECTS))}], subject))::bigint subject_priority, subject in ('Board Meeting Outcome', 'Investor Communication') is_companion, case when subject = 'Financial Results' then strftime({_PERIOD}, '%Y-%m-%d') end fiscal_period from t2")
def tax_classify(spark, sf_dir):
    return taxonomy.classify(_announced(spark)).drop("SUBCATNAME", "NEWSSUB", "HEADLINE")


@query("tax_documents", f"with d0 as (select source, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') t from documents), d as (select source, coalesce({_case(taxonomy.KEYWORDS)}, 'Other / Unclassified') subject from d0) select source, subject, count(*) n from d group by 1, 2")
def tax_documents(spark, sf_dir):
    """The keyword rules over all documents, by source."""
    rows = fx.table(spark, sf_dir, "documents").select("source", taxonomy.lowered(F.coalesce("text", F.lit(""))).alias("t"))
    collapsed = F.regexp_replace("t", r"(?U)\s+", " ")
    subject = F.coalesce(taxonomy._first_rule(collapsed, list(taxonomy.KEYWORDS), F.col("t")), F.lit(taxonomy.SUBJECTS[-1]))
    return rows.select("source", subject.alias("subject")).groupBy("source", "subject").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- clustering


@query("cl_anchor", o.with_(*o.TO_ALIGNED, o.clusters()) + "select wid cluster_id, count(*) n_filings, min(effective_ts) anchor, max(effective_ts) last_ts from anch group by 1")
def cl_anchor(spark, sf_dir):
    rows = study(spark, sf_dir).aligned.where("exclusion_reason = '' and not is_companion")
    return cluster.anchor_clusters(rows, C.cluster_hours).groupBy("cluster_id").agg(F.count("*").alias("n_filings"), F.min("effective_ts").alias("anchor"), F.max("effective_ts").alias("last_ts"))


@query("cl_fiscal_merge", o.with_(*o.TO_ALIGNED, o.clusters()) + "select NEWSID, cluster_id from fiscal")
def cl_fiscal_merge(spark, sf_dir):
    rows = study(spark, sf_dir).aligned.where("exclusion_reason = '' and not is_companion")
    return cluster.merge_fiscal(cluster.anchor_clusters(rows, C.cluster_hours)).select("NEWSID", "cluster_id")


@query("cl_companion", o.with_(*o.TO_ALIGNED, o.clusters()) + "select NEWSID, cluster_id from near")
def cl_companion(spark, sf_dir):
    rows = study(spark, sf_dir).aligned.where("exclusion_reason = ''")
    main = cluster.merge_fiscal(cluster.anchor_clusters(rows.where("not is_companion"), C.cluster_hours))
    return cluster.nearest_cluster(rows.where("is_companion"), main.groupBy("symbol", "cluster_id").agg(F.min("effective_ts").alias("anchor")), C.cluster_hours)


@query("cl_build", o.with_(*o.TO_ALIGNED, o.clusters()) + "select NEWSID, cluster_id from clustered")
def cl_build(spark, sf_dir):
    return study(spark, sf_dir).clustered.select("NEWSID", "cluster_id")


@query("cl_collapse", o.with_(*o.TO_EVENTS) + f"select cluster_id, anchor_NEWSID, symbol, subject, event_ts, effective_ts, D0, n_filings, n_companion_filings, member_subjects, {r('cluster_span_hours')}, overlap_60m, overlap_same_session from ev")
def cl_collapse(spark, sf_dir):
    return study(spark, sf_dir).events.select("cluster_id", "anchor_NEWSID", "symbol", "subject", "event_ts", "effective_ts", "D0", "n_filings", "n_companion_filings", "member_subjects", "cluster_span_hours", "overlap_60m", "overlap_same_session")


# ---------------------------------------------------------------- impact

_R = impact.return_names(C)


@query("imp_raw_returns", o.with_(*o.TO_EVENTS, o.RETURNS) + f"select cluster_id, own, symbol, {r(*_R)} from rets")
def imp_raw_returns(spark, sf_dir):
    """Returns of each event on its own symbol and re-aligned on every other."""
    s = study(spark, sf_dir)
    listed = s.sess.agg(F.collect_set("symbol").alias("others"))
    points = s.events.select("cluster_id", F.col("symbol").alias("own"), "event_ts").join(F.broadcast(listed), F.lit(True)).select(F.struct("cluster_id", "own").alias("key"), F.explode("others").alias("symbol"), "event_ts")
    return impact.raw_returns(points, s.numbered, s.sess, C).select("key.cluster_id", "key.own", "symbol", *_R)


@query("imp_peer_basket", o.with_(*o.TO_EVENTS, o.RETURNS) + f"select cluster_id, {r(*_R, *(f'peer_{n}' for n in _R))}, {', '.join(f'round({n} - peer_{n}, 6) adj_{n}' for n in _R)} from peers")
def imp_peer_basket(spark, sf_dir):
    s = study(spark, sf_dir)
    return impact.with_peers(s.events, s.numbered, s.sess, C)


@query("imp_window", o.with_(*o.TO_EVENTS, o.WINDOWS) + "select cluster_id, " + r(*(f"vol_{k}m" for k in C.intraday_windows), *(f"zero_vol_share_{k}m" for k in C.intraday_windows), f"rv_{M}", f"range_{M}") + " from win")
def imp_window(spark, sf_dir):
    s = study(spark, sf_dir)
    return impact.window_measures(s.events, s.numbered, C)


@query("imp_baseline", o.with_(*o.TO_EVENTS, o.FULL, o.BASELINE) + "select cluster_id, " + r(*(f"vol_base_{k}m" for k in C.intraday_windows), "rv_base", "range_base", f"baseline_abs_r_{M}", "vol_base_d0") + " from base")
def imp_baseline(spark, sf_dir):
    s = study(spark, sf_dir)
    return impact.baselines(s.events, s.numbered, s.sess, C)


_MEASURES = [*_R, *(f"adj_{n}" for n in _R), *(f"vol_ratio_{k}m" for k in C.intraday_windows), f"rv_ratio_{M}", f"range_ratio_{M}", f"baseline_abs_r_{M}", "vol_d0", "vol_ratio_d0"]


@query("imp_measure", o.with_(*o.TO_MEASURED) + f"select cluster_id, symbol, subject, {r(*_MEASURES)}, round(abs(adj_r_{M}), 6) abs_adj_r_{M} from ms")
def imp_measure(spark, sf_dir):
    return study(spark, sf_dir).measured.select("cluster_id", "symbol", "subject", *_MEASURES, f"abs_adj_r_{M}")


# ---------------------------------------------------------------- summaries

_W = summary.windows(C)
_SUBJECT = ", ".join(
    ["count(*) n_events", "sum(n_filings)::bigint n_filings", "count(distinct symbol) n_stocks", "round(avg((tradable_regime = 'at_open')::int), 6) share_tradable_at_open", "round(avg(overlap_60m::int), 6) share_overlapping_60m"]
    + [f"round(avg({c}), 6) mean_{c}, round(median({c}), 6) median_{c}, round(avg(adj_{c}), 6) mean_adj_{c}, round(median(adj_{c}), 6) median_adj_{c}, round(avg(case when adj_{c} > 0 then 1.0 else 0.0 end), 6) share_positive_adj_{c}" for c in _W]
    + [f"round(median(abs(adj_r_{M})), 6) median_abs_adj_r_{M}, round(avg(abs(adj_r_{M})), 6) mean_abs_adj_r_{M}, round(median(baseline_abs_r_{M}), 6) baseline_abs_r_{M}"]
    + [f"round(median(vol_ratio_{C.intraday_windows[0]}m), 6) median_vol_ratio_{C.intraday_windows[0]}m, round(median(vol_ratio_{M}), 6) median_vol_ratio_{M}, round(avg(vol_ratio_{M}), 6) mean_vol_ratio_{M}"]
    + [f"round(median(vol_ratio_d0), 6) median_vol_ratio_d0, round(median(rv_ratio_{M}), 6) median_rv_ratio_{M}, round(median(range_ratio_{M}), 6) median_range_ratio_{M}"]
)


@query("agg_subject_aggregates", o.with_(*o.TO_MEASURED) + f"select subject, {_SUBJECT} from ms group by 1")
def agg_subject_aggregates(spark, sf_dir):
    return summary.subject_aggregates(study(spark, sf_dir).measured, C)


@query("agg_subject_summary")
def agg_subject_summary(spark, sf_dir):
    return summary.subject_summary(study(spark, sf_dir).measured, C)


_STOCK = f"count(*) n_events, round(median(abs(adj_r_{M})), 6) median_abs_adj_r_{M}, round(avg(abs(adj_r_{M})), 6) mean_abs_adj_r_{M}, round(median(adj_r_{M}), 6) median_adj_r_{M}, round(avg(case when adj_r_{M} > 0 then 1.0 else 0.0 end), 6) share_positive_{M}, round(median(vol_ratio_{M}), 6) median_vol_ratio_{M}, round(median(rv_ratio_{M}), 6) median_rv_ratio_{M}, round(median(adj_r_to_close), 6) median_adj_r_to_close, count(*) >= {C.min_events} inference_supported"


@query("agg_stock_aggregates", o.with_(*o.TO_MEASURED) + f"select symbol, 'ALL SUBJECTS' subject, {_STOCK} from ms group by 1 union all select symbol, subject, {_STOCK} from ms group by 1, 2")
def agg_stock_aggregates(spark, sf_dir):
    return summary.stock_aggregates(study(spark, sf_dir).measured, C)


@query("agg_stock_summary")
def agg_stock_summary(spark, sf_dir):
    return summary.stock_summary(study(spark, sf_dir).measured, C)


_RB_COLUMNS = {"abs_r": f"abs(adj_r_{M})", "r": f"adj_r_{M}", "vol": f"vol_ratio_{M}"}
_RB = "select '{s}' specification, subject, count(*) filter (where {k})::bigint n, " + ", ".join(f"round(median({c}) filter (where {{k}}), 6) median_{'vol_ratio' if c == 'vol' else c}" for c in _RB_COLUMNS) + " from {t} group by 2"
_RB_SRC = (
    "v0 as (select subject, overlap_60m, " + ", ".join(f"{x} {c}" for c, x in _RB_COLUMNS.items()) + " from ms), "
    "e as (select " + ", ".join(f"quantile_cont({c}, 0.01) {c}_lo, quantile_cont({c}, 0.99) {c}_hi" for c in _RB_COLUMNS) + " from v0), "
    "vw as (select subject, overlap_60m, " + ", ".join(f"case when {c} is not null then greatest(least({c}, {c}_hi), {c}_lo) end {c}" for c in _RB_COLUMNS) + " from v0, e)"
)


@query("agg_robustness", o.with_(*o.TO_MEASURED, _RB_SRC) + " union all ".join(_RB.format(s=s, t=t, k=k) for s, t, k in zip(summary.SPECIFICATIONS, ("v0", "v0", "vw"), ("true", "not overlap_60m", "true"), strict=True)))
def agg_robustness(spark, sf_dir):
    return summary.robustness(study(spark, sf_dir).measured, C)


@query("agg_robustness_tests")
def agg_robustness_tests(spark, sf_dir):
    return summary.robustness_tests(study(spark, sf_dir).measured, C)


@query("agg_event_table", o.with_(*o.TO_MEASURED) + f"select cluster_id, symbol, subject, anchor_NEWSID, event_ts, effective_ts, n_filings, '' exclusion_reason, {r(f'adj_r_{M}', f'vol_ratio_{M}')} from ms union all select null, symbol, subject, NEWSID, event_ts, null, null, exclusion_reason, null, null from aligned where exclusion_reason <> ''")
def agg_event_table(spark, sf_dir):
    s = study(spark, sf_dir)
    return summary.event_table(s.measured, s.aligned, C).select("cluster_id", "symbol", "subject", "anchor_NEWSID", "event_ts", "effective_ts", "n_filings", "exclusion_reason", f"adj_r_{M}", f"vol_ratio_{M}")


@query("agg_describe", "select l_returnflag, l_linestatus, count(l_extendedprice) n, round(avg(l_extendedprice), 4) mean, round(median(l_extendedprice), 4) median, round(stddev_samp(l_extendedprice), 4) sd, round(quantile_cont(l_extendedprice, 0.25), 4) q25, round(quantile_cont(l_extendedprice, 0.75), 4) q75, round(avg((l_extendedprice > 0)::int), 4) share_positive from lineitem group by 1, 2")
def agg_describe(spark, sf_dir):
    return canon(ranks.describe(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"]), 4)


# ---------------------------------------------------------------- statistics

_KW = """
x as (select {g} g, {v} v from {t} where {v} is not null), big as (select g from x group by 1 having count(*) >= 10), y as (select x.g, v from x join big on big.g = x.g),
rk as (select g, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 r from y), gs as (select g, count(*) n, sum(r) rs from rk group by 1),
tt as (select sum(c)::double n, sum(c::double * c * c - c) tie from (select v, count(*) c from y group by 1)),
kw as (select (12 / (tt.n * (tt.n + 1)) * sum(rs * rs / gs.n) - 3 * (tt.n + 1)) / (1 - tt.tie / (tt.n * tt.n * tt.n - tt.n)) H, count(*) k, tt.n n from gs, tt group by tt.n, tt.tie)"""
_DUNN = "select a.g group_a, b.g group_b, a.n n_a, b.n n_b, round((a.rs / a.n - b.rs / b.n) / sqrt((tt.n * (tt.n + 1) / 12 - tt.tie / (12 * (tt.n - 1))) * (1.0 / a.n + 1.0 / b.n)), 6) z from gs a join gs b on a.g < b.g cross join tt"


@query("st_kruskal", "with " + _KW.format(g="event_type", v="value", t="events") + "select round(H, 6) \"H\", round((H - k + 1) / (n - k), 6) epsilon_sq, n::bigint n, k from kw")
def st_kruskal(spark, sf_dir):
    return ranks.kruskal(fx.table(spark, sf_dir, "events"), "event_type", "value")


@query("st_kruskal_subjects", o.with_(*o.TO_MEASURED, f"src as (select subject, round(abs(adj_r_{M}), 9) av from ms)", _KW.format(g="subject", v="av", t="src")) + "select round(H, 6) \"H\", round((H - k + 1) / (n - k), 6) epsilon_sq, n::bigint n, k from kw")
def st_kruskal_subjects(spark, sf_dir):
    """Responses rounded first, so that values that are equal but for the order of a sum tie."""
    return ranks.kruskal(study(spark, sf_dir).measured.withColumn("v", F.round(f"abs_adj_r_{M}", 9)), "subject", "v")


@query("st_dunn", "with " + _KW.format(g="event_type", v="value", t="events") + _DUNN)
def st_dunn(spark, sf_dir):
    return ranks.dunn(fx.table(spark, sf_dir, "events"), "event_type", "value")


@query("st_dunn_bh")
def st_dunn_bh(spark, sf_dir):
    return ranks.dunn_bh(fx.table(spark, sf_dir, "events"), "event_type", "value")


@query("st_block_label", o.with_(*o.TO_EVENTS) + "select cluster_id, symbol || '|' || strftime(D0, '%Y-%m-%d') block_d, symbol || '|' || strftime(D0, '%Y-%m') block_m from ev")
def st_block_label(spark, sf_dir):
    return study(spark, sf_dir).events.select("cluster_id", resample.block_label(1).alias("block_d"), resample.block_label(20).alias("block_m"))


@query("st_bootstrap_ci")
def st_bootstrap_ci(spark, sf_dir):
    events = study(spark, sf_dir).measured.withColumn("block_d", resample.block_label(1))
    return resample.intervals(summary.usable(events), ["symbol"], f"abs_adj_r_{M}", "block_d", C.bootstrap_iters, C.seed)


@query("st_permutation")
def st_permutation(spark, sf_dir):
    return resample.permutation_test(study(spark, sf_dir).measured, "subject", f"abs_adj_r_{M}", "symbol", C.permutation_iters, C.seed, C.min_events)


@query("st_clustered_ols")
def st_clustered_ols(spark, sf_dir):
    rows = study(spark, sf_dir).measured.withColumn("block", resample.block_label(1))
    f = ols.clustered_ols(rows, f"abs_adj_r_{M}", "subject", "symbol", "block")
    return spark.createDataFrame([(f["F"], f["df1"], f["df2"], f["p"], f["n"], f["r_squared"])], "F double, df1 long, df2 long, p double, n long, r_squared double")


_MOMENTS = "count(v) n, round(avg(v), 6) mean, round(median(v), 6) median, round(stddev_samp(v), 6) sd, round(quantile_cont(v, 0.25), 6) q25, round(quantile_cont(v, 0.75), 6) q75, count(*) filter (where v > 0) n_positive, round(avg((v > 0)::int), 6) share_positive, round(avg(v) / (nullif(stddev_samp(v), 0) / sqrt(count(v))), 6) t_stat"


@query("st_one_sample")
def st_one_sample(spark, sf_dir):
    rows = study(spark, sf_dir).measured.withColumn("block_d", resample.block_label(1))
    return ranks.one_sample(rows, ["symbol"], f"adj_r_{M}", "block_d", C.bootstrap_iters, C.seed)


@query("st_one_sample_moments", f"select event_type, {_MOMENTS} from (select event_type, value - 50 v from events) group by 1 having count(v) >= 3")
def st_one_sample_moments(spark, sf_dir):
    found = ranks.one_sample(fx.table(spark, sf_dir, "events").select("event_type", (F.col("value") - 50).alias("v")), ["event_type"], "v")
    return found.where("n >= 3").drop("p_ttest", "p_wilcoxon", "p_sign")


@query("st_signed_rank_cells", "with x as (select c_mktsegment, v, abs(v) a from (select c_mktsegment, round(c_acctbal / 100) - 45 v from customer)), rk as (select c_mktsegment, v, rank() over (partition by c_mktsegment order by a) + (count(*) over (partition by c_mktsegment, a) - 1) / 2.0 r from x where v <> 0), ti as (select c_mktsegment, sum(c::double * c * c - c) tie from (select c_mktsegment, a, count(*) c from x where v <> 0 group by 1, 2) group by 1), z as (select c_mktsegment, count(*) filter (where v = 0) zeros from x group by 1) select rk.c_mktsegment, round(sum(case when v > 0 then r else 0 end), 4) w_plus, count(*) n, round(any_value(tie), 4) tie_term, any_value(zeros)::bigint zeros from rk join ti on ti.c_mktsegment = rk.c_mktsegment join z on z.c_mktsegment = rk.c_mktsegment group by 1")
def st_signed_rank_cells(spark, sf_dir):
    """Signed-rank sums of every cell in one plan, from values with ties and zeros."""
    rows = fx.table(spark, sf_dir, "customer").select("c_mktsegment", (F.round(F.col("c_acctbal") / 100) - 45).alias("v"))
    cells = ranks.sample_moments(rows, ["c_mktsegment"], "v")
    return cells.select("c_mktsegment", F.col("w_plus__").alias("w_plus"), F.col("m__").alias("n"), F.col("tie__").alias("tie_term"), F.col("zeros__").alias("zeros"))


@query("st_signed_ranks", "with x as (select abs(v) a, v from (select c_acctbal - 4500 v from customer) where v <> 0), rk as (select v, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 r from x) select round(sum(case when v > 0 then r else 0 end), 4) w_plus, count(*) n, (select round(sum(c::double * c * c - c), 4) from (select a, count(*) c from x group by 1)) tie_term from rk")
def st_signed_ranks(spark, sf_dir):
    return canon(ranks.signed_ranks(fx.table(spark, sf_dir, "customer").select((F.col("c_acctbal") - 4500).alias("v")), "v"), 4)


@query("st_mde", f"select event_type, count(*) n, round({tails.normal_quantile(0.975) + tails.normal_quantile(0.8)} * stddev_samp(value) / sqrt(count(*)), 6) min_detectable_effect from events group by 1")
def st_mde(spark, sf_dir):
    z = tails.normal_quantile(1 - C.alpha / 2) + tails.normal_quantile(0.8)
    return fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), (z * F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("min_detectable_effect"))


@query("subject_tests")
def subject_tests(spark, sf_dir):
    return summary.subject_tests(study(spark, sf_dir).measured, C)


# ---------------------------------------------------------------- drift

_DRIFTS = [f"signed_{x}drift_{h}d" for x in ("", "adj_") for h in C.horizons]


@query("pead_events", o.with_(*o.TO_MEASURED, o.PEAD) + f"select cluster_id, symbol, D0, {r('R0', 'R0_adj', 'direction')}, block_m, {r(*_DRIFTS)} from pead")
def pead_events(spark, sf_dir):
    return study(spark, sf_dir).pead.select("cluster_id", "symbol", "D0", "R0", "R0_adj", "direction", "block_m", *_DRIFTS)


_LONG = " union all ".join(f"select {s} scope, '{m}' measure, {h}::bigint horizon_sessions, {p}_{h}d v from pead" for m, p in (("raw", "signed_drift"), ("peer_adjusted", "signed_adj_drift")) for h in C.horizons for s in ("'POOLED'", "symbol"))
_FIRSTS = " union all ".join(f"select 'POOLED' scope, '{m} | initial reaction {n}' measure, {h}::bigint horizon_sessions, {f'abs({c})' if h else c} v from pead" for m, c in (("raw", "R0"), ("peer_adjusted", "R0_adj")) for h, n in ((0, "R0 (signed)"), (-1, "|R0|")))


@query(
    "pead_aggregates",
    o.with_(*o.TO_MEASURED, o.PEAD, f"lg as ({_LONG}), fs as ({_FIRSTS})")
    + "select scope, measure, horizon_sessions, count(v) n_events, round(avg(v), 6) mean_drift, round(median(v), 6) median_drift, round(stddev_samp(v), 6) sd, round(avg((v > 0)::int), 6) continuation_rate, count(*) filter (where v > 0) n_continued from lg group by 1, 2, 3"
    + " union all select scope, measure, horizon_sessions, count(v), round(avg(v), 6), round(median(v), 6), round(stddev_samp(v), 6), null, null from fs group by 1, 2, 3",
)
def pead_aggregates(spark, sf_dir):
    return pead.drift_aggregates(study(spark, sf_dir).pead, C)


@query("pead_summary")
def pead_summary(spark, sf_dir):
    return pead.pead_summary(study(spark, sf_dir).pead, C)


@query("pead_persistence")
def pead_persistence(spark, sf_dir):
    return pead.drift_persistence(pead.pead_summary(study(spark, sf_dir).pead, C))


@query("dc_daily_panel", "select c_mktsegment symbol, o_orderdate::date session_date, round(arg_max(o_totalprice, o_orderkey), 6) close from orders join customer on c_custkey = o_custkey group by 1, 2")
def dc_daily_panel(spark, sf_dir):
    return fx.session_panel(spark, sf_dir)


_ORDERS = """
sess as (select c_mktsegment symbol, o_orderdate::date session_date, arg_max(o_totalprice, o_orderkey) close from orders join customer on c_custkey = o_custkey group by 1, 2)"""
_ADJ = "fw as (select *, " + ", ".join(f"lead(close, {k}) over w / nullif(close, 0) - 1 fwd_{k}" for k in C.horizons) + " from dense window w as (partition by symbol order by pos)), ad as (select *, " + ", ".join(f"fwd_{k} - (coalesce(sum(fwd_{k}) over d, 0) - fwd_{k}) / (count(*) over d - 1) adj_{k}" for k in C.horizons) + " from fw window d as (partition by session_date))"


@query("dc_adjusted", o.with_(_ORDERS, o.DENSE, _ADJ) + f"select symbol, session_date, pos, {r('close', *(f'fwd_{k}' for k in C.horizons), *(f'adj_{k}' for k in C.horizons))} from ad")
def dc_adjusted(spark, sf_dir):
    return panel.adjusted(panel.forward_returns(panel.dense(fx.session_panel(spark, sf_dir)), C.horizons), C.horizons)


@query("join_placebo_block", o.with_(*o.TO_MEASURED, o.PEAD, o.DENSE, "nd as (select max(pos) + 1 n from dates)", "pc as (select *, lag(close) over (partition by symbol order by pos) pcl from dense)", "evp as (select p.symbol, d.pos from pead p join dates d on d.session_date = p.D0)") + f"select symbol, pos from pc, nd where pos >= 1 and pos < n - {max(C.horizons)} and close is not null and pcl is not null and not exists (select 1 from evp where evp.symbol = pc.symbol and abs(evp.pos - pc.pos) <= {C.exclusion_radius})")
def join_placebo_block(spark, sf_dir):
    s = study(spark, sf_dir)
    return panel.eligible_sessions(s.grid, s.pead, C.exclusion_radius, max(C.horizons))


@query("join_clean_peers", o.with_(*o.TO_MEASURED, o.PEAD, o.DENSE, "evp as (select p.cluster_id, p.symbol, d.pos p from pead p join dates d on d.session_date = p.D0 where d.pos >= 1)", "evq as (select p.symbol, d.pos p from pead p join dates d on d.session_date = p.D0)", "ks(k) as (values (0), " + ", ".join(f"({h})" for h in C.horizons) + ")") + f"select e.cluster_id, e.symbol, e.p, k::bigint k, s.symbol peer from evp e cross join ks cross join (select distinct symbol from sess) s where s.symbol <> e.symbol and not exists (select 1 from evq q where q.symbol = s.symbol and q.p between e.p - {C.peer_lookback} and e.p + k)")
def join_clean_peers(spark, sf_dir):
    s = study(spark, sf_dir)
    return panel.clean_peers(s.grid, s.pead, C.peer_lookback, C.horizons).select("cluster_id", "symbol", "p", "k", "peer")


@query("dc_placebo")
def dc_placebo(spark, sf_dir):
    s = study(spark, sf_dir)
    return drift.placebo_null(s.grid, s.pead, C)


_KS = (0, *C.horizons)
_CLEAN = (
    "evp as (select p.cluster_id, p.symbol, p.D0, d.pos p from pead p join dates d on d.session_date = p.D0 where d.pos >= 1)",
    "evq as (select p.symbol, d.pos p from pead p join dates d on d.session_date = p.D0)",
    "fw as (select symbol, pos, close / nullif(lag(close) over w, 0) - 1 f0, " + ", ".join(f"lead(close, {k}) over w / nullif(close, 0) - 1 f{k}" for k in C.horizons) + " from dense window w as (partition by symbol order by pos))",
    "vals as (" + " union all ".join(f"select symbol, pos, {k} k, f{k} v from fw" for k in _KS) + ")",
    f"bk as (select e.cluster_id, e.symbol, e.D0, e.p, o.k, any_value(o.v) own, count(s.symbol) filter (where c.clean) n_peers, avg(s.v) filter (where c.clean) basket from evp e join vals o on o.symbol = e.symbol and o.pos = e.p left join vals s on s.pos = e.p and s.k = o.k and s.symbol <> e.symbol left join lateral (select not exists (select 1 from evq q where q.symbol = s.symbol and q.p between e.p - {C.peer_lookback} and e.p + o.k) clean) c on true group by 1, 2, 3, 4, 5)",
    "wd as (select cluster_id, symbol, D0, " + ", ".join(f"max(own - basket) filter (where k = {k}) dd{k}, max(n_peers) filter (where k = {k}) n{k}" for k in _KS) + " from bk group by 1, 2, 3)",
)


@query("dc_clean_events", o.with_(*o.TO_MEASURED, o.PEAD, o.DENSE, *_CLEAN) + "select cluster_id, symbol, D0, round(dd0, 6) R0_clean, n0 n_clean_peers, " + ", ".join(f"case when n0 > 0 then n{k} end n_clean_peers_{k}d, round(sign(dd0) * dd{k}, 6) signed_clean_drift_{k}d" for k in C.horizons) + " from wd")
def dc_clean_events(spark, sf_dir):
    s = study(spark, sf_dir)
    return drift.clean_peer_events(s.grid, s.pead, C)


@query("dc_clean_peers")
def dc_clean_peers(spark, sf_dir):
    s = study(spark, sf_dir)
    return drift.clean_peer_drift(s.grid, s.pead, C)


# ---------------------------------------------------------------- sweeps and figures

_SWEEP = f"""select {{h}}::bigint cluster_window_hours, count(*) n_events, round(sum(n_filings) / count(*), 6) filings_per_event, count(*) filter (where subject = 'Financial Results') n_earnings_events,
 round(median(case when subject = 'Financial Results' then abs(adj_r_{M}) end), 6) median_abs_r_results, round(median(case when subject = 'Financial Results' then vol_ratio_{M} end), 6) median_vol_ratio_results,
 round(median(case when subject = 'Order Win' then abs(adj_r_{M}) end), 6) median_abs_r_orderwin, round(median(case when subject = 'Routine Filing' then abs(adj_r_{M}) end), 6) median_abs_r_routine,
 round(avg(case when subject = 'Order Win' then case when adj_r_{M} > 0 then 1.0 else 0.0 end end), 6) orderwin_share_positive, {{head}} is_headline_setting from ms"""


def _sweep_sql(h: int) -> str:
    return o.with_(*o.TO_ALIGNED, o.clusters(h), o.COLLAPSED, o.FULL, o.RETURNS, o.WINDOWS, o.BASELINE, o.MEASURED) + _SWEEP.format(h=h, head=str(h == C.cluster_hours).lower())


def _sens(hours: int, spark, sf_dir):
    s = study(spark, sf_dir)
    return sensitivity.window_sweep(s.aligned, s.numbered, s.sess, C, (hours,), tests=False)


for _h in C.sweep_hours:
    query(f"sens_window_{_h}h", _sweep_sql(_h))(partial(_sens, _h))


@query("sens_window")
def sens_window(spark, sf_dir):
    s = study(spark, sf_dir)
    return sensitivity.window_sweep(s.aligned, s.numbered, s.sess, C)


@query("sens_threshold")
def sens_threshold(spark, sf_dir):
    return sensitivity.threshold_sweep(summary.subject_summary(study(spark, sf_dir).measured, C), C)


@query("fig01_arrival", o.with_(*o.TO_ALIGNED) + "select symbol, arrival_bucket, count(*) n_filings from aligned where exclusion_reason = '' group by 1, 2")
def fig01_arrival(spark, sf_dir):
    return figures.fig01_arrival(study(spark, sf_dir).aligned)


@query("fig01_delays", o.with_(*o.TO_ALIGNED) + "select least(floor(delay_minutes / 6.0), 39)::bigint bin, count(*) n_filings from aligned where exclusion_reason = '' and delay_minutes <= 240 group by 1")
def fig01_delays(spark, sf_dir):
    return figures.fig01_delays(study(spark, sf_dir).aligned, 240.0)


@query("fig02_clustering", o.with_(*o.TO_EVENTS) + "select subject, count(*) n_events, sum(n_filings)::bigint n_filings, round(sum(n_filings) / count(*), 6) filings_per_event from ev group by 1")
def fig02_clustering(spark, sf_dir):
    return figures.fig02_clustering(study(spark, sf_dir).events)


@query("fig03_subject_return")
def fig03_subject_return(spark, sf_dir):
    return figures.fig03_subject_return(summary.subject_summary(study(spark, sf_dir).measured, C), C)


@query("fig04_subject_volume")
def fig04_subject_volume(spark, sf_dir):
    return figures.fig04_subject_volume(summary.subject_summary(study(spark, sf_dir).measured, C), C)


@query("fig05_response_decay", o.with_(*o.TO_MEASURED) + " union all ".join(f"select subject, '{n}' \"window\", round(median(abs(adj_{n})), 6) median_abs_adj from ms group by 1" for n in _W[: len(C.intraday_windows) + 1]))
def fig05_response_decay(spark, sf_dir):
    return figures.fig05_response_decay(study(spark, sf_dir).measured, C)


@query("fig06_pead")
def fig06_pead(spark, sf_dir):
    return figures.fig06_pead(pead.pead_summary(study(spark, sf_dir).pead, C))


@query("fig07_continuation")
def fig07_continuation(spark, sf_dir):
    return figures.fig07_continuation(pead.drift_aggregates(study(spark, sf_dir).pead, C), C.alpha)


@query("fig08_heatmap", o.with_(*o.TO_MEASURED) + "select subject, " + ", ".join(f"round(median(case when symbol = '{s}' then abs(adj_r_{M}) end), 6) \"{s}\"" for s in SYMBOLS) + " from ms group by 1")
def fig08_heatmap(spark, sf_dir):
    return figures.fig08_heatmap(study(spark, sf_dir).measured, C, list(SYMBOLS))
