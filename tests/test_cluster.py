from tests.study_fixtures import CFG, LONG, aligned, day, make_bars, make_filings, one
from tidemark.config import StudyConfig
from tidemark.operators import cluster
from tidemark.sources import scratch

RESULTS = {"subject": "Financial Results", "priority": 1}
CALL = {"subject": "Investor Communication", "priority": 10, "companion": True}


def events(spark, *parts, cfg=CFG):
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    bars = make_bars(spark, LONG, minutes=120)
    out, _, _ = aligned(spark, rows, bars, cfg)
    return scratch.written(cluster.collapse(scratch.written(cluster.build_clusters(out, cfg), "clustered"), cfg), "events")


def test_within_and_beyond_the_window(spark):
    r = one(events(spark, make_filings(spark, day(3, "10:00"), day(4, "10:00"))))
    assert (r.n_filings, r.effective_ts) == (2, day(3, "10:00"))
    assert events(spark, make_filings(spark, day(2, "10:00"), day(5, "10:00"))).count() == 2


def test_anchor_is_the_first_member_not_the_last(spark):
    got = events(spark, make_filings(spark, day(2, "10:00"), day(3, "10:00"), day(4, "10:00"), day(5, "10:00"))).collect()
    assert sorted(r.n_filings for r in got) == [2, 2]


def test_companion_joins_the_nearest_or_stands_alone(spark):
    r = one(events(spark, make_filings(spark, day(3, "10:00"), **RESULTS), make_filings(spark, day(3, "11:00"), first=1, **CALL)))
    assert (r.subject, r.n_filings, r.n_companion_filings, r.member_subjects) == ("Financial Results", 2, 1, "Financial Results | Investor Communication")
    assert one(events(spark, make_filings(spark, day(3, "10:00"), **CALL))).subject == "Investor Communication"


def test_fiscal_periods_merge_and_split(spark):
    r = one(events(spark, make_filings(spark, day(2, "10:00"), day(9, "10:00"), period="2023-12-31", **RESULTS)))
    assert r.n_filings == 2
    two = events(spark, make_filings(spark, day(2, "10:00"), period="2023-09-30", **RESULTS), make_filings(spark, day(3, "10:00"), period="2023-12-31", first=1, **RESULTS))
    assert two.count() == 2


def test_earliest_member_supplies_the_clock(spark):
    assert one(events(spark, make_filings(spark, day(3, "11:00"), day(3, "10:00")))).effective_ts == day(3, "10:00")


def test_namer(spark):
    parts = make_filings(spark, day(3, "10:00"), subject="Routine Filing", priority=11), make_filings(spark, day(3, "10:30"), first=1, **CALL)
    assert one(events(spark, *parts)).subject == "Investor Communication"
    assert one(events(spark, *parts, cfg=StudyConfig(namer="substantive"))).subject == "Routine Filing"


def test_overlap_flags(spark):
    got = events(spark, make_filings(spark, day(3, "10:00")), make_filings(spark, day(3, "10:45"), first=1, **RESULTS), make_filings(spark, day(4, "10:00"), first=2, subject="Credit Rating", priority=5)).collect()
    assert sorted((r.subject, r.overlap_60m, r.overlap_same_session) for r in got) == [("Credit Rating", False, False), ("Financial Results", True, True), ("Order Win", True, True)]
