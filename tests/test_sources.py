import pytest

from tidemark.config import data_dir
from tidemark.operators import quality, taxonomy
from tidemark.plans import queries
from tidemark.sources import announcements, sinks
from tidemark.sources import bars as bar_source
from tidemark.config import StudyConfig


def test_bars_from_csv_keep_the_first_of_a_time(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("date,open,high,low,close,volume\n2024-01-02 09:15:00,1,2,0.5,1.5,10\n2024-01-02 09:15:00,9,9,9,9,9\n2024-01-02 09:16:00,NaN,2,1,1,0\n")
    (tmp_path / "BBB.csv").write_text("date,open,high,low,close,volume\n2024-01-02 09:15:00,5,4,6,5,0\n")
    raw = bar_source.read_raw_csv(spark, str(tmp_path), ["AAA", "BBB"])
    bars = bar_source.read_bars(spark, str(tmp_path), ["AAA", "BBB"])
    got = sorted((r.symbol, r.minute_of_day, r.open, r.close) for r in bars.collect())
    assert got == [("AAA", 555, 1.0, 1.5), ("AAA", 556, None, 1.0), ("BBB", 555, 5.0, 5.0)]
    counts = {(r.check, r.scope): r["count"] for r in quality.bar_checks(bars, StudyConfig(), raw).collect()}
    assert counts["duplicate_timestamps_as_read", "AAA"] == 1 and counts["duplicate_timestamps", "AAA"] == 0
    assert counts["malformed_ohlc", "BBB"] == 1 and counts["null_ohlcv", "AAA"] == 1 and counts["malformed_ohlc", "AAA"] == 0
    fixed = {r.symbol: (r.high, r.low) for r in quality.repair(bars).where("symbol = 'BBB'").collect()}
    assert fixed["BBB"] == (6.0, 4.0)
    cached = bar_source.cached_bars(bars, f"{tmp_path}/cache")
    assert cached.columns == bars.columns and cached.count() == 3
    assert bar_source.cached_bars(bars.where("false"), f"{tmp_path}/cache").count() == 3


def test_announcements_from_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"NEWSID": "1", "SCRIP_CD": 7, "NEWSSUB": " x ", "DissemDT": "2024-01-02T10:00:00", "DT_TM": "2024-01-02T10:00:05"}\n'
        '{"NEWSID": "2", "SCRIP_CD": 8, "DissemDT": "junk", "DT_TM": "2024-01-02T11:00:00"}\n{"NEWSID": "3", "SCRIP_CD": 7}\n{"NEWSID": "1", "SCRIP_CD": 7, "DissemDT": "2024-01-03T10:00:00"}\n'
    )
    df = announcements.read_announcements(spark, f"{tmp_path}/a.jsonl", {7: "AAA"})
    got = sorted((r.NEWSID, r.symbol, r.ts_source, str(r.event_ts)) for r in df.collect())
    assert got[1:] == [("1", "AAA", "DissemDT", "2024-01-03 10:00:00"), ("2", None, "DT_TM", "2024-01-02 11:00:00"), ("3", "AAA", "none", "None")]
    assert announcements.unique(df).count() == 3


def test_data_dir(tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_DATA_DIR", str(tmp_path))
    assert data_dir() == tmp_path
    monkeypatch.setenv("TIDEMARK_DATA_DIR", str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        data_dir()
    monkeypatch.delenv("TIDEMARK_DATA_DIR")
    (tmp_path / "corporate_announcements.jsonl").write_text("")
    assert data_dir(candidates=(str(tmp_path),)) == tmp_path


def test_classification(spark):
    got = {r.NEWSID: (r.subject, r.subject_rule, r.fiscal_period) for r in taxonomy.classify(queries._announced(spark)).collect()}
    assert got["1"] == ("Financial Results", "outcome-resolved:Financial Results", "2023-09-30")
    assert got["2"][0] == "Financial Results" and got["3"][:2] == ("Board Meeting Outcome", "subcategory")
    assert got["4"][0] == "Routine Filing" and got["5"][0] == "Order Win" and got["6"][:2] == ("Other / Unclassified", "unmatched")
    assert got["7"][2] == "2024-03-31" and got["11"][2] == "2024-09-30"
    assert sum(map(len, taxonomy.SUBCATEGORIES.values())) == 54


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    sinks.write_tables({"t": df}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").count() == 2
    assert "1.5" in sinks.report({"t": df})
