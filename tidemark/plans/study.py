"""The whole study as one plan, stage by stage."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from tidemark.config import StudyConfig
from tidemark.functions import ranks
from tidemark.operators import align, cluster, impact, panel, quality, sessions
from tidemark.plans import drift, pead, sensitivity, summary
from tidemark.sources import scratch


@dataclass
class Study:
    """``bars`` derived, ``filings`` classified. ``store`` writes the stages that several others read, which cuts lineage."""

    bars: DataFrame
    filings: DataFrame
    cfg: StudyConfig
    store: Callable[[DataFrame, str], DataFrame] = scratch.written

    @cached_property
    def repaired(self) -> DataFrame:
        return self.store(quality.repair(self.bars), "bars")

    @cached_property
    def sess(self) -> DataFrame:
        return self.store(sessions.sessions(self.repaired), "sessions")

    @cached_property
    def numbered(self) -> DataFrame:
        return self.store(sessions.number_bars(self.repaired, self.sess), "numbered-bars")

    @cached_property
    def aligned(self) -> DataFrame:
        return self.store(align.align_events(self.filings, self.numbered, self.sess, self.cfg), "aligned")

    @cached_property
    def clustered(self) -> DataFrame:
        return self.store(cluster.build_clusters(self.aligned, self.cfg), "clustered")

    @cached_property
    def events(self) -> DataFrame:
        return self.store(cluster.collapse(self.clustered, self.cfg), "events")

    @cached_property
    def measured(self) -> DataFrame:
        return self.store(impact.measure(self.events, self.numbered, self.sess, self.cfg), "measured")

    @cached_property
    def pead(self) -> DataFrame:
        return self.store(pead.pead_events(self.measured, self.cfg), "pead")

    @cached_property
    def grid(self) -> DataFrame:
        return self.store(panel.dense(panel.daily_panel(self.repaired)), "grid")

    def run(self) -> Mapping[str, DataFrame]:
        """Every result table by name."""
        cfg = self.cfg
        subjects = summary.subject_summary(self.measured, cfg)
        return {
            "subject_summary": subjects,
            "stock_summary": summary.stock_summary(self.measured, cfg),
            "event_table": summary.event_table(self.measured, self.aligned, cfg),
            "subject_tests": summary.subject_tests(self.measured, cfg),
            "dunn": ranks.dunn_bh(summary.usable(self.measured), "subject", f"abs_adj_r_{cfg.main}", cfg.min_events),
            "robustness": summary.robustness(self.measured, cfg),
            "robustness_tests": summary.robustness_tests(self.measured, cfg),
            "pead_events": self.pead,
            "pead_summary": pead.pead_summary(self.pead, cfg),
            "placebo": drift.placebo_null(self.grid, self.pead, cfg),
            "clean_peers": drift.clean_peer_drift(self.grid, self.pead, cfg),
            "window_sweep": sensitivity.window_sweep(self.aligned, self.numbered, self.sess, cfg),
            "threshold_sweep": sensitivity.threshold_sweep(subjects, cfg),
        }
