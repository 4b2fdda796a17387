from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postura.operators import statement as S

ENTRY = "site_id string, network string, scoped boolean, observation_id string, observed_at timestamp, partial boolean, status string, missing array<string>, freshness string, reason string, vantage string, notes array<string>, supplemental boolean"
PAIR = "site_id string, number long, baseline_id string, current_id string, rule_version string, guardrails array<string>, skipped string"
EVENT = "site_id string, number long, seq int, evidence_id string, title string, summary string, review string, state string, friendly_name string, investigate boolean"
EXTRA = "site_id string, seq int, label string, summary string, vantage string, observed_at timestamp, registry_id string"


def day(n):
    return datetime(2026, 1, 1 + n, 12)


def entry(site, n, **change):
    row = {"site_id": site, "network": "home", "scoped": True, "observation_id": f"{site}-{n}", "observed_at": day(n), "partial": False, "status": "complete", "missing": [], "freshness": "fresh", "reason": None, "vantage": "wired", "notes": [], "supplemental": False} | change
    return tuple(row.values())


@pytest.fixture(scope="module")
def rows(spark):
    entries = [entry("calm", 0), entry("calm", 6), entry("lan-02:00:00:00:00:01", 0, network=None, notes=[f"n{i}" for i in range(9)]), entry("lan-02:00:00:00:00:01", 3, missing=["port scan"], freshness="stale", reason="old"), entry("tap", 2, supplemental=True, scoped=None)]
    pairs = [("calm", 1, "calm-0", "calm-6", "v1", [], None), ("lan-02:00:00:00:00:01", 1, "a", "b", "v1", ["x"], None), ("lan-02:00:00:00:00:01", 2, "b", "c", "v1", None, "gone")]
    events = [("lan-02:00:00:00:00:01", 1, i, f"e/{i}", "New device at 10.1.2.3", None, "Look", "investigate" if i == 2 else None, "tv", i == 2) for i in (1, 2)]
    extra = [("tap", 0, "Capture", "s", "mirror", day(2), "r 1")]
    made = S.statement_rows(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(pairs, PAIR), spark.createDataFrame(events, EVENT), spark.createDataFrame(extra, EXTRA), F.lit(day(0)), F.lit(day(6)), F.lit(day(7)))
    return made.orderBy("site_id", "section", "place").collect()


def items(rows, site):
    return {r.item: r for r in rows if r.site_id == site}


def test_a_quiet_week(rows):
    got = items(rows, "calm")
    assert got["period-title"].text == "Weekly Network Statement" and got["period-title-reason"].severity == "info" and "coverage-title-gap" not in got
    assert {"stable-no-events", "stable-boundary", "changed-none", "review-none", "responses-none", "supplement-none", "action-cadence", "freshness-fresh", "provenance-comparison-1"} <= got.keys()
    assert got["provenance-comparison-1"].reference == "/activity" and "calm-0 to calm-6" in got["provenance-comparison-1"].text


def test_limits_events_and_hidden_ids(rows):
    got = items(rows, "lan-02:00:00:00:00:01")
    assert got["period-title"].text == "Network Statement" and got["coverage-title-gap"].severity == got["cannot-week"].severity == "warning"
    assert "coverage-note-4" in got and "coverage-note-5" not in got and got["freshness-limit-1"].text == "old"
    assert got["changed-2"].text == "Comparison 1: New device at [redacted ip]. " and got["review-2"].severity == "review" and got["review-1"].severity == "info"
    assert got["response-1"].text.startswith("Comparison 1: investigate (tv)") and "stable-bounded" in got
    assert all(r.reference is None for r in got.values()) and "a to b" not in got["provenance-comparison-1"].text
    assert got["provenance-skipped-1"].place == 4 and "02:00" not in got["site-id"].text
    assert {"action-week", "action-fresh", "action-missing-sources", "action-responses", "action-events"} <= got.keys() and "action-cadence" not in got


def test_supplements_alone(rows):
    got = items(rows, "tap")
    assert got["coverage-counts"].severity == got["stable-none"].severity == got["action-observe"].severity == "warning"
    assert got["supplement-1"].reference == "/captures?observation=r+1" and "cannot-supplement" in got and "Coverage" not in got["coverage-statuses"].text


def test_every_section_of_every_site_in_order(rows):
    for site in ("calm", "tap", "lan-02:00:00:00:00:01"):
        own = [(r.section, r.place) for r in rows if r.site_id == site]
        assert {s for s, _ in own} == set(range(1, 13)) and len(own) == len(set(own))
    assert all(r.section_id == S.SECTIONS[r.section - 1][0] for r in rows)


def test_markdown(spark, rows):
    lines = S.statement_lines(spark.createDataFrame(rows)).filter("site_id = 'calm'").orderBy("section", "place", "part").collect()
    text = "\n".join(r.line for r in lines)
    assert text.startswith("# Weekly Network Statement\n\n## Statement title and selected period\n\n- Weekly Network Statement\n- Period: Jan 1, 2026 to Jan 7, 2026.")
    assert text.count("\n## ") == 12 and "  Evidence: [provenance-comparison-1](/activity)" in text


def test_nothing_at_all(spark):
    empty = [spark.createDataFrame([], x) for x in (ENTRY, PAIR, EVENT, EXTRA)]
    assert S.statement_rows(*empty, F.lit(day(0)), F.lit(day(6)), F.lit(day(7))).count() == 0
