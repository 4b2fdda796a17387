"""A site's statement of a period: ordered sections of items, all sites in one plan.

Ids of sections and items and their severities are those of the format but for the
captures; the sentences are ours.  Facts are one row a site; whatever has an item a row
(events, notes, comparisons) is numbered over range-dealt parts, so a site with
very many events is spread.

entries: (site_id, network, scoped, observation_id, observed_at, partial,
status, missing, freshness, reason, vantage, notes, supplemental); missing and
notes are arrays.  comparisons: (site_id, number, baseline_id, current_id,
rule_version, guardrails, skipped); skipped is null or why there is none.
events: (site_id, number, seq, evidence_id, title, summary, review, state,
friendly_name, investigate).  supplements: (site_id, seq, label, summary,
vantage, observed_at, registry_id).  Observations that supplement are no
primary ones.  A site without any entry in the period has no statement; null
texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import markdown, redact
from .places import placed

# Sections in order, with their titles.
SECTIONS = (
    ("selected-period", "Statement title and selected period"), ("site-network", "Site/network covered"), ("coverage-vantage", "Observation coverage and collection vantage"), ("freshness", "Evidence freshness"),
    ("stable", "What appeared stable"), ("changed", "What changed"), ("needs-review", "What needs user review"), ("unresolved-responses", "Unresolved not_sure and investigate responses"),
    ("supplements", "Supplemental capture evidence"), ("cannot-conclude", "What cannot be concluded"), ("next-actions", "Practical next actions"), ("technical-provenance", "Technical evidence/provenance summary"),
)
# Days of a weekly range, days its first and last observation may lie inside, days they must span, and coverage notes shown.
WEEK, EDGE, SPAN, NOTES = (6, 8), 1, 5, 4
UNRESOLVED = ("not_sure", "investigate")
_V4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
_MAC = r"(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b"


def short_date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "MMM d, yyyy"), F.lit("not available"))


def date_time(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "MMM d, yyyy, h:mm a 'UTC'"), F.lit("not available"))


def hides_ids(site: Column, network: Column) -> Column:
    """Whether a site's own name holds an address, so ids made of it may not be shown."""
    either = lambda p: F.coalesce(site.rlike(p), F.lit(False)) | F.coalesce(network.rlike(p), F.lit(False))
    return either(_V4) | either(_MAC)


def consecutive(entries: DataFrame) -> DataFrame:
    """(site_id, number, baseline_id, current_id) of primary observations that follow each other, by time and id."""
    ranked = placed(entries.filter(~F.col("supplemental")).select("site_id", "observed_at", "observation_id"), "site_id", ["observed_at", "observation_id"])
    base = ranked.select("site_id", (F.col("place") + 1).alias("place"), F.col("observation_id").alias("baseline_id"))
    return base.join(ranked, ["site_id", "place"]).select("site_id", (F.col("place") - 1).alias("number"), "baseline_id", F.col("observation_id").alias("current_id"))


def _counts(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(site_id, name): "value: n" of each value, in order; few values a site."""
    each = rows.groupBy("site_id", column).count()
    pairs = F.array_sort(F.collect_list(F.struct(F.col(column).alias("v"), F.col("count").alias("n"))))
    return each.groupBy("site_id").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["v"], F.lit(": "), x["n"].cast("string"))), ", ").alias(name))


def site_facts(entries: DataFrame, comparisons: DataFrame, events: DataFrame, supplements: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row a site with what its sections share."""
    primary = entries.filter(~F.col("supplemental"))
    who = F.struct("network", "scoped")
    latest = F.struct("observed_at", "observation_id")
    sites = entries.groupBy("site_id").agg(F.coalesce(F.max_by(F.when(~F.col("supplemental"), who), F.when(~F.col("supplemental"), latest)), F.max_by(who, latest)).alias("who"))
    gap = F.col("partial") | (F.col("status") != "complete") | (F.size("missing") > 0)
    facts = primary.groupBy("site_id").agg(
        F.count("*").alias("n_primary"), F.max(gap).alias("partial"), F.max(F.col("freshness").isin("stale", "partial")).alias("stale"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"),
        F.max_by("freshness", latest).alias("latest_freshness"), F.array_sort(F.collect_set("vantage")).alias("vantages"), F.max(F.col("freshness") != "fresh").alias("unfresh"),
    )
    missing = primary.select("site_id", F.explode("missing").alias("m")).groupBy("site_id").agg(F.array_sort(F.collect_set("m")).alias("missing"))  # a few kinds of source
    pairs = comparisons.groupBy("site_id").agg(F.count_if(F.col("skipped").isNull()).alias("n_pairs"))
    told = events.groupBy("site_id").agg(F.count("*").alias("n_events"), F.count("state").alias("n_responses"), F.count_if(F.col("state").isin(*UNRESOLVED)).alias("n_open"))
    extra = supplements.groupBy("site_id").agg(F.count("*").alias("n_extra"))
    out = sites
    for part in (facts, missing, pairs, told, extra, _counts(primary, "status", "statuses"), _counts(primary, "freshness", "freshnesses")):
        out = out.join(part, "site_id", "left")
    zero = lambda *names: {n: F.coalesce(n, F.lit(0)) for n in names}
    none = F.array().cast("array<string>")
    out = out.withColumns(zero("n_primary", "n_pairs", "n_events", "n_responses", "n_open", "n_extra") | {n: F.coalesce(n, F.lit(False)) for n in ("partial", "stale", "unfresh")} | {n: F.coalesce(n, none) for n in ("vantages", "missing")})
    days = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400_000_000.0
    asked = days(start, end).between(*WEEK)
    covered = asked & (F.col("n_pairs") > 0) & F.coalesce((days(start, F.col("first")) <= EDGE) & (days(F.col("last"), end) <= EDGE) & (days(F.col("first"), F.col("last")) >= SPAN), F.lit(False))
    return out.select("*", "who.network", F.coalesce("who.scoped", F.lit(False)).alias("scoped"), asked.alias("asked_week"), covered.alias("week"), hides_ids(F.col("site_id"), F.col("who.network")).alias("hidden")).drop("who")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _item(section: int, place: int, name: str, text: Column, severity: Column | str = "info", when: Column | None = None) -> Column:
    made = F.struct(F.lit(section).alias("section"), F.lit(place).cast("long").alias("place"), F.lit(name).alias("item"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), text.alias("text"))
    return made if when is None else F.when(when, made)


def fixed_items(facts: DataFrame, start: Column, end: Column, evaluated_at: Column) -> DataFrame:
    """(site_id, section, place, item, severity, text): items that a site has at most once."""
    c = F.col
    none = c("n_primary") == 0
    short = c("asked_week") & ~c("week")
    limited = c("partial") | c("stale")
    reason = F.when(~c("asked_week"), "The range takes the general title.").when(c("n_pairs") == 0, "The week has no two comparable observations.").when(
        ~c("week"), _text("Observations span too little of the week: ", date_time(c("first")), " to ", date_time(c("last")), ".")).otherwise("Observations span the week.")
    warned = lambda bad: F.when(bad, "warning").otherwise("info")
    listed = lambda a: F.array_join(a, ", ")
    items = [
        _item(1, 1, "period-title", F.when(c("week"), "Weekly Network Statement").otherwise("Network Statement")), _item(1, 2, "period-range", _text("Period: ", short_date(start), " to ", short_date(end), ".")),
        _item(1, 3, "period-generated", _text("Generated: ", date_time(evaluated_at), ".")), _item(1, 4, "period-title-reason", reason, warned(short)),
        _item(2, 1, "site-name", _text("Network: ", redact(c("network")), ".")), _item(2, 2, "site-id", _text("Site: ", redact(c("site_id")), ".")), _item(2, 3, "site-scope", F.when(c("scoped"), "A scope is recorded; its targets are not repeated here.").otherwise("No scope is recorded.")),
        _item(3, 1, "coverage-counts", _text("Primary observations: ", c("n_primary"), "; comparable pairs: ", c("n_pairs"), "; supplemental records: ", c("n_extra"), "."), warned(c("n_pairs") == 0)),
        _item(3, 2, "coverage-vantage", F.when(F.size("vantages") > 0, _text("Vantage: ", F.array_join("vantages", "; "), ".")).otherwise("No primary vantage."), warned(F.size("vantages") == 0)),
        _item(3, 3, "coverage-title-gap", reason, "warning", short), _item(3, 4, "coverage-statuses", F.when(none, "No coverage statuses.").otherwise(_text("Coverage: ", c("statuses"), ".")), warned(none)),
        _item(3, 5, "coverage-missing-sources", F.when(F.size("missing") > 0, _text("Gaps: ", listed(c("missing")), ".")).otherwise("No gaps reported."), warned(F.size("missing") > 0)),
        _item(4, 1, "freshness-counts", F.when(none, "No freshness.").otherwise(_text("Freshness: ", c("freshnesses"), ".")), warned(none)),
        _item(4, 2, "freshness-latest", F.when(none, "No latest observation.").otherwise(_text("Latest: ", date_time(c("last")), "; ", c("latest_freshness"), ".")), warned(none | (c("latest_freshness") != "fresh"))),
        _item(4, 3, "freshness-fresh", F.lit("All within the cadence."), "info", ~none & ~c("unfresh")),
        _item(5, 1, "stable-none", F.lit("Fewer than two comparable observations: nothing can be called stable."), "warning", c("n_pairs") == 0),
        _item(5, 1, "stable-no-events", _text("No changes in ", c("n_pairs"), F.when(c("n_pairs") == 1, " comparison.").otherwise(" comparisons.")), warned(limited), (c("n_pairs") > 0) & (c("n_events") == 0)),
        _item(5, 2, "stable-boundary", F.when(limited, "Bounded by coverage and freshness; no proof of safety.").otherwise("Stored observations only; no proof of safety."), "info", (c("n_pairs") > 0) & (c("n_events") == 0)),
        _item(5, 1, "stable-bounded", _text(c("n_pairs"), F.when(c("n_pairs") == 1, " pair").otherwise(" pairs"), " compared; what did not change is not listed."), "info", (c("n_pairs") > 0) & (c("n_events") > 0)),
        _item(6, 1, "changed-none", F.lit("No change events."), "info", c("n_events") == 0), _item(7, 1, "review-none", F.lit("Nothing needs review."), "info", c("n_events") == 0),
        _item(8, 1, "responses-none", F.lit("No open responses."), "info", c("n_open") == 0), _item(9, 1, "supplement-none", F.lit("No supplemental evidence."), "info", c("n_extra") == 0),
        _item(10, 1, "cannot-safety", F.lit("Neither safety nor compromise nor compliance can be proved.")), _item(10, 2, "cannot-absence", F.lit("Absence outside these observations, sources and dates can't be proved.")), _item(10, 3, "cannot-responses", F.lit("Responses tell what users know, not what is secure.")),
        _item(10, 4, "cannot-week", F.lit("The evidence does not cover the week."), "warning", short), _item(10, 5, "cannot-limited", F.lit("Coverage, freshness or too few comparisons limit every conclusion."), "warning", limited | (c("n_pairs") == 0)),
        _item(10, 6, "cannot-supplement", F.lit("Captures prove no full inventory, ownership, safety or cause."), "info", c("n_extra") > 0),
        _item(11, 1, "action-observe", F.lit("Collect two primary observations or more."), "warning", (c("n_primary") < 2) | (c("n_pairs") == 0)), _item(11, 2, "action-week", F.lit("Observe near both ends of the week."), "warning", short),
        _item(11, 3, "action-fresh", F.lit("Observe again before calling this current."), "warning", c("stale")), _item(11, 4, "action-missing-sources", _text("Collect what is missing: ", listed(c("missing")), "."), "warning", F.size("missing") > 0),
        _item(11, 5, "action-responses", F.lit("Settle the open responses."), "review", c("n_open") > 0), _item(11, 6, "action-events", F.lit("Check that each change is expected."), "review", c("n_events") > 0),
        _item(11, 7, "action-supplement", F.lit("Take captures as context only."), "info", c("n_extra") > 0),
        _item(11, 8, "action-cadence", F.lit("Keep observing at this cadence."), "info", ~((c("n_primary") < 2) | (c("n_pairs") == 0) | short | c("stale") | (F.size("missing") > 0) | (c("n_open") > 0) | (c("n_events") > 0) | (c("n_extra") > 0))),
        _item(12, 1, "provenance-source", F.lit("Made from registered observations, their comparisons, coverage, responses and capture metadata.")),
        _item(12, 2, "provenance-counts", _text("Observations: ", c("n_primary"), "; comparisons: ", c("n_pairs"), "; responses: ", c("n_responses"), "; supplemental: ", c("n_extra"), ".")),
    ]
    return facts.select("site_id", F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def _numbered(rows: DataFrame, order: list[str], section: int, name: str, first: int, text: Column, severity: Column | str = "info", ref: Column | None = None) -> DataFrame:
    """Items of one kind, counted on by site; first: the place before them."""
    n = placed(rows, "site_id", order, name="_n")
    return n.select(
        "site_id", F.lit(section).alias("section"), (F.col("_n") + first).alias("place"), _text(f"{name}-", F.col("_n")).alias("item"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        text.alias("text"), (F.lit(None).cast("string") if ref is None else ref).alias("reference"))


def statement_rows(entries: DataFrame, comparisons: DataFrame, events: DataFrame, supplements: DataFrame, start: Column, end: Column, evaluated_at: Column) -> DataFrame:
    """(site_id, section, section_id, place, item, severity, text, reference): items of all sites; order by site_id, section and place.

    entries hold those of the period.  reference: where the evidence is; null
    where there is none, or the site's name forbids to show it.
    """
    c = F.col
    facts = site_facts(entries, comparisons, events, supplements, start, end)
    primary = entries.filter(~c("supplemental"))
    notes = primary.select("site_id", F.explode("notes").alias("note")).filter("note <> ''").distinct()
    reasons = primary.filter("freshness <> 'fresh'").select("site_id", "reason").distinct()
    told = events.filter(c("state").isin(*UNRESOLVED))
    pair = _text("Comparison ", c("number"), ": ")
    seen = _text("/activity#", F.url_encode("evidence_id"))
    friendly = F.when(F.coalesce("friendly_name", F.lit("")) != "", _text(" (", redact(c("friendly_name")), ")")).otherwise("")
    per_pair = comparisons.join(events.groupBy("site_id", "number").agg(F.count("*").alias("n")), ["site_id", "number"], "left").join(facts.select("site_id", "hidden"), "site_id")
    source = F.when(c("hidden"), "baseline to current").otherwise(_text(c("baseline_id"), " to ", c("current_id")))
    n = F.coalesce("n", F.lit(0))
    made, skipped = per_pair.filter("skipped is null"), per_pair.filter("skipped is not null")
    n_made = facts.select("site_id", (c("n_pairs") + 2).alias("_before"))
    parts = [
        fixed_items(facts, start, end, evaluated_at).withColumn("reference", F.lit(None).cast("string")),
        _numbered(notes, ["note"], 3, "coverage-note", 5, _text("Note: ", redact(c("note")), ".")).filter(c("place") <= 5 + NOTES),
        _numbered(reasons, ["reason"], 4, "freshness-limit", 2, F.coalesce("reason", F.lit("")), "warning"),
        _numbered(events, ["number", "seq"], 6, "changed", 0, _text(pair, redact(c("title")), ". ", redact(c("summary"))), "review", seen),
        _numbered(events, ["number", "seq"], 7, "review", 0, _text(pair, redact(c("review")), F.when(c("state").isNotNull(), _text(" User says: ", c("state"), ".")).otherwise("")), F.when(c("investigate"), "review").otherwise("info"), seen),
        _numbered(told, ["number", "seq"], 8, "response", 0, _text(pair, c("state"), friendly, " stays open for ", redact(c("title")), "."), "review", seen),
        _numbered(supplements.withColumn("_late", -F.unix_micros(F.coalesce(c("observed_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))))), ["_late", "seq", "registry_id"], 9, "supplement", 0, _text(redact(c("label")), ": ", redact(c("summary")), " Vantage: ", c("vantage"), "; observed ", date_time(c("observed_at")), "."), "info", _text("/captures?observation=", F.url_encode("registry_id"))),
        _numbered(made, ["number"], 12, "provenance-comparison", 2, _text(pair, source, "; rule ", c("rule_version"), "; ", n, F.when(n == 1, " event").otherwise(" events"), "; guardrails ", F.when(F.size("guardrails") > 0, F.array_join(F.array_sort("guardrails"), ", ")).otherwise("none"), "."), "info", F.lit("/activity")),
        _numbered(skipped, ["number"], 12, "provenance-skipped", 0, _text("Skipped ", source, ": ", c("skipped"), "."), "warning").join(n_made, "site_id").withColumn("place", c("place") + c("_before")).drop("_before"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    ids = F.array(*[F.lit(name) for name, _ in SECTIONS])
    rows = rows.join(facts.select("site_id", "hidden"), "site_id")
    return rows.select("site_id", "section", F.get(ids, c("section") - 1).alias("section_id"), "place", "item", "severity", "text", F.when(~c("hidden"), c("reference")).alias("reference"))


def statement_lines(rows: DataFrame) -> DataFrame:
    """(site_id, section, place, part, line): Markdown of statements, in the order of these columns; write it sorted, a file a site or one for all."""
    title = rows.filter("item = 'period-title'").select("site_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), F.inline(F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit("# "), markdown("text")).alias("line")), F.struct(F.lit(1).alias("part"), F.lit("").alias("line")))))
    heads = F.array(*[F.struct(F.lit(k).alias("section"), F.lit(t).alias("t")) for k, (_, t) in enumerate(SECTIONS, 1)])
    head = rows.select("site_id").distinct().select("site_id", F.inline(heads)).select("site_id", "section", F.lit(0).cast("long").alias("place"), F.inline(F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit("## "), F.col("t")).alias("line")), F.struct(F.lit(1).alias("part"), F.lit("").alias("line")))))
    text = F.struct(F.lit(0).alias("part"), F.concat(F.lit("- "), markdown("text")).alias("line"))
    ref = F.when(F.col("reference").isNotNull(), F.struct(F.lit(1).alias("part"), F.concat(F.lit("  Evidence: ["), F.col("item"), F.lit("]("), F.col("reference"), F.lit(")")).alias("line")))
    items = rows.select("site_id", "section", "place", F.inline(F.filter(F.array(text, ref), lambda x: x.isNotNull())))
    return title.unionByName(head).unionByName(items)
