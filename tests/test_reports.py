"""Reports of literal events: empty sections, ties, caps and the largest driver."""

import json

from pyspark.sql import functions as F

from newsloom.operators import reports
from newsloom.sources.tables import Scratch


def test_reports(spark):
    t = "2024-01-0{} 00:00:00"
    events = [(1, "Flood", "Rain floods the valley.", "climate", "high", "developing", "NP", 3, 9), (2, None, None, None, None, None, None, 0, 0), (3, "Dam", "A dam.", "climate", "normal", "active", "NP", 1, 1), (4, "Vote", "A vote.", "politics", "normal", "active", None, 1, 1)]
    events = spark.createDataFrame(events, "event_id long, title string, summary string, category string, severity string, status string, country string, source_count long, article_count long")
    events = events.withColumn("first_reported_at", F.to_timestamp(F.lit(t.format(1)))).withColumn("last_updated_at", F.to_timestamp(F.lit(t.format(2))))
    arts = [(1, i, f"Title {i}", f"rainfall account {i} of sort{i} kind{i}", "Daily" if i % 2 else "Weekly", "rss", "", 0.9) for i in range(25)] + [(1, 99, None, None, None, None, None, None), (2, None, None, None, None, None, None, None)]
    arts = spark.createDataFrame(arts, "event_id long, article_id long, title string, summary string, outlet string, kind string, url string, reliability double").withColumn("published_at", F.to_timestamp(F.lit(t.format(1))))
    claims = [(1, 5, "The dam failure caused the flood", "VERIFIED", True), (1, 6, "Army began relief", "CONTRADICTED", True), (1, 7, "Heavy damage", "UNVERIFIED", True), (3, 8, "No cause", "UNVERIFIED", False)]
    claims = spark.createDataFrame(claims, "event_id long, claim_id long, claim_text string, status string, causal boolean").withColumn("extracted_at", F.to_timestamp(F.lit(t.format(2))))
    named = spark.createDataFrame([(1, "Ann", "person"), (1, "Ann", "person"), (4, "Ann", "person"), (1, "Relief Org", "organization")], "event_id long, name string, type string")
    timeline = spark.createDataFrame([(1, "article:1", 1, "TRIGGER_POINT"), (1, "article:2", 2, "AFTERMATH"), (1, "late", 21, "AFTERMATH")], "event_id long, id string, i int, phase string")
    keep = Scratch(spark, "reports-test").keep
    rows = {r.event_id: r for r in reports.assemble(reports.News(events, arts, claims, named), keep, timeline).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    r, j = rows[1], json.loads(rows[1].report)
    assert (r.confirmed, r.uncertain) == (3, 0) and j["verified_picture"] == "The dam failure caused the flood" and j["independent_sources"] == 3
    assert len(j["coverage"]) == 20 and j["meta"]["n_articles"] == 26 and j["coverage"][0] == {"id": 0, "source": "Weekly", "level": "INDEPENDENT_NEWS", "reliability": 90, "title": "Title 0", "published_at": "2024-01-01 00:00:00"}
    assert [s["claim"] for s in j["causal"] if s["status"] == "SUPPORTED"] == [5, 7] and r.gaps.startswith("preconditions,mechanism")
    assert j["what_happened"].split("\n\n") == ["Rain floods the valley.", *[f"rainfall account {i} of sort{i} kind{i}" for i in range(3)]]
    assert j["framing"] == [{"category": "Causal & Environmental", "articles": 26, "percent": 100}] and j["observation"] == "causal & environmental"
    assert [x["id"] for x in j["related"]] == [3, 4] and j["people"] == ["Ann"] and j["organizations"] == ["Relief Org"] and len(j["timeline"]) == 2
    assert r.driver == "Dispatch Velocity" and j["forecast"]["lower"] < r.probability < j["forecast"]["upper"]
    empty = json.loads(rows[2].report)
    assert rows[2].probability is None and rows[2].driver is None and "headline" not in empty and empty["verified_picture"] == "" and empty["coverage"] == [] and len(empty["gaps"]) == 9
    assert json.loads(rows[4].report)["related"] == [{"id": 1, "title": "Flood"}]
    none = reports.assemble(reports.News(events.limit(0), arts.limit(0), claims.limit(0), named.limit(0)), Scratch(spark, "reports-test").keep, timeline.limit(0))
    assert none.count() == 0
