"""Verdicts on literal reports, and leaders by rounds against the plain order."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import verification
from newsloom.sources.tables import Scratch

REPORTS = "claim_id long, article_id long, published_at timestamp, title string, summary string, outlet string, kind string, url string"


def report(claim, article, outlet, kind="rss", title=None, url="", summary=""):
    return claim, article, None, title or f"headline{article} words{article} differ{article}", summary, outlet, kind, url


@pytest.mark.parametrize("group", [verification.GROUP, 1])
def test_verdicts(spark, monkeypatch, group):
    monkeypatch.setattr(verification, "GROUP", group)
    support = [
        report(1, 1, "Daily"), report(1, 2, "Weekly"),  # two outlets
        report(2, 3, "Daily", summary="By Reuters"), report(2, 4, "Weekly", summary="Reuters reports"),  # one wire
        report(3, 5, "Ministry of Water", "official"),  # official
        report(4, 6, "Reddit", "social"), report(4, 7, "Telegram", "social"),  # signals only
        report(5, 8, "Daily"),
        report(6, 9, "Daily"), report(6, 10, "Weekly"),
        report(8, 11, "Daily", title="rain floods valley again today"), report(8, 12, "Other", title="Rain floods valley again today!"),  # a reprint
        report(9, 13, "daily "), report(9, 14, "Daily"), report(9, 14, "Daily"), report(9, 15, None), report(9, 16, ""),  # outlets by name; unnamed ones are not the same
        report(10, 17, "Blog", "", url="https://www.agency.gov/x"),
    ]
    against = [report(6, 21, "The Herald"), report(6, 20, None), report(7, 22, "Gazette")]
    make = lambda rows: spark.createDataFrame(rows, REPORTS)
    claims = spark.createDataFrame([(i,) for i in [*range(1, 12), 11]], "claim_id long")
    out = {r.claim_id: tuple(r)[1:] for r in verification.verify(claims, make(support), make(against), Scratch(spark, "verdicts").keep).collect()}
    assert out == {
        1: ("VERIFIED", "VERIFIED", 2, "NEWS REPORTING"),
        2: ("UNVERIFIED", "UNVERIFIED", 1, "NEWS REPORTING"),
        3: ("VERIFIED", "VERIFIED", 1, "PRIMARY SOURCE"),
        4: ("UNVERIFIED", "UNVERIFIED (PUBLIC SIGNAL ONLY)", 2, "PUBLIC SIGNAL"),
        5: ("UNVERIFIED", "UNVERIFIED", 1, "NEWS REPORTING"),
        6: ("CONTRADICTED", "CONTRADICTED BY INDEPENDENT REPORTING", 2, "NEWS REPORTING"),
        7: ("CONTRADICTED", "CONTRADICTED BY GAZETTE", 1, "NEWS REPORTING"),
        8: ("UNVERIFIED", "UNVERIFIED", 1, "NEWS REPORTING"),
        9: ("VERIFIED", "VERIFIED", 3, "NEWS REPORTING"),
        10: ("VERIFIED", "VERIFIED", 1, "PRIMARY SOURCE"),
        11: ("UNVERIFIED", "UNVERIFIED", 0, "NEWS REPORTING"),
    }
    assert verification.verify(claims.limit(0), make([]), make([]), Scratch(spark, "verdicts").keep).count() == 0


def test_rounds_equal_the_fold(spark, monkeypatch):
    """One claim with most reports: rounds and the fold lead by the same reports."""
    rng = random.Random(6)
    words = ["river", "valley", "flood", "rescue", "bridge", "school"]
    rows = [report(rng.choice([1, 1, 1, 2, 3]), i, rng.choice("ABCDEFGHIJ"), title=" ".join(rng.choice(words) for _ in range(5)) + rng.choice(["", " reuters", " AP"])) for i in range(150)]
    df = verification.marked(spark.createDataFrame(rows, REPORTS).withColumn("published_at", F.timestamp_seconds(F.pmod(F.xxhash64("article_id"), F.lit(50)))))
    led = lambda: {(r.claim_id, r.x.article_id) for r in verification.leaders(df, Scratch(spark, "rounds").keep).collect()}
    whole = led()
    monkeypatch.setattr(verification, "GROUP", 4)
    assert led() == whole and 5 < len(whole) < 60
