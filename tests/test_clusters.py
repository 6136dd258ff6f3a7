"""Greedy independence clusters against the plain loop."""

import random
import re

from newsloom.operators.clusters import REPRINT, independent_clusters

SCHEMA = "article_id long, place long, title string, summary string, outlet string"


def wire(title, outlet, summary):
    said = f"{title or ''} {outlet or ''} {(summary or '')[:300]}"
    return "Associated Press" if re.search(r"\bAP\b", said) else "Reuters" if re.search(r"\breuters\b", said, re.I) else None


def loop(rows):
    words = lambda t: {w for w in re.sub(r"[^a-z0-9\s]", "", t.lower()).split() if len(w) > 3}
    leaders, out = [], {}
    for i, _, title, summary, outlet in sorted(rows, key=lambda r: (r[1], r[0])):
        x = (i, wire(title, outlet, summary), (outlet or "").strip().lower(), words(f"{title or ''} {summary or ''}"))
        for y in leaders:
            alike = x[3] and y[3] and len(x[3] & y[3]) > REPRINT * len(x[3] | y[3])
            if (x[1] and x[1] == y[1]) or (x[2] and x[2] == y[2]) or alike:
                out[i] = y[0]
                break
        else:
            leaders.append(x)
            out[i] = i
    return out


def test_clusters(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        text = " ".join(rnd.choice(["storm", "river", "council", "harbour", "market", "the"]) for _ in range(rnd.randrange(0, 6)))
        title = rnd.choice([None, "", "Calm (AP)", "via Reuters", "an app"]) if i % 4 == 0 else f"title{i % 23}"
        rows.append((i, rnd.randrange(20), title, text or None, rnd.choice([None, "", f"Outlet {i % 31}", f" outlet {i % 31} "])))
    out = independent_clusters(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.article_id: r.leader_id for r in out} == loop(rows)
    assert all((r.reason is None) == (r.article_id == r.leader_id) for r in out)


def test_no_pool(spark):
    assert independent_clusters(spark.createDataFrame([], SCHEMA)).count() == 0
