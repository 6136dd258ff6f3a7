"""Verdicts, timelines, framing, forecasts and causal stages."""

from __future__ import annotations

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark
from newsloom.sources.adapters import with_tables

#: Logistic weights of the escalation forecast (fixed values).
BIAS, VELOCITY, BREADTH, RELIABILITY, HAZARD, CONTRADICTION, ENTITIES = -1.45, 0.42, 0.28, 0.35, 0.65, 0.55, 0.22
STAGES = ["preconditions", "trigger", "mechanism", "immediate_consequences", "chain_reaction", "human_response", "amplifier", "secondary_effects", "current_state"]


def claim_verdicts(d: Spark) -> str:
    """Verified with support of two different outlets; contradicted by name where the claim's own status says so."""
    return with_tables(d, ["claims", "evidence", "articles"], """
        SELECT claim_id, support, outlets, CASE WHEN status = 'CONTRADICTED' THEN 'CONTRADICTED' WHEN outlets >= 2 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verdict FROM (
        SELECT c.claim_id, c.status, count(e.article_id) AS support, count(DISTINCT a.source_id) AS outlets FROM claims c LEFT JOIN evidence e ON e.claim_id = c.claim_id LEFT JOIN articles a ON a.article_id = e.article_id GROUP BY c.claim_id, c.status) x""")


def verified_picture(d: Spark) -> str:
    """The verified claim with most query tokens, the first of those on a tie; it must hold two of them or 40 percent."""
    hits = " + ".join(f"CASE WHEN contains(lower(claim_text), {d.text(t)}) THEN 1 ELSE 0 END" for t in V.FIXTURE_TOKENS)
    return with_tables(d, ["claims"], f"SELECT claim_id, matches FROM (SELECT claim_id, {hits} AS matches FROM claims WHERE status = 'VERIFIED') x WHERE matches >= 2 OR matches >= 0.4 * {len(V.FIXTURE_TOKENS)} ORDER BY matches DESC, claim_id LIMIT 1")


def event_forecast(d: Spark) -> str:
    hazard = "CASE category " + " ".join(f"WHEN {d.text(k)} THEN {v}" for k, v in V.HAZARDS.items()) + f" ELSE {V.HAZARD_OTHER} END"
    z = f"{BIAS} + {VELOCITY} * ln(1 + article_count) + {BREADTH} * least(1.0, source_count / 6.0) + {RELIABILITY} * reliability + {HAZARD} * {hazard} + {CONTRADICTION} * contradicted + {ENTITIES} * least(1.0, greatest(1, entities) / 10.0)"
    return with_tables(d, ["story_events", "event_articles", "articles", "sources", "claims", "entities"], f"""
        , rel AS (SELECT ea.event_id, coalesce(avg(s.reliability), 0.55) AS reliability FROM event_articles ea JOIN articles a ON a.article_id = ea.article_id LEFT JOIN sources s ON s.source_id = a.source_id GROUP BY ea.event_id),
        con AS (SELECT event_id, max(CASE WHEN status = 'CONTRADICTED' THEN 1.0 ELSE 0.0 END) AS contradicted FROM claims GROUP BY event_id),
        ent AS (SELECT ea.event_id, count(DISTINCT e.name) AS entities FROM entities e JOIN event_articles ea ON ea.article_id = e.article_id GROUP BY ea.event_id),
        f AS (SELECT e.event_id, e.article_count, e.source_count, round(cast(1.0 / (1.0 + exp(-({z}))) AS double), 3) AS p FROM (SELECT ev.*, rel.reliability, coalesce(con.contradicted, 0.0) AS contradicted, coalesce(ent.entities, 0) AS entities
              FROM story_events ev JOIN rel ON rel.event_id = ev.event_id LEFT JOIN con ON con.event_id = ev.event_id LEFT JOIN ent ON ent.event_id = ev.event_id) e WHERE article_count >= 2 AND source_count >= 1)
        SELECT event_id, round(cast(p AS double), 3) AS probability, round(cast(greatest(0.01, p - 1.96 * sqrt(p * (1 - p) / greatest(10, 5 * article_count + 10 * source_count))) AS double), 3) AS lower_bound,
               round(cast(least(0.99, p + 1.96 * sqrt(p * (1 - p) / greatest(10, 5 * article_count + 10 * source_count))) AS double), 3) AS upper_bound FROM f""")


def timeline(d: Spark) -> str:
    """Milestones of an event by time with their phase."""
    return with_tables(d, ["event_articles", "articles", "claims"], f"""
        , m AS (SELECT ea.event_id, 'article:' || a.article_id AS id, a.published_at AS happened FROM event_articles ea JOIN articles a ON a.article_id = ea.article_id UNION ALL SELECT event_id, 'claim:' || claim_id, extracted_at FROM claims),
        o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY happened, id) AS i, cast({d.micros('happened')} AS double) - cast({d.micros('min(happened) OVER (PARTITION BY event_id)')} AS double) AS gone,
                     greatest(1000.0, cast({d.micros('max(happened) OVER (PARTITION BY event_id)')} AS double) - cast({d.micros('min(happened) OVER (PARTITION BY event_id)')} AS double)) AS whole FROM m)
        SELECT event_id, id, i, CASE WHEN i = 1 THEN 'TRIGGER_POINT' WHEN whole <= 1000 THEN 'DURING' WHEN gone / whole < 0.25 THEN 'BEFORE' WHEN gone / whole > 0.85 THEN 'SUBSEQUENT' WHEN gone / whole > 0.6 THEN 'AFTERMATH' ELSE 'DURING' END AS phase FROM o WHERE i <= 20""")


def framing(d: Spark) -> str:
    """The frame with most keywords; the first wins ties, also those without any."""
    n = {k: " + ".join(f"CASE WHEN {d.word('lower(summary)', [t])} THEN 1 ELSE 0 END" for t in ts) for k, ts in V.FIXTURE_FRAMES.items()}
    names = list(n)
    cols = ", ".join(f"{x} AS f{i}" for i, x in enumerate(n.values()))
    best = " ".join(f"WHEN {' AND '.join(f'f{i} >= f{j}' for j in range(len(names)) if j != i)} THEN {d.text(names[i])}" for i in range(len(names)))
    return with_tables(d, ["articles"], f"SELECT frame, count(*) AS articles, {d.integer('floor(100.0 * count(*) / max(total) + 0.5)')} AS percent FROM (SELECT CASE {best} END AS frame FROM (SELECT {cols} FROM articles) x) y CROSS JOIN (SELECT count(*) AS total FROM articles) t GROUP BY frame")


def causal_stages(d: Spark) -> str:
    """Each stage with its claim, or MISSING_EVIDENCE; a claim fills the stage of its number, later ones win."""
    stages = " UNION ALL ".join(f"SELECT {i} AS pos, {d.text(s)} AS stage" for i, s in enumerate(STAGES))
    return with_tables(d, ["claims"], f"""
        , st AS ({stages}), l AS (SELECT event_id, claim_id % 11 AS pos, max_by(claim_id, extracted_at) AS claim_id FROM claims WHERE status <> 'CONTRADICTED' GROUP BY event_id, claim_id % 11), ev AS (SELECT DISTINCT event_id FROM claims)
        SELECT ev.event_id, st.stage, l.claim_id, CASE WHEN l.claim_id IS NULL THEN 'MISSING_EVIDENCE' ELSE 'SUPPORTED' END AS status FROM ev CROSS JOIN st LEFT JOIN l ON l.event_id = ev.event_id AND l.pos = st.pos""")


def desks(d: Spark) -> str:
    """Sections: events of the category, filled up to four with the latest of the others. Only the four latest of each category and the
    eight latest of all can stand in one."""
    return with_tables(d, ["story_events"], """
        , latest AS (SELECT category, event_id, last_updated_at FROM story_events ORDER BY last_updated_at DESC, event_id LIMIT 8),
        own AS (SELECT category, event_id, last_updated_at FROM (SELECT category, event_id, last_updated_at, row_number() OVER (PARTITION BY category ORDER BY last_updated_at DESC, event_id) AS k FROM story_events) x WHERE k <= 4),
        d AS (SELECT DISTINCT category AS desk FROM own),
        offered AS (SELECT category AS desk, 0 AS other, event_id, last_updated_at FROM own UNION ALL SELECT d.desk, 1, l.event_id, l.last_updated_at FROM d CROSS JOIN latest l WHERE l.category <> d.desk)
        SELECT desk, event_id, rn FROM (SELECT desk, event_id, row_number() OVER (PARTITION BY desk ORDER BY other, last_updated_at DESC, event_id) AS rn FROM offered) x WHERE rn <= 4""")


QUERIES = [claim_verdicts, verified_picture, event_forecast, timeline, framing, causal_stages, desks]
