"""DuckDB SQL for the verdicts on claims: the reports of a claim are taken one after the other."""

from __future__ import annotations

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Duck, Spark
from newsloom.operators.text import hierarchy_sql, wire_sql
from newsloom.sources.adapters import with_tables


def reports(d: Spark) -> str:
    """Reports of the claims that the articles hold, each for or against: sources of some numbers deny claims that are labelled contradicted, and
    some pass for social or official ones."""
    return """SELECT e.claim_id, a.article_id, a.published_at, a.title, a.summary, s.name AS outlet, CASE WHEN a.source_id % 5 = 4 THEN 'social' WHEN a.source_id % 11 = 6 THEN 'official' ELSE s.type END AS kind, '' AS url,
        c.status = 'CONTRADICTED' AND a.source_id % 3 = 0 AS denies FROM claims c JOIN evidence e ON e.claim_id = c.claim_id JOIN articles a ON a.article_id = e.article_id LEFT JOIN sources s ON s.source_id = a.source_id"""


def claim_verifications() -> str:
    d = Duck()
    return with_tables(d, ["claims", "evidence", "articles", "sources"], f"""
        , every AS ({reports(d)}),
        marked AS (SELECT claim_id, article_id, row_number() OVER (PARTITION BY claim_id ORDER BY published_at, article_id) AS place, lower(trim(coalesce(outlet, ''))) AS outlet, {wire_sql(d, "(coalesce(title, '') || ' ' || coalesce(outlet, '') || ' ' || left(coalesce(summary, ''), 300))", V.FIXTURE_WIRES)} AS wire,
            {hierarchy_sql(d, "coalesce(outlet, '')", "coalesce(kind, '')", "url")} AS level, list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), '[^a-z0-9 \\t\\n\\x0b\\x0c\\r]', '', 'g'), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda w: length(w) > 3)) AS ws
            FROM (SELECT DISTINCT * FROM every WHERE NOT denies) x),
        dependent AS (SELECT b.claim_id, b.place, a.place AS earlier FROM marked a JOIN marked b ON a.claim_id = b.claim_id AND a.place < b.place
            WHERE coalesce(a.wire = b.wire, false) OR (a.outlet = b.outlet AND a.outlet <> '') OR (len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) > 0.65 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))))),
        led(claim_id, k, leaders) AS (SELECT DISTINCT claim_id, 0::bigint, []::bigint[] FROM marked UNION ALL
            SELECT l.claim_id, l.k + 1, CASE WHEN EXISTS (SELECT 1 FROM dependent x WHERE x.claim_id = l.claim_id AND x.place = l.k + 1 AND list_contains(l.leaders, x.earlier)) THEN l.leaders ELSE list_append(l.leaders, l.k + 1) END
            FROM led l JOIN marked m ON m.claim_id = l.claim_id AND m.place = l.k + 1),
        last AS (SELECT claim_id, arg_max(leaders, k) AS leaders FROM led GROUP BY claim_id),
        summed AS (SELECT l.claim_id, count(*) AS clusters, bool_or(m.level IN ('PRIMARY SOURCE', 'SCIENTIFIC_TECHNICAL')) AS official, bool_and(m.level = 'PUBLIC_SIGNAL') AS social FROM last l JOIN marked m ON m.claim_id = l.claim_id AND list_contains(l.leaders, m.place) GROUP BY l.claim_id),
        denied AS (SELECT claim_id, arg_min(outlet, (published_at, article_id)) AS by, count(*) AS denials FROM (SELECT DISTINCT claim_id, article_id, published_at, coalesce(outlet, 'Independent Reporting') AS outlet FROM every WHERE denies) x GROUP BY claim_id)
        SELECT c.claim_id, CASE WHEN n.denials IS NOT NULL THEN 'CONTRADICTED' WHEN s.social THEN 'UNVERIFIED' WHEN s.official OR s.clusters >= 2 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status,
               CASE WHEN n.denials IS NOT NULL THEN 'CONTRADICTED BY ' || upper(n.by) WHEN s.social THEN 'UNVERIFIED (PUBLIC SIGNAL ONLY)' WHEN s.official OR s.clusters >= 2 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS badge,
               coalesce(n.denials, s.clusters, 0) AS independent_sources, CASE WHEN n.denials IS NOT NULL THEN 'NEWS REPORTING' WHEN s.social THEN 'PUBLIC SIGNAL' WHEN s.official THEN 'PRIMARY SOURCE' ELSE 'NEWS REPORTING' END AS provenance
        FROM claims c LEFT JOIN summed s ON s.claim_id = c.claim_id LEFT JOIN denied n ON n.claim_id = c.claim_id""").replace("WITH ", "WITH RECURSIVE ", 1)


def oracle_sql() -> dict[str, str]:
    return {"claim_verifications": claim_verifications()}
