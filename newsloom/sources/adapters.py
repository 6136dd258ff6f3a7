"""News tables over the fixture tables, as common table expressions; SURVEY-style names, explicit clock, no inference."""

from __future__ import annotations

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def first_label(d: Spark, x: str, rules: dict[str, list[str]], default: str) -> str:
    """Ordered rules: the first label with a matching term."""
    arms = " ".join(f"WHEN {d.word(x, terms)} THEN {d.text(label)}" for label, terms in rules.items())
    return f"CASE {arms} ELSE {d.text(default)} END"


def _tables(d: Spark) -> dict[str, tuple[list[str], str]]:
    """name: (what it reads, SQL)."""
    title = "left(split_part(text, chr(10), 1), 80)"
    # A text that holds a claim holds the claim's inner words as whole words: texts and claims meet by the longest of them.
    evidence = r"""
            SELECT m.claim_id, a.doc_id AS article_id, 'supports' AS stance FROM (
                SELECT DISTINCT t.doc_id, k.claim_id, k.claim_text FROM (SELECT doc_id, explode(array_distinct(split(text, '\\s+'))) AS w FROM documents) t
                JOIN (SELECT claim_id, claim_text, array_max(transform(slice(ws, 2, size(ws) - 2), w -> struct(length(w) AS n, w AS w))).w AS key FROM (SELECT claim_id, claim_text, split(claim_text, '\\s+') AS ws FROM claims) c WHERE size(ws) > 2) k ON k.key = t.w) m
            JOIN documents a ON a.doc_id = m.doc_id AND contains(a.text, m.claim_text)
            UNION ALL SELECT c.claim_id, a.doc_id, 'supports' FROM (SELECT * FROM claims WHERE size(split(claim_text, '\\s+')) <= 2) c JOIN documents a ON contains(a.text, c.claim_text)"""
    return {
        "sources": ([], """
            SELECT source_id, 'src' || source_id AS name, round(cast(0.50 + 0.05 * (source_id % 10) AS double), 2) AS reliability, source_id % 7 <> 0 AS enabled,
                   CASE source_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'gdelt' ELSE 'newsapi' END AS type
            FROM (SELECT DISTINCT cast(substr(source, 4) AS int) AS source_id FROM documents) s"""),
        "articles": ([], f"""
            SELECT doc_id AS article_id, {title} AS title, left(text, 500) AS summary, text AS content, lang, cast(substr(source, 4) AS int) AS source_id,
                   {d.minutes_after("2024-01-01 00:00:00", "(doc_id * 41) % 43200")} AS published_at
            FROM documents"""),
        "event_articles": (["articles"], "SELECT e.label AS event_id, e.vec_id AS article_id, 1.0 AS relevance FROM embeddings e JOIN articles a ON a.article_id = e.vec_id"),
        "story_events": (["event_articles", "articles"], f"""
            SELECT g.*, n.n_name AS country, {first_label(d, "lower(g.lead)", V.FIXTURE_CATEGORIES, "other")} AS category, {first_label(d, "lower(g.lead)", V.FIXTURE_SEVERITIES, "normal")} AS severity,
                   CASE WHEN g.event_id % 4 = 0 THEN 'historical' WHEN g.event_id % 2 = 0 THEN 'active' ELSE 'developing' END AS status
            FROM (SELECT ea.event_id, min_by(a.title, a.article_id) AS title, min_by(a.summary, a.article_id) AS lead, min(a.published_at) AS first_reported_at, max(a.published_at) AS last_updated_at,
                         count(*) AS article_count, count(DISTINCT a.source_id) AS source_count
                  FROM event_articles ea JOIN articles a ON a.article_id = ea.article_id GROUP BY ea.event_id) g
            JOIN nation n ON n.n_nationkey = g.event_id % 25"""),
        "claims": ([], f"""
            SELECT b.item_id AS claim_id, b.item_id % 10 AS event_id, b.text AS claim_text, CASE l.quality WHEN 1 THEN 'VERIFIED' WHEN 0 THEN 'CONTRADICTED' ELSE 'UNVERIFIED' END AS status,
                   {d.minutes_after("2024-01-01 00:00:00", "b.item_id * 60")} AS extracted_at
            FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id"""),
        "evidence": (["claims"], evidence if d.name == "spark" else "SELECT c.claim_id, a.doc_id AS article_id, 'supports' AS stance FROM claims c JOIN documents a ON contains(a.text, c.claim_text)"),
        "live_entries": ([], "SELECT event_id AS entry_id, ts AS created_at, user_id % 10 AS event_id, event_type AS entry_type FROM events"),
        "entities": (["articles"], f"""
            SELECT name, CASE WHEN length(name) % 2 = 0 THEN 'person' ELSE 'organization' END AS type, article_id
            FROM (SELECT DISTINCT article_id, name FROM {d.rows("articles", d.found("title", "[A-Z][a-z]+(?: [A-Z][a-z]+)*"), "name")}) x WHERE length(name) >= 4"""),
        "edges": (["articles", "event_articles", "claims", "entities"], """
            SELECT 'article:' || article_id AS src, 'source:' || source_id AS dst, 'REPORTED_BY' AS rel FROM articles
            UNION ALL SELECT 'article:' || article_id, 'event:' || event_id, 'COVERS_EVENT' FROM event_articles
            UNION ALL SELECT 'claim:' || claim_id, 'event:' || event_id, 'RELATES_TO' FROM claims
            UNION ALL SELECT DISTINCT 'entity:' || e.name, 'event:' || ea.event_id, 'INVOLVED_IN' FROM entities e JOIN event_articles ea ON ea.article_id = e.article_id"""),
        "nodes": (["edges"], "SELECT id, split_part(id, ':', 1) AS label FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) x"),
    }


def with_tables(d: Spark, names: list[str], body: str) -> str:
    """body with the tables that it names, and those that they read, before it."""
    tables, done = _tables(d), []

    def add(name: str) -> None:
        for x in tables[name][0]:
            add(x)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    parts = [f"{x} AS ({tables[x][1]})" for x in done]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
