"""Lists, details, counters and merges over the news tables. Each function gives the SQL of one query in a dialect."""

from __future__ import annotations

from newsloom.functions.dialect import Spark
from newsloom.sources.adapters import AS_OF, with_tables


def page(number: int = 1, size: int = 20) -> tuple[int, int]:
    """LIMIT and OFFSET of a page: number from 1, size from 1 to 100."""
    size = min(100, max(1, size))
    return size, (max(1, number) - 1) * size


def articles_page(d: Spark, needle: str = "%attion%", number: int = 1, size: int = 20) -> str:
    limit, offset = page(number, size)
    return with_tables(d, ["articles", "sources"], f"""
        SELECT a.article_id, a.title, s.name AS source_name, s.reliability, a.published_at FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id
        WHERE a.title ILIKE {d.text(needle)} OR a.summary ILIKE {d.text(needle)} ORDER BY a.published_at DESC NULLS LAST, a.article_id LIMIT {limit} OFFSET {offset}""")


def articles_total_pages(d: Spark, size: int = 20) -> str:
    return with_tables(d, ["articles"], f"SELECT count(*) AS total, cast(ceil(count(*) / {float(size)}) AS bigint) AS total_pages FROM articles WHERE lang = 'en'")


def events_filtered_page(d: Spark) -> str:
    return with_tables(d, ["story_events"], "SELECT event_id, title, category, severity, status, article_count FROM story_events WHERE status IN ('active', 'developing') ORDER BY last_updated_at DESC, event_id LIMIT 20")


def platform_stats(d: Spark) -> str:
    one = lambda q, name: f"(SELECT count(*) FROM {q}) AS {name}"
    return with_tables(d, ["articles", "sources", "story_events", "claims", "entities"], "SELECT " + ", ".join([
        one("story_events", "total_events"), one("story_events WHERE status IN ('active', 'developing')", "active_events"), one("articles", "total_articles"),
        one("sources WHERE enabled", "enabled_sources"), one("claims WHERE status = 'VERIFIED'", "verified_claims"), one("(SELECT DISTINCT name, type FROM entities) e", "total_entities")]))


def source_article_counts(d: Spark) -> str:
    return with_tables(d, ["articles", "sources"], "SELECT s.source_id, s.name, s.type, s.enabled, count(a.article_id) AS article_count FROM sources s LEFT JOIN articles a ON a.source_id = s.source_id GROUP BY s.source_id, s.name, s.type, s.enabled")


def enabled_sources(d: Spark) -> str:
    return with_tables(d, ["sources"], "SELECT source_id, name, type FROM sources WHERE enabled ORDER BY name")


def live_feed(d: Spark) -> str:
    return with_tables(d, ["live_entries", "story_events"], "SELECT l.entry_id, l.created_at, l.entry_type, e.title AS event_title FROM live_entries l LEFT JOIN story_events e ON e.event_id = l.event_id ORDER BY l.created_at DESC, l.entry_id LIMIT 50")


def live_feed_merge(d: Spark) -> str:
    """New ids only, then the merged feed."""
    return with_tables(d, ["live_entries"], """
        SELECT entry_id, created_at, entry_type FROM live_entries WHERE entry_id % 3 = 0
        UNION ALL SELECT n.entry_id, n.created_at, n.entry_type FROM live_entries n WHERE n.entry_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM live_entries o WHERE o.entry_id % 3 = 0 AND o.entry_id = n.entry_id)""")


def event_articles_detail(d: Spark) -> str:
    return with_tables(d, ["event_articles", "articles", "sources"], """
        SELECT ea.event_id, a.article_id, a.title, s.name AS source_name, ea.relevance FROM event_articles ea JOIN articles a ON a.article_id = ea.article_id LEFT JOIN sources s ON s.source_id = a.source_id WHERE ea.event_id = 3""")


def claims_with_evidence(d: Spark) -> str:
    return with_tables(d, ["claims", "evidence", "story_events"], f"""
        SELECT c.claim_id, c.status, max(e.title) AS event_title, count(v.article_id) AS evidence_count, {d.joined(d.each(d.list_where("v.article_id", "v.article_id IS NOT NULL"), "cast(x AS string)"), ",")} AS evidence_ids
        FROM claims c LEFT JOIN story_events e ON e.event_id = c.event_id LEFT JOIN evidence v ON v.claim_id = c.claim_id GROUP BY c.claim_id, c.status""")


def claim_evidence_count(d: Spark) -> str:
    return with_tables(d, ["claims", "evidence"], "SELECT c.claim_id, count(v.article_id) AS evidence_count FROM claims c LEFT JOIN evidence v ON v.claim_id = c.claim_id GROUP BY c.claim_id")


def event_entities(d: Spark) -> str:
    return with_tables(d, ["entities", "event_articles"], "SELECT ea.event_id, e.name, e.type, count(*) AS mentions FROM entities e JOIN event_articles ea ON ea.article_id = e.article_id GROUP BY ea.event_id, e.name, e.type")


def related_events(d: Spark) -> str:
    """Same category, or the same known country: two equi-joins, then the best four of each event."""
    return with_tables(d, ["story_events"], """
        , pairs AS (SELECT a.event_id, b.event_id AS related_id, b.article_count FROM story_events a JOIN story_events b ON a.category = b.category AND a.event_id <> b.event_id
                    UNION SELECT a.event_id, b.event_id, b.article_count FROM story_events a JOIN story_events b ON a.country = b.country AND a.event_id <> b.event_id)
        SELECT event_id, related_id, rn FROM (SELECT event_id, related_id, row_number() OVER (PARTITION BY event_id ORDER BY article_count DESC, related_id) AS rn FROM pairs) x WHERE rn <= 4""")


def event_family(d: Spark, token: str = "er") -> str:
    """Events of three seeds' country and category, or with the question's first word in the title: four each, the latest."""
    return with_tables(d, ["story_events"], f"""
        , near AS (SELECT s.event_id AS seed_id, e.event_id, e.last_updated_at FROM story_events s JOIN story_events e ON e.country = s.country AND e.category = s.category AND e.event_id <> s.event_id WHERE s.event_id < 3
                   UNION SELECT s.event_id, e.event_id, e.last_updated_at FROM (SELECT event_id FROM story_events WHERE event_id < 3) s JOIN (SELECT event_id, last_updated_at FROM story_events WHERE title ILIKE {d.text(f"%{token}%")}) e ON e.event_id <> s.event_id)
        SELECT seed_id, event_id, 0.45 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY last_updated_at DESC, event_id) AS rn FROM near) x WHERE rn <= 4""")


def event_counters(d: Spark) -> str:
    return with_tables(d, ["event_articles", "articles"], f"""
        SELECT ea.event_id, count(*) AS article_count, count(DISTINCT a.source_id) AS source_count, {d.joined(d.sorted(d.distinct(d.list_where("a.lang", "a.lang IS NOT NULL"))), ",")} AS langs
        FROM event_articles ea JOIN articles a ON a.article_id = ea.article_id GROUP BY ea.event_id""")


def semi_articles_in_event(d: Spark) -> str:
    return with_tables(d, ["articles", "event_articles"], "SELECT a.article_id FROM articles a WHERE EXISTS (SELECT 1 FROM event_articles ea WHERE ea.article_id = a.article_id AND ea.event_id = 2)")


def anti_orphan_articles(d: Spark) -> str:
    return with_tables(d, ["articles", "event_articles"], "SELECT a.article_id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM event_articles ea WHERE ea.article_id = a.article_id)")


def recent_events(d: Spark) -> str:
    """Events of the last seven days before the clock, which is the newest update if that is earlier, that aren't history."""
    return with_tables(d, ["story_events"], f"""
        , now AS (SELECT least({AS_OF}, max(last_updated_at)) AS at FROM story_events)
        SELECT e.event_id, e.last_updated_at FROM story_events e CROSS JOIN now n WHERE e.last_updated_at > n.at - INTERVAL '7' DAY AND e.status <> 'historical'""")


def entity_upsert(d: Spark) -> str:
    """Upsert by (name, type): a new description replaces the old one if there is any."""
    return with_tables(d, ["entities"], """
        , old AS (SELECT name, type, min(article_id) AS description FROM entities WHERE article_id % 2 = 0 GROUP BY name, type), new AS (SELECT name, type, max(CASE WHEN article_id % 3 = 0 THEN article_id END) AS description FROM entities WHERE article_id % 2 = 1 GROUP BY name, type)
        SELECT coalesce(n.name, o.name) AS name, coalesce(n.type, o.type) AS type, coalesce(n.description, o.description) AS description FROM old o FULL OUTER JOIN new n ON n.name = o.name AND n.type = o.type""")


def conversation_threads(d: Spark) -> str:
    return "SELECT conv_id, count(*) AS messages, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations WHERE role <> 'system' GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 60"


def followup_blend(d: Spark) -> str:
    """A short user turn, or one that asks for a cause, is read together with the turn before it."""
    return """SELECT conv_id, turn, CASE WHEN prev IS NOT NULL AND (length(text) < 15 OR contains(lower(text), 'why did') OR contains(lower(text), 'what caused')) THEN text || ' ' || prev ELSE text END AS effective
        FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS prev FROM conversations WHERE role = 'user') x"""


def sources_last_fetched(d: Spark) -> str:
    return with_tables(d, ["articles"], "SELECT source_id, max(published_at) AS last_fetched_at FROM articles GROUP BY source_id")


def graph_neighbors(d: Spark) -> str:
    return with_tables(d, ["edges", "nodes"], """
        SELECT s.id AS seed, e.rel, e.dst AS neighbor, n.label FROM (SELECT id FROM nodes WHERE label = 'event') s
        JOIN (SELECT src, dst, rel FROM edges UNION SELECT dst, src, rel FROM edges) e ON e.src = s.id JOIN nodes n ON n.id = e.dst WHERE n.label <> 'entity'""")


def graph_two_hop(d: Spark) -> str:
    return with_tables(d, ["edges"], """
        , ev AS (SELECT DISTINCT src AS mid, dst AS event FROM edges WHERE rel = 'INVOLVED_IN')
        SELECT a.event AS seed, b.event AS reached, count(*) AS paths FROM ev a JOIN ev b ON a.mid = b.mid AND a.event <> b.event GROUP BY a.event, b.event""")


def graph_node_counts(d: Spark) -> str:
    return with_tables(d, ["nodes"], "SELECT label, count(*) AS nodes FROM nodes GROUP BY label")


def stream_tumbling(d: Spark) -> str:
    return f"SELECT {d.bucket('ts', 60)} AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY {d.bucket('ts', 60)}, event_type" if d.name == "duck" else "SELECT window.start AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY window(ts, '60 minutes'), event_type"


def stream_session(d: Spark) -> str:
    """Sessions of a user: events less than 30 minutes apart."""
    return f"""SELECT user_id, session, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM (
        SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n, {d.integer("sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")} AS session
        FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, session"""


QUERIES = [
    articles_page, articles_total_pages, events_filtered_page, platform_stats, source_article_counts, enabled_sources, live_feed, live_feed_merge, event_articles_detail, claims_with_evidence,
    claim_evidence_count, event_entities, related_events, event_family, event_counters, semi_articles_in_event, anti_orphan_articles, recent_events, entity_upsert, conversation_threads,
    followup_blend, sources_last_fetched, graph_neighbors, graph_two_hop, graph_node_counts, stream_tumbling, stream_session,
]
