"""Writes as set operations: links, merges, updates, logs and checks; small projections and labels. Each query gives the table after the write."""

from __future__ import annotations

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark
from newsloom.sources.adapters import AS_OF, with_tables

#: Types, states and ranges that rows must keep to (fixed values).
SOURCE_TYPES = ("rss", "gdelt", "newsapi", "manual")
EVENT_STATES = ("developing", "ongoing", "resolved", "historical")
#: Defaults of user settings (fixed values).
SETTINGS = {"theme": "dark", "language": "en", "page_size": "20"}


def _in(xs: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def entity_event_links(d: Spark) -> str:
    """Stored links, and those of new mentions that aren't stored yet."""
    return with_tables(d, ["entities", "event_articles"], """
        , mentions AS (SELECT DISTINCT e.name, e.type, ea.event_id, e.article_id % 2 AS fresh FROM entities e JOIN event_articles ea ON ea.article_id = e.article_id),
        old AS (SELECT DISTINCT name, type, event_id FROM mentions WHERE fresh = 0), new AS (SELECT DISTINCT name, type, event_id FROM mentions WHERE fresh = 1)
        SELECT name, type, event_id, 'stored' AS origin FROM old UNION ALL
        SELECT n.name, n.type, n.event_id, 'linked' FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.name = n.name AND o.type = n.type AND o.event_id = n.event_id)""")


def new_events(d: Spark) -> str:
    """An event of its own for each article without one, and the entry that announces it."""
    return with_tables(d, ["articles", "event_articles"], f"""
        SELECT 'event:' || {d.sha256("cast(a.article_id AS string)" if d.name == "spark" else "cast(a.article_id AS varchar)")} AS event_id, left(a.title, 120) AS title, left(a.summary, 200) AS description, 'developing' AS status, 1 AS article_count,
               1 AS source_count, a.published_at AS first_reported_at, 'new_event' AS entry_type
        FROM articles a WHERE NOT EXISTS (SELECT 1 FROM event_articles ea WHERE ea.article_id = a.article_id)""")


def new_evidence_entries(d: Spark) -> str:
    """A live entry for each article that joins an event, with its source's name."""
    return with_tables(d, ["event_articles", "articles", "sources"], """
        SELECT ea.event_id, a.article_id, 'new_evidence' AS entry_type, left(a.title, 120) AS title, coalesce(s.name, 'Unknown source') AS source_name
        FROM event_articles ea JOIN articles a ON a.article_id = ea.article_id LEFT JOIN sources s ON s.source_id = a.source_id AND s.enabled""")


def event_article_relevance(d: Spark) -> str:
    """Links written more than once keep what the last write says."""
    return with_tables(d, ["event_articles"], """
        , writes AS (SELECT event_id, article_id, 1 AS seq, cast(0.5 AS double) AS relevance FROM event_articles UNION ALL SELECT event_id, article_id, 2, cast(0.5 AS double) + (article_id % 50) / cast(100 AS double) FROM event_articles WHERE article_id % 3 = 0)
        SELECT event_id, article_id, round(max_by(relevance, seq), 6) AS relevance FROM writes GROUP BY event_id, article_id""")


def category_update(d: Spark) -> str:
    """Events of the catch-all category take the category that their severity suggests; then events by category."""
    return with_tables(d, ["story_events"], "SELECT category, count(*) AS events FROM (SELECT CASE WHEN category = 'other' AND severity = 'critical' THEN 'conflict' WHEN category = 'other' AND severity = 'high' THEN 'climate' ELSE category END AS category FROM story_events) x GROUP BY category ORDER BY events DESC, category")


def causal_inserts(d: Spark) -> str:
    """Links with a cause, an effect and a type; confidence from 0 to 1, 0.8 where none is given."""
    return with_tables(d, ["claims"], """
        , offered AS (SELECT claim_id, event_id, CASE WHEN claim_id % 5 = 0 THEN NULL ELSE left(claim_text, 60) END AS cause_text, left(claim_text, 30) AS effect_text, CASE claim_id % 3 WHEN 0 THEN 'trigger' WHEN 1 THEN 'mechanism' ELSE '' END AS relationship_type, cast((claim_id % 8) / cast(5 AS double) - 0.2 AS double) AS given FROM claims)
        SELECT claim_id, event_id, relationship_type, cause_text, effect_text, round(least(cast(1 AS double), greatest(cast(0 AS double), coalesce(nullif(round(given, 6), 0), 0.8))), 6) AS confidence
        FROM offered WHERE coalesce(cause_text, '') <> '' AND coalesce(effect_text, '') <> '' AND relationship_type <> ''""")


def causal_merge(d: Spark) -> str:
    """Stored links first, then those of the graph whose id isn't among them."""
    return with_tables(d, ["claims"], """
        , u AS (SELECT claim_id AS link_id, 'stored' AS origin, 1 AS lane FROM claims WHERE claim_id % 2 = 0 UNION ALL SELECT claim_id, 'graph', 2 FROM claims WHERE claim_id % 3 = 0)
        SELECT link_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY lane) AS rn FROM u) x WHERE rn = 1""")


def related_merge(d: Spark) -> str:
    """Related events of an event, stored ones before those of the graph, each once, eight at most."""
    return with_tables(d, ["story_events", "edges"], """
        , stored AS (SELECT a.event_id, b.event_id AS related_id, 1 AS lane FROM story_events a JOIN story_events b ON b.category = a.category AND b.event_id <> a.event_id WHERE a.event_id = 3),
        near AS (SELECT 3 AS event_id, cast(split_part(y.dst, ':', 2) AS int) AS related_id, 2 AS lane FROM edges x JOIN edges y ON y.src = x.src AND y.rel = 'INVOLVED_IN' AND y.dst <> x.dst WHERE x.dst = 'event:3' AND x.rel = 'INVOLVED_IN' GROUP BY y.dst),
        u AS (SELECT * FROM stored UNION ALL SELECT * FROM near), once AS (SELECT related_id, lane, row_number() OVER (PARTITION BY related_id ORDER BY lane) AS rn FROM u)
        SELECT related_id, lane, place FROM (SELECT related_id, lane, row_number() OVER (ORDER BY lane, related_id) AS place FROM once WHERE rn = 1) x WHERE place <= 8""")


def entity_merge(d: Spark) -> str:
    """Entities by lower-cased name, stored ones first; those only the graph knows get an id of their own."""
    return with_tables(d, ["entities"], """
        , u AS (SELECT name, 1 AS lane, min(article_id) AS first_article FROM entities WHERE article_id % 2 = 0 GROUP BY name UNION ALL SELECT upper(name), 2, min(article_id) FROM entities GROUP BY upper(name))
        SELECT lower(name) AS key_name, name, CASE WHEN lane = 1 THEN 'stored' ELSE 'graph-' || lower(name) END AS origin FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY lane, name) AS rn FROM u) x WHERE rn = 1""")


def job_log(d: Spark) -> str:
    """A run's totals by source: fetched, ingested and duplicates; failed where nothing was fetched."""
    return with_tables(d, ["articles", "sources"], f"""
        , h AS (SELECT source_id, article_id, row_number() OVER (PARTITION BY {d.sha256("lower(content)")} ORDER BY article_id) AS rn FROM articles),
        n AS (SELECT source_id, count(*) AS fetched, count(CASE WHEN rn = 1 THEN 1 END) AS ingested FROM h GROUP BY source_id)
        SELECT s.source_id, CASE WHEN s.enabled AND n.fetched > 0 THEN 'completed' ELSE 'failed' END AS status, coalesce(n.fetched, 0) AS fetched, coalesce(n.ingested, 0) AS ingested, coalesce(n.fetched - n.ingested, 0) AS duplicates
        FROM sources s LEFT JOIN n ON n.source_id = s.source_id""")


def job_totals(d: Spark) -> str:
    return f"WITH log AS ({job_log(d)}) SELECT {d.integer('sum(coalesce(fetched, 0))')} AS fetched, {d.integer('sum(coalesce(ingested, 0))')} AS ingested, {d.integer('sum(coalesce(duplicates, 0))')} AS duplicates FROM log"


def user_upsert(d: Spark) -> str:
    """A user's name stays unless it is empty; a new photo replaces the old one if there is any."""
    return """WITH old AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS display_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'old.png' END AS photo FROM customer WHERE c_custkey % 10 < 7),
        new AS (SELECT c_custkey AS user_id, c_mktsegment AS display_name, CASE WHEN c_custkey % 5 = 0 THEN 'new.png' END AS photo FROM customer WHERE c_custkey % 10 > 3)
        SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(nullif(o.display_name, ''), n.display_name, '') AS display_name, coalesce(n.photo, o.photo) AS photo FROM old o FULL OUTER JOIN new n ON n.user_id = o.user_id"""


def user_settings(d: Spark) -> str:
    """Defaults, then what is stored, then what is sent; sent values that are not allowed are dropped."""
    return f"""SELECT c_custkey AS user_id, coalesce(CASE WHEN sent_theme IN ('dark', 'light') THEN sent_theme END, stored_theme, '{SETTINGS['theme']}') AS theme, coalesce(sent_language, '{SETTINGS['language']}') AS language,
        cast(coalesce(CASE WHEN sent_size BETWEEN 1 AND 100 THEN sent_size END, {SETTINGS['page_size']}) AS bigint) AS page_size FROM (
        SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'plaid' END AS sent_theme, CASE WHEN c_custkey % 2 = 0 THEN 'light' END AS stored_theme, CASE WHEN c_custkey % 7 = 0 THEN 'fr' END AS sent_language, c_custkey % 130 - 5 AS sent_size FROM customer) x"""


def account_stats(d: Spark) -> str:
    """What a user's account page counts; orders stand for fact checks."""
    return "SELECT c.c_custkey AS user_id, count(o.o_orderkey) AS fact_checks, count(CASE WHEN o.o_orderstatus = 'F' THEN 1 END) AS finished FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey"


def account_delete(d: Spark) -> str:
    """Deleting accounts takes their orders with them and unlinks what only refers to them."""
    return "SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)"


def source_update(d: Spark) -> str:
    """Sources after a patch, a deletion and an insertion."""
    return with_tables(d, ["sources"], """
        , patch AS (SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 'renamed ' || name END AS name, CASE WHEN source_id % 3 = 0 THEN cast(0.9 AS double) END AS reliability FROM sources WHERE source_id % 4 = 0)
        SELECT s.source_id, coalesce(p.name, s.name) AS name, round(coalesce(p.reliability, s.reliability), 6) AS reliability FROM sources s LEFT JOIN patch p ON p.source_id = s.source_id WHERE s.source_id <> 5
        UNION ALL SELECT max(source_id) + 1, 'added', cast(0.5 AS double) FROM sources""")


def seed_sources(d: Spark) -> str:
    """Seed rows whose name is not there yet are inserted; one of the seeds is taken for stored already, with another reliability."""
    none = f"cast(NULL AS {'string' if d.name == 'spark' else 'varchar'})"
    seeds = " UNION ALL ".join(f"SELECT {d.text(n)} AS name, {d.text(t)} AS type, {d.text(u) if u else none} AS url, cast({r} AS double) AS reliability, {str(e).lower()} AS enabled" for n, t, u, r, e in V.SOURCES)
    return with_tables(d, ["sources"], f""", stored AS (SELECT name, type, {none} AS url, cast(reliability AS double) AS reliability, enabled FROM sources UNION ALL SELECT {d.text(V.SOURCES[2][0])}, 'rss', {none}, cast(0.5 AS double), false), seeds AS ({seeds})
        SELECT name, type, url, reliability, enabled FROM stored UNION ALL SELECT name, type, url, reliability, enabled FROM seeds x WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.name = x.name)""")


def conversation_delete(d: Spark) -> str:
    """Users delete conversations: of the demands, which name a conversation and a user, only those of its owner take effect. A
    conversation belongs to the user of its number modulo 5; every seventh user asks for a conversation that is not theirs."""
    return """WITH demands AS (SELECT DISTINCT conv_id, (conv_id + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END) % 5 AS user_id FROM conversations WHERE conv_id % 3 = 0), owned AS (SELECT conv_id, turn, conv_id % 5 AS owner_id FROM conversations)
        SELECT conv_id, count(*) AS messages FROM owned o WHERE NOT EXISTS (SELECT 1 FROM demands x WHERE x.conv_id = o.conv_id AND x.user_id = o.owner_id) GROUP BY conv_id"""


def conversation_search(d: Spark) -> str:
    """Turns that hold the words as they are; a percent sign is one."""
    return "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), lower('Er'))"


def constraint_violations(d: Spark) -> str:
    """Rows that break an enumeration or a range, by rule."""
    return with_tables(d, ["sources", "story_events", "event_articles"], f"""
        SELECT 'source type' AS rule, count(CASE WHEN type NOT IN {_in(SOURCE_TYPES)} THEN 1 END) AS violations FROM sources UNION ALL
        SELECT 'reliability', count(CASE WHEN reliability < 0 OR reliability > 1 THEN 1 END) FROM sources UNION ALL
        SELECT 'event status', count(CASE WHEN status NOT IN {_in(EVENT_STATES)} THEN 1 END) FROM story_events UNION ALL
        SELECT 'relevance', count(CASE WHEN relevance < 0 OR relevance > 1 THEN 1 END) FROM event_articles""")


def hydrate_articles(d: Spark) -> str:
    """Articles by a list of ids that the graph found."""
    return with_tables(d, ["articles", "edges"], """
        , ids AS (SELECT DISTINCT cast(split_part(src, ':', 2) AS bigint) AS article_id FROM edges WHERE rel = 'COVERS_EVENT' AND dst IN ('event:1', 'event:4'))
        SELECT a.article_id, a.title, a.published_at FROM articles a WHERE a.article_id IN (SELECT article_id FROM ids)""")


def articles_with_events(d: Spark) -> str:
    """The list that repeats an article for each of its events, beside the total that counts it once."""
    return with_tables(d, ["articles", "sources", "event_articles"], """
        , links AS (SELECT event_id, article_id FROM event_articles UNION ALL SELECT (event_id + 1) % 10, article_id FROM event_articles WHERE article_id % 4 = 0)
        SELECT a.article_id, s.name AS source_name, l.event_id, (SELECT count(*) FROM articles) AS total FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id LEFT JOIN links l ON l.article_id = a.article_id""")


def training_rows(d: Spark) -> str:
    """One row per article for the ranker's training, of its first event; the first 500 are kept as samples."""
    return with_tables(d, ["articles", "sources", "event_articles", "story_events"], """
        , joined AS (SELECT a.article_id, a.title, a.published_at, s.reliability, e.event_id, e.category, row_number() OVER (PARTITION BY a.article_id ORDER BY a.published_at, e.event_id) AS rn
                     FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id LEFT JOIN event_articles ea ON ea.article_id = a.article_id LEFT JOIN story_events e ON e.event_id = ea.event_id)
        SELECT article_id, title, published_at, reliability, event_id, category FROM joined WHERE rn = 1 ORDER BY article_id LIMIT 500""")


def event_claims_graph(d: Spark) -> str:
    """Claims that the graph ties to an event, with the event's other neighbours counted."""
    return with_tables(d, ["edges"], """
        , c AS (SELECT src, dst FROM edges WHERE rel = 'RELATES_TO'), n AS (SELECT dst, count(*) AS degree FROM edges GROUP BY dst)
        SELECT c.src AS claim, c.dst AS event, n.degree FROM c JOIN n ON n.dst = c.dst""")


def stored_source_counts(d: Spark) -> str:
    """The larger of an event's stored counter and its distinct named sources."""
    return with_tables(d, ["story_events", "event_articles", "articles", "sources"], """
        SELECT e.event_id, greatest(max(e.event_id % 4), count(DISTINCT s.name)) AS sources FROM story_events e LEFT JOIN event_articles ea ON ea.event_id = e.event_id LEFT JOIN articles a ON a.article_id = ea.article_id
        LEFT JOIN sources s ON s.source_id = a.source_id GROUP BY e.event_id""")


def entities_by_kind(d: Spark) -> str:
    """Ten entities, persons first, then by name."""
    return with_tables(d, ["entities"], "SELECT name, type, CASE WHEN type IN ('person') THEN 1 ELSE 0 END AS is_person FROM (SELECT DISTINCT name, type FROM entities) x ORDER BY is_person DESC, name LIMIT 10")


def legacy_order(d: Spark) -> str:
    """Candidates by the first of composite, relevance and similarity that isn't 0; and the former score of the ranker."""
    return with_tables(d, ["articles"], """
        , c AS (SELECT article_id, cast((article_id % 4) / cast(10 AS double) AS double) AS composite, cast((article_id % 3) / cast(10 AS double) AS double) AS relevance, cast((article_id % 7) / cast(10 AS double) AS double) AS similarity FROM articles)
        SELECT article_id, round(coalesce(nullif(composite, 0), nullif(relevance, 0), nullif(similarity, 0), 0), 6) AS sort_score, round(0.45 * similarity + 0.35 * relevance + 0.20 * composite, 6) AS legacy_score FROM c
        ORDER BY sort_score DESC, article_id LIMIT 50""")


def first_claims(d: Spark) -> str:
    return with_tables(d, ["claims"], "SELECT claim_id, event_id, status FROM claims ORDER BY claim_id LIMIT 8")


def labels_of_names(d: Spark) -> str:
    """Node labels of entity types, labels of stages (only the first underscore becomes a blank), ids of addresses and plain text of marked-up text."""
    stage = d.replace_first("upper(stage)", "_", " ")
    b64 = "base64(cast(url AS binary))" if d.name == "spark" else "base64(encode(url))"
    marked = d.replace_all(d.replace_all("marked", r"(?m)^### ", ""), r"\*\*", "")
    return f"""SELECT page_id, left(translate({b64}, '+/', '-_'), 24) AS external_id, upper(left(kind, 1)) || substr({d.replace_all('kind', '[^A-Za-z]', '')}, 2) AS node_label, {stage} AS stage_label, {marked} AS plain
        FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' ELSE 'law-2' END AS kind, CASE page_id % 2 WHEN 0 THEN 'immediate_consequences' ELSE 'chain_of_reactions' END AS stage, '### Page ' || page_id || ' **bold** text' AS marked FROM pages) x"""


def article_ages(d: Spark) -> str:
    """Date, hours since the first report of the article's event (two or more allow a new headline) and the label that a reader sees; articles
    without an event have no hours."""
    hours = f"(cast({d.seconds(AS_OF)} AS double) - cast({d.seconds('published_at')} AS double)) / 3600.0"
    day = "date_format(published_at, 'yyyy-MM-dd')" if d.name == "spark" else "strftime(published_at, '%Y-%m-%d')"
    since = f"(cast({d.seconds('published_at')} AS double) - cast({d.seconds('started')} AS double)) / 3600.0"
    whole = lambda x: f"cast(cast(floor({x}) AS bigint) AS {'string' if d.name == 'spark' else 'varchar'})"
    return with_tables(d, ["articles", "event_articles", "story_events"], f"""
        SELECT article_id, {day} AS day, round({since}, 4) AS hours_since_first, {since} >= 2 AS may_retitle,
               CASE WHEN {hours} < 1 THEN {whole(f'60 * {hours}')} || 'm ago' WHEN {hours} < 24 THEN {whole(hours)} || 'h ago' ELSE {whole(f'{hours} / 24')} || 'd ago' END AS age
        FROM (SELECT a.article_id, a.published_at, e.first_reported_at AS started FROM articles a LEFT JOIN event_articles ea ON ea.article_id = a.article_id LEFT JOIN story_events e ON e.event_id = ea.event_id) x""")


def event_props(d: Spark) -> str:
    """A property out of JSON, and the JSON that a patch of it gives."""
    text = "cast(cast({} AS bigint) AS string)" if d.name == "spark" else "cast(cast({} AS bigint) AS varchar)"
    return f"SELECT event_id, {d.json('props', 'k')} AS k, '{{\"k\":' || {text.format(d.json('props', 'k') + ' + 1')} || ',\"seen\":true}}' AS patched FROM events"


def video_pages(d: Spark) -> str:
    """Whether an address is a video's, and which service describes it; the pages' own and one of each service."""
    host = f"lower({d.group('url', '^https?://([^/?#:]+)', 1)})"
    found = f"CASE WHEN contains({host}, 'youtube.com') OR contains({host}, 'youtu.be') THEN 'youtube' WHEN contains({host}, 'vimeo.com') THEN 'vimeo' WHEN contains({host}, 'dailymotion.com') THEN 'dailymotion' END"
    extra = " UNION ALL ".join(f"SELECT cast({-i} AS bigint), {d.text(u)}" for i, u in enumerate(("https://www.youtube.com/watch?v=1", "https://youtu.be/1", "http://player.vimeo.com/1", "https://Dailymotion.com/x", "https://example.com/youtube.com", "not an address"), 1))
    return f"SELECT page_id, {found} IS NOT NULL AS is_video, {found} AS service FROM (SELECT page_id, url FROM pages UNION ALL {extra}) x"


def image_choice(d: Spark) -> str:
    """An event keeps its first image; else it takes the newest article's."""
    return with_tables(d, ["event_articles", "articles"], f"""
        , images AS (SELECT ea.event_id, a.article_id, a.published_at, CASE WHEN a.article_id % 3 = 0 THEN 'image-' || a.article_id END AS image FROM event_articles ea JOIN articles a ON a.article_id = ea.article_id)
        SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'stored-' || event_id END, max_by(image, {d.integer(d.seconds('published_at'))} * 1000000 + article_id) FILTER (WHERE image IS NOT NULL)) AS image FROM images GROUP BY event_id""")


QUERIES = [
    entity_event_links, new_events, new_evidence_entries, event_article_relevance, category_update, causal_inserts, causal_merge, related_merge, entity_merge, job_log, job_totals, user_upsert, user_settings,
    account_stats, account_delete, source_update, seed_sources, conversation_delete, conversation_search, constraint_violations, hydrate_articles, articles_with_events, training_rows, event_claims_graph,
    stored_source_counts, entities_by_kind, legacy_order, first_claims, labels_of_names, article_ages, event_props, video_pages, image_choice,
]
