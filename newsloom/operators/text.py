"""Normalisation, hashing, tokens, similarity and rule labels."""

from __future__ import annotations

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Duck, Spark
from newsloom.sources.adapters import first_label, with_tables

#: Query parameters that only track (fixed values), besides utm_*.
TRACKING = ["fbclid", "gclid", "ref", "source", "mc_cid", "mc_eid"]


def clean_url_sql(d: Spark, url: str) -> str:
    query = f"split_part({url}, '?', 2)"
    kept = d.keep(d.words(query, "&"), f"x <> '' AND NOT {d.rlike('x', '^(?:utm_[^=]*|' + '|'.join(TRACKING) + ')(?:=|$)')}")
    joined = d.joined(kept, "&")
    return f"split_part({url}, '?', 1) || CASE WHEN {joined} = '' THEN '' ELSE '?' || {joined} END"


def clean_url(d: Spark) -> str:
    return f"SELECT page_id, {clean_url_sql(d, 'url')} AS clean_url FROM pages"


def url_parts(d: Spark) -> str:
    return f"SELECT page_id, lower({d.group('url', '^https?://([^/?#]+)', 1)}) AS host, {d.group('url', '^https?://[^/?#]+([^?#]*)', 1)} AS path FROM pages"


def url_guard(d: Spark) -> str:
    """Addresses that must not be fetched."""
    host = f"lower({d.group('url', r'^[a-z]+://(\[[^\]]*\]|[^/:?#]+)', 1)})"
    bad = d.rlike(host, r"^(?:localhost|.*\.localhost|0\.0\.0\.0|\[?::1\]?|127\..*|10\.[0-9.]+|192\.168\.[0-9.]+|169\.254\..*|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9.]+)$|\.(?:internal|local|lan|home|corp)$")
    extra = " UNION ALL ".join(f"SELECT cast({-i} AS bigint), {d.text(u)}" for i, u in enumerate(("http://0.0.0.0/", "http://[::1]/", "http://a.localhost/x", "http://169.254.169.254/", "http://172.20.1.1", "http://10.0.0.1:80/", "ftp://example.com", "http://db.corp/", "https://example.com/"), 1))
    return f"SELECT page_id, {d.rlike('url', '^https?://')} AND NOT {bad} AS safe FROM (SELECT page_id, url FROM pages UNION ALL {extra}) x"


def strip_html_sql(d: Spark, html: str) -> str:
    x = d.replace_all(html, r"(?is)<script\b.*?</script>", " ")
    x = d.replace_all(x, r"(?is)<style\b.*?</style>", " ")
    x = d.replace_all(x, r"<[^>]*>", " ")
    for entity, by in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        x = f"replace({x}, {d.text(entity)}, {d.text(by)})"
    return f"trim({d.replace_all(x, r'[ \t\n\r]+', ' ')})"


def strip_html(d: Spark) -> str:
    return f"SELECT page_id, length({strip_html_sql(d, 'html')}) AS n_chars, {d.sha256(strip_html_sql(d, 'html'))} AS text_sha256 FROM pages"


def page_paragraphs(d: Spark) -> str:
    """Paragraphs over 25 characters without cookie or subscription notices, up to 10000 characters."""
    ps = d.each(d.found("html", r"(?is)<p\b[^>]*>.*?</p>"), f"trim({d.replace_all('x', '<[^>]*>', '')})")
    kept = d.keep(ps, "length(x) > 25 AND NOT contains(lower(x), 'cookie') AND NOT contains(lower(x), 'subscribe')")
    return f"SELECT page_id, {d.integer(d.size(kept))} AS paragraphs, length(left({d.joined(kept, ' ')}, 10000)) AS n_chars FROM pages"


def page_titles(d: Spark) -> str:
    return f"SELECT page_id, trim({d.group('html', '(?is)<title[^>]*>(.*?)</title>', 1)}) AS title FROM pages"


def normalize_articles(d: Spark) -> str:
    return with_tables(d, ["articles"], """
        SELECT article_id, title, CASE WHEN length(content) > 500 THEN left(content, 497) || '...' ELSE content END AS summary, coalesce(nullif(lang, ''), 'en') AS lang FROM articles WHERE length(trim(title)) >= 5""")


def address_sql(d: Spark, url: str) -> str:
    """Host and path of an address in lower case, without port, user and final slashes; what is no address is kept as it is."""
    whole = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"
    host, path = d.group(url, whole, 1), d.group(url, whole, 2)
    return f"CASE WHEN {host} <> '' THEN {d.replace_all(f'lower({host} || {path})', '/+$', '')} ELSE lower(trim({url})) END"


def content_hash_sql(d: Spark) -> str:
    """The key of an article: its title and the start of its content without case, marks and runs of blanks, and its address; of
    columns title, content and url, where nulls are empty."""
    title = f"trim({d.replace_all(d.replace_all('lower(coalesce(title, ' + d.text('') + '))', r'[^A-Za-z0-9_ \t\n\r]', ''), r'[ \t\n\r]+', ' ')})"
    snippet = f"trim(left({d.replace_all('lower(coalesce(content, ' + d.text('') + '))', r'[ \t\n\r]+', ' ')}, 150))"
    return d.sha256(f"{title} || '|' || {address_sql(d, 'coalesce(url, ' + d.text('') + ')')} || '|' || {snippet}")


def _addressed(d: Spark) -> str:
    """Articles with their keys; those whose page is among the pages have its address."""
    return with_tables(d, ["articles"], f", hashed AS (SELECT article_id, {content_hash_sql(d)} AS content_hash FROM (SELECT a.article_id, a.title, a.content, p.url FROM articles a LEFT JOIN pages p ON p.page_id = a.article_id) x)")


def content_hash(d: Spark) -> str:
    return _addressed(d) + " SELECT article_id, content_hash FROM hashed"


def dedupe_articles(d: Spark) -> str:
    """The first article of each content hash."""
    return _addressed(d) + " SELECT content_hash, min(article_id) AS article_id, count(*) AS copies FROM hashed GROUP BY content_hash"


def claim_hash(d: Spark) -> str:
    return with_tables(d, ["claims"], f"SELECT claim_id, {d.sha256('claim_text || ' + d.text('|') + ' || event_id')} AS content_hash FROM claims")


def token_stats(d: Spark) -> str:
    tokens = d.keep(d.words("lower(content)", r"[^a-zA-Z0-9_-]+"), f"length(x) > 2 AND NOT x IN ({', '.join(map(d.text, V.STOP))})")
    return with_tables(d, ["articles"], f"SELECT article_id, {d.integer(d.size(tokens))} AS tokens, {d.integer(d.size(d.distinct(tokens)))} AS distinct_tokens FROM articles")


def stem_tokens(d: Spark) -> str:
    stem = "CASE WHEN length(t) > 5 AND t LIKE '%ing' THEN left(t, length(t) - 3) WHEN length(t) > 4 AND t LIKE '%es' THEN left(t, length(t) - 2) WHEN length(t) > 4 AND (t LIKE '%s' OR t LIKE '%y') THEN left(t, length(t) - 1) ELSE t END"
    return with_tables(d, ["articles"], f"SELECT stem, count(*) AS uses FROM (SELECT {stem} AS stem FROM {d.rows('articles', d.words('lower(title)', '[^a-zA-Z0-9_-]+'), 't')}) x WHERE length(stem) > 2 GROUP BY stem")


def capitalized_phrases(d: Spark) -> str:
    return with_tables(d, ["articles"], f"SELECT phrase, count(*) AS uses FROM (SELECT phrase FROM {d.rows('articles', d.found('title', '[A-Z][a-z]+(?: [A-Z][a-z]+)*'), 'phrase')}) x GROUP BY phrase")


def conversation_titles(d: Spark) -> str:
    x = d.replace_all("trim(text)", r"(?i)^(?:what happened with|what caused|why did|how did|tell me about|is there|what are the|what is the)\s+", "")
    x = d.replace_all(x, r"(?i)^(?:the|a|an)\s+", "")
    x = f"coalesce(nullif(trim({d.replace_all(x, '[?!.]+$', '')}), ''), trim(text))"
    return f"SELECT conv_id, turn, left(upper(left({x}, 1)) || substr({x}, 2), 45) AS title FROM conversations WHERE role = 'user'"


def trigram_title_pairs(d: Spark) -> str:
    """Trigram similarity of distinct part names: words padded by two blanks before and one after, shared over all trigrams."""
    padded = d.each(d.keep(d.words("lower(p_name)", r"[^a-z0-9]+"), "x <> ''"), "'  ' || x || ' '")
    grams = "SELECT p_name, w, substr(w, i, 3) AS g FROM words LATERAL VIEW explode(sequence(1, length(w) - 2)) AS i" if d.name == "spark" else "SELECT p_name, w, substr(w, i, 3) AS g FROM (SELECT p_name, w, unnest(range(1, length(w) - 1)) AS i FROM words) z"
    return f"""WITH names AS (SELECT DISTINCT p_name FROM part), words AS (SELECT p_name, w FROM {d.rows('names', padded, 'w')}),
        grams AS (SELECT DISTINCT p_name, g FROM ({grams}) x), sizes AS (SELECT p_name, count(*) AS n FROM grams GROUP BY p_name),
        shared AS (SELECT a.p_name AS left_name, b.p_name AS right_name, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.p_name < b.p_name GROUP BY a.p_name, b.p_name)
        SELECT left_name, right_name, round(cast(c AS double) / (x.n + y.n - c), 6) AS similarity FROM shared JOIN sizes x ON x.p_name = left_name JOIN sizes y ON y.p_name = right_name WHERE cast(c AS double) / (x.n + y.n - c) >= 0.38"""


def headline_jaccard(d: Spark) -> str:
    """Word similarity of a source's consecutive headlines."""
    ws = lambda c: d.distinct(d.keep(d.words(d.replace_all(f"lower({c})", r"[^a-z0-9 ]", ""), r"\s+"), "length(x) > 2"))
    both = d.size(d.common(ws("title"), ws("prev")))
    return with_tables(d, ["articles"], f"""
        SELECT article_id, CASE WHEN a + b - c = 0 THEN 0.0 ELSE round(cast(c AS double) / (a + b - c), 6) END AS similarity FROM (
        SELECT article_id, {d.size(ws('title'))} AS a, {d.size(ws('prev'))} AS b, {both} AS c FROM (SELECT article_id, title, lag(title) OVER (PARTITION BY source_id ORDER BY published_at, article_id) AS prev FROM articles) x WHERE prev IS NOT NULL) y""")


def dependence(d: Spark) -> str:
    """(article_id, wire, outlet, ws) of articles a with sources s: what they share with those that they depend on."""
    ws = d.sorted(d.distinct(d.keep(d.words(d.replace_all("lower(title || ' ' || summary)", "[^a-z0-9 \t\n\r]", ""), r"\s+"), "length(x) > 3")))
    said = "coalesce(a.title, '') || ' ' || coalesce(s.name, '') || ' ' || left(coalesce(a.summary, ''), 300)"
    return f"SELECT a.article_id, {wire_sql(d, said, V.FIXTURE_WIRES)} AS wire, s.name AS outlet, {d.joined(ws, ' ')} AS ws FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id"


def syndication_oracle(d: Duck) -> str:
    """Articles that depend on others: those of one wire service or outlet by membership of its first article, and pairs of the first articles of word
    sets of a similarity above 0.65 (equal sets by membership). It compares all sets; the query is in `syndication`."""
    head = with_tables(d, ["articles", "sources"], f"""
        , m AS ({dependence(d)}),
        led AS (SELECT wire, min(article_id) AS leader FROM m WHERE wire IS NOT NULL GROUP BY wire), outlets AS (SELECT outlet, min(article_id) AS leader FROM m GROUP BY outlet),
        sets AS (SELECT ws, min(article_id) AS leader FROM m WHERE ws <> '' GROUP BY ws), listed AS (SELECT leader, {d.words('ws', ' ')} AS words FROM sets)""")
    pairs = ", alike AS (SELECT a.leader AS x, b.leader AS y FROM listed a JOIN listed b ON a.leader < b.leader WHERE len(list_intersect(a.words, b.words)) > 0.65 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))))"
    return head + pairs + """
        SELECT l.leader, m.article_id, 'same wire service' AS reason FROM m JOIN led l ON l.wire = m.wire WHERE m.article_id <> l.leader
        UNION ALL SELECT o.leader, m.article_id, 'same outlet' FROM m JOIN outlets o ON o.outlet = m.outlet WHERE m.article_id <> o.leader
        UNION ALL SELECT s.leader, m.article_id, 'same words' FROM m JOIN sets s ON s.ws = m.ws WHERE m.article_id <> s.leader
        UNION ALL SELECT x, y, 'similar words' FROM alike"""


def category_histogram(d: Spark) -> str:
    return with_tables(d, ["articles"], f"SELECT category, count(*) AS articles FROM (SELECT {first_label(d, 'lower(content)', V.FIXTURE_CATEGORIES, 'other')} AS category FROM articles) x GROUP BY category")


def infer_severity(d: Spark) -> str:
    return with_tables(d, ["articles"], f"SELECT article_id, {first_label(d, 'lower(content)', V.FIXTURE_SEVERITIES, 'normal')} AS severity, {first_label(d, 'lower(content)', V.CATEGORIES, 'other')} AS news_category FROM articles")


def taxonomy_labels(d: Spark) -> str:
    """Scored labels: a hit in the title counts two, in the text one; base .65 or .40 and .10 a hit up to .30; .45 or more counts."""
    hits = lambda ts, by: " + ".join(f"CASE WHEN {d.word('lower(title)', [t])} THEN 2 WHEN {d.word('lower(content)', [t])} THEN 1 ELSE 0 END" for t in ts) if by == "n" else " OR ".join(d.word("lower(title)", [t]) for t in ts)
    parts = [f"SELECT article_id, {d.text(label)} AS label, {hits(ts, 'n')} AS n, ({hits(ts, 't')}) AS in_title FROM articles" for label, ts in V.FIXTURE_CATEGORIES.items()]
    score = "least(0.98, CASE WHEN in_title THEN 0.65 ELSE 0.40 END + least(0.30, 0.10 * n))"
    return with_tables(d, ["articles"], f"SELECT article_id, label, round(cast({score} AS double), 4) AS score FROM ({' UNION ALL '.join(parts)}) x WHERE n > 0 AND {score} >= 0.45")


def source_tier(d: Spark) -> str:
    host = f"lower({d.group('url', '^https?://([^/?#]+)', 1)})"
    return f"""SELECT page_id, CASE WHEN contains({host}, 'gov') OR contains({host}, '.edu') OR contains({host}, 'official') THEN 'PRIMARY_SOURCE'
        WHEN contains({host}, 'nature.com') OR contains({host}, 'arxiv.org') OR contains({host}, 'who.int') THEN 'SCIENTIFIC_INSTITUTIONAL'
        WHEN contains({host}, 'bbc.') OR contains({host}, 'reuters.com') OR contains({host}, 'apnews.com') THEN 'HIGH_QUALITY_NEWS' ELSE 'SECONDARY_ANALYSIS' END AS tier FROM pages"""


#: What time a question asks about, by its phrases (fixed values).
TEMPORAL = {
    "CURRENT_STATUS": ["right now", "currently", "at this moment", "today", "latest update", "breaking"],
    "CAUSAL": ["why did", "what caused", "cause of", "root cause", "how did this happen"],
    "HISTORICAL": ["history of", "historical", "legacy", "handover", "origins of", "background of", "decades ago", "in the 19", "in the 200", "past events", "anniversary"],
    "RECENT_EVENT": ["what happened", "aftermath", "consequences", "damage", "victims", "rescue"],
}


def temporal_sql(d: Spark, text: str) -> str:
    """The first rule with one of its phrases."""
    q = f"lower(trim({text}))"
    arms = []
    for label, phrases in TEMPORAL.items():
        cond = " OR ".join(f"contains({q}, {d.text(p)})" for p in phrases)
        arms.append(f"WHEN {cond}{f' OR {q} LIKE ' + d.text('is %') + f' OR {q} LIKE ' + d.text('are %') if label == 'CURRENT_STATUS' else ''} THEN {d.text(label)}")
    return f"CASE {' '.join(arms)} ELSE 'GENERAL_TOPIC' END"


def temporal_intent(d: Spark) -> str:
    """What time each user turn asks about."""
    return f"SELECT conv_id, turn, {temporal_sql(d, 'text')} AS intent FROM conversations WHERE role = 'user'"


def region_activity(d: Spark) -> str:
    """Events by region: an event counts for each region with a keyword in its title or lead."""
    regions = {"north": ["the", "and"], "south": ["que", "los"], "east": ["der", "und"], "west": ["les", "une"]}
    parts = [f"SELECT {d.text(r)} AS region, event_id FROM story_events WHERE {d.word('lower(lead)', ts)}" for r, ts in regions.items()]
    return with_tables(d, ["story_events"], f"SELECT region, count(DISTINCT event_id) AS events FROM ({' UNION ALL '.join(parts)}) x GROUP BY region")


def tracking_params(d: Spark) -> str:
    """How many parameters of an address only track."""
    tracks = d.keep(d.words("split_part(url, '?', 2)", "&"), d.rlike("x", "^(?:utm_[^=]*|" + "|".join(TRACKING) + ")(?:=|$)"))
    return f"SELECT page_id, {d.integer(d.size(tracks))} AS tracking_params FROM pages"


def wire_sql(d: Spark, x: str, wires: dict[str, str]) -> str:
    """The first service whose signature x holds, else null. Boundaries are those of ASCII words in both engines."""
    edge = (r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])", r"\b")[d.name == "duck"]
    arms = " ".join(f"WHEN {d.rlike(x, p.replace(chr(92) + 'b', f'(?:{edge})'))} THEN {d.text(name)}" for name, p in wires.items())
    return f"CASE {arms} END"


def wire_service(d: Spark) -> str:
    return with_tables(d, ["articles", "sources"], f"""
        SELECT article_id, {wire_sql(d, "said", V.FIXTURE_WIRES)} AS wire, {wire_sql(d, "said", V.WIRES)} AS news_wire FROM (
        SELECT a.article_id, coalesce(a.title, '') || ' ' || coalesce(s.name, '') || ' ' || left(coalesce(a.summary, ''), 300) AS said FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id) x""")


def hierarchy_sql(d: Spark, name: str, kind: str, url: str) -> str:
    """The first level that the source's type equals, or whose marks its address or name contains."""
    arms = []
    for level, (kinds, urls, names) in V.HIERARCHY.items():
        conds = [f"lower({kind}) = {d.text(x)}" for x in kinds] + [f"contains(lower({url}), {d.text(x)})" for x in urls] + [f"contains(lower({name}), {d.text(x)})" for x in names]
        arms.append(f"WHEN {' OR '.join(conds)} THEN {d.text(level)}")
    return f"CASE {' '.join(arms)} ELSE 'SECONDARY_REPORT' END"


def source_hierarchy(d: Spark) -> str:
    """Levels of the addresses of pages and, by name and type, of the sources; every third source passes for one without a type."""
    return with_tables(d, ["sources"], f"""
        SELECT 'page' AS kind, page_id AS id, {hierarchy_sql(d, "''", "''", "url")} AS level FROM pages
        UNION ALL SELECT 'source', source_id, {hierarchy_sql(d, "name", "CASE WHEN source_id % 3 = 1 THEN '' ELSE type END", "''")} FROM sources""")


#: Types of events that a question's signals ask for, and those that they rule out (fixed values).
EXPECTED = {
    "forecast": "FORECAST", "model": "MODEL_RELEASE,PRODUCT_LAUNCH,PRODUCT_RELEASE,COMPANY_ANNOUNCEMENT", "launches": "PRODUCT_LAUNCH,PRODUCT_RELEASE,FEATURE_RELEASE,COMPANY_ANNOUNCEMENT",
    "research": "RESEARCH_FINDING,SCIENTIFIC_DISCOVERY,REPORT", "court": "COURT_DECISION,REPORT,INVESTIGATION", "cause": "REPORT,INVESTIGATION,DISASTER,CONFLICT,ANALYSIS", "disaster": "DISASTER,REPORT",
    "policy": "POLICY,REGULATION,LAW,GOVERNMENT", "business": "BUSINESS_DEAL,ACQUISITION,MARKET_MOVE,COMPANY_ANNOUNCEMENT", "history": "REPORT,ANALYSIS",
    "broad": "PRODUCT_LAUNCH,MODEL_RELEASE,RESEARCH_FINDING,COMPANY_ANNOUNCEMENT,POLICY,BUSINESS_DEAL",
}
DEMOTED = {"model": "EXPERT_WARNING,OPINION", "launches": "EXPERT_WARNING,OPINION,FORECAST,ANALYSIS", "research": "OPINION,MARKET_MOVE,EXPERT_WARNING"}


def intent_sql(d: Spark, table: str, keys: str, signals: dict[str, list[str]], mode: str = "ask") -> str:
    """keys, primary_intent, intents (in the order of the rules), expected and demoted types, temporal_focus of table's `text`."""
    flags = ", ".join(f"{d.word('q', ts)} AS s_{name}" for name, ts in signals.items())
    yes = lambda cond, labels: f"CASE WHEN {cond} THEN {d.text(labels + ',')} ELSE '' END"
    asked = " || ".join([
        yes("s_forecast", "FORECAST"), yes(f"s_fact_check OR {d.text(mode)} = 'fact_check'", "FACT_CHECK"), yes("s_model", "MODEL_RELEASE,PRODUCT_RELEASE"), yes("s_launches AND NOT s_model", "PRODUCT_LAUNCH,PRODUCT_RELEASE"),
        yes("s_launches AND s_model", "PRODUCT_LAUNCH"), yes("s_research", "RESEARCH_FINDING,SCIENTIFIC_DISCOVERY"), yes("s_court", "COURT_DECISION,LEGAL"),
        yes("s_cause", "CAUSE" + (",RESEARCH_FINDING" if mode == "research" else "")), yes("s_disaster", "DISASTER_STATUS"), yes("s_policy", "POLICY,REGULATION"), yes("s_business", "BUSINESS,MARKETS"),
        yes("s_history", "HISTORY,TIMELINE"), yes("s_timeline AND NOT s_history", "TIMELINE,HISTORY"), yes("s_broad", "LATEST_NEWS,NEWS_OVERVIEW")])
    whole = "CASE WHEN asked <> '' THEN asked WHEN s_now THEN 'LATEST_NEWS,' ELSE 'GENERAL_EXPLANATION,' END"
    types = lambda by: d.sorted(d.distinct(d.keep(d.words(" || ".join(yes(f"s_{k}", v) for k, v in by.items()), ","), "x <> ''")))
    return f"""
        SELECT {keys}, split_part(intents, ',', 1) AS primary_intent, left(intents, length(intents) - 1) AS intents, {d.joined('expected', ',')} AS expected_types,
               {d.joined(d.keep('demoted', 'NOT array_contains(expected, x)'), ',')} AS demoted_types,
               CASE WHEN s_forecast THEN 'FUTURE' WHEN contains(intents, 'HISTORY') THEN 'HISTORICAL' ELSE 'CURRENT' END AS temporal_focus
        FROM (SELECT *, {whole} AS intents, {types(EXPECTED)} AS expected, {types(DEMOTED)} AS demoted FROM (
        SELECT *, {asked} AS asked FROM (
        SELECT *, s_overview OR ({d.size(d.words('q', ' '))} <= 4 AND s_short_overview AND NOT s_launch AND NOT s_model) AS s_broad, s_launch OR (s_product AND s_fresh) AS s_launches FROM (
        SELECT {keys}, q, {flags} FROM (SELECT {keys}, lower(trim(text)) AS q FROM {table}) a) b) c) e) f"""


def query_intent(d: Spark) -> str:
    """What each user turn is after; the news signals and some of the fixture's words."""
    signals = {k: [*ts, *V.FIXTURE_SIGNALS.get(k, [])] for k, ts in V.INTENT_SIGNALS.items()}
    return intent_sql(d, "(SELECT conv_id, turn, text FROM conversations WHERE role = 'user') u", "conv_id, turn", signals)


QUERIES = [
    clean_url, url_parts, url_guard, strip_html, page_paragraphs, page_titles, normalize_articles, content_hash, dedupe_articles, claim_hash, token_stats, stem_tokens, capitalized_phrases,
    conversation_titles, trigram_title_pairs, headline_jaccard, category_histogram, infer_severity, taxonomy_labels, source_tier, temporal_intent, region_activity,
    tracking_params, wire_service, source_hierarchy, query_intent,
]
