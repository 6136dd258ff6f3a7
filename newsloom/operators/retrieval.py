"""Recall lanes, composite rerank, ranker features and their evaluation."""

from __future__ import annotations

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark
from newsloom.sources.adapters import AS_OF, first_label, with_tables

#: Weights of the composite score (fixed values).
WEIGHTS = {"semantic": 0.30, "lexical": 0.25, "entity": 0.20, "graph": 0.10, "temporal": 0.10, "source": 0.05}
#: A pool article needs this composite score (fixed value).
GATE = 0.34
#: Weights and intercept of the logistic ranker's default model (fixed values).
RANKER = {
    "semantic": 1.85, "lexical": 1.25, "headline": 1.65, "entity": 1.40, "topic": 0.90, "event_type": 2.10, "temporal": 1.15, "reliability": 0.80, "independence": 0.70, "importance": 0.60, "novelty": 0.50,
    "fit": 0.85, "redundancy": -0.90, "syndication": -0.75, "graph": 0.95, "direct": 2.20,
}
INTERCEPT = -0.45
#: What a candidate with a demoted type keeps of its score (fixed value).
DEMOTED = 0.20


def overlap(d: Spark, x: str, tokens: list[str] | None = None) -> str:
    """Share of the tokens that x holds: short ones as words, others with endings."""
    tokens = tokens or V.FIXTURE_TOKENS
    hit = " + ".join(f"CASE WHEN {d.rlike(f'lower({x})', t if len(t) > 3 else f'(?:^|[^a-z0-9_]){t}(?:[^a-z0-9_]|$)')} THEN 1 ELSE 0 END" for t in tokens)
    return f"(cast({hit} AS double) / {len(tokens)})"


def _cosine(d: Spark, a: str, b: str) -> str:
    return f"{d.dot(a, b)} / (sqrt({d.dot(a, a)}) * sqrt({d.dot(b, b)}))"


def cosine_topk(d: Spark, k: int = 3) -> str:
    """The k nearest vectors of each vector whose id is divisible by 100."""
    return f"""SELECT query_id, vec_id, similarity, rn FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_cosine(d, 'q.embedding', 'e.embedding')}, 6) AS similarity,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_cosine(d, 'q.embedding', 'e.embedding')}, 6) DESC, e.vec_id) AS rn
        FROM embeddings e JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q ON q.vec_id <> e.vec_id) x WHERE rn <= {k}"""


def _lanes(d: Spark) -> str:
    any_token = " OR ".join(d.rlike("lower(a.title || ' ' || a.summary)", t) for t in V.FIXTURE_TOKENS)
    return with_tables(d, ["articles", "sources", "event_articles", "story_events"], f"""
        , q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
        vec AS (SELECT e.vec_id AS article_id, {_cosine(d, 'e.embedding', 'q.embedding')} AS similarity FROM embeddings e CROSS JOIN q),
        vector_lane AS (SELECT v.article_id, v.similarity FROM vec v JOIN articles a ON a.article_id = v.article_id WHERE v.similarity >= 0.38 ORDER BY round(v.similarity, 6) DESC, v.article_id LIMIT 35),
        lexical_lane AS (SELECT a.article_id, cast(0.5 AS double) AS similarity FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id WHERE {any_token}
                         ORDER BY coalesce(s.reliability, 0.5) DESC, a.published_at DESC, a.article_id LIMIT 35),
        seeds AS (SELECT DISTINCT ea.event_id FROM event_articles ea JOIN vector_lane v ON v.article_id = ea.article_id ORDER BY ea.event_id LIMIT 10),
        graph_lane AS (SELECT a.article_id, cast(0.6 AS double) AS similarity FROM event_articles ea JOIN seeds s ON s.event_id = ea.event_id JOIN articles a ON a.article_id = ea.article_id GROUP BY a.article_id, a.published_at ORDER BY a.published_at DESC, a.article_id LIMIT 35),
        lanes AS (SELECT article_id, similarity, lane FROM (SELECT article_id, similarity, lane, row_number() OVER (PARTITION BY article_id ORDER BY lane) AS rn FROM
                  (SELECT article_id, similarity, 1 AS lane FROM vector_lane UNION ALL SELECT article_id, similarity, 2 AS lane FROM lexical_lane UNION ALL SELECT article_id, similarity, 3 AS lane FROM graph_lane) u) w WHERE rn = 1)""")


def lexical_lane(d: Spark) -> str:
    return _lanes(d) + " SELECT article_id, similarity FROM lexical_lane"


def lane_union(d: Spark) -> str:
    return _lanes(d) + " SELECT article_id, lane, round(similarity, 6) AS similarity FROM lanes"


def lane_pool(d: Spark) -> str:
    """The articles of the three lanes, at most 105, with their place: the most similar first."""
    return _lanes(d) + """
        SELECT l.article_id, row_number() OVER (ORDER BY round(l.similarity, 6) DESC, l.article_id) AS place, a.title, a.summary, s.name AS outlet
        FROM lanes l JOIN articles a ON a.article_id = l.article_id LEFT JOIN sources s ON s.source_id = a.source_id"""


def token_overlap(d: Spark) -> str:
    return with_tables(d, ["articles"], f"SELECT article_id, round({overlap(d, 'content')}, 6) AS overlap FROM articles")


def _age(d: Spark, ts: str) -> str:
    return f"greatest(0.0, (cast({d.seconds(AS_OF)} AS double) - cast({d.seconds(ts)} AS double)) / 3600.0)"


def _temporal(d: Spark, ts: str) -> str:
    h = _age(d, ts)
    return f"CASE WHEN {ts} IS NULL THEN 0.5 WHEN {h} <= 72 THEN 0.7 + 0.3 * exp(-{h} / 72.0) ELSE greatest(0.35, 0.7 * exp(-{h} / 2160.0)) END"


def temporal_score(d: Spark) -> str:
    return with_tables(d, ["articles"], f"SELECT article_id, round({_temporal(d, 'published_at')}, 6) AS temporal FROM articles")


def _composite(d: Spark) -> str:
    w = WEIGHTS
    corpus = "a.title || ' ' || a.summary || ' ' || left(a.content, 400)"
    return _lanes(d) + f"""
        , scored AS (SELECT l.article_id, l.lane, a.title, a.summary, a.content, a.source_id, a.published_at, l.similarity, {overlap(d, corpus)} AS lex, {overlap(d, 'a.title')} AS headline, {overlap(d, corpus, V.FIXTURE_ENTITIES)} AS entity,
                            {_temporal(d, 'a.published_at')} AS temporal, coalesce(s.reliability, 0.5) AS reliability FROM lanes l JOIN articles a ON a.article_id = l.article_id LEFT JOIN sources s ON s.source_id = a.source_id),
        composed AS (SELECT *, {w['semantic']} * greatest(0.0, least(1.0, similarity)) + {w['lexical']} * (CASE WHEN headline > 0 THEN 0.5 * lex + 0.5 * headline ELSE 0.7 * lex END) + {w['entity']} * entity + {w['graph']} * (CASE WHEN lane = 3 THEN 1 ELSE 0 END)
                            + {w['temporal']} * temporal + {w['source']} * reliability AS composite FROM scored),
        gated AS (SELECT * FROM composed WHERE NOT (lex = 0 AND entity = 0 AND similarity < 0.65) AND composite >= {GATE})"""


def composite_rerank(d: Spark) -> str:
    """Vector, lexical and graph lanes, composite score, suppression and gate, best eight."""
    return _composite(d) + " SELECT article_id, title, round(composite, 6) AS composite, rn FROM (SELECT *, row_number() OVER (ORDER BY round(composite, 6) DESC, article_id) AS rn FROM gated) x WHERE rn <= 8"


def _features(d: Spark) -> str:
    """The 16 features of the gated pool. An article's category and types come from its words, its source and article counts from its event."""
    query = "climate " + " ".join(V.FIXTURE_TOKENS)
    tokens = lambda x: d.distinct(d.keep(d.words(f"lower({x})", "[^a-zA-Z0-9_-]+"), "length(x) > 2"))
    wanted = d.array(V.FIXTURE_TOKENS)
    share = lambda x: f"cast({d.size(d.common(tokens(x), wanted))} AS double) / {len(V.FIXTURE_TOKENS)}"
    held = " + ".join(f"CASE WHEN contains(lower(body), {d.text(e)}) THEN 1 ELSE 0 END" for e in V.FIXTURE_ENTITIES)
    topic = f"CASE WHEN contains({d.text(query)}, category) THEN 1.0 WHEN category = 'technology' AND {d.rlike(d.text(query), 'ai|software|model|tech')} THEN 0.95 WHEN category = 'climate' AND {d.rlike(d.text(query), 'flood|earthquake|disaster')} THEN 0.95 ELSE 0.5 END"
    yes = lambda types: " OR ".join(f"type = {d.text(t)}" for t in types)
    return _composite(d) + f"""
        , ev AS (SELECT ea.article_id, max(e.article_count) AS article_count, max(e.source_count) AS source_count, count(*) AS degree FROM event_articles ea JOIN story_events e ON e.event_id = ea.event_id GROUP BY ea.article_id),
        pool AS (SELECT g.*, g.title || ' ' || g.summary AS body, {first_label(d, "lower(g.summary)", V.FIXTURE_CATEGORIES, "other")} AS category, coalesce(ev.article_count, 1) AS article_count, coalesce(ev.source_count, 1) AS source_count,
                        coalesce(ev.degree, 0) AS degree, {_age(d, "g.published_at")} AS age, count(*) OVER (PARTITION BY g.title) AS same_title, count(*) OVER (PARTITION BY g.content) AS same_text FROM gated g LEFT JOIN ev ON ev.article_id = g.article_id),
        typed AS (SELECT *, CASE category WHEN 'conflict' THEN 'CONFLICT' WHEN 'climate' THEN 'DISASTER' WHEN 'science' THEN 'RESEARCH_FINDING' WHEN 'law' THEN 'OPINION' ELSE '' END AS type, greatest(0.0, least(1.0, coalesce(nullif(similarity, 0), 0.5))) AS semantic_in,
                         {share("title")} AS headline_in FROM pool),
        featured AS (SELECT article_id, reliability AS stated, {yes(V.FIXTURE_DEMOTED)} AS demoted, cast(semantic_in AS double) AS semantic, {share("body")} AS lexical, headline_in AS headline_match, cast({held} AS double) / {len(V.FIXTURE_ENTITIES)} AS entity_overlap, {topic} AS topic,
                            CASE WHEN type = '' THEN 0.5 WHEN {yes(V.FIXTURE_EXPECTED)} THEN 1.0 WHEN {yes(V.FIXTURE_DEMOTED)} THEN 0.05 ELSE 0.35 END AS event_type, exp(-0.004 * age) AS temporal_relevance, greatest(0.5, least(1.0, reliability)) AS source_reliability,
                            least(1.0, source_count / 4.0) AS independence, least(1.0, log2(article_count + 1) / 3.0) AS importance, 0.6 AS novelty, CASE WHEN age <= 72 THEN 1.0 ELSE 0.6 END AS fit, CASE WHEN same_title > 1 THEN 0.8 ELSE 0.0 END AS redundancy,
                            CASE WHEN same_text > 1 THEN 0.7 ELSE 0.0 END AS syndication, CASE WHEN degree = 0 THEN 0.4 ELSE least(1.0, degree / 5.0) END AS graph, 0.5 * headline_in + 0.5 * semantic_in AS direct, composite FROM typed)"""


#: Columns of the features that are named otherwise than their weights.
COLUMNS = {"headline": "headline_match", "entity": "entity_overlap", "temporal": "temporal_relevance", "reliability": "source_reliability"}


def ranker_features(d: Spark) -> str:
    return _features(d) + f" SELECT article_id, {', '.join(f'round(cast({COLUMNS.get(x, x)} AS double), 6) AS {x}' for x in RANKER)} FROM featured"


def _score() -> str:
    z = " + ".join(f"{w} * {COLUMNS.get(x, x)}" for x, w in RANKER.items())
    return f"(CASE WHEN demoted THEN {DEMOTED} ELSE 1.0 END / (1.0 + exp(-cast({INTERCEPT} + {z} AS double))))"


def ranker_top(d: Spark) -> str:
    """The ten best; near ties by four digits go to the more reliable source."""
    return _features(d) + f" SELECT article_id, score, rn FROM (SELECT article_id, round({_score()}, 4) AS score, row_number() OVER (ORDER BY round({_score()}, 4) DESC, stated DESC, article_id) AS rn FROM featured) x WHERE rn <= 10"


def ranker_score(d: Spark) -> str:
    """The logistic score of every candidate of the pool."""
    return _features(d) + f" SELECT article_id, round({_score()}, 4) AS score, demoted FROM featured"


def knn_events(d: Spark, k: int = 3) -> str:
    """The k story events whose mean vector is nearest each vector whose id is divisible by 100. A mean is taken a place at a time and put
    together as an array, so that vectors meet events in one step, with the few events broadcast."""
    if d.name == "spark":
        mean = "SELECT event_id, transform(array_sort(collect_list(struct(pos, x))), z -> z.x) AS v FROM (SELECT label AS event_id, pos, avg(cast(x AS double)) AS x FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, x GROUP BY label, pos) f GROUP BY event_id"
    else:
        mean = "SELECT event_id, list(x ORDER BY pos) AS v FROM (SELECT label AS event_id, pos, avg(cast(x AS double)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e GROUP BY label, pos) f GROUP BY event_id"
    return f"""WITH mean AS ({mean}), near AS (SELECT q.vec_id AS query_id, m.event_id, round({d.dot('q.embedding', 'm.v')} / nullif(sqrt({d.dot('q.embedding', 'q.embedding')}) * sqrt({d.dot('m.v', 'm.v')}), 0), 6) AS similarity
        FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q CROSS JOIN mean m)
        SELECT query_id, event_id, similarity, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, event_id) AS rn FROM near) x WHERE rn <= {k}"""


def sufficiency_gate(d: Spark) -> str:
    return _composite(d) + " SELECT count(*) AS candidates, count(CASE WHEN composite >= 0.45 THEN 1 END) AS relevant, count(CASE WHEN composite >= 0.45 THEN 1 END) >= 1 AS sufficient FROM composed"


def prune_hypotheses(d: Spark) -> str:
    """Hypotheses that the retrieved pool supports: two in five of their longer words stand in it, or the whole phrase does."""
    terms = d.distinct(d.keep(d.words("h", "[^a-z0-9]+"), f"length(x) > 3 AND NOT x IN ({', '.join(map(d.text, V.STOP))})"))
    return _lanes(d) + f"""
        , pool AS (SELECT lower(a.title || ' ' || a.summary || ' ' || left(a.content, 1000)) AS t FROM lanes l JOIN articles a ON a.article_id = l.article_id), hyp AS (SELECT item_id, lower(text) AS h FROM benchmark),
        terms AS (SELECT item_id, term FROM {d.rows("hyp", terms, "term")}), held AS (SELECT x.term FROM (SELECT DISTINCT term FROM terms) x WHERE EXISTS (SELECT 1 FROM pool WHERE contains(pool.t, x.term))),
        phrases AS (SELECT hyp.item_id FROM hyp WHERE EXISTS (SELECT 1 FROM pool WHERE contains(pool.t, hyp.h)))
        SELECT item_id, total, matched, (total > 0 AND 5 * matched >= 2 * total) OR phrase AS supported FROM (
        SELECT hyp.item_id, count(t.term) AS total, count(held.term) AS matched, count(p.item_id) > 0 AS phrase FROM hyp LEFT JOIN terms t ON t.item_id = hyp.item_id LEFT JOIN held ON held.term = t.term
        LEFT JOIN phrases p ON p.item_id = hyp.item_id GROUP BY hyp.item_id) y"""


def weak_labels(d: Spark) -> str:
    return with_tables(d, ["articles"], f"""
        SELECT article_id, CASE WHEN t >= 0.6 THEN 5 WHEN t > 0 AND x > 0 THEN 4 WHEN x >= 0.6 THEN 3 WHEN x > 0 THEN 2 ELSE 0 END AS relevance FROM (SELECT article_id, {overlap(d, 'title')} AS t, {overlap(d, 'content')} AS x FROM articles) y""")


def time_split(d: Spark) -> str:
    """Train, validation and test by exact order statistics at 60 and 80 percent: the day that holds each by the days' counts, then its
    place within the day, so that no window holds more than a day."""
    return with_tables(d, ["articles"], """
        , dated AS (SELECT article_id, published_at, date_trunc('day', published_at) AS day FROM articles),
        days AS (SELECT day, count(*) AS n FROM dated GROUP BY day), upto AS (SELECT day, n, sum(n) OVER (ORDER BY day) AS upto, sum(n) OVER () AS total FROM days),
        wanted AS (SELECT day, cut, floor(cut * total) + 1 - (upto - n) AS k FROM upto CROSS JOIN (SELECT 0.6 AS cut UNION ALL SELECT 0.8) c WHERE floor(cut * total) + 1 > upto - n AND floor(cut * total) + 1 <= upto),
        placed AS (SELECT w.cut, w.k, a.published_at, row_number() OVER (PARTITION BY w.cut, w.day ORDER BY a.published_at, a.article_id) AS rn FROM wanted w JOIN dated a ON a.day = w.day),
        cuts AS (SELECT max(CASE WHEN cut = 0.6 THEN published_at END) AS c1, max(CASE WHEN cut = 0.8 THEN published_at END) AS c2 FROM placed WHERE rn = k)
        SELECT part, count(*) AS rows_in_part FROM (SELECT CASE WHEN a.published_at > c.c2 THEN 'test' WHEN a.published_at > c.c1 THEN 'validation' ELSE 'train' END AS part FROM articles a CROSS JOIN cuts c) x GROUP BY part""")


def _labelled(d: Spark) -> str:
    return with_tables(d, ["articles"], f""", s AS (SELECT a.article_id, a.source_id, l.quality AS y, round(0.5 * {overlap(d, 'a.content')} + 0.5 * ((a.article_id * 37) % 100) / 100.0, 6) AS p FROM articles a JOIN labels l ON l.doc_id = a.article_id)""")


def threshold_sweep(d: Spark) -> str:
    """The first threshold from 0.05 by 0.02 to 0.65 with the best F1."""
    steps = "SELECT cast(id AS int) AS i FROM range(0, 31)" if d.name == "spark" else "SELECT cast(range AS int) AS i FROM range(0, 31)"
    return _labelled(d) + f""", steps AS ({steps}), f AS (SELECT i, cast(2.0 * sum(CASE WHEN p >= t AND y = 1 THEN 1 ELSE 0 END) AS double) / (sum(CASE WHEN p >= t THEN 1 ELSE 0 END) + sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)) AS f1
        FROM (SELECT s.p, s.y, steps.i, round(0.05 + 0.02 * steps.i, 2) AS t FROM s CROSS JOIN steps) x GROUP BY i)
        SELECT i, round(f1, 6) AS f1 FROM (SELECT i, f1, row_number() OVER (ORDER BY round(f1, 9) DESC, i) AS rn FROM f) z WHERE rn = 1"""


def ranking_metrics(d: Spark) -> str:
    """Precision and NDCG at 5 by source."""
    return _labelled(d) + """, r AS (SELECT source_id, y, row_number() OVER (PARTITION BY source_id ORDER BY p DESC, article_id) AS i, row_number() OVER (PARTITION BY source_id ORDER BY y DESC, article_id) AS ideal FROM s)
        SELECT source_id, round(cast(sum(CASE WHEN i <= 5 THEN y ELSE 0 END) AS double) / 5.0, 6) AS p_at_5, round(coalesce(sum(CASE WHEN i <= 5 THEN (power(2.0, y) - 1) / log2(i + 1) END) / nullif(sum(CASE WHEN ideal <= 5 THEN (power(2.0, y) - 1) / log2(ideal + 1) END), 0), 0), 6) AS ndcg_at_5 FROM r GROUP BY source_id"""


def confusion(d: Spark) -> str:
    return _labelled(d) + """ SELECT tp, fp, fn, round(cast(tp AS double) / nullif(tp + fp, 0), 6) AS precision_value, round(cast(tp AS double) / nullif(tp + fn, 0), 6) AS recall_value FROM (
        SELECT count(CASE WHEN p >= 0.3 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= 0.3 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN p < 0.3 AND y = 1 THEN 1 END) AS fn FROM s) x"""


QUERIES = [
    cosine_topk, lexical_lane, lane_union, token_overlap, temporal_score, composite_rerank, ranker_features, ranker_score, ranker_top, knn_events, prune_hypotheses, sufficiency_gate, weak_labels, time_split, threshold_sweep, ranking_metrics, confusion,
]
