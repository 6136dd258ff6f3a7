"""DuckDB SQL for the questions' queries, written apart from them: every question meets every item, as on a small table one may."""

from __future__ import annotations

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Duck
from newsloom.operators import retrieval
from newsloom.operators import text as rules
from newsloom.operators.text import hierarchy_sql, wire_sql
from newsloom.sources.adapters import AS_OF, first_label, with_tables

D = Duck()
_in = lambda items: ", ".join(map(D.text, items))


def _questions() -> str:
    concepts = ", ".join(f"({i}, {D.text(k)}, {j}, {D.text(r)})" for i, (k, v) in enumerate(V.CONCEPTS.items()) for j, r in enumerate(v))
    signals = {k: [*ts, *V.FIXTURE_SIGNALS.get(k, [])] for k, ts in V.INTENT_SIGNALS.items()}
    once = "list_transform(list_filter(list_zip({0}, range(1, len({0}) + 1)), lambda z: list_position({0}, z[1]) = z[2]), lambda z: z[1])"
    return rf"""
        turns AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS question FROM conversations WHERE role = 'user'),
        split_up AS (SELECT *, list_filter(string_split_regex(lower(question), '[^a-zA-Z0-9_-]+'), lambda t: length(t) > 2 OR t IN ({_in(V.SHORT_TOKENS)})) AS every,
            list_filter(regexp_extract_all(question, '\b[A-Z][a-z0-9_-]+(?:\s+[A-Z][a-z0-9_-]+)*\b'), lambda w: lower(w) NOT IN ({_in(V.QUESTION_STOP)})) AS names FROM turns),
        strong AS (SELECT *, list_filter(every, lambda t: t NOT IN ({_in(V.QUESTION_STOP)})) AS tokens FROM split_up),
        concepts(place, key, pos, related) AS (VALUES {concepts}),
        hits AS (SELECT conv_id, turn, related, min(place * 100 + pos) AS k FROM turns JOIN concepts ON contains(lower(question), key) GROUP BY conv_id, turn, related),
        hyp AS (SELECT conv_id, turn, list(related ORDER BY k) AS hypotheses FROM hits GROUP BY conv_id, turn),
        asked_for AS (SELECT s.conv_id, s.turn, s.question, s.question AS text, s.tokens, {once.format('s.names')} AS entities, coalesce(h.hypotheses, []) AS hypotheses,
            list_filter({once.format("(CASE WHEN len(s.tokens) > 0 THEN s.tokens ELSE s.every END)")}, lambda t: length(t) > 2 AND t NOT IN ({_in(V.QUESTION_STOP)})) AS keywords,
            left(array_to_string(list_concat([s.question], coalesce(h.hypotheses, [])[1:4]), ' '), 300) AS expanded
            FROM strong s LEFT JOIN hyp h ON h.conv_id = s.conv_id AND h.turn = s.turn),
        q AS (SELECT *, {rules.temporal_sql(D, 'question')} AS temporal_intent FROM ({rules.intent_sql(D, 'asked_for', 'conv_id, turn, question, tokens, entities, hypotheses, keywords, expanded', signals)}) i)"""


def expand_questions() -> str:
    return f"WITH {_questions()} SELECT conv_id, turn, temporal_intent, array_to_string(tokens, ' ') AS tokens, array_to_string(entities, '|') AS entities, array_to_string(hypotheses, '|') AS hypotheses, array_to_string(keywords, ' ') AS keywords, expanded FROM q"


_STEM = "CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, -3) WHEN t LIKE '%es' AND length(t) > 4 THEN left(t, -2) WHEN t LIKE '%s' AND length(t) > 3 THEN left(t, -1) WHEN t LIKE '%y' AND length(t) > 4 THEN left(t, -1) WHEN t LIKE '%an' AND length(t) > 4 THEN left(t, -2) ELSE t END"


def _overlap(tokens: str, text: str) -> str:
    pattern = rf"'\b(' || t || CASE WHEN length(t) <= 3 THEN '' ELSE '|' || {_STEM} || '\w*' END || ')\b'"
    return f"CASE WHEN len({tokens}) = 0 THEN 0.0::double ELSE len(list_filter({tokens}, lambda t: regexp_matches(lower({text}), {pattern})))::double / len({tokens}) END"


def _age(ts: str) -> str:
    return f"greatest(0.0::double, (epoch({AS_OF}) - epoch({ts}))::double / 3600.0)"


def _reranked(name: str, item: str, corpus: str, dated: str, lasting: str, source: str, reliability: str) -> str:
    """Pool `name`_pool to `name`_ranked, as the composite score, gate and features are defined."""
    w, r = retrieval.WEIGHTS, retrieval.RANKER
    h = _age(lasting)
    moment = f"CASE WHEN {lasting} IS NULL THEN 0.5 WHEN temporal_intent = 'CURRENT_STATUS' THEN CASE WHEN {h} <= 72 THEN 0.7 + 0.3 * exp(-{h} / 72.0) ELSE greatest(0.35, 0.7 * exp(-{h} / 2160.0)) END WHEN temporal_intent = 'HISTORICAL' THEN least(1.0, 0.3 + {h} / 8760.0) ELSE exp(-{h} / 4320.0) END"
    terms = lambda x: f"list_distinct(list_filter(string_split_regex({x}, '[^a-zA-Z0-9_-]+'), lambda t: length(t) > 2))"
    share = lambda x: f"CASE WHEN len(wanted) = 0 THEN 0.0::double ELSE len(list_intersect(wanted, {x}))::double / len(wanted) END"
    has = lambda c: f"len(list_intersect(event_types, string_split({c}, ','))) > 0"
    direct = "0.5 * f_headline + 0.5 * f_semantic"
    for intent, patterns, otherwise in reversed(V.DIRECT):
        arms = " ".join(f"WHEN regexp_matches({'body' if intent == 'CAUSE' else 'lower(title)'}, {D.text(chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')}) THEN {v}" for p, v in patterns)
        direct = f"CASE WHEN list_contains(string_split(intents, ','), '{intent}') THEN CASE {arms} ELSE {otherwise} END ELSE {direct} END"
    z = f"""{retrieval.INTERCEPT} + {r['semantic']} * f_semantic + {r['lexical']} * f_lexical + {r['headline']} * f_headline
        + {r['entity']} * CASE WHEN len(entities) > 0 THEN len(list_filter(entities, lambda e: contains(body, lower(e))))::double / len(entities) ELSE 0.2 END
        + {r['topic']} * CASE WHEN category <> '' AND contains(lower(question), category) THEN 1.0 WHEN category = 'technology' AND regexp_matches(lower(question), 'ai|software|model|tech') THEN 0.95 WHEN category = 'climate' AND regexp_matches(lower(question), 'flood|earthquake|disaster') THEN 0.95 ELSE 0.5 END
        + {r['event_type']} * CASE WHEN expected_types = '' THEN 0.6 WHEN f_expected AND NOT f_demoted THEN 1.0 WHEN f_expected THEN 0.6 WHEN f_demoted THEN 0.05 ELSE 0.35 END
        + {r['temporal']} * exp(-0.004 * f_age) + {r['reliability']} * greatest(0.5, least(1.0, {reliability})) + {r['independence']} * least(1.0, source_count / 4.0) + {r['importance']} * least(1.0, log2(article_count + 1) / 3.0) + {r['novelty']} * 0.6
        + {r['fit']} * CASE temporal_focus WHEN 'HISTORICAL' THEN CASE WHEN status = 'historical' OR f_age > 168 THEN 1.0 ELSE 0.5 END WHEN 'CURRENT' THEN CASE WHEN status = 'developing' OR f_age <= 72 THEN 1.0 ELSE 0.6 END ELSE 0.8 END
        + {r['redundancy']} * CASE WHEN same > 1 THEN 0.8 ELSE 0.0 END + {r['graph']} * 0.4 + {r['direct']} * ({direct})"""
    return f"""
        {name}_lexed AS (SELECT *, {corpus} AS corpus, {_overlap('tokens', corpus)} AS lex, {_overlap('tokens', 'title')} AS headline, {_overlap('list_transform(entities, lambda e: lower(e))', corpus)} AS entity FROM {name}_pool),
        {name}_composed AS (SELECT *, round({w['semantic']} * similarity + {w['lexical']} * CASE WHEN headline > 0 THEN 0.5 * lex + 0.5 * headline ELSE 0.7 * lex END + {w['entity']} * entity + {w['graph']} * CASE WHEN channel IN ('graph', 'family') THEN 1 ELSE 0 END
            + {w['temporal']} * {moment} + {w['source']} * {source}, 9) AS composite FROM {name}_lexed),
        {name}_gated AS (SELECT *, lower(title || ' ' || summary) AS body, count(*) OVER (PARTITION BY conv_id, turn, title) AS same FROM {name}_composed WHERE composite >= {retrieval.GATE} AND NOT (len(tokens) > 0 AND lex = 0 AND entity = 0 AND similarity < 0.65)),
        {name}_wanted AS (SELECT *, CASE WHEN len(tokens) > 0 THEN list_distinct(tokens) ELSE {terms('lower(question)')} END AS wanted, coalesce(nullif(similarity, 0), 0.5) AS f_semantic, coalesce({_age(dated)}, 48.0) AS f_age,
            expected_types <> '' AND {has('expected_types')} AS f_expected, demoted_types <> '' AND {has('demoted_types')} AS f_demoted FROM {name}_gated),
        {name}_shared AS (SELECT *, {share(terms('body'))} AS f_lexical, {share(terms('lower(title)'))} AS f_headline FROM {name}_wanted),
        {name}_scored AS (SELECT *, round(CASE WHEN f_demoted THEN {retrieval.DEMOTED} ELSE 1.0 END / (1.0 + exp(-({z})::double)), 4) AS score FROM {name}_shared),
        {name}_ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, {reliability} DESC, {item}) AS place FROM {name}_scored) x WHERE place <= 8)"""


def ask_turns() -> str:
    types = lambda c: f"[CASE {c} {' '.join(f'WHEN {D.text(k)} THEN {D.text(v)}' for k, v in V.FIXTURE_TYPES.items())} ELSE 'OTHER' END]"
    # a token stands in a text: short ones between word boundaries
    stands = lambda x, t="n.t": rf"CASE WHEN length({t}) <= 3 THEN regexp_matches({x}, '\b' || {t} || '\b') AND {t} NOT LIKE '-%' AND {t} NOT LIKE '%-' ELSE contains({x}, {t}) END"
    on_subject = rf"""NOT (demoted_types <> '' AND len(list_filter(event_types, lambda y: y <> 'OTHER' AND NOT list_contains(string_split(demoted_types, ','), y))) = 0)
        AND CASE WHEN len(tokens) = 0 THEN true WHEN len(tokens) <= 2 THEN hit = len(tokens) ELSE hit >= 2 AND 2 * hit >= len(tokens) END"""
    hit = rf"len(list_filter(tokens, lambda t: CASE WHEN length(t) <= 3 THEN regexp_matches(body, '\b' || t || '\b') ELSE contains(body, t) OR contains(body, {_STEM}) END))"
    return with_tables(D, ["articles", "sources", "story_events", "event_articles", "claims", "entities"], f"""
        , {_questions()},
        arts AS (SELECT a.article_id, coalesce(a.title, '') AS title, coalesce(a.summary, '') AS summary, coalesce(a.content, '') AS content, a.published_at, s.name AS outlet, s.type AS kind, coalesce(s.reliability, 0.5) AS reliability,
            {types(first_label(D, 'lower(a.summary)', V.FIXTURE_CATEGORIES, 'other'))} AS event_types, '' AS category, '' AS status, 1 AS source_count, 1 AS article_count, lower(coalesce(a.title, '') || ' ' || coalesce(a.summary, '') || ' ' || coalesce(a.content, '')) AS low
            FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id),
        evs AS (SELECT event_id, title, lead AS summary, category, status, country, source_count, article_count, first_reported_at, last_updated_at, {types('category')} AS event_types, lower(title || ' ' || lead) AS low FROM story_events),
        needles AS (SELECT DISTINCT unnest(tokens) AS t FROM q), asks AS (SELECT DISTINCT conv_id, turn, unnest(tokens) AS t FROM q), firsts AS (SELECT conv_id, turn, tokens[1] AS t FROM q WHERE len(tokens) > 0),
        art_hits AS (SELECT n.t, a.article_id FROM needles n JOIN arts a ON {stands('a.low')}), ev_hits AS (SELECT n.t, e.event_id FROM needles n JOIN evs e ON {stands('e.low')}),
        art_lane AS (SELECT * FROM (SELECT conv_id, turn, article_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY reliability DESC, published_at DESC, article_id) AS place FROM (SELECT DISTINCT conv_id, turn, article_id FROM asks JOIN art_hits USING (t)) x JOIN arts USING (article_id)) y WHERE place <= 35),
        ev_lane AS (SELECT * FROM (SELECT conv_id, turn, event_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY last_updated_at DESC, event_id) AS place FROM (SELECT DISTINCT conv_id, turn, event_id FROM asks JOIN ev_hits USING (t)) x JOIN evs USING (event_id)) y WHERE place <= 25),
        wanted_names AS (SELECT DISTINCT conv_id, turn, unnest(list_concat(entities, list_filter(tokens, lambda t: length(t) > 3))) AS name FROM q),
        records AS (SELECT conv_id, turn, 0 AS kind, w.name AS origin, n.event_id AS target FROM wanted_names w JOIN (SELECT DISTINCT e.name, ea.event_id FROM entities e JOIN event_articles ea ON ea.article_id = e.article_id) n ON n.name = w.name
            UNION ALL SELECT conv_id, turn, 1, lpad(cast(l.event_id AS varchar), 20, '0'), m.article_id FROM ev_lane l JOIN (SELECT DISTINCT event_id, article_id FROM event_articles) m ON m.event_id = l.event_id WHERE l.place <= 10),
        graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY kind, origin, target) AS place FROM records) x WHERE place <= 15),
        graph_evs AS (SELECT conv_id, turn, target AS event_id, min(place) AS place FROM graph g WHERE kind = 0 AND NOT EXISTS (SELECT 1 FROM ev_lane l WHERE l.conv_id = g.conv_id AND l.turn = g.turn AND l.event_id = g.target AND l.place <= 10) GROUP BY ALL),
        heads AS (SELECT conv_id, turn, event_id AS head FROM (SELECT conv_id, turn, event_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY place, event_id) AS k FROM
            (SELECT conv_id, turn, event_id, min(place) AS place FROM (SELECT conv_id, turn, event_id, place FROM ev_lane UNION ALL SELECT conv_id, turn, event_id, place + 25 FROM graph_evs) u GROUP BY ALL) v) w WHERE k <= 3),
        sisters AS (SELECT DISTINCT conv_id, turn, event_id FROM (SELECT h.conv_id, h.turn, e.event_id, row_number() OVER (PARTITION BY h.conv_id, h.turn, h.head ORDER BY e.last_updated_at DESC, e.event_id) AS k
            FROM heads h JOIN evs o ON o.event_id = h.head LEFT JOIN firsts f ON f.conv_id = h.conv_id AND f.turn = h.turn JOIN evs e ON e.event_id <> h.head AND ((e.country = o.country AND e.category = o.category) OR contains(lower(e.title), f.t))) x WHERE k <= 4),
        art_candidates AS (SELECT conv_id, turn, article_id, arg_min(similarity, lane) AS similarity, arg_min(channel, lane) AS channel FROM (SELECT conv_id, turn, article_id, 1 AS lane, 0.5::double AS similarity, 'lexical' AS channel FROM art_lane
            UNION ALL SELECT conv_id, turn, target, 2, 0.6, 'graph' FROM graph WHERE kind = 1) u GROUP BY ALL),
        ev_candidates AS (SELECT conv_id, turn, event_id, arg_min(similarity, lane) AS similarity, arg_min(channel, lane) AS channel FROM (SELECT conv_id, turn, event_id, 1 AS lane, 0.5::double AS similarity, 'lexical' AS channel FROM ev_lane
            UNION ALL SELECT conv_id, turn, event_id, 2, 0.6, 'graph' FROM graph_evs UNION ALL SELECT conv_id, turn, event_id, 3, 0.45, 'family' FROM sisters) u GROUP BY ALL),
        art_pool AS (SELECT c.similarity, c.channel, q.*, a.* FROM art_candidates c JOIN q ON q.conv_id = c.conv_id AND q.turn = c.turn JOIN arts a ON a.article_id = c.article_id),
        ev_pool AS (SELECT c.similarity, c.channel, q.*, e.* FROM ev_candidates c JOIN q ON q.conv_id = c.conv_id AND q.turn = c.turn JOIN evs e ON e.event_id = c.event_id),
        {_reranked('art', 'article_id', "title || ' ' || summary || ' ' || left(content, 400)", 'published_at', 'published_at', 'reliability', 'reliability')},
        {_reranked('ev', 'event_id', "title || ' ' || summary", 'first_reported_at', 'last_updated_at', 'CASE WHEN source_count >= 2 THEN 0.9 ELSE 0.6 END', '0.82')},
        art_on AS (SELECT *, {on_subject} AS on_subject FROM (SELECT *, {hit} AS hit FROM art_ranked) x), ev_on AS (SELECT *, {on_subject} AS on_subject FROM (SELECT *, {hit} AS hit FROM ev_ranked) x),
        art_list AS (SELECT conv_id, turn, string_agg(article_id::varchar, ',' ORDER BY place) AS article_ids, coalesce(string_agg(article_id::varchar, ',' ORDER BY place) FILTER (WHERE on_subject), '') AS on_article_ids, count(*) FILTER (WHERE score >= 0.45 AND NOT f_demoted) AS good,
            count(*) FILTER (WHERE score >= 0.45 AND NOT f_demoted AND len(list_intersect(event_types, ['PRODUCT_LAUNCH', 'PRODUCT_RELEASE', 'MODEL_RELEASE'])) > 0) AS launches, count(*) FILTER (WHERE score >= 0.45 AND NOT f_demoted AND len(list_intersect(event_types, ['RESEARCH_FINDING', 'SCIENTIFIC_DISCOVERY'])) > 0) AS studies,
            count(*) FILTER (WHERE score >= 0.45 AND NOT f_demoted AND NOT (contains(lower(question), 'japan') AND NOT contains(body, 'japan')) AND NOT (contains(lower(question), 'nepal') AND NOT contains(body, 'nepal'))) AS placed,
            count(*) FILTER (WHERE on_subject) AS n_on, arg_min(title, place) FILTER (WHERE on_subject) AS on_title FROM art_on GROUP BY conv_id, turn),
        ev_list AS (SELECT conv_id, turn, string_agg(event_id::varchar, ',' ORDER BY place) AS event_ids, coalesce(string_agg(event_id::varchar, ',' ORDER BY place) FILTER (WHERE on_subject), '') AS on_event_ids, count(*) FILTER (WHERE on_subject) AS n_on,
            arg_min(summary, place) FILTER (WHERE on_subject) AS on_summary, arg_min(status, place) FILTER (WHERE on_subject) AS on_status FROM ev_on GROUP BY conv_id, turn),
        marked AS (SELECT conv_id, turn, place, article_id, lower(trim(coalesce(outlet, ''))) AS outlet, {wire_sql(D, "(title || ' ' || coalesce(outlet, '') || ' ' || left(summary, 300))", V.FIXTURE_WIRES)} AS wire, {hierarchy_sql(D, "coalesce(outlet, '')", "coalesce(kind, '')", "''")} AS level,
            list_distinct(list_filter(string_split_regex(regexp_replace(body, '[^a-z0-9 \\t\\n\\x0b\\x0c\\r]', '', 'g'), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda w: length(w) > 3)) AS ws FROM art_ranked),
        dependent AS (SELECT b.conv_id, b.turn, b.place, a.place AS earlier FROM marked a JOIN marked b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.place < b.place
            WHERE coalesce(a.wire = b.wire, false) OR (a.outlet = b.outlet AND a.outlet <> '') OR (len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) > 0.65 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))))),
        led(conv_id, turn, k, leaders) AS (SELECT DISTINCT conv_id, turn, 0::bigint, []::bigint[] FROM marked UNION ALL
            SELECT l.conv_id, l.turn, l.k + 1, CASE WHEN EXISTS (SELECT 1 FROM dependent d WHERE d.conv_id = l.conv_id AND d.turn = l.turn AND d.place = l.k + 1 AND list_contains(l.leaders, d.earlier)) THEN l.leaders ELSE list_append(l.leaders, l.k + 1) END
            FROM led l JOIN marked m ON m.conv_id = l.conv_id AND m.turn = l.turn AND m.place = l.k + 1),
        clustered AS (SELECT l.conv_id, l.turn, len(l.leaders) AS n, (SELECT count(*) FROM marked m WHERE m.conv_id = l.conv_id AND m.turn = l.turn AND list_contains(l.leaders, m.place) AND m.level IN ('PRIMARY SOURCE', 'SCIENTIFIC_TECHNICAL')) AS official,
            (SELECT count(*) FROM marked m WHERE m.conv_id = l.conv_id AND m.turn = l.turn AND list_contains(l.leaders, m.place) AND m.level <> 'PUBLIC_SIGNAL') AS other FROM (SELECT conv_id, turn, arg_max(leaders, k) AS leaders FROM led GROUP BY conv_id, turn) l),
        claim_hits AS (SELECT conv_id, turn, claim_id FROM ev_ranked e JOIN claims c USING (event_id) UNION SELECT conv_id, turn, claim_id FROM firsts f JOIN claims c ON contains(lower(c.claim_text), f.t)),
        claim_rows AS (SELECT * FROM (SELECT conv_id, turn, claim_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY claim_id) AS place FROM claim_hits) x WHERE place <= 8),
        longer AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(question), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 3 AND t NOT IN ({_in(V.PICTURE_STOP)})) AS ts FROM q),
        matched AS (SELECT r.conv_id, r.turn, r.claim_id, len(o.ts) AS n, len(list_filter(o.ts, lambda t: contains(lower(c.claim_text), t))) AS m FROM claim_rows r JOIN claims c ON c.claim_id = r.claim_id JOIN longer o ON o.conv_id = r.conv_id AND o.turn = r.turn),
        pictured AS (SELECT conv_id, turn, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY m DESC, claim_id) AS k FROM matched WHERE m > 0 AND (m >= 2 OR m >= 0.4 * n)) x WHERE k = 1),
        whole AS (SELECT q.*, ['ask', 'fact_check', 'research'][q.conv_id % 3 + 1] AS mode, coalesce(a.article_ids, '') AS article_ids, coalesce(a.on_article_ids, '') AS on_article_ids, coalesce(a.good, 0) AS good, coalesce(a.n_on, 0) AS n_on_articles, a.on_title,
            CASE WHEN primary_intent IN ('PRODUCT_LAUNCH', 'MODEL_RELEASE') THEN 'launch' WHEN primary_intent IN ('RESEARCH_FINDING', 'SCIENTIFIC_DISCOVERY') THEN 'study' WHEN primary_intent = 'DISASTER_STATUS' THEN 'disaster' ELSE '' END AS strict,
            coalesce(CASE WHEN primary_intent IN ('PRODUCT_LAUNCH', 'MODEL_RELEASE') THEN a.launches WHEN primary_intent IN ('RESEARCH_FINDING', 'SCIENTIFIC_DISCOVERY') THEN a.studies WHEN primary_intent = 'DISASTER_STATUS' THEN a.placed ELSE a.good END, 0) AS fitting,
            coalesce(e.event_ids, '') AS event_ids, coalesce(e.on_event_ids, '') AS on_event_ids, coalesce(e.n_on, 0) AS n_on_events, e.on_summary, e.on_status, coalesce(c.n, 0) AS n_leaders, CASE WHEN c.n > 0 AND c.other = 0 THEN 'UNVERIFIED' WHEN c.official > 0 OR c.n >= 2 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS claim_status
            FROM q LEFT JOIN art_list a ON a.conv_id = q.conv_id AND a.turn = q.turn LEFT JOIN ev_list e ON e.conv_id = q.conv_id AND e.turn = q.turn LEFT JOIN clustered c ON c.conv_id = q.conv_id AND c.turn = q.turn),
        claimed AS (SELECT conv_id, turn, list(claim_id ORDER BY place) AS ids FROM claim_rows GROUP BY conv_id, turn),
        settled AS (SELECT w.*, w.fitting > 0 AS sufficient, w.mode = 'fact_check' AND c.ids IS NULL AND w.question <> '' AS own, coalesce(c.ids, []) AS ids, p.claim_id AS picture, len(o.ts) AS n_longer,
            CASE WHEN w.mode = 'fact_check' THEN 'all' WHEN w.fitting = 0 THEN '' WHEN w.n_on_articles > 0 THEN 'on' ELSE 'all' END AS target
            FROM whole w LEFT JOIN claimed c ON c.conv_id = w.conv_id AND c.turn = w.turn LEFT JOIN pictured p ON p.conv_id = w.conv_id AND p.turn = w.turn JOIN longer o ON o.conv_id = w.conv_id AND o.turn = w.turn),
        targets AS (SELECT s.conv_id, s.turn, a.article_id, a.published_at, a.outlet, a.reliability, row_number() OVER (PARTITION BY s.conv_id, s.turn ORDER BY a.place) AS k FROM settled s JOIN art_on a ON a.conv_id = s.conv_id AND a.turn = s.turn WHERE s.target = 'all' OR (s.target = 'on' AND a.on_subject)),
        shown AS (SELECT conv_id, turn, string_agg(article_id::varchar, ',' ORDER BY k) FILTER (WHERE k <= 4) AS sources, greatest(count(*) - 4, 0) AS more, string_agg(article_id || '|' || strftime(published_at, '%Y-%m-%d') || '|' || coalesce(nullif(lower(outlet), ''), 'News Source') || '|' || CASE WHEN reliability >= 0.9 THEN 'PRIMARY_SOURCE' ELSE 'HIGH_QUALITY_NEWS' END, ';' ORDER BY k) FILTER (WHERE k <= 4) AS developments FROM targets GROUP BY conv_id, turn),
        kinds AS (SELECT s.*, CASE WHEN mode = 'fact_check' THEN CASE WHEN own OR len(ids) > 0 THEN 'AUDIT' ELSE 'NO_REPORTING' END WHEN NOT sufficient THEN CASE strict WHEN 'launch' THEN 'NO_LAUNCH' WHEN 'disaster' THEN 'NO_DISASTER' WHEN 'study' THEN 'NO_RESEARCH' ELSE 'NO_EVIDENCE' END
            WHEN n_on_events > 0 THEN 'EVENT' WHEN n_on_articles > 0 THEN 'ARTICLE' ELSE 'NOTHING_ON_SUBJECT' END AS answer_kind FROM settled s)
        SELECT k.conv_id, k.turn, k.mode, k.temporal_intent, k.primary_intent, k.sufficient, CASE WHEN k.sufficient THEN 'CORROBORATED' WHEN k.strict IN ('launch', 'study') AND k.good > 0 THEN 'CONTEXT_ONLY_NO_DIRECT_ANSWER' ELSE 'NO_RELEVANT_EVIDENCE' END AS evidence_state,
            cast(CASE WHEN k.sufficient OR k.strict = 'disaster' THEN k.fitting ELSE k.good END AS int) AS relevant_count, k.article_ids, k.event_ids, k.on_article_ids, k.on_event_ids,
            CASE WHEN k.own THEN 'claim-custom:' || k.claim_status ELSE array_to_string(list_transform(k.ids, lambda i: i || ':' || k.claim_status), ',') END AS claims, cast(k.n_leaders AS int) AS independent_sources,
            CASE WHEN k.claim_status = 'VERIFIED' AND k.n_longer > 0 THEN CASE WHEN k.own THEN 'claim-custom' ELSE k.picture::varchar END END AS picture_claim, k.answer_kind, left(CASE k.answer_kind WHEN 'EVENT' THEN k.on_summary WHEN 'ARTICLE' THEN k.on_title END, 180) AS answer,
            CASE WHEN k.n_on_events > 0 AND k.on_status IN ('developing', 'ongoing') AND k.temporal_intent <> 'HISTORICAL' THEN 'ACTIVE' WHEN k.n_on_events = 0 THEN 'NO_ALERT' WHEN k.temporal_intent = 'HISTORICAL' THEN 'HISTORICAL_RECORD' ELSE 'CONCLUDED' END AS current_status,
            CASE WHEN k.mode = 'research' OR k.temporal_focus = 'FUTURE' THEN 'REQUESTED' ELSE 'NO_FORECAST_JUSTIFIED' END AS forecast, CASE WHEN k.mode <> 'fact_check' AND k.sufficient THEN coalesce(s.developments, '') ELSE '' END AS developments,
            coalesce(s.sources, '') AS sources, cast(coalesce(s.more, 0) AS int) AS more_sources
        FROM kinds k LEFT JOIN shown s ON s.conv_id = k.conv_id AND s.turn = k.turn""").replace("WITH ", "WITH RECURSIVE ", 1)


def oracle_sql() -> dict[str, str]:
    return {"expand_questions": expand_questions(), "ask_turns": ask_turns()}
