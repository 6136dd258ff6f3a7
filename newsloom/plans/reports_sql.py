"""DuckDB SQL for the events' reports, as nested structs."""

from __future__ import annotations

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Duck
from newsloom.operators import intelligence as I
from newsloom.operators import reports
from newsloom.operators.text import hierarchy_sql, wire_sql
from newsloom.sources.adapters import with_tables

#: Words of the synthetic claims that fill stages of a causal chain.
STAGE_WORDS = {"trigger": ["honer", "ertion"], "immediate_consequences": ["thtion", "anat", "ing"]}


def event_reports() -> str:
    d = Duck()
    held = lambda x, ws: " OR ".join(f"contains(lower({x}), {d.text(w)})" for w in ws)
    stage = "CASE " + " ".join(f"WHEN {held('claim_text', ws)} THEN {d.text(s)}" for s, ws in STAGE_WORDS.items()) + " END"
    frames = ", ".join(f"({i}, {d.text(k)}, {d.text(w)})" for i, (k, ws) in enumerate(V.FIXTURE_FRAMES.items()) for w in ws)
    hazard = "CASE category " + " ".join(f"WHEN {d.text(k)} THEN {v}" for k, v in V.HAZARDS.items()) + f" ELSE {V.HAZARD_OTHER} END"
    parts = [f"{I.VELOCITY} * ln(1 + n_articles)", f"{I.BREADTH} * least(1.0, n_sources / 6.0)", f"{I.RELIABILITY} * mean_reliability", f"{I.HAZARD} * {hazard}", f"{I.CONTRADICTION} * contradicted", f"{I.ENTITIES} * least(1.0, greatest(n_names, 1) / 10.0)"]
    shares = ", ".join(f"({-i}, {d.text(n)}, ({p})::double)" for i, (n, p) in enumerate(zip(reports.DRIVERS, parts, strict=True)))
    time = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    stages = ", ".join(f"({i}, {d.text(s)})" for i, s in enumerate(reports.STAGES))
    timeline = I.timeline(d)
    # every field that may be null is taken out of the text, as Spark writes none
    return with_tables(d, ["story_events", "event_articles", "articles", "sources", "claims", "entities"], f"""
        , arts AS (SELECT ea.event_id, a.article_id, coalesce(a.title, '') AS title, coalesce(a.summary, '') AS summary, a.published_at, s.name AS outlet, s.type AS kind, s.reliability, row_number() OVER (PARTITION BY ea.event_id ORDER BY a.published_at DESC, a.article_id) AS i
            FROM event_articles ea JOIN articles a ON a.article_id = ea.article_id LEFT JOIN sources s ON s.source_id = a.source_id),
        coverage AS (SELECT event_id, list({{'id': article_id, 'source': coalesce(outlet, 'News Wire'), 'level': {hierarchy_sql(d, "coalesce(outlet, '')", "coalesce(kind, '')", "''")}, 'reliability': cast(floor(reliability * 100 + 0.5) AS bigint), 'title': title, 'published_at': {time('published_at')}}} ORDER BY i) FILTER (WHERE i <= 20) AS coverage,
            list(summary ORDER BY i) FILTER (WHERE i <= 3) AS told, count(*) AS n, count(DISTINCT outlet) AS outlets, coalesce(avg(reliability), 0.55) AS mean_reliability FROM arts GROUP BY event_id),
        marked AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY published_at, article_id) AS place, lower(trim(coalesce(outlet, ''))) AS outlet, {wire_sql(d, "(title || ' ' || coalesce(outlet, '') || ' ' || left(summary, 300))", V.FIXTURE_WIRES)} AS wire, {hierarchy_sql(d, "coalesce(outlet, '')", "coalesce(kind, '')", "''")} AS level,
            list_distinct(list_filter(string_split_regex(regexp_replace(lower(title || ' ' || summary), '[^a-z0-9 \\t\\n\\x0b\\x0c\\r]', '', 'g'), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda w: length(w) > 3)) AS ws FROM arts),
        led(event_id, k, leaders) AS (SELECT DISTINCT event_id, 0::bigint, []::bigint[] FROM marked UNION ALL
            SELECT l.event_id, l.k + 1, CASE WHEN EXISTS (SELECT 1 FROM marked a WHERE a.event_id = l.event_id AND list_contains(l.leaders, a.place) AND (coalesce(a.wire = m.wire, false) OR (a.outlet = m.outlet AND a.outlet <> '')
                OR (len(a.ws) > 0 AND len(m.ws) > 0 AND len(list_intersect(a.ws, m.ws)) > 0.65 * (len(a.ws) + len(m.ws) - len(list_intersect(a.ws, m.ws)))))) THEN l.leaders ELSE list_append(l.leaders, l.k + 1) END
            FROM led l JOIN marked m ON m.event_id = l.event_id AND m.place = l.k + 1),
        judged AS (SELECT l.event_id, count(*) AS clusters, CASE WHEN bool_and(m.level = 'PUBLIC_SIGNAL') THEN false ELSE bool_or(m.level IN ('PRIMARY SOURCE', 'SCIENTIFIC_TECHNICAL')) OR count(*) >= 2 END AS verified FROM (SELECT event_id, arg_max(leaders, k) AS leaders FROM led GROUP BY event_id) l JOIN marked m ON m.event_id = l.event_id AND list_contains(l.leaders, m.place) GROUP BY l.event_id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY extracted_at DESC, claim_id) AS i, {stage} AS stage FROM claims),
        told_claims AS (SELECT event_id, list({{'id': claim_id, 'text': claim_text}} ORDER BY i) FILTER (WHERE i <= 20) AS claims, max(CASE WHEN status = 'CONTRADICTED' THEN 1 ELSE 0 END) AS contradicted,
            array_to_string((list(claim_text ORDER BY i) FILTER (WHERE status = 'VERIFIED'))[1:4], ' ') AS picture, array_to_string((list(claim_text ORDER BY i) FILTER (WHERE status <> 'CONTRADICTED'))[1:20], ' ') AS why FROM placed GROUP BY event_id),
        filled AS (SELECT event_id, stage, arg_min(claim_id, i) AS claim_id FROM placed WHERE stage IS NOT NULL AND status <> 'CONTRADICTED' GROUP BY event_id, stage),
        stages(pos, stage) AS (VALUES {stages}),
        causal AS (SELECT e.event_id, '[' || string_agg('{{"stage":"' || s.stage || '","status":"' || CASE WHEN f.claim_id IS NULL THEN 'MISSING_EVIDENCE"}}' ELSE 'SUPPORTED","claim":' || f.claim_id || '}}' END, ',' ORDER BY s.pos) || ']' AS causal, list(s.stage ORDER BY s.pos) FILTER (WHERE f.claim_id IS NULL) AS gaps,
            string_agg(s.stage || ':' || f.claim_id, ';' ORDER BY s.pos) FILTER (WHERE f.claim_id IS NOT NULL) AS chained FROM story_events e CROSS JOIN stages s LEFT JOIN filled f ON f.event_id = e.event_id AND f.stage = s.stage GROUP BY e.event_id),
        names AS (SELECT DISTINCT ea.event_id, e.name, e.type FROM entities e JOIN event_articles ea ON ea.article_id = e.article_id),
        buckets AS (SELECT event_id, coalesce((list(name ORDER BY name) FILTER (WHERE type = 'person'))[1:20], []) AS people, coalesce((list(name ORDER BY name) FILTER (WHERE type = 'organization'))[1:20], []) AS organizations, count(DISTINCT name) AS n_names FROM names GROUP BY event_id),
        marks AS (SELECT event_id, list({{'id': id, 'phase': phase}} ORDER BY i) AS timeline FROM ({timeline}) t GROUP BY event_id),
        words(pos, frame, w) AS (VALUES {frames}),
        hits AS (SELECT a.event_id, a.article_id, w.pos, w.frame, count(*) FILTER (WHERE contains(lower(a.title || ' ' || a.summary), w.w)) AS n FROM arts a CROSS JOIN words w GROUP BY ALL),
        framed AS (SELECT event_id, pos, frame, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_id, article_id ORDER BY n DESC, pos) AS k FROM hits) x WHERE k = 1 GROUP BY ALL),
        shares AS (SELECT *, cast(floor(100.0 * n / sum(n) OVER (PARTITION BY event_id) + 0.5) AS bigint) AS percent FROM framed),
        framing AS (SELECT event_id, list({{'category': frame, 'articles': n, 'percent': percent}} ORDER BY pos) AS framing, array_to_string((list(percent || '% ' || lower(frame) ORDER BY n DESC, pos))[1:2], '; ') AS observation, count(*) AS n_frames, lower(any_value(frame)) AS only_frame FROM shares GROUP BY event_id),
        pairs AS (SELECT a.event_id, b.event_id AS other, 0 AS kind, row_number() OVER (PARTITION BY a.event_id ORDER BY b.last_updated_at DESC, b.event_id) AS i FROM story_events a JOIN story_events b ON a.event_id <> b.event_id AND (a.category = b.category OR a.country = b.country)),
        sharing AS (SELECT event_id, other, 1 AS kind, row_number() OVER (PARTITION BY event_id ORDER BY other) AS i FROM (SELECT DISTINCT n.event_id, h.other FROM names n JOIN (SELECT name, event_id AS other, row_number() OVER (PARTITION BY name ORDER BY event_id) AS k FROM (SELECT DISTINCT name, event_id FROM names) y) h ON h.name = n.name AND h.k <= 9 AND h.other <> n.event_id) x),
        ranked AS (SELECT event_id, other, row_number() OVER (PARTITION BY event_id ORDER BY spot, other) AS i FROM (SELECT event_id, other, min((kind, i)) AS spot FROM (SELECT * FROM pairs WHERE i <= 4 UNION ALL SELECT * FROM sharing WHERE i <= 8) u GROUP BY event_id, other) v),
        related AS (SELECT r.event_id, list({{'id': r.other, 'title': e.title}} ORDER BY r.i) AS related FROM ranked r JOIN story_events e ON e.event_id = r.other WHERE r.i <= 8 GROUP BY r.event_id),
        whole AS (SELECT e.*, e.lead AS summary, greatest(e.article_count, coalesce(c.n, 0)) AS n_articles, greatest(e.source_count, coalesce(c.outlets, 0)) AS n_sources, coalesce(c.mean_reliability, 0.55) AS mean_reliability, coalesce(c.coverage, []) AS coverage, coalesce(c.told, []) AS told, coalesce(j.verified, false) AS verified, coalesce(j.clusters, 0) AS clusters,
            t.claims, coalesce(t.contradicted, 0) AS contradicted, coalesce(t.picture, '') AS picture, coalesce(t.why, '') AS why, k.causal, k.gaps, k.chained, coalesce(b.people, []) AS people, coalesce(b.organizations, []) AS organizations, coalesce(b.n_names, 0) AS n_names, m.timeline, f.framing, CASE WHEN f.n_frames = 1 THEN f.only_frame ELSE f.observation END AS observation, r.related
            FROM story_events e LEFT JOIN coverage c USING (event_id) LEFT JOIN judged j USING (event_id) LEFT JOIN told_claims t USING (event_id) LEFT JOIN causal k USING (event_id) LEFT JOIN buckets b USING (event_id) LEFT JOIN marks m USING (event_id) LEFT JOIN framing f USING (event_id) LEFT JOIN related r USING (event_id)),
        summed AS (SELECT w.event_id, sum(s.x) AS z, max((round(s.x, 2), s.pos)) AS top FROM whole w, LATERAL (VALUES {shares}) s(pos, driver, x) GROUP BY w.event_id),
        scored AS (SELECT w.*, CASE WHEN n_articles >= 2 AND n_sources >= 1 THEN round(1.0 / (1.0 + exp(-({I.BIAS} + s.z))), 3) END AS probability, s.top[1] AS share, [{', '.join(map(d.text, reports.DRIVERS))}][1 - s.top[2]] AS best, 1.96 / sqrt(greatest(10, 5 * n_articles + 10 * n_sources)) AS unit FROM whole w JOIN summed s ON s.event_id = w.event_id)
        SELECT event_id, CASE WHEN verified THEN len(coalesce(claims, [])) ELSE 0 END::int AS confirmed, CASE WHEN verified THEN 0 ELSE len(coalesce(claims, [])) END::int AS uncertain, probability, CASE WHEN probability IS NOT NULL THEN best END AS driver, array_to_string(gaps, ',') AS gaps,
            '{{"headline":' || to_json(title) || ',"meta":' || to_json({{'n_sources': n_sources, 'n_articles': n_articles, 'category': category, 'severity': severity, 'status': status, 'country': country, 'first_reported_at': {time('first_reported_at')}, 'last_updated_at': {time('last_updated_at')}}})
            || ',"verified_picture":' || to_json(CASE WHEN picture <> '' THEN picture WHEN summary <> '' THEN summary ELSE coalesce(told[1], '') END) || ',"what_happened":' || to_json(array_to_string(list_filter(list_transform(range(1, len(told) + 2), lambda i: CASE WHEN list_position(list_prepend(summary, told), list_prepend(summary, told)[i]) = i THEN list_prepend(summary, told)[i] END), lambda x: x <> ''), chr(10) || chr(10)))
            || CASE WHEN why <> '' THEN ',"why":' || to_json(why) WHEN chained IS NOT NULL THEN ',"why":' || to_json(chained) ELSE '' END || ',"confirmed":' || CASE WHEN verified AND claims IS NOT NULL THEN to_json(claims) ELSE '[]' END || ',"uncertain":' || CASE WHEN NOT verified AND claims IS NOT NULL THEN to_json(claims) ELSE '[]' END
            || ',"independent_sources":' || clusters || ',"causal":' || causal || ',"gaps":' || to_json(gaps) || ',"timeline":' || coalesce(to_json(timeline), '[]') || ',"people":' || to_json(people) || ',"organizations":' || to_json(organizations) || ',"coverage":' || to_json(coverage)
            || ',"framing":' || coalesce(to_json(framing), '[]') || ',"observation":' || to_json(coalesce(observation, '')) || ',"related":' || coalesce(to_json(related), '[]')
            || CASE WHEN probability IS NULL THEN '' ELSE ',"forecast":' || to_json({{'probability': probability, 'lower': round(greatest(0.01, probability - unit * sqrt(probability * (1 - probability))), 3), 'upper': round(least(0.99, probability + unit * sqrt(probability * (1 - probability))), 3), 'driver': best, 'share': share}}) END || '}}' AS report
        FROM scored""").replace("WITH ", "WITH RECURSIVE ", 1)


def oracle_sql() -> dict[str, str]:
    return {"event_reports": event_reports()}
