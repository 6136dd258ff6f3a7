"""Rules over news text. The Spark side folds each rule list into expressions; the oracle joins the texts with a table of the rules."""

from __future__ import annotations

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Duck, Spark
from newsloom.sources.adapters import first_label, with_tables

#: Lines with real news words, beside all articles, whose invented prose holds few.
LINES = (
    ("Acme unveils new flagship phone", "The device launches on Friday with a faster chip."),
    ("Review of the phone Acme launched", "We tried the gadget and its software update."),
    ("Lab releases model weights for gpt-6", "The foundation model has open weights and a public beta."),
    ("Experts warn of existential risk", "Scientists warn that the launch was rushed, a warning to regulators."),
    ("Researchers found a new species", "Scientists discovered it; the study shows a genome sequence, published in a journal."),
    ("Parliament: bill signed into law", "Lawmakers pass the statute after the election."),
    ("Earthquake kills dozens", "Magnitude 7 quake; death toll rises, rescue operations under way."),
    ("Breaking: troops cross border as ceasefire fails", "Missiles and shelling reported, thousands displaced."),
    ("Central bank raises interest rate", "Inflation and debt weigh on the currency."),
    ("Shares plunge on Nasdaq", "The stock price drop follows the earnings call and a merger."),
    ("Supreme court verdict in lawsuit", "The judge rules after an inquiry and a probe."),
    ("Monsoon rainfall displaces thousands", "Corruption, drainage failure and encroachment blamed; army leads relief."),
    ("UN envoy holds bilateral talks", "The ambassador spoke at the summit of the un assembly."),
    ("Vaccine trial at hospital", "who officials praised the clinical trial."),
    ("World cup final tonight", "A championship match for the league."),
    ("Museum opens film festival", "An exhibition of the artist and a novel."),
    ("Highway and bridge closed", "The supply chain loss runs to billions."),
    ("A quiet afternoon", "Nothing of note."),
    ("", ""),
)


def _lines(d: Spark) -> str:
    rows = " UNION ALL ".join(f"SELECT cast({-1 - i} AS bigint) AS id, {d.text(t)} AS title, {d.text(b)} AS body" for i, (t, b) in enumerate(LINES))
    return f", lines AS ({rows} UNION ALL SELECT article_id, title, summary FROM articles), said AS (SELECT id, title, trim(title || ' ' || body) AS full_text, lower(title || ' ' || body) AS low FROM lines)"


def _rules(rules: dict[str, list[str]]) -> str:
    """A table (place, label, pattern) for the oracle: a pattern a term."""
    return "(VALUES " + ", ".join(f"({i}, {Duck.text(label)}, {Duck.text(chr(92) + 'b(?:' + t + ')' + chr(92) + 'b')})" for i, (label, ts) in enumerate(rules.items()) for t in ts) + ") AS r(place, label, pattern)"


def _first(d: Spark, rules: dict[str, list[str]], default: str, name: str) -> str:
    if d.name == "spark":
        return with_tables(d, ["articles"], _lines(d) + f" SELECT id, {first_label(d, 'low', rules, default)} AS {name} FROM said")
    return with_tables(d, ["articles"], _lines(d) + f" SELECT s.id, coalesce(arg_min(r.label, r.place), {d.text(default)}) AS {name} FROM said s LEFT JOIN {_rules(rules)} ON regexp_matches(s.low, r.pattern) GROUP BY s.id")


def news_category(d: Spark) -> str:
    """The first category with a word in the text."""
    return _first(d, V.CATEGORIES, "other", "category")


def recategorised(d: Spark) -> str:
    """What stands under politics, the former catch-all, takes the category of its words; then lines by category. Every third article and
    all lines of LINES are taken to stand there."""
    label = "CASE WHEN id < 0 OR id % 3 = 0 THEN 'politics' ELSE 'culture' END"
    if d.name == "spark":
        return with_tables(d, ["articles"], _lines(d) + f", moved AS (SELECT CASE WHEN {label} = 'politics' THEN {first_label(d, 'low', V.CATEGORIES, 'other')} ELSE {label} END AS category FROM said) SELECT category, count(*) AS items FROM moved GROUP BY category")
    return with_tables(d, ["articles"], _lines(d) + f""", moved AS (SELECT s.id, coalesce(arg_min(r.label, r.place), 'other') AS category FROM said s LEFT JOIN {_rules(V.CATEGORIES)} ON regexp_matches(s.low, r.pattern) WHERE s.id < 0 OR s.id % 3 = 0 GROUP BY s.id)
        SELECT category, count(*) AS items FROM (SELECT category FROM moved UNION ALL SELECT 'culture' FROM said WHERE NOT (id < 0 OR id % 3 = 0)) x GROUP BY category""")


def news_severity(d: Spark) -> str:
    return _first(d, V.SEVERITIES, "normal", "severity")


def news_frames(d: Spark) -> str:
    """Frames by the number of their keywords that the text holds anywhere; the first of the largest, also of none; shares in whole percent."""
    if d.name == "spark":
        n = [" + ".join(f"CASE WHEN contains(low, {d.text(t)}) THEN 1 ELSE 0 END" for t in ts) for ts in V.FRAMES.values()]
        counted = f"SELECT id, {', '.join(f'{x} AS f{i}' for i, x in enumerate(n))} FROM said"
        most = f"greatest({', '.join(f'f{i}' for i in range(len(n)))})"
        pick = " ".join(f"WHEN f{i} = {most} THEN {d.text(k)}" for i, k in enumerate(V.FRAMES))
        return with_tables(d, ["articles"], _lines(d) + f", framed AS (SELECT CASE {pick} END AS frame FROM ({counted}) x) SELECT frame, count(*) AS articles, {d.integer('floor(100.0 * count(*) / max(total) + 0.5)')} AS percent FROM framed CROSS JOIN (SELECT count(*) AS total FROM framed) t GROUP BY frame")
    words = "(VALUES " + ", ".join(f"({i}, {d.text(k)}, {d.text(t)})" for i, (k, ts) in enumerate(V.FRAMES.items()) for t in ts) + ") AS r(place, frame, term)"
    return with_tables(d, ["articles"], _lines(d) + f""", n AS (SELECT s.id, r.place, r.frame, count(*) FILTER (WHERE contains(s.low, r.term)) AS n FROM said s CROSS JOIN {words} GROUP BY ALL),
        best AS (SELECT id, frame, row_number() OVER (PARTITION BY id ORDER BY n DESC, place) AS rn FROM n), f AS (SELECT frame FROM best WHERE rn = 1)
        SELECT frame, count(*) AS articles, cast(floor(100.0 * count(*) / (SELECT count(*) FROM f) + 0.5) AS bigint) AS percent FROM f GROUP BY frame""")


def taxonomy(d: Spark) -> str:
    """Every event type of 0.45 or more with its score and rank. A pattern counts 2 in the title, else 1 in the text; discussions and warnings are told
    from launches by their titles, and compatible types are raised."""
    types = list(V.TAXONOMY)
    launches = ("PRODUCT_LAUNCH", "PRODUCT_RELEASE", "MODEL_RELEASE")
    num = lambda x: f"cast({x} AS double)"
    if d.name == "spark":
        hit = lambda c, p: d.rlike(c, f"(?i)(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])")
        cols = []
        for t, ps in V.TAXONOMY.items():
            cols.append(f"{' + '.join(f'CASE WHEN {hit("title", p)} THEN 2 WHEN {hit("full_text", p)} THEN 1 ELSE 0 END' for p in ps)} AS n_{t}")
            cols.append(f"{' OR '.join(hit('title', p) for p in ps)} AS t_{t}")
        counted = f"SELECT id, full_text, {' OR '.join(hit('title', p) for p in V.DISCUSSION)} AS discussion, {', '.join(cols)} FROM said"
        base = lambda t: f"CASE WHEN n_{t} = 0 THEN {num(0)} ELSE least({num(0.98)}, CASE WHEN t_{t} THEN {num(0.65)} ELSE {num(0.40)} END + least({num(0.30)}, n_{t} * {num(0.10)})) END"
        scored = f"SELECT id, full_text, discussion, t_EXPERT_WARNING AS warning, {', '.join(f'{base(t)} AS {t}' for t in types)} FROM ({counted}) a"
    else:
        rules = "(VALUES " + ", ".join(f"({d.text(t)}, {d.text('(?i)' + chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')})" for t, ps in V.TAXONOMY.items() for p in ps) + ") AS r(type, pattern)"
        talk = " OR ".join(f"regexp_matches(title, {d.text('(?i)' + chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')})" for p in V.DISCUSSION)
        pivot = ", ".join(f"coalesce(max(s) FILTER (WHERE type = {d.text(t)}), 0) AS {t}" for t in types)
        scored = f"""SELECT id, any_value(full_text) AS full_text, any_value(discussion) AS discussion, bool_or(type = 'EXPERT_WARNING' AND titled) AS warning, {pivot} FROM (
            SELECT id, any_value(full_text) AS full_text, any_value(discussion) AS discussion, type, bool_or(in_title) AS titled,
                   CASE WHEN sum(n) > 0 THEN least(0.98::double, CASE WHEN bool_or(in_title) THEN 0.65::double ELSE 0.40::double END + least(0.30::double, sum(n) * 0.10::double)) ELSE 0 END AS s
            FROM (SELECT s.id, s.full_text, {talk} AS discussion, r.type, regexp_matches(s.title, r.pattern) AS in_title, CASE WHEN regexp_matches(s.title, r.pattern) THEN 2 WHEN regexp_matches(s.full_text, r.pattern) THEN 1 ELSE 0 END AS n FROM said s CROSS JOIN {rules}) h
            GROUP BY id, type) g GROUP BY id"""
    lowered = lambda t: f"CASE WHEN discussion THEN {num(0.25)} ELSE {num(1)} END * CASE WHEN warning THEN {num(0.20)} ELSE {num(1)} END * {t}"
    first = {t: t for t in types} | {t: lowered(t) for t in launches}
    first["ANALYSIS"] = f"CASE WHEN discussion THEN greatest(ANALYSIS, {num(0.75)}) ELSE ANALYSIS END"
    first["EXPERT_WARNING"] = f"CASE WHEN warning THEN greatest(EXPERT_WARNING, {num(0.85)}) ELSE EXPERT_WARNING END"
    second = {t: t for t in types}
    second["PRODUCT_RELEASE"] = f"CASE WHEN MODEL_RELEASE >= {num(0.65)} THEN greatest(PRODUCT_RELEASE, MODEL_RELEASE * {num(0.90)}) ELSE PRODUCT_RELEASE END"
    second["PRODUCT_LAUNCH"] = f"CASE WHEN MODEL_RELEASE >= {num(0.65)} AND NOT discussion AND NOT warning THEN greatest(PRODUCT_LAUNCH, MODEL_RELEASE * {num(0.85)}) ELSE PRODUCT_LAUNCH END"
    second["RESEARCH_FINDING"] = f"CASE WHEN SCIENTIFIC_DISCOVERY >= {num(0.70)} THEN greatest(RESEARCH_FINDING, SCIENTIFIC_DISCOVERY * {num(0.95)}) ELSE RESEARCH_FINDING END"
    second["REGULATION"] = f"CASE WHEN LAW >= {num(0.70)} THEN greatest(REGULATION, LAW * {num(0.80)}) ELSE REGULATION END"
    second["POLICY"] = f"CASE WHEN LAW >= {num(0.70)} THEN greatest(POLICY, LAW * {num(0.75)}) ELSE POLICY END"
    layer = lambda cols, rest, table, name: f"SELECT id, full_text{rest}, {', '.join(f'{x} AS {t}' for t, x in cols.items())} FROM ({table}) {name}"
    done = layer(second, "", layer(first, ", discussion, warning", scored, "b"), "c")
    if d.name == "spark":
        pairs = ", ".join(f"struct(round({t}, 6) AS score, {i} AS place, {d.text(t)} AS label)" for i, t in enumerate(types))
        none = "struct(CASE WHEN full_text = '' THEN cast(1 AS double) ELSE cast(0.6 AS double) END AS score, 99 AS place, 'OTHER' AS label)"
        found = f"SELECT id, full_text, filter(array({pairs}), x -> x.score >= 0.45) AS xs FROM ({done}) e"
        return with_tables(d, ["articles"], _lines(d) + f" SELECT id, x.label AS label, x.score AS score, row_number() OVER (PARTITION BY id ORDER BY x.score DESC, x.place) AS rn FROM (SELECT id, explode(CASE WHEN size(xs) = 0 THEN array({none}) ELSE xs END) AS x FROM ({found}) f) g")
    flat = " UNION ALL ".join(f"SELECT id, round({t}, 6) AS score, {i} AS place, {d.text(t)} AS label FROM done" for i, t in enumerate(types))
    return with_tables(d, ["articles"], _lines(d) + f""", done AS ({done}), hits AS (SELECT * FROM ({flat}) f WHERE score >= 0.45),
        every AS (SELECT id, score, place, label FROM hits UNION ALL SELECT id, CASE WHEN full_text = '' THEN 1.0 ELSE 0.6 END, 99, 'OTHER' FROM done WHERE id NOT IN (SELECT id FROM hits))
        SELECT id, label, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS rn FROM every""")


QUERIES = [news_category, recategorised, news_severity, news_frames, taxonomy]
