"""The queries of the training-data operators by name, and DuckDB SQL for what SQL can express of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, classifier, fingerprints, licenses, mixing, neardup, pii, quality, sentencepiece_bpe, spelling, toxicity, warc, whitening


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_quality that its base rules alone decide."""
    return quality.op2_quality(spark, sf_dir).drop("kept", "llr")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_licenses that its base phrases alone decide."""
    return licenses.op3_licenses(spark, sf_dir).drop("labels", "score")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_fingerprints that tell the texts compared."""
    return fingerprints.op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of base spans of op8_pii."""
    return pii.op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op9_mixing."""
    return mixing.op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op12_whitening."""
    return whitening.op12_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def queries() -> dict:
    found = [bpe.op1_bpe, quality.op2_quality, licenses.op3_licenses, fingerprints.op4_fingerprints, neardup.op5_neardup, warc.op6_warc, classifier.op7_classifier, pii.op8_pii, mixing.op9_mixing, toxicity.op10_toxicity]
    found += [sentencepiece_bpe.op11_sentencepiece, whitening.op12_whitening, spelling.op13_spelling]
    return {f.__name__: f for f in [*found, quality_base, license_base, fingerprint_edits, pii_base, mixing_targets, whitening_base]}


_SPACE_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACE_WORDS.format("text")} AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM d WHERE len(ws) >= 5),
named AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS win FROM windows),
twice AS (SELECT doc_id, win FROM named GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT n.doc_id, unnest(range(n.i, n.i + 5)) AS p FROM named n JOIN twice t ON t.doc_id = n.doc_id AND t.win = n.win) x GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
SELECT d.doc_id, len(d.ws) AS n_words, cast(length(array_to_string(d.ws, '')) AS bigint) AS word_chars, cast(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
       len(l.ls) - len(list_distinct(l.ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(d.ws) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(d.ws) AS base_failed
FROM d JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN covered c ON c.doc_id = d.doc_id"""

_LICENSES = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS w, unnest(ws[2:] || ['']) AS w2, unnest(ws[3:] || ['', '']) AS w3 FROM d),
p AS (SELECT doc_id, i, 'cc-by' AS label FROM w WHERE w = 'cc' AND w2 = 'by' UNION ALL SELECT doc_id, i, 'gpl' FROM w WHERE w = 'general' AND w2 = 'public' AND w3 = 'license'
      UNION ALL SELECT doc_id, i, 'reserved' FROM w WHERE w = 'all' AND w2 = 'rights' AND w3 = 'reserved')
SELECT d.doc_id, len(any_value(d.ws)) AS n_words, count(p.i) AS n_base, min(p.i) AS first_word, max(p.i) AS last_word, coalesce(array_to_string(list_sort(list_distinct(list(p.label) FILTER (WHERE p.label IS NOT NULL))), ','), '') AS base_labels
FROM d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id"""

_EDITS = """
SELECT doc_id, cast(length(t) AS bigint) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(after, length(t) // 2)) AS edited_sha256 FROM (
SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) x) y"""

_NEARDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACE_WORDS.format(_LOWER.format("text"))} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w) x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT p.x, p.y FROM pairs p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * p.c >= 80 * (a.n + b.n - p.c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.y FROM reached r JOIN links l ON l.x = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) m ON m.a = w.doc_id"""

_WARC = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM (SELECT page_id, cast(strlen(coalesce(html, '')) AS bigint) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages) x) y"""

_PII = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ips,
             list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS cards, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones FROM d)
SELECT doc_id, len(emails) AS n_email, len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: try_cast(p AS hugeint))) <= 255)) AS n_ip,
       len(list_filter(cards, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN cast(x[i] AS int) WHEN cast(x[i] AS int) > 4 THEN 2 * cast(x[i] AS int) - 9 ELSE 2 * cast(x[i] AS int) END)) % 10 = 0)) AS n_card,
       len(list_filter(phones, lambda x: length(x) BETWEEN 9 AND 15)) AS n_phone FROM f"""

_TARGETS = rf"""
WITH d AS (SELECT doc_id, source, len({_SPACE_WORDS.format("text")}) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source), n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
weighed AS (SELECT source, cast(source_size AS bigint) AS source_size, [5.0, 2.0, 1.0][(k - 1) % 3 + 1]::double AS weight FROM n),
levels AS (SELECT DISTINCT 3.0::double * source_size / weight AS at FROM weighed WHERE source_size > 0),
filled AS (SELECT l.at, sum(least(3.0::double * w.source_size, l.at * w.weight)) AS taken FROM levels l CROSS JOIN weighed w GROUP BY l.at),
total AS (SELECT sum(source_size)::double AS total FROM weighed),
below AS (SELECT coalesce(max(f.at), 0.0) AS at FROM filled f, total t WHERE f.taken <= t.total),
level AS (SELECT (t.total - coalesce(sum(3.0::double * w.source_size) FILTER (WHERE 3.0::double * w.source_size / w.weight <= b.at), 0)) / nullif(sum(w.weight) FILTER (WHERE 3.0::double * w.source_size / w.weight > b.at), 0) AS water
          FROM weighed w, total t, below b GROUP BY t.total)
SELECT d.doc_id, d.size, w.source_size, round(least(3.0::double * w.source_size, coalesce(v.water, 1e300) * w.weight), 4) AS target FROM d JOIN weighed w ON w.source IS NOT DISTINCT FROM d.source CROSS JOIN level v"""


_WHITENING = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: cast(floor(1024 * cast(c AS double)) AS bigint) + 100000) AS x FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
e AS (SELECT unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM x), s AS (SELECT i, sum(v) AS s, count(*) AS n FROM e GROUP BY i), t AS (SELECT list(s ORDER BY i) AS s, any_value(n) AS n FROM s)
SELECT vec_id, cast(unnest(range(1, least(8, len(x)) + 1)) AS int) AS component, n, cast(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) AS bigint) AS deviation FROM x, t"""


def _nibbles(poly: int = 0xEDB88320) -> list[int]:
    """What four zero bits make of each of the 16 last nibbles of a reflected CRC."""
    out = list(range(16))
    for _ in range(4):
        out = [c >> 1 ^ (poly if c & 1 else 0) for c in out]
    return out


_BEYOND, _ASCII = "".join(map(chr, range(0xC0, 0x100))), "".join(chr(c) for c in range(33, 127) if not 97 <= c <= 122 and c not in (39, 92))
_SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT coalesce(cast(doc_id AS varchar), '') AS id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT id, run, count(*) AS c, hex(id || ':' || run) AS hx FROM runs GROUP BY id, run),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_transform(flatten(list_transform(range(1, len(hx) // 2 + 1), lambda k: [hx[2 * k], hx[2 * k - 1]])), lambda h: cast(strpos('123456789ABCDEF', h) AS bigint)),
           lambda crc, b: xor(crc >> 4, {_nibbles()}[(xor(crc, b) & 15) + 1]), 4294967295)) AS h FROM own),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, cast(sum(c) AS bigint) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
variants AS (SELECT DISTINCT word, n, translate(word, '{_BEYOND}', '{_ASCII[:64].replace("'", "''")}') AS plain, unnest(list_transform(range(0, length(word) + 1), lambda i: CASE WHEN i = 0 THEN word ELSE left(word, i - 1) || substr(word, i + 1) END)) AS v FROM words),
near AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM variants a JOIN variants b ON a.v = b.v AND a.word <> b.word WHERE levenshtein(a.plain, b.plain) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
found AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
led AS (SELECT word, word AS at, form AS next FROM found UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN found f ON f.word = l.next)
SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n FROM found f JOIN led l ON l.word = f.word AND l.next IS NULL"""


def oracle_sql() -> dict[str, str]:
    """What no SQL can express is tested against brute force: ids of BPE and of pieces, ratios, licence labels, fingerprints, disclosing terms, draws,
    models, eigenvectors."""
    return {"op5_neardup": _NEARDUP, "op6_warc": _WARC, "quality_base": _QUALITY, "license_base": _LICENSES, "fingerprint_edits": _EDITS, "pii_base": _PII, "mixing_targets": _TARGETS, "whitening_base": _WHITENING, "op13_spelling": _SPELLING}
