"""Personal data: patterns for protected entities, and terms that the corpus shows to disclose them.

Sanitisation by information content: the corpus tells how many documents hold an entity e, a term t, and both. Of the
information that e carries, IC(e) = -log p(e), the term gives away PMI(t; e) = log p(e | t) - log p(e). A term whose share
PMI / IC reaches REMOVE for some entity is removed wherever it stands, one that reaches GENERALISE is replaced by a general word.

What a few documents show may be chance: every word of a single text stands beside its entities. So the texts that hold both must
give evidence, PMI nats each, that exceeds what the best of all pairs looked at would give by chance (at ERROR).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, broadcast_if, read_table

KINDS = ("email", "ip", "card", "phone", "term")
#: The contract's patterns. Possessive repeats and the look-behinds change no match: nothing that they hold on to could be given
#: back, and a match could only start inside a run of such characters after another match. They keep long runs linear.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
LETTER = r"[\p{L}\p{M}\p{N}]"
WORD = f"{LETTER}+"
#: Chance that any pair of term and entity at all is taken for disclosing without being so.
ERROR = 0.01
REMOVE, GENERALISE = 0.98, 0.9
#: Rows up to which a table of entities, terms or hits is broadcast; beyond it the join is shuffled.
MOST_BROADCAST = 100_000
#: What stands for a span of each kind, then for a general term by its form (numbers, mixed letters and digits, capitalised, other), then for a removed one.
TAGS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<NUMBER>", "<CODE>", "<NAME>", "<WORD>", "")

_FOUND = "array<struct<s:int,e:int,v:string>>"
_SPANS = "array<struct<kind:int,s:int,e:int,v:string>>"


def matches(text: Column, pattern: str | Column, kind: int = 0) -> Column:
    """Leftmost non-overlapping matches as (s, e, v) in code points: their places add up from what split() leaves between them.
    Only those valid for the kind are appended, as each append copies the array."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, 0)
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["v"])
        grown = F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"))))
        return F.struct(e.alias("at"), (F.when(_valid(kind, x["v"]), grown).otherwise(acc["out"]) if kind else grown).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))
    zipped = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
    whole = F.aggregate(F.filter(zipped, lambda x: x["v"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, whole).otherwise(F.array().cast(_FOUND))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    digits = F.split(F.reverse(_digits(v)), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def _valid(kind: int, v: Column) -> Column:
    if kind == 1:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(v))
    if kind == 2:
        return F.when(n.between(13, 19), _luhn(v)).otherwise(False)
    return n.between(9, 15)


def base_spans(text: Column) -> Column:
    """array of (kind, s, e, v), by kind and start."""
    parts = []
    for kind, pattern in enumerate(PATTERNS):
        parts.append(_with_kind(matches(text, pattern, kind), kind))
    return F.concat(*parts)


def _with_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))).cast(_SPANS)


_CUTS = "array<struct<s:int,e:int,tag:int>>"


def _merged(cuts: Column) -> Column:
    """Cuts (s, e, tag) by place; those that overlap become one, with the tag of the first."""

    def joined(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["tag"].alias("tag"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] > x["s"]), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(cuts), F.array().cast(_CUTS), joined)


def _tagged(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("tag"))).cast(_CUTS)


def _replaced(text: Column, cuts: str, by: Callable[[Column], Column]) -> Column:
    """text with each cut x replaced by by(x)."""
    before = lambda i: F.coalesce(F.get(cuts, i - 1)["e"], F.lit(0))
    parts = F.transform(cuts, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["s"] - before(i)), by(x)))
    end = F.get(cuts, F.size(cuts) - 1)["e"]
    return F.when(F.size(cuts) > 0, F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text)))).otherwise(text)


def _with_blanks(df: DataFrame) -> DataFrame:
    """df with _nl_blank: the text with a blank for each code point of a span, so that places stay."""
    out = df.withColumn("_nl_cuts", _merged(_tagged(F.col("_nl_spans"))))
    return out.withColumn("_nl_blank", _replaced(F.coalesce("text", F.lit("")), "_nl_cuts", lambda x: F.repeat(F.lit(" "), x["e"] - x["s"]))).drop("_nl_cuts")


def find_entities(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Every row of docs with a number _nl_row, its base spans _nl_spans and its different words outside them, _nl_words."""
    out = docs.withColumn("_nl_row", F.monotonically_increasing_id()).withColumn("_nl_spans", base_spans(F.coalesce("text", F.lit(""))))
    out = _with_blanks(out).withColumn("_nl_words", F.array_distinct(F.regexp_extract_all("_nl_blank", F.lit(WORD), 0))).drop("_nl_blank")
    return scratch.keep(out, "rows")


def _lowered(ws: str) -> Column:
    return F.array_distinct(F.transform(ws, lambda w: F.lower(w)))


def disclosing_terms(rows: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(term, remove): the terms to sanitise; None if there are none. All counts cover the whole corpus and whole documents:
    documents by entity, by term and by both over all rows, and different texts that hold both. A text gives log(rows) nats of
    evidence at most, so pairs in fewer than `least` texts can be left out before anything is joined."""
    key = F.concat_ws(":", F.xxhash64("text").cast("string"), F.xxhash64(F.lit(1), "text").cast("string"))
    entities = F.array_distinct(F.transform("_nl_spans", lambda x: F.xxhash64(x["kind"], F.lower(x["v"]))))
    texts = rows.where(F.size("_nl_spans") > 0).select(key.alias("key"), entities.alias("entities"), _lowered("_nl_words").alias("words"))
    texts = scratch.keep(texts.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words")), "texts")
    n_rows, looked = rows.count(), texts.agg(F.sum(F.size("entities").cast("double") * F.size("words"))).first()[0]
    if n_rows < 2 or not looked:
        return None
    needed = math.log(looked / ERROR)
    least = max(1, math.ceil(needed / math.log(n_rows)))
    of_text = texts.select("key", "copies", F.explode("entities").alias("entity"))
    common = of_text.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("by_entity")).where(F.col("texts") >= least)
    common = scratch.keep(common.select("entity", "by_entity"), "common")
    n_common = common.count()
    if not n_common:
        return None
    few = broadcast_if(common, n_common, MOST_BROADCAST)
    held = texts.select("key", "copies", "words").join(of_text.join(few, "entity", "left_semi").select("key", "entity"), "key")
    pairs = held.select("entity", "copies", F.explode("words").alias("term")).groupBy("term", "entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("both"))
    pairs = pairs.where(F.col("texts") >= least).join(few, "entity")
    beside = texts.select("copies", F.explode("words").alias("term")).groupBy("term").agg(F.sum("copies").alias("beside"))
    pairs = pairs.join(beside, "term")
    content = -F.log(F.col("by_entity") / n_rows)
    share = lambda by_term: F.when(content > 0, 1 + F.log(F.least(F.lit(1.0), F.col("both") / F.col(by_term))) / content).otherwise(0.0)
    # A term is in at least as many documents as it is with any entity in, so the share can be bounded before the corpus is counted.
    discloses = lambda by_term: (share(by_term) >= GENERALISE) & (F.col("texts") * content * share(by_term) >= needed)
    pairs = scratch.keep(pairs.where(discloses("beside")), "pairs")
    terms = scratch.keep(pairs.select("term").distinct(), "terms")
    n_terms = terms.count()
    if not n_terms:
        return None
    words = rows.select(F.explode(_lowered("_nl_words")).alias("term"))
    by_term = words.join(broadcast_if(terms, n_terms, MOST_BROADCAST), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("by_term"))
    found = pairs.join(by_term, "term").where(discloses("by_term")).withColumn("share", share("by_term"))
    found = scratch.keep(found.groupBy("term").agg((F.max("share") >= REMOVE).alias("remove")), "disclosing")
    return found if found.limit(1).count() else None


_TERMS = "array<struct<s:int,e:int,remove:boolean,form:int>>"


def _form(v: Column) -> Column:
    return F.when(v.rlike("^[0-9]+$"), 0).when(v.rlike("[0-9]"), 1).when(v.rlike(r"^\p{Lu}"), 2).otherwise(3)


def _with_terms(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with _nl_terms: the places (s, e, remove) of every disclosing term outside the base spans, whatever else the row holds.

    The words of all rows are joined with the terms; a row's hits, as they are written there, make up a pattern that finds them."""
    found = disclosing_terms(rows, scratch)
    if found is None:
        return rows.withColumn("_nl_terms", F.array().cast(_TERMS))
    words = rows.select("_nl_row", F.explode("_nl_words").alias("w"))
    hits = words.join(broadcast_if(found, found.count(), MOST_BROADCAST), F.lower("w") == F.col("term"))
    hits = hits.groupBy("_nl_row").agg(*[F.array_sort(F.collect_list(F.when(F.col("remove") == r, F.col("w")))).alias(c) for c, r in (("_nl_gone", True), ("_nl_general", False))])
    hits = scratch.keep(hits, "hits")
    n = hits.agg(F.sum(F.size("_nl_gone") + F.size("_nl_general"))).first()[0] or 0
    out = _with_blanks(rows.join(broadcast_if(hits, n, MOST_BROADCAST), "_nl_row", "left"))
    for c, remove in (("_nl_gone", F.lit(True)), ("_nl_general", F.lit(False))):
        pattern = F.concat(F.lit(f"(?<!{LETTER})(?:"), F.array_join(c, "|"), F.lit(f")(?!{LETTER})"))
        places = F.transform(matches(F.col("_nl_blank"), pattern), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), remove.alias("remove"), _form(x["v"]).alias("form")))  # noqa: B023
        out = out.withColumn(c, F.when(F.size(c) > 0, places.cast(_TERMS)).otherwise(F.array().cast(_TERMS)))
    return out.withColumn("_nl_terms", F.array_sort(F.concat("_nl_gone", "_nl_general"))).drop("_nl_gone", "_nl_general", "_nl_blank")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, terms) of every row of docs: base spans (kind, s, e, v), and the places of disclosing terms (s, e, remove).

    Null and empty texts have none. Repeated rows have equal results and count as documents each, but as one text for evidence.
    Very long texts are searched whole. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    out = _with_terms(find_entities(docs.select("doc_id", "text"), scratch), scratch)
    return out.select("doc_id", F.col("_nl_spans").alias("spans"), F.col("_nl_terms").alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with base spans replaced by their kinds, and every disclosing term by a general word for its form or nothing. Columns and
    row count are those of docs; texts without either stay as they are. Nulls, empty and repeated rows as in find_personal_data();
    other columns are carried, but names with the prefix _nl_ are reserved."""
    scratch = Scratch(docs.sparkSession, "pii")
    out = _with_terms(find_entities(docs, scratch), scratch)
    terms = F.transform("_nl_terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["remove"], len(TAGS) - 1).otherwise(4 + x["form"]).alias("tag"))).cast(_CUTS)
    tags = F.array(*map(F.lit, TAGS))
    out = out.withColumn("_nl_cuts", _merged(F.concat(_tagged(F.col("_nl_spans")), terms)))
    out = out.withColumn("_nl_out", _replaced(F.col("text"), "_nl_cuts", lambda x: F.get(tags, x["tag"])))
    return out.select(*[F.col("_nl_out").alias(c) if c == "text" else out[c] for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans of every row of documents."""
    out = find_personal_data(read_table(spark, sf_dir, "documents"))
    base = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    terms = F.transform("terms", lambda x: F.struct(F.lit(4).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(base, terms)).alias("spans"))


def _of_kind(kind: int) -> Column:
    return F.filter("spans", lambda x: x["kind"] == kind)
