"""The report of every event: each section is gathered by event, capped in its own order, and all are joined to one nested row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark
from newsloom.operators import intelligence as I
from newsloom.operators import verification
from newsloom.operators.text import hierarchy_sql

#: Rows of a section at most: coverage, claims of a verdict, names of a kind, milestones, related events (parameters); claims in the picture,
#: summaries in the account and latest related events (fixed values).
COVERAGE, CLAIMS, NAMES, MILESTONES, RELATED, PICTURE, SUMMARIES, LATEST = 20, 20, 20, 20, 8, 4, 3, 4
#: Stages of a causal chain, and those that words of claims fill, in the order of the rules (fixed values).
STAGES = ["preconditions", "trigger", "mechanism", "chain_reaction", "amplifiers", "immediate_consequences", "human_response", "secondary_effects", "current_state"]
STAGE_WORDS = {"trigger": ["cause", "trigger", "began"], "immediate_consequences": ["result", "damage", "kill", "flood"]}
#: What a forecast adds up, by the names of its drivers (fixed values).
DRIVERS = ["Dispatch Velocity", "Source Breadth", "Average Source Reliability", "Category Historical Hazard", "Reporting Contradictions", "Entity Salience"]


@dataclass(frozen=True)
class News:
    """events (event_id, title, summary, category, severity, status, country, source_count, article_count, first_reported_at, last_updated_at),
    articles (event_id, article_id, title, summary, published_at, outlet, kind, url, reliability), claims (event_id, claim_id,
    claim_text, status, extracted_at, causal), named (event_id, name, type)."""

    events: DataFrame
    articles: DataFrame
    claims: DataFrame
    named: DataFrame


def _capped(df: DataFrame, order: list, k: int, *by: str) -> DataFrame:
    """The first k rows of each event (and of `by`); Spark cuts partitions to k rows a group before the shuffle."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy("event_id", *by).orderBy(*order))).where(F.col("i") <= k)


def _listed(df: DataFrame, name: str, value: Column, place: str = "i") -> DataFrame:
    """(event_id, name): the values of an event as an array by their place."""
    xs = df.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("i"), value.alias("v")))).alias("xs"))
    return xs.select("event_id", F.transform("xs", lambda x: x["v"]).alias(name))


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def drivers(category: Column, articles: Column, sources: Column, reliability: Column, contradicted: Column, names: Column) -> Column:
    """The contributions to a forecast's logit, by name, rounded to cents."""
    hazard = F.coalesce(F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in V.HAZARDS.items()]), lambda h: h["k"] == F.lower(category)), F.lit(0))["v"], F.lit(V.HAZARD_OTHER))
    parts = [I.VELOCITY * F.log1p(articles), I.BREADTH * F.least(F.lit(1.0), sources / 6.0), I.RELIABILITY * reliability, I.HAZARD * hazard, I.CONTRADICTION * contradicted.cast("double"), I.ENTITIES * F.least(F.lit(1.0), F.greatest(names, F.lit(1)) / 10.0)]
    return F.array(*[F.struct(F.lit(n).alias("driver"), p.cast("double").alias("exact")) for n, p in zip(DRIVERS, parts, strict=True)])


def _frames(articles: DataFrame, frames: dict[str, list[str]]) -> DataFrame:
    """(event_id, framing, observation): articles by the frame with most of its words, the first on a tie, with whole percents."""
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    counts = [sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in ws), F.lit(0)) for ws in frames.values()]
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i")) for i, n in enumerate(counts)]))
    per = articles.select("event_id", (-best["i"]).alias("frame")).groupBy("event_id", "frame").count()
    total = per.groupBy("event_id").agg(F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("frame", "count"))).alias("xs"))
    names = F.array(*map(F.lit, frames))
    shown = F.transform("xs", lambda x: F.struct(F.element_at(names, x["frame"] + 1).alias("category"), x["count"].alias("articles"), F.floor(100.0 * x["count"] / F.col("total") + 0.5).alias("percent")))
    df = total.withColumn("framing", shown)
    top = F.array_sort("framing", lambda a, b: F.when(a["articles"] > b["articles"], -1).when(a["articles"] < b["articles"], 1).otherwise(0))
    df = df.withColumn("top", top)
    say = lambda k: F.lower(F.get("top", F.lit(k))["category"])
    share = lambda k: F.concat(F.get("top", F.lit(k))["percent"].cast("string"), F.lit("% "))
    told = F.when(F.size("top") > 1, F.concat(share(0), say(0), F.lit("; "), share(1), say(1))).otherwise(say(0))
    return df.select("event_id", "framing", told.alias("observation"))


def assemble(news: News, keep: Callable[[DataFrame, str], DataFrame], timeline: DataFrame, stage_words: dict[str, list[str]] = STAGE_WORDS, frames: dict[str, list[str]] = V.FRAMES, wires: dict[str, str] = V.WIRES) -> DataFrame:
    """(event_id, confirmed, uncertain, probability, driver, gaps, report) of every event; report is the whole as JSON, without null fields.

    timeline: (event_id, id, i, phase). Counts are of all articles, sections hold their first rows. An event without articles,
    claims or names has empty sections; claims are judged by all reports of their event, as independent clusters.
    """
    events, articles = keep(news.events, "events"), keep(news.articles.where("article_id IS NOT NULL"), "articles")
    newest = [F.desc("published_at"), F.col("article_id")]
    level = F.expr(hierarchy_sql(Spark(), "coalesce(outlet, '')", "coalesce(kind, '')", "coalesce(url, '')"))
    covered = keep(_capped(articles, newest, COVERAGE), "covered")
    item = F.struct(
        F.col("article_id").alias("id"), F.coalesce("outlet", F.lit("News Wire")).alias("source"), level.alias("level"), F.floor(F.col("reliability") * 100 + 0.5).alias("reliability"),
        F.coalesce("title", F.lit("")).alias("title"), _time("published_at").alias("published_at"),
    )
    coverage = _listed(covered, "coverage", item)
    told = _listed(covered.where(F.col("i") <= SUMMARIES), "told", F.coalesce("summary", F.lit("")))
    counts = articles.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_articles"), F.count_distinct("outlet").alias("n_sources"), F.coalesce(F.avg("reliability"), F.lit(0.55)).alias("mean_reliability"))

    judged = verification.verify(events.select(F.col("event_id").alias("claim_id")), articles.withColumnRenamed("event_id", "claim_id"), articles.limit(0).withColumnRenamed("event_id", "claim_id"), keep, wires)
    verdicts = judged.select(F.col("claim_id").alias("event_id"), F.col("status").alias("verdict"), "independent_sources")
    latest = [F.desc("extracted_at"), F.col("claim_id")]
    claims = keep(news.claims, "claims")
    shown = _listed(_capped(claims, latest, CLAIMS), "claims", F.struct(F.col("claim_id").alias("id"), F.col("claim_text").alias("text")))
    picture = _listed(_capped(claims.where("status = 'VERIFIED'"), latest, PICTURE), "picture", F.col("claim_text"))
    why = _listed(_capped(claims.where("causal"), latest, CLAIMS), "why", F.col("claim_text"))
    says = lambda ws: F.greatest(*[F.contains(F.lower("claim_text"), F.lit(w)) for w in ws], F.lit(False))
    stage = F.coalesce(*[F.when(says(ws), F.lit(s)) for s, ws in stage_words.items()])
    filled = _capped(claims.where("causal").withColumn("stage", stage).where("stage IS NOT NULL"), latest, 1, "stage")
    chain = filled.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "claim_id"))).alias("chain"))
    denied = claims.groupBy("event_id").agg(F.bool_or(F.col("status") == "CONTRADICTED").alias("contradicted"))

    named = news.named.distinct()
    kinds = _capped(named, ["name"], NAMES, "type")
    people, groups = (_listed(kinds.where(F.col("type") == t), n, F.col("name")) for t, n in (("person", "people"), ("organization", "organizations")))
    n_names = named.groupBy("event_id").agg(F.count_distinct("name").alias("n_names"))
    marks = _listed(timeline.where(F.col("i") <= MILESTONES), "timeline", F.struct("id", "phase"))

    # the latest of the category or country, then events that share a name
    light = events.select("event_id", "category", "country", "last_updated_at", "title")
    near = []
    for c in ("category", "country"):
        first = light.where(F.col(c).isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy(c).orderBy(F.desc("last_updated_at"), "event_id"))).where(F.col("k") <= LATEST + 1)
        near.append(light.select("event_id", c).join(first.select(c, F.col("event_id").alias("other"), "last_updated_at"), c).where("event_id <> other").select("event_id", "other", "last_updated_at"))
    same = _capped(near[0].union(near[1]).distinct(), [F.desc("last_updated_at"), F.col("other")], LATEST).select("event_id", "other", F.lit(0).alias("kind"), "i")
    holders = named.select("name", F.col("event_id").alias("other")).distinct().withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("other"))).where(F.col("k") <= RELATED + 1).drop("k")
    sharing = _capped(named.select("event_id", "name").join(holders, "name").where("event_id <> other").select("event_id", "other").distinct(), ["other"], RELATED).select("event_id", "other", F.lit(1).alias("kind"), "i")
    related = same.union(sharing).groupBy("event_id", "other").agg(F.min(F.struct("kind", "i")).alias("at"))
    related = _capped(related, ["at", "other"], RELATED).join(light.select(F.col("event_id").alias("other"), "title"), "other")
    related = _listed(related, "related", F.struct(F.col("other").alias("id"), F.coalesce("title", F.lit("")).alias("title")))

    df = events
    for part in (coverage, told, counts, verdicts, shown, picture, why, chain, denied, people, groups, n_names, marks, _frames(articles, frames), related):
        df = df.join(part, "event_id", "left")
    return _report(df)


def _report(df: DataFrame) -> DataFrame:
    none = lambda c, kind="array<string>": F.coalesce(c, F.array().cast(kind))
    n_articles, n_sources = F.greatest("article_count", F.coalesce("n_articles", F.lit(0))), F.greatest("source_count", F.coalesce("n_sources", F.lit(0)))
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("coverage", "claims", "timeline", "framing", "related")}
    df = df.withColumn("summary", F.coalesce("summary", F.lit(""))).withColumn("n_articles", n_articles.cast("long")).withColumn("n_sources", n_sources.cast("long"))
    df = df.withColumn("parts", drivers(F.col("category"), F.col("n_articles"), F.col("n_sources"), F.coalesce("mean_reliability", F.lit(0.55)), F.coalesce("contradicted", F.lit(False)), F.coalesce("n_names", F.lit(0))))
    z = F.aggregate("parts", F.lit(I.BIAS), lambda a, p: a + p["exact"])
    enough = (F.col("n_articles") >= 2) & (F.col("n_sources") >= 1)
    df = df.withColumn("probability", F.when(enough, F.round(1.0 / (1.0 + F.exp(-z)), 3)))
    p, size = F.col("probability"), F.greatest(F.lit(10), 5 * F.col("n_articles") + 10 * F.col("n_sources"))
    spread = 1.96 * F.sqrt(p * (1 - p) / size)
    # the largest contribution, to cents; the earlier on a tie
    best = F.array_max(F.transform("parts", lambda x, i: F.struct(F.round(x["exact"], 2).alias("share"), (-i).alias("at"), x["driver"].alias("driver"))))
    df = df.withColumn("best", F.when(enough, best))
    verified = F.col("verdict") == "VERIFIED"
    claims = none("claims", kinds["claims"])
    status = lambda s: F.when(F.map_contains_key(F.coalesce("chain", F.create_map().cast("map<string,bigint>")), F.lit(s)), "SUPPORTED").otherwise("MISSING_EVIDENCE")
    df = df.withColumn("causal", F.array(*[F.struct(F.lit(s).alias("stage"), status(s).alias("status"), F.col("chain")[s].alias("claim")) for s in STAGES]))
    supported = F.filter("causal", lambda s: s["status"] == "SUPPORTED")
    chained = F.when(F.size(supported) > 0, F.array_join(F.transform(supported, lambda s: F.concat(s["stage"], F.lit(":"), s["claim"].cast("string"))), ";"))
    gaps = F.transform(F.filter("causal", lambda s: s["status"] != "SUPPORTED"), lambda s: s["stage"])
    account = F.array_distinct(F.filter(F.concat(F.array("summary"), none("told")), lambda x: x != ""))
    df = df.withColumn("confirmed", F.when(verified, claims).otherwise(F.slice(claims, 1, 0))).withColumn("uncertain", F.when(verified, F.slice(claims, 1, 0)).otherwise(claims)).withColumn("gaps", gaps)
    forecast = F.when(enough, F.struct("probability", F.round(F.greatest(F.lit(0.01), p - spread), 3).alias("lower"), F.round(F.least(F.lit(0.99), p + spread), 3).alias("upper"), F.col("best.driver").alias("driver"), F.col("best.share").alias("share")))
    report = F.struct(
        F.col("title").alias("headline"),
        F.struct("n_sources", "n_articles", "category", "severity", "status", "country", _time("first_reported_at").alias("first_reported_at"), _time("last_updated_at").alias("last_updated_at")).alias("meta"),
        F.when(F.size(none("picture")) > 0, F.array_join("picture", " ")).when(F.col("summary") != "", F.col("summary")).otherwise(F.coalesce(F.get(none("told"), F.lit(0)), F.lit(""))).alias("verified_picture"),
        F.array_join(account, "\n\n").alias("what_happened"),
        F.when(F.size(none("why")) > 0, F.array_join("why", " ")).otherwise(chained).alias("why"),
        "confirmed", "uncertain", F.coalesce("independent_sources", F.lit(0)).alias("independent_sources"), "causal", "gaps", none("timeline", kinds["timeline"]).alias("timeline"),
        none("people").alias("people"), none("organizations").alias("organizations"), none("coverage", kinds["coverage"]).alias("coverage"), none("framing", kinds["framing"]).alias("framing"), F.coalesce("observation", F.lit("")).alias("observation"),
        none("related", kinds["related"]).alias("related"), forecast.alias("forecast"),
    )
    return df.select("event_id", F.size("confirmed").alias("confirmed"), F.size("uncertain").alias("uncertain"), "probability", F.col("best.driver").alias("driver"), F.array_join("gaps", ",").alias("gaps"), F.to_json(report).alias("report"))
