"""Queries that are written with the DataFrame API: streams and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Duck, Spark
from newsloom.operators import asking, clusters, intelligence, nearest, questions, reports, retrieval, syndication, training, verification
from newsloom.operators.text import dedupe_articles, dependence, syndication_oracle
from newsloom.plans import asking_sql, reports_sql, verification_sql
from newsloom.sources.adapters import AS_OF, first_label, with_tables
from newsloom.sources.tables import Scratch
from newsloom.streaming import clustering, ingest


def ingest_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of articles into the keyed store: the first of each content hash, by the key of the batch queries."""
    store = ingest.ArticleStore(spark, Scratch(spark, "ingest").root, "article_id bigint, title string, content string, url string")

    def prepared(batch: DataFrame) -> DataFrame:
        own = batch.sparkSession
        batch.createOrReplaceTempView("documents")
        own.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("pages")
        return own.sql(with_tables(Spark(), ["articles"], "SELECT a.article_id, a.title, a.content, p.url FROM articles a LEFT JOIN pages p ON p.page_id = a.article_id"))

    store.follow(_stream(spark, sf_dir, "documents"), prepared)
    return store.articles().select("content_hash", "article_id")


def train_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted logistic regression of the quality label on structure features; weights of the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select(
        F.col("quality").cast("double").alias("label"),
        F.log1p(F.length("text")).alias("size"),
        (F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.length("text"), F.lit(1))).alias("upper"),
        (F.regexp_count("text", F.lit("[#*$%&|<>]")) / F.greatest(F.length("text"), F.lit(1))).alias("symbols"),
    )
    weight = rows.agg(F.least(F.greatest(F.sum(1 - F.col("label")) / F.greatest(F.sum("label"), F.lit(1)), F.lit(1.0)), F.lit(8.0))).first()[0] or 1.0
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    names = ["size", "upper", "symbols"]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=30).fit(data)
    return spark.createDataFrame([(n, float(w)) for n, w in zip([*names, "intercept"], [*model.coefficients, model.intercept], strict=True)], "feature string, weight double")


def independent_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the two lanes' pool, the nearest first."""
    for t in ("documents", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    pool = retrieval.lane_pool(Spark())
    return clusters.independent_clusters(spark.sql(pool), V.FIXTURE_WIRES)


def syndication_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that depend on others, and on which."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    articles = spark.sql(with_tables(Spark(), ["articles", "sources"], dependence(Spark())))
    return syndication.syndication_pairs(articles, Scratch(spark, "syndication").keep)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of each vector whose id is divisible by 100; its oracle is `retrieval.cosine_topk`."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.nearest(vectors, vectors.where("vec_id % 100 = 0"), 3)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the user turns of all conversations ask; the news signals and some of the fixture's words."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    signals = {k: [*ts, *V.FIXTURE_SIGNALS.get(k, [])] for k, ts in V.INTENT_SIGNALS.items()}
    return questions.expand(turns, ["conv_id", "turn"], signals)


def expand_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, entities, hypotheses, keywords and expanded text of every user turn."""
    listed = lambda c, by: F.array_join(c, by).alias(c)
    return _turns(spark, sf_dir).select("conv_id", "turn", "temporal_intent", listed("tokens", " "), listed("entities", "|"), listed("hypotheses", "|"), listed("keywords", " "), "expanded")


def news_tables(spark: SparkSession, sf_dir: str) -> asking.Corpus:
    """The news tables over the fixture; an item's event type comes from its category."""
    for t in ("documents", "embeddings", "benchmark", "labels", "nation"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    d = Spark()
    sql = lambda names, body: spark.sql(with_tables(d, names, body))
    types = lambda c: f"array(CASE {c} {' '.join(f'WHEN {d.text(k)} THEN {d.text(v)}' for k, v in V.FIXTURE_TYPES.items())} ELSE 'OTHER' END) AS event_types"
    return asking.Corpus(
        articles=sql(["articles", "sources"], f"SELECT a.article_id, a.title, a.summary, a.content, a.published_at, s.name AS outlet, s.type AS kind, s.reliability, {types(first_label(d, 'lower(a.summary)', V.FIXTURE_CATEGORIES, 'other'))} FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id"),
        events=sql(["story_events"], f"SELECT event_id, title, lead AS summary, category, status, country, source_count, article_count, first_reported_at, last_updated_at, {types('category')} FROM story_events"),
        members=sql(["event_articles"], "SELECT event_id, article_id FROM event_articles"),
        named=sql(["entities", "event_articles"], "SELECT DISTINCT e.name, ea.event_id FROM entities e JOIN event_articles ea ON ea.article_id = e.article_id"),
        claims=sql(["claims"], "SELECT claim_id, event_id, claim_text FROM claims"),
        as_of=AS_OF,
    )


def ask_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dossier of every user turn; conversations take the three modes in turn."""
    mode = F.element_at(questions.strings(["ask", "fact_check", "research"]), (F.col("conv_id") % 3 + 1).cast("int"))
    return asking.dossiers(_turns(spark, sf_dir).withColumn("mode", mode), ["conv_id", "turn"], news_tables(spark, sf_dir), Scratch(spark, "asking").keep)


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    where, name = ingest.folder_of(spark, f"{sf_dir}/{table}.parquet")
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).option("pathGlobFilter", name).parquet(where)


def _clustered(spark: SparkSession, sf_dir: str) -> clustering.EventStore:
    """The articles of all documents as a stream of one run; half of them have vectors."""
    store, d = clustering.EventStore(spark, Scratch(spark, "clustering").root), Spark()
    types = f"CASE category {' '.join(f'WHEN {d.text(k)} THEN {d.text(v)}' for k, v in V.FIXTURE_TYPES.items())} ELSE 'OTHER' END"

    def prepared(batch: DataFrame) -> DataFrame:
        own = batch.sparkSession
        batch.createOrReplaceTempView("documents")
        own.read.parquet(f"{sf_dir}/embeddings.parquet").createOrReplaceTempView("embeddings")
        return own.sql(with_tables(d, ["articles", "sources"], f"""
            SELECT article_id, title, summary, published_at, source, reliability, category, array({types}) AS event_types, embedding FROM (
            SELECT a.article_id, a.title, a.summary, a.published_at, s.name AS source, s.reliability, {first_label(d, "lower(a.summary)", V.FIXTURE_CATEGORIES, "other")} AS category, cast(e.embedding AS array<double>) AS embedding
            FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id LEFT JOIN embeddings e ON e.vec_id = a.article_id) x"""))

    clustering.cluster_stream(_stream(spark, sf_dir, "documents"), prepared, store)
    return store


def online_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event that each article joined or founded when it came, and whether it gave the event its headline."""
    joined = _clustered(spark, sf_dir).table("joined", clustering.JOINED)
    return joined.select("article_id", "event_id", F.round("relevance", 6).alias("relevance"), "is_new", "new_headline")


def cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the stream with their counts of articles and sources, the article whose headline they have, and entries of the live feed."""
    joined = _clustered(spark, sf_dir).table("joined", clustering.JOINED)
    return clustering.event_counts(joined)


def claim_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every claim by the reports for and against it."""
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    d, scratch = Spark(), Scratch(spark, "claims")
    every = scratch.keep(spark.sql(with_tables(d, ["claims", "evidence", "articles", "sources"], verification_sql.reports(d))), "reports")
    claims = spark.sql(with_tables(d, ["claims"], "SELECT claim_id FROM claims"))
    return verification.verify(claims, every.where("NOT denies"), every.where("denies"), scratch.keep, V.FIXTURE_WIRES)


def event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every story event."""
    for t in ("documents", "embeddings", "benchmark", "labels", "nation"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    d = Spark()
    sql = lambda names, body: spark.sql(with_tables(d, names, body))
    news = reports.News(
        events=sql(["story_events"], "SELECT event_id, title, lead AS summary, category, severity, status, country, source_count, article_count, first_reported_at, last_updated_at FROM story_events"),
        articles=sql(["event_articles", "articles", "sources"], "SELECT ea.event_id, a.article_id, a.title, a.summary, a.published_at, s.name AS outlet, s.type AS kind, '' AS url, s.reliability FROM event_articles ea JOIN articles a ON a.article_id = ea.article_id LEFT JOIN sources s ON s.source_id = a.source_id"),
        claims=sql(["claims"], "SELECT event_id, claim_id, claim_text, status, extracted_at, status <> 'CONTRADICTED' AS causal FROM claims"),
        named=sql(["entities", "event_articles"], "SELECT ea.event_id, e.name, e.type FROM entities e JOIN event_articles ea ON ea.article_id = e.article_id"),
    )
    timeline = spark.sql(intelligence.timeline(d))
    return reports.assemble(news, Scratch(spark, "reports").keep, timeline, reports_sql.STAGE_WORDS, V.FIXTURE_FRAMES, V.FIXTURE_WIRES)


def ranker_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranker fitted on the article candidates of all user turns, its stored version read back: weights and metrics beside the default's."""
    scratch = Scratch(spark, "training")
    found, news = _turns(spark, sf_dir), news_tables(spark, sf_dir)
    keys = ["conv_id", "turn"]
    pool = asking.pools(found, keys, news, scratch.keep).articles
    features = asking.featured(pool, keys, "article_id", scratch.keep, **asking.article_features(), as_of=news.as_of)
    store = training.ModelStore(spark, f"{scratch.root}/models")
    out = training.train(scratch.keep(training.labelled(features), "rows"), store)
    stored = store.read()
    return out.withColumn("stored", F.create_map(*[F.lit(y) for n, w in {**stored["weights"], "intercept": stored["intercept"]}.items() for y in (n, float(w))])[F.col("name")])


def queries() -> dict:
    return {f.__name__: f for f in (ingest_stream_dedupe, train_logreg, independent_clusters, syndication_pairs, cosine_topk, expand_questions, ask_turns, claim_verifications, event_reports, ranker_training, online_clusters, cluster_events)}


def oracle_sql() -> dict[str, str]:
    dedupe = dedupe_articles(Duck()).replace(", count(*) AS copies", "")
    return asking_sql.oracle_sql() | verification_sql.oracle_sql() | reports_sql.oracle_sql() | {"ingest_stream_dedupe": dedupe, "syndication_pairs": syndication_oracle(Duck())}
