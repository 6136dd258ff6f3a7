"""Readers of saved feed responses: RSS or Atom items, and article lists in the two JSON shapes. Each gives RAW columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a raw item, whatever its source.
RAW = ("external_id", "url", "title", "content", "summary", "author", "published_at", "image_url", "language", "source_name", "source_type")

_MEDIA = "struct<_url:string,_type:string>"
_LINK = {"item": "string", "entry": "array<struct<_href:string,_rel:string>>"}
_ITEM = f"""guid string, id string, title string, description string, `content:encoded` string, content string, summary string, `dc:creator` string, author string,
    pubDate string, published string, updated string, enclosure {_MEDIA}, `media:content` {_MEDIA}, `media:thumbnail` {_MEDIA}"""
_GDELT = "articles array<struct<url:string,title:string,seendate:string,socialimage:string,domain:string,language:string,sourcecountry:string>>"
_NEWSAPI = "status string, articles array<struct<source:struct<name:string>,author:string,title:string,description:string,url:string,urlToImage:string,publishedAt:string,content:string>>"


def _text(*options: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.when(x != "", x) for x in options], F.lit(""))


def parsed_time(x: Column, as_of: str) -> Column:
    """Compact UTC stamps, mail dates, ISO dates; as_of for what is none of them."""
    compact = F.try_to_timestamp(x, F.lit("yyyyMMdd'T'HHmmssX"))
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z]{3},\s*", ""), r"\s(?:GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(compact, mail, F.try_to_timestamp(x), F.lit(as_of).cast("timestamp"))


def read_rss(spark: SparkSession, path: str, name: str, as_of: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS files (row_tag "item") or Atom files ("entry"). The image is the first of an image enclosure, media content
    and thumbnail."""
    item = spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").schema(f"{_ITEM}, link {_LINK[row_tag]}").load(path)
    # Atom names addresses in attributes; the article's own has no relation or is the alternate
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate") if row_tag == "entry" else None
    link = F.col("link") if own is None else F.get(own, 0)["_href"]
    image = F.coalesce(F.when(F.col("enclosure._type").startswith("image/"), F.col("enclosure._url")), F.col("`media:content`._url"), F.col("`media:thumbnail`._url"))
    snippet = F.trim(F.regexp_replace(_text(F.col("description"), F.col("content"), F.col("summary")), r"<[^>]*>", ""))
    return item.select(
        F.coalesce("guid", "id", link).alias("external_id"),
        _text(link).alias("url"),
        _text(F.col("title")).alias("title"),
        _text(F.col("`content:encoded`"), F.col("content"), F.col("description")).alias("content"),
        snippet.alias("summary"),
        _text(F.col("`dc:creator`"), F.col("author"), F.lit(name)).alias("author"),
        parsed_time(F.coalesce("pubDate", "published", "updated"), as_of).alias("published_at"),
        image.alias("image_url"),
        F.lit(None).cast("string").alias("language"),
        F.lit(name).alias("source_name"),
        F.lit("rss").alias("source_type"),
    )


def _articles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Responses that are no JSON have no articles."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_gdelt(spark: SparkSession, path: str, name: str, as_of: str) -> DataFrame:
    """Article lists with compact dates. They give titles only, which stand for content and summary."""
    x = _articles(spark, path, _GDELT).select(F.explode("articles").alias("x")).select("x.*")
    title = _text(F.col("title"))
    return x.select(
        F.col("url").alias("external_id"),
        _text(F.col("url")).alias("url"),
        title.alias("title"),
        title.alias("content"),
        title.alias("summary"),
        _text(F.col("domain"), F.lit("GDELT")).alias("author"),
        parsed_time(F.col("seendate"), as_of).alias("published_at"),
        F.when(F.col("socialimage") != "", F.col("socialimage")).alias("image_url"),
        _text(F.col("language"), F.lit("en")).alias("language"),
        F.lit(name).alias("source_name"),
        F.lit("gdelt").alias("source_type"),
    )


def read_newsapi(spark: SparkSession, path: str, name: str, as_of: str) -> DataFrame:
    """Headlines of responses with status ok, without untitled and removed ones."""
    x = _articles(spark, path, _NEWSAPI).where("status = 'ok'").select(F.explode("articles").alias("x")).select("x.*")
    x = x.where((F.col("title") != "") & (F.col("title") != "[Removed]"))
    return x.select(
        F.col("url").alias("external_id"),
        _text(F.col("url")).alias("url"),
        "title",
        _text(F.col("content"), F.col("description")).alias("content"),
        _text(F.col("description")).alias("summary"),
        _text(F.col("author"), F.col("source.name"), F.lit(name)).alias("author"),
        parsed_time(F.col("publishedAt"), as_of).alias("published_at"),
        F.when(F.col("urlToImage") != "", F.col("urlToImage")).alias("image_url"),
        F.lit(None).cast("string").alias("language"),
        F.lit(name).alias("source_name"),
        F.lit("newsapi").alias("source_type"),
    )


READERS = {"rss": read_rss, "atom": functools.partial(read_rss, row_tag="entry"), "gdelt": read_gdelt, "newsapi": read_newsapi}


def read_feeds(spark: SparkSession, feeds: list[tuple[str, str, str]], as_of: str) -> DataFrame:
    """All items of (type, path, name) feeds; an unknown type is an error."""
    parts = [READERS[kind](spark, path, name, as_of) for kind, path, name in feeds]
    return functools.reduce(DataFrame.unionByName, parts)
