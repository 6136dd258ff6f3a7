"""Feed readers on saved responses."""

import datetime
import json

import pytest

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark
from newsloom.operators.text import hierarchy_sql, intent_sql, wire_sql
from newsloom.sources import feeds

AS_OF = "2024-01-31 00:00:00"
RSS = """<?xml version="1.0"?><rss xmlns:media="m" xmlns:content="c" xmlns:dc="d"><channel><title>Feed</title>
<item><guid>g1</guid><link>https://a.b/1</link><title>One</title><description>&lt;b&gt;short&lt;/b&gt;</description><content:encoded>long</content:encoded><dc:creator>Ann</dc:creator>
<pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate><enclosure url="https://a.b/i.png" type="image/png"/><media:content url="https://a.b/m.png"/></item>
<item><link>https://a.b/2</link><title>Two</title><enclosure url="https://a.b/s.mp3" type="audio/mpeg"/><media:thumbnail url="https://a.b/t.png"/></item>
</channel></rss>"""


def moment(*x):
    return datetime.datetime(*x)


@pytest.fixture
def saved(tmp_path):
    def save(name, text):
        at = tmp_path / name
        at.write_text(text if isinstance(text, str) else json.dumps(text))
        return str(at)

    return save


def test_rss(spark, saved):
    one, two = feeds.read_rss(spark, saved("f.xml", RSS), "Paper", AS_OF).orderBy("url").collect()
    assert (one.external_id, one.content, one.summary, one.author, one.image_url, one.published_at) == ("g1", "long", "short", "Ann", "https://a.b/i.png", moment(2024, 1, 15, 10))
    assert (two.external_id, two.content, two.summary, two.author, two.image_url, two.published_at) == ("https://a.b/2", "", "", "Paper", "https://a.b/t.png", moment(2024, 1, 31))


def test_atom(spark, saved):
    text = """<feed xmlns="a"><entry><id>e1</id><link rel="self" href="https://a.b/self"/><link href="https://a.b/1"/><title>One</title><summary>sum</summary><updated>2024-01-15T10:00:00Z</updated></entry>
    <entry><id>e2</id><link rel="alternate" href="https://a.b/2"/><title>Two</title></entry></feed>"""
    one, two = feeds.read_rss(spark, saved("a.xml", text), "Paper", AS_OF, row_tag="entry").orderBy("external_id").collect()
    assert (one.external_id, one.url, one.summary, one.published_at) == ("e1", "https://a.b/1", "sum", moment(2024, 1, 15, 10))
    assert (two.url, two.published_at) == ("https://a.b/2", moment(2024, 1, 31))


def test_gdelt(spark, saved):
    at = saved("g.json", {"articles": [{"url": "https://a.b", "title": "T", "seendate": "20240115T123000Z", "domain": "a.b"}, {"url": "https://c.d", "seendate": "soon"}]})
    one, two = feeds.read_gdelt(spark, at, "Lists", AS_OF).orderBy("url").collect()
    assert (one.title, one.content, one.author, one.language, one.published_at) == ("T", "T", "a.b", "en", moment(2024, 1, 15, 12, 30))
    assert (two.title, two.author, two.published_at) == ("", "GDELT", moment(2024, 1, 31))
    assert feeds.read_gdelt(spark, saved("bad.json", "<html>limited</html>"), "Lists", AS_OF).count() == 0


def test_newsapi(spark, saved):
    items = [{"title": "[Removed]", "url": "u0"}, {"title": None, "url": "u1"}, {"title": "T", "url": "u2", "description": "D", "source": {"name": "S"}, "publishedAt": "2024-01-15T12:00:00Z"}]
    (one,) = feeds.read_newsapi(spark, saved("n.json", {"status": "ok", "articles": items}), "Api", AS_OF).collect()
    assert (one.url, one.content, one.author, one.published_at) == ("u2", "D", "S", moment(2024, 1, 15, 12))
    assert feeds.read_newsapi(spark, saved("e.json", {"status": "error", "articles": items}), "Api", AS_OF).count() == 0


def test_feeds(spark, saved):
    out = feeds.read_feeds(spark, [("rss", saved("f.xml", RSS), "Paper"), ("gdelt", saved("g.json", {"articles": [{"url": "x", "title": "T"}]}), "Lists")], AS_OF)
    assert tuple(out.columns) == feeds.RAW and out.count() == 3
    with pytest.raises(KeyError):
        feeds.read_feeds(spark, [("fax", "x", "y")], AS_OF)


@pytest.mark.parametrize(
    "said, wire",
    [("Storm hits coast (AP)", "Associated Press"), ("an app and a map", None), ("LONDON, reuters - calm", "Reuters"), ("Par AFP.", "Agence France-Presse"), ("via PRNewswire", "PR Newswire"), (None, None)],
)
def test_wire(spark, said, wire):
    assert spark.createDataFrame([(said,)], "x string").selectExpr(wire_sql(Spark(), "x", V.WIRES) + " AS y").first().y == wire


@pytest.mark.parametrize(
    "name, kind, url, level",
    [("", "", "https://x.gov/a", "PRIMARY SOURCE"), ("State University", "rss", "", "SCIENTIFIC_TECHNICAL"), ("x", "gdelt", "", "INDEPENDENT_NEWS"), ("Reddit", "", "", "PUBLIC_SIGNAL"), ("x", "", "", "SECONDARY_REPORT")],
)
def test_hierarchy(spark, name, kind, url, level):
    assert spark.createDataFrame([(name, kind, url)], "n string, k string, u string").selectExpr(hierarchy_sql(Spark(), "n", "k", "u") + " AS y").first().y == level


@pytest.mark.parametrize(
    "text, primary, intents, focus",
    [
        ("Will the river rise", "FORECAST", "FORECAST", "FUTURE"),
        ("Did OpenAI release GPT", "MODEL_RELEASE", "MODEL_RELEASE,PRODUCT_RELEASE", "CURRENT"),
        ("Which phone launched", "PRODUCT_LAUNCH", "PRODUCT_LAUNCH,PRODUCT_RELEASE", "CURRENT"),
        ("what caused the flooding", "CAUSE", "CAUSE,DISASTER_STATUS", "CURRENT"),
        ("history of the canal", "HISTORY", "HISTORY,TIMELINE", "HISTORICAL"),
        ("latest news", "LATEST_NEWS", "LATEST_NEWS,NEWS_OVERVIEW", "CURRENT"),
        ("anything recent about that old and rather quiet town", "LATEST_NEWS", "LATEST_NEWS", "CURRENT"),
        ("tell me about the canal", "GENERAL_EXPLANATION", "GENERAL_EXPLANATION", "CURRENT"),
    ],
)
def test_intents(spark, text, primary, intents, focus):
    spark.createDataFrame([(1, text)], "id int, text string").createOrReplaceTempView("asked_texts")
    r = spark.sql(intent_sql(Spark(), "asked_texts", "id", V.INTENT_SIGNALS)).first()
    assert (r.primary_intent, r.intents, r.temporal_focus) == (primary, intents, focus)
