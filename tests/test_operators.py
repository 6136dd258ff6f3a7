"""Pure operators on literal cases."""

import pytest

from newsloom.functions import vocabulary as V
from newsloom.functions.dialect import Spark
from newsloom.operators.relational import page
from newsloom.operators.text import clean_url_sql, strip_html_sql
from newsloom.sources.adapters import first_label

D = Spark()


def value(spark, sql, x):
    return spark.createDataFrame([(x,)], "x string").selectExpr(f"{sql} AS y").first().y


@pytest.mark.parametrize(
    "text, label",
    [
        ("troops move as ceasefire fails", "conflict"),
        ("central bank raises interest rate", "economics"),
        ("new vaccine against the virus", "health"),
        ("wildfire and drought", "climate"),
        ("the telescope finds", "science"),
        ("a warm afternoon", "other"),
        ("forwarded", "other"),
    ],
)
def test_category(spark, text, label):
    assert value(spark, first_label(D, "lower(x)", V.CATEGORIES, "other"), text) == label


@pytest.mark.parametrize("text, label", [("Breaking news", "critical"), ("a crash", "high"), ("calm", "normal")])
def test_severity(spark, text, label):
    assert value(spark, first_label(D, "lower(x)", V.SEVERITIES, "normal"), text) == label


@pytest.mark.parametrize(
    "url, clean",
    [
        ("https://a.b/c?utm_source=x&id=1&ref=y", "https://a.b/c?id=1"),
        ("https://a.b/c?utm_source=x", "https://a.b/c"),
        ("https://a.b/c", "https://a.b/c"),
        ("https://a.b/c?reference=1", "https://a.b/c?reference=1"),
    ],
)
def test_clean_url(spark, url, clean):
    assert value(spark, clean_url_sql(D, "x"), url) == clean


def test_strip_html(spark):
    assert value(spark, strip_html_sql(D, "x"), "<p>a &amp; b</p><script>x()</script><style>y</style>\n c") == "a & b c"


@pytest.mark.parametrize("number, size, found", [(1, 20, (20, 0)), (3, 10, (10, 20)), (0, 500, (100, 0)), (-2, 0, (1, 0))])
def test_page(number, size, found):
    assert page(number, size) == found


ROWS = "article_id long, title string, content string, url string, image string"


def test_keyed_store(spark, tmp_path, monkeypatch):
    """Batches into the store, one of which fails after it was written and runs again; then the stream again with nothing new."""
    from newsloom.streaming.ingest import ArticleStore

    batches = [
        [(4, "A  title!", "Body", "https://www.x.org:80/A/?q=1", None), (2, "a title", " body ", "http://www.x.org/a", None), (9, None, None, None, None)],
        [(1, "a title", "body", "www.x.org/a", None), (3, "a title", "body", "https://u@www.x.org/a//", "i3"), (8, None, "", "", "i8")],
        [(5, "A title", "BODY", "http://www.x.org/a", "i5"), (6, "other", "body", None, None)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    store, merge, calls = ArticleStore(spark, f"{tmp_path}/store", ROWS), ArticleStore.merge, []

    def fails(self, batch, number):
        merge(self, batch, number)
        calls.append(number)
        if calls == [0, 1]:
            raise RuntimeError("lost")

    monkeypatch.setattr(ArticleStore, "merge", fails)
    stream = lambda: spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="lost"):
        store.follow(stream(), lambda b: b)
    for _ in range(2):
        store.follow(stream(), lambda b: b)
        rows = store.articles().collect()
        assert len(rows) == len({r.content_hash for r in rows}) == 3 and calls == [0, 1, 1, 2]
        assert {r.article_id for r in rows} >= {2, 6, 9}
    # what a stored row lacks comes from later copies of its key; nothing that it has is replaced
    filled = {r.article_id: (r.image, r.title) for r in store.filled("image").collect()}
    assert filled[2] == ("i3", "a title") and filled[9] == ("i8", None) and filled[6] == (None, "other")
