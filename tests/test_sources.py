from pyspark.sql import functions as F

from warraq.sources import feeds, files
from warraq.streaming import ingest

FEED = """<rss><channel><item><title>خبر أول - موقع</title><link>http://a/1</link><description>&lt;b&gt; نص الخبر الأول هنا</description><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate></item>
<item><title>english only</title><link>http://a/2</link><description>plain english words</description></item>
<item><title>خبر بلا رابط</title><guid>http://a/3</guid><summary><![CDATA[<p>ملخص الخبر</p>]]></summary></item></channel></rss>"""


def test_feed_entries(spark):
    d = spark.createDataFrame([("f", FEED), ("broken", "<rss><item>")], "feed string, xml string")
    a = {r["url"]: r for r in feeds.articles_of(feeds.entries(d)).collect()}
    assert set(a) == {"http://a/1", "http://a/3"}
    assert str(a["http://a/1"]["published_at"]) == "2025-01-06 10:00:00" and a["http://a/3"]["content"] == "ملخص الخبر"
    assert feeds.articles_of(feeds.entries(d), most=1).count() == 1


def test_redirects_blocks_bodies(spark):
    d = spark.createDataFrame([("u1", "t", "short"), ("u2", "t", "x" * 400), ("bad.host/3", "t", "c")], "url string, title string, content string")
    r = feeds.resolved(d, spark.createDataFrame([("u1", "v1")], "url string, target string"))
    assert sorted(x["url"] for x in r.collect()) == ["bad.host/3", "u2", "v1"]
    assert feeds.not_blocked(d, ["bad.host"]).count() == 2
    pages = spark.createDataFrame([("u1", "<p>" + "body " * 80 + "</p>"), ("u2", "<p>" + "other " * 80 + "</p>")], "url string, html string")
    got = {x["url"]: x["content"] for x in feeds.with_bodies(d, pages).collect()}
    assert got["u1"].startswith("body") and got["u2"].startswith("xxx") and got["bad.host/3"] == "c"


def test_files(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    d = spark.createDataFrame([("نص", None)], "text string, date string")
    files.write_jsonl(d, p)
    assert files.read_jsonl(spark, p, "text string, date string").collect() == d.collect()
    assert files.read_jsonl(spark, str(tmp_path / "none"), "text string").count() == 0
    (tmp_path / "b.jsonl").write_text('{"text": "x"}\n{broken\n\n', encoding="utf8")
    good, counts = files.read_tolerant(spark, str(tmp_path / "b.jsonl"), "text string")
    assert good.filter("text is not null").count() == 1 and tuple(counts.first()) == (2, 1, 1)
    assert files.detect_column(d, ["content", "text"], "text") == "text"


def test_stream(spark, tmp_path):
    rows = [("u1", "same text", "2025-01-01 00:00:00"), ("u2", "Same  text", "2025-01-01 01:00:00"), ("u3", "other", None), ("u1", "third", "2025-01-01 02:00:00")]
    d = spark.createDataFrame(rows, "url string, content string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for k in range(2):  # a second run over the same rows adds nothing
        s = ingest.deduplicated(ingest.read_stream(spark, str(tmp_path / "in"), d.schema.simpleString()[7:-1].replace(":", " ")), F.col("content"))
        ingest.run(s, ingest.idempotent_sink(out), str(tmp_path / f"cp{k}")).awaitTermination(120)
    got = sorted(r["url"] for r in spark.read.parquet(out).collect())
    assert len(got) == len(set(got)) and "u3" in got
    assert ingest.fresh(d, F.lit("2025-01-03 00:30:00").cast("timestamp")).count() == 3
