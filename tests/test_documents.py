import datetime as dt

from pyspark.sql import functions as F

from newsflow.sources import documents

RSS = """<?xml version="1.0"?><rss xmlns:dc="x"><channel><title>Feed</title><link>http://feed.example.com</link>
<item><title><![CDATA[A <b>bold</b> </item> title]]></title><link> http://www.a.example.com/1?utm_source=x </link><description>one &nbsp;&amp; two</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><media:content url="i.jpg"><media:title>other</media:title></media:content></item>
<!-- <item><title>commented</title><link>http://a.example.com/0</link></item> -->
<item rdf:about="x"><title>B</title><link>http://a.example.com/2</link><dc:date>2024-01-02T00:00:00+00:00</dc:date></item>
<item><title>no link</title></item><item><title>unreadable <b></title><link>http://a.example.com/x</link></item>
<item><title>C</title><link>http://a.example.com/3</link></item><item><title>cut off</title><link>http://a.exam"""
ATOM = """<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>F</a:title><a:entry><a:title>D &amp; d</a:title><a:link rel="self" href="http://b.example.com/self"/>
<a:link rel="alternate" href="http://b.example.com/4/"/><a:updated>2024-01-03T00:00:00Z</a:updated><a:content>text</a:content></a:entry></a:feed>"""


def test_whole_feeds(spark):
    rows = [(1, "feed.example.com", RSS), (2, "b.example.com", ATOM), (3, "c.example.com", None), (4, "c.example.com", ""), (5, "c.example.com", "<html><body>no feed</body></html>"), (6, "d.example.com", RSS[: RSS.index("2024-01-02")])]
    got = documents.feed_items(spark.createDataFrame(rows, "seq long, feed_domain string, xml string")).collect()
    by = {(r["seq"]["document"], r["title"]): r for r in got}
    assert [r["title"] for r in sorted(got, key=lambda r: r["seq"]) if r["seq"]["document"] < 6] == ["A <b>bold</b> </item> title", "B", "C", "D & d"]
    first, second, atom = by[1, "A <b>bold</b> </item> title"], by[1, "B"], by[2, "D & d"]
    assert first["url"] == "http://a.example.com/1" and first["summary"] == "one &nbsp;& two" and first["published_at"] == dt.datetime(2024, 1, 1, 10)
    assert second["published_at"] == dt.datetime(2024, 1, 2) and by[1, "C"]["published_at"] is None
    assert (atom["url"], atom["summary"], atom["published_at"]) == ("http://b.example.com/4", "text", dt.datetime(2024, 1, 3))
    assert [t for d, t in by if d == 6] == ["A <b>bold</b> </item> title"]


NEWS = """<urlset xmlns:n="news"><url><loc>http://a.example.com/n1</loc><n:news><n:publication><n:name>P</n:name></n:publication><n:publication_date>2024-01-05T00:00:00Z</n:publication_date><n:title>N1</n:title></n:news></url>
<url><loc>http://a.example.com/n2</loc></url><url><loc>http://a.example.com/n3</loc><n:news>"""


def test_news_sitemaps_with_another_prefix(spark):
    df = spark.createDataFrame([(1, "a.example.com", NEWS), (2, "b.example.com", NEWS.replace("n:", "news:"))], "seq long, feed_domain string, xml string")
    got = {(r["seq"]["document"], r["url"]): (r["title"], r["published_at"]) for r in documents.news_items(df).collect()}
    for n in (1, 2):
        assert got[n, "http://a.example.com/n1"] == ("N1", dt.datetime(2024, 1, 5)) and got[n, "http://a.example.com/n2"] == ("", None)
    assert len(got) == 4


def test_files_from_the_index_to_its_last_page(spark, tmp_path):
    index = "<s:sitemapindex xmlns:s='x'>" + "".join(f"<s:sitemap><s:loc>file:{tmp_path}/in/posts-post-{n}.xml</s:loc></s:sitemap>" for n in (1, 2, 10)) + "<s:sitemap><s:loc>http://x/pages.xml</s:loc></s:sitemap></s:sitemapindex>"
    url = lambda slug, day: f"<url><loc>https://a.example.com/{slug}</loc><lastmod>2024-01-{day:02}</lastmod></url>"
    (tmp_path / "in").mkdir()
    files = {"index.xml": index, "posts-post-2.xml": f"<urlset>{url('older', 30)}</urlset>", "posts-post-10.xml": f"<urlset>{url('new-and-long-slug', 30)}{url('new-and-long-slug-2', 30)}{url('old', 1)}<url><loc>https://a.example.com/undated</loc></url><url><loc>cut"}
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text)
    docs = documents.document_files(spark, f"{tmp_path}/in").withColumn("seq", F.crc32("url")).withColumn("feed_domain", F.lit("a.example.com"))
    docs = docs.withColumn("url", F.regexp_replace("url", "^file:/+", "file:/"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    assert {r["url"] for r in documents.standard_sitemap(docs, as_of).collect()} == {"https://a.example.com/new-and-long-slug"}
    assert {r["url"] for r in documents.standard_sitemap(docs, as_of, keep_undated=True).collect()} == {"https://a.example.com/new-and-long-slug", "https://a.example.com/undated"}
    listed = documents.element_files(spark, f"{tmp_path}/in/posts-post-2.xml", "url", "loc string, lastmod string")
    assert [tuple(map(str, r)) for r in listed.collect()] == [("https://a.example.com/older", "2024-01-30")]
