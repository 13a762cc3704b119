"""Pages with known links, sentences and text."""

from linkloom.sources import html

PAGE = """<html><body><nav><ul><li><a href="/Home">Home</a></li></ul></nav><div class="x reflist"><p>Junk with a <a href="/Junk">junk link</a> in a long enough sentence here.</p></div>
<h1>Cats</h1><p>The <a href="/Cat_%26_dog">cat</a> sat on the mat. It was   a very
happy cat indeed.<p>Short <a href="/Cat_%26_dog">cat</a>. A <a href="/Help:Me">help</a> page and a <a href="/Far">far</a> one.</p>
<table><tr><td>Cell that speaks of Far away places in ten words or more, truly so.</td></tr></table>
<h2>External links</h2><p>Cut <a href="/Cut">cut</a> sentence that nobody should ever come to see.</p></body></html>"""


def rows(df):
    return sorted(tuple(r)[1:] for r in df.collect())


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>open <a href='/X'>x")], "page_id long, html string")
    assert rows(html.html_links(pages)) == sorted([(0, "Home", "Home"), (1, "Junk", "junk link"), (2, "Cat & dog", "cat"), (3, "Cat & dog", "cat"), (4, "Far", "far"), (5, "Cut", "cut"), (0, "X", "x")])
    got = dict(rows(html.html_contexts(pages)))
    assert got["Cat & dog"] == "The cat sat on the mat." and got["Far"] == "A help page and a far one." and "Home" not in got and got["Junk"].startswith("Junk with")
    full = dict(rows(html.html_full_contexts(pages)))
    assert full == {"Far": "Cell that speaks of Far away places in ten words or more, truly so."}
    assert dict(rows(html.html_full_contexts(pages, least_words=5)))["Far"] == "A help page and a far one."
    text = {r.page_id: r.text for r in html.html_text(pages).collect()}
    assert text == {1: "Cats\nThe cat sat on the mat. It was a very happy cat indeed.\nShort cat. A help page and a far one.", 2: "", 3: "", 4: "open x"}


def test_few_pages_at_a_time(spark):
    """A batch of 10,000 pages was parsed as one, and its rows held together."""
    from pyspark.sql import functions as F

    from linkloom.sources import html

    df = html.html_text(spark.range(0, 1000, 1, 1).select(F.col("id").alias("page_id"), F.lit("<p>a b</p>").alias("html")))
    assert df.where("text = 'a b'").count() == 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)
