"""References in plain text against html.unescape."""

import html

from beamspark.llm import derivatives


def test_all_references(spark):
    names = [f"&{n}" for n in html.entities.html5]
    texts = ["", "&", "a & b && c", "&#8217;&#x27;&#X1F600;", "&eacute;&euro; x &notit; &nosuch;", "&amp;lt; &amp;amp;#39;", "&lt;b&gt;", "R&amp", "AT&T &#", "&#128;&#0;&#xD800;&#x110000;",
             "end &copy", "&a" * 40, "x&#39;y&#039;z"]
    texts += [" ".join(names[i:i + 50]) for i in range(0, len(names), 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.u for r in df.select("i", derivatives.unescaped(df.t).alias("u")).collect()}
    assert got == {i: html.unescape(t) for i, t in enumerate(texts)}


def test_conversion_record(spark):
    df = spark.createDataFrame([("r", "u", None, None, "<p>It&#8217;s &eacute;t&#xE9;&#x20AC;&#160;&nbsp;&amp;lt;p&amp;gt;")],
                               "record_id string, target_uri string, date string, http_headers string, payload string")
    got = {r.record_type: r.block for r in derivatives.derived(df).collect()}
    assert got["conversion"] == "It’s été€ &lt;p&gt;" and "text-length: 19\r\n" in got["metadata"]
