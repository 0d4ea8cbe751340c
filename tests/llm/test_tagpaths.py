"""Tag-path extraction on made pages and against the article element of every page."""

import html
import re

from beamspark.llm.op_queries import op2_tag_paths
from beamspark.llm.tagpaths import extracted, main_text

BODY = "".join(f"<p>Paragraph {i}, with commas, stops. And a second sentence here, as usual.</p>" for i in range(6))


def plain(source):
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", source.replace("<br>", " ")))).strip()


def test_plain_layout_without_semantic_tags():
    page = (f"<html><body><div id='top'><ul class='menu'><li><a href='/'>Home, start.</a></ul></div><div class=content>{BODY}"
            "<div class='comments'><p>First! I am a reader, and I comment.</p></div></div><div class='footer-note footer'>All rights, etc.</div></body>")
    assert main_text(page) == "\n".join(plain(x) for x in BODY.split("</p>") if x)


def test_links_without_marks_are_not_content():
    menu = "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(12))
    assert "Topic" not in main_text(f"<body><div><ul>{menu}</ul></div><div>{BODY}</div></body>")


def test_noise_elements_inside_the_article():
    for noise in ("<aside>Aside, text.</aside>", "<form>Send, now.<input></form>", "<div class='ad'>Buy, now.</div>", "<section id=comments>Reader, said.</section>",
                  "<div role='navigation'>Go, there.</div>", "<div style='display: none'>Hidden, text.</div>", "<p hidden>Hidden, too.</p>", "<script>var a='<p>no, no.</p>'</script>",
                  "<style>p{a:b}</style>", "<div class='cookie-notice'>We use, cookies.</div>", "<!-- gone, gone. -->", "<noscript>No, script.</noscript>"):
        assert main_text(f"<body><article><h1>Title</h1>{BODY}{noise}</article></body>") == main_text(f"<body><article><h1>Title</h1>{BODY}</article></body>")


def test_words_that_only_look_like_noise():
    assert main_text("<article class='post has-sidebar'><p class='address download shadow'>Kept, all of it.</p></article>") == "Kept, all of it."


def test_references_spaces_and_breaks():
    assert main_text("<article><p>a &lt;b&gt; &amp;amp; &#233;&nbsp;\n\t x<br>y</p>\n<p> &nbsp; </p><p>z&copy</p></article>") == "a <b> &amp; é x y\nz©"


def test_broken_markup():
    assert main_text("<article><p>One, two.<p><b>Three, four.<p>Five, six.</article><footer>No.") == "One, two.\nThree, four.\nFive, six."
    assert main_text("<article><p>Cut, off <a href='x") == "Cut, off"
    for odd in (None, "", "<", "<!--", "<script>", "</p></p>", "<p>" * 30000, "<div>" * 30000):
        assert main_text(odd) == ("<" if odd == "<" else "")
    assert main_text("<div>" * 5000 + "deep") == "deep"


def test_rows(spark):
    rows = [(1, "u", "<p>x, y.</p>"), (1, "u", "<p>x, y.</p>"), (None, None, None), (2, "", "<p>" + "long, text. " * 50000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 as text", "8 as tag")
    got = extracted(df)
    assert got.columns == ["page_id", "url", "tag", "text"]
    assert sorted(len(r.text) for r in got.collect()) == [0, 5, 5, 12 * 50000 - 1]
    assert extracted(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op2_tag_paths(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        assert r.text == "\n".join(x for x in map(plain, re.split(r"</?(?:p|h1)>", article)) if x)
        assert r.n_chars == len(r.text)
