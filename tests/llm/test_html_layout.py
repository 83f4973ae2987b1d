import re

from pyspark.sql import functions as F

from airmetrics.llm.html_layout import extract, visible_text
from tests.llm.helpers import SF, documents


def test_paragraphs_and_implied_ends():
    assert visible_text("<p>a<p>b<div>c</div>d") == "a\n\nb\n\nc\nd"
    assert visible_text("x<br>y<br/>z") == "x\ny\nz"
    assert visible_text("<title>t</title>shown") == "shown"


def test_lists():
    page = "<ul><li>x<li>y<ol start=3><li>one<li>two</ol></ul>after"
    assert visible_text(page) == "- x\n- y\n\n  3. one\n  4. two\n\nafter"


def test_table_columns_are_aligned():
    page = "<table><tr><th>n<th>title<tr><td>12345<td>z<tr><td>1<td>q</table>"
    assert visible_text(page) == "n      title\n12345  z\n1      q"
    spans = "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell</table>"
    assert visible_text(spans) == "a  b\n   c\nwide cell"


def test_hidden_things_stay_hidden():
    page = (
        "<style>.no{display:none} #off,b.x{visibility: hidden}</style><p hidden>1</p><p style='display: none'>2</p>"
        "<p class='a no'>3</p><p id=off>4</p><b class=x>5</b><b>6</b><script>7</script><!-- 8 --><noscript>9</noscript>"
        "<details><summary>s</summary>10</details>"
    )
    assert visible_text(page) == "6\ns"


def test_drawings_formulas_and_dialogs():
    svg = (
        "<p>see <svg viewBox='0 0 9 9'><title>no</title><desc>no</desc><defs><text id=t>used</text></defs><style/>"
        "<path d='M0'/><g>\n loose <text x=1>one <tspan>two</tspan></text></g><text display=none>no</text>"
        "<text visibility='hidden'>no</text><use href='#t'/><foreignObject><div>html</div></foreignObject></svg> here"
    )
    assert visible_text(svg).split() == ["see", "one", "two", "used", "html", "here"]
    math = (
        "so <math><semantics><mrow><msup><mi>x</mi> <mn>2</mn></msup><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow>"
        "<annotation encoding='application/x-tex'>x^2</annotation></semantics></math> holds"
    )
    assert visible_text(math) == "so x2= 1 2 holds"
    assert visible_text("<dialog>no</dialog>a<dialog open>b<p>c</dialog>d") == "a\nb\n\nc\n\nd"
    assert visible_text("<pre>a <svg><text>b</text></svg></pre>").split() == ["a", "b"]
    assert visible_text("<ul><svg><text>a</text>no</svg><li><math><mi>b</mi></math></ul>") == "  a\n- b"


def test_broken_drawings():
    assert visible_text("<svg><g><path d=x><p>after</p>") == "after"
    assert visible_text("<svg><title/><text>a</svg>b").split() == ["a", "b"]
    assert visible_text("<svg><use href=#u id=u /><g id=g><use href=#g /><text>a</text></g></svg>").split() == ["a", "a"]
    nest = "<div>" * 180 + "<svg><use href=#k /></svg>" + "</div>" * 180 + "<svg><symbol id=k>" + "<g>" * 180 + "<foreignObject>deep"
    assert "deep" in visible_text(nest)
    laughs = "".join(f"<g id=u{k}>" + f"<use href=#u{k + 1} />" * 50 + "</g>" for k in range(40))
    assert visible_text(f"<svg>{laughs}<text id=u40>a</text></svg>").split().count("a") >= 1
    assert visible_text("<svg>" * 3000 + "<text>deep") in ("deep", "")
    assert visible_text("<math><mi>x</math><svg hidden><text>no</svg><svg style='display:none'><text>no</svg>y") == "xy"


def test_preformatted_and_entities():
    assert visible_text("<pre>\na  b\n  c</pre>") == "a  b\n  c"
    assert visible_text("a &lt;b&gt; &amp;amp; 1 < 2") == "a <b> &amp; 1 < 2"


def test_broken_pages(spark):
    assert visible_text("") == "" and visible_text(None) is None and visible_text("<") == "<"
    assert visible_text("</p></table></li>x") == "x"
    assert visible_text("<div>" * 3000 + "deep") == "deep"
    assert visible_text("<a href='x>y") == "<a href='x>y"
    assert visible_text("word " * 200_000).count("word") == 200_000
    pages = documents(spark, [(1, "<p>a"), (1, "<p>a"), (2, None), (3, "")]).withColumnRenamed("text", "html")
    got = extract(pages.withColumn("text", F.lit("clash"))).select("doc_id", "text").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (1, "a"), (2, None), (3, "")]
    assert extract(pages.limit(0)).count() == 0


def test_no_visible_word_is_lost_or_made_up(spark):
    """Brute force on real pages: cut what is never shown, drop all tags, compare the words."""
    for row in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect():
        plain = re.sub(r"(?s)<!--.*?-->|<(head|script|style)\b.*?</\1>", " ", row.html)
        plain = re.sub(r"</?(b|a|i|em|span)\b[^>]*>", "", plain)
        import html

        plain = html.unescape(re.sub(r"<[^>]*>", " ", plain))
        shown = [w for line in visible_text(row.html).split("\n") for w in line.split() if w != "-"]
        assert shown == [w for w in plain.split() if w != "-"]
