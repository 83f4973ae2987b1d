import pytest
from pyspark.sql import functions as F

from airmetrics.llm.queries import URL_RULES
from airmetrics.llm.urls import judge, matching_rule, parts
from tests.llm.helpers import documents


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://Blog.EXAMPLE.org/es/7?x#y", "blog.example.org", "/es/7", "example.org/es/", "block"),
        ("https://example.org/en/19", "example.org", "/en/19", "example.org/en/1", "block"),
        ("https://a.org/en/29", "a.org", "/en/29", "org/", "allow"),
        ("https://a.org", "a.org", "", None, None),
        ("https://a.org?x=/en", "a.org", "", None, None),
        ("x://y://z.com/fr/", "y:", "//z.com/fr/", None, None),
        ("https://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"),
        ("https://b.com/de/1#/", "b.com", "/de/1", "com/de/", "block"),
        ("https://xcom/de/1", "xcom", "/de/1", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://É.com/de/é", "É.com", "/de/é", "com/de/", "block"),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule, verdict):
    frame = spark.createDataFrame([(url,)], "url string")
    h, p = parts(F.col("url"))
    row = frame.select(h.alias("h"), p.alias("p")).withColumn("r", matching_rule(F.col("h"), F.col("p"), URL_RULES)).first()
    assert (row.h, row.p) == (host, path)
    assert (row.r.rule if row.r else None, row.r.verdict if row.r else None) == (rule, verdict)


def _pages(spark, rows):
    return documents(spark, rows, "page_id long, url string, verdict string")


def test_bad_templates_are_rejected(spark):
    urls = [f"http://h.net/good/{k}" for k in range(60)] + [f"http://h.net/bad/{k + 60}" for k in range(60)]
    urls += [f"http://h.net/user/name{chr(97 + k % 26)}{chr(97 + k // 26)}/about" for k in range(60)]
    urls += ["http://h.net/good/9999", "http://h.net/bad/9998", "http://other.net/bad/1000000"]
    rows = list(enumerate(urls)) + [(900, None), (901, "junk"), (0, urls[0])]
    labels = spark.createDataFrame([(k, 0) for k in range(60)] + [(60 + k, 1) for k in range(60)], "label_id long, bad long")
    got = judge(_pages(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by_path = {(r.host, r.path): r for r in got}
    assert by_path["h.net", "/good/9999"].verdict == "allow"
    assert by_path["h.net", "/bad/9998"].verdict == "block"
    assert by_path["other.net", "/bad/1000000"].verdict == by_path["", ""].verdict
    assert {r.template for r in got if r.path.startswith("/user/")} == {"user/*/about"}


def test_a_bad_branch_at_depth_six(spark):
    urls = [f"http://h.net/a/b/c/d/e/{('good', 'bad')[k % 2]}/{k}" for k in range(120)]
    urls += [f"http://h.net/a/b/c/d/e/user/{chr(97 + k % 26)}{chr(97 + k // 26)}/about" for k in range(60)]
    urls += ["http://h.net/a/b/c/d/e/good/9998", "http://h.net/a/b/c/d/e/bad/9999", "http://o.net/a/b/c/d/e/bad/9997"]
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "label_id long, bad long")
    got = {(r.host, r.path): r for r in judge(_pages(spark, list(enumerate(urls))), labels).collect()}
    assert len(got) == len(urls)
    for (host, path), row in got.items():
        if host == "h.net" and "/user/" not in path:
            assert row.verdict == ("block" if "/bad/" in path else "allow"), path
    assert {r.template for (_, path), r in got.items() if "/user/" in path} == {"a/b/c/d/e/user/*/about"}
    unlabelled = got["o.net", "/a/b/c/d/e/bad/9997"]
    assert unlabelled.template == "a/b/c/d/**" and unlabelled.purity == 0.5


def test_one_endless_path_does_not_deepen_the_work(spark):
    pages = _pages(spark, [(1, "http://h.net/" + "x/" * 600 + "7")])
    labels = spark.createDataFrame([(7, 1)], "label_id long, bad long")
    row = judge(pages, labels).first()
    assert row.template == "x/" * 600 + "*" and row.purity > 0.5


def test_similar_branches_share_their_labels(spark):
    """/a/* has too few labels to judge alone; its kin has the same share of bad ones."""
    urls = [f"http://h.net/a/{k}" for k in range(4)] + [f"http://h.net/b/{k + 4}" for k in range(80)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(84)], "label_id long, bad long")
    got = judge(_pages(spark, list(enumerate(urls))), labels)
    assert {r.verdict for r in got.collect()} == {"block"}
    assert got.select("purity").distinct().count() == 1


def test_without_pages_or_labels(spark):
    labels = spark.createDataFrame([], "label_id long, bad long")
    pages = _pages(spark, [(1, "http://h.net/x/y/z/w/v/u"), (2, "http://h.net/")])
    assert judge(pages.limit(0), labels).count() == 0
    rows = {r.page_id: r for r in judge(pages, labels).collect()}
    assert rows[1].template == "x/y/z/w/**" and rows[1].purity == 0.5
