"""Page differencing where the nearest pages are copies, empty or without anything in common."""

import pytest

from tabweave.llm.html_diff import OTHER, extract_pages, template_lines


def html(story):
    return f"<div>Menu</div><p>{story}</p><div>Imprint</div>"


def test_a_neighbour_that_shares_nothing_is_passed_over():
    page = ("h", "/a/1", [1, 2, 3], [OTHER] * 3)
    assert template_lines(page, [("h", "/a/2", [9], [OTHER]), ("h", "/b", [1, 8, 3], [OTHER] * 3)]) == [0, 2]


@pytest.mark.parametrize("parts", ["1", "5"])
def test_copies_and_empty_pages(spark, parts):
    rows = [(i, f"http://copies.example/a?utm={i}", html("story one")) for i in range(9)] + [(9, "http://copies.example/b", html("story two"))]
    rows += [(20, "http://gaps.example/a", html("first")), (21, "http://gaps.example/ab", ""), (22, "http://gaps.example/abc", None)]
    rows += [(23, "http://gaps.example/b", html("second")), (24, "http://gaps.example/ba", "<p>moved</p>")]
    rows += [(30 + i, f"http://only.example/{i}", html("the same")) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.page_id: r.text for r in extract_pages(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = dict.fromkeys(range(9), "story one") | {9: "story two", 20: "first", 21: "", 22: "", 23: "second", 24: "moved"}
    # Nothing tells a template where all pages are copies.
    want |= dict.fromkeys(range(30, 34), "Menu\n\nthe same\n\nImprint")
    assert got == want
