"""Page differencing: parsing, alignment, pairing over partitions, odd rows."""

import random

import pytest

from tabweave.llm.html_diff import MAIN, OTHER, common_lines, extract_pages, host_and_path, page_lines, template_lines


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    draw = random.Random(0)
    for _ in range(1500):
        k = draw.choice([2, 4, 9])
        a, b = ([draw.randrange(k) for _ in range(draw.randrange(25))] for _ in range(2))
        at = common_lines(a, b)
        rest = iter(b)
        assert at == sorted(set(at)) and all(a[i] in rest for i in at) and len(at) == lcs(a, b)


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        ("", []),
        ("plain &amp; text", ["plain & text"]),
        ("<p>a\n  b<br>c</p><p>d", ["a b c", "d"]),
        ("<p>a<script>var x='</p><p>no'</script>b</p>", ["ab"]),
        ("<!-- <p>no</p> --><p>x<!--y-->z</p><!-- open", ["xz"]),
        ("<div>x &lt;b&gt; &copy; &#233;&nbsp;y</div>", ["x <b> © é y"]),
        ("<body><header>Site</header><nav><ul><li>m</ul></nav><p>t</p><aside>s</aside><footer>f</footer>", ["t"]),
        ("<div class='ad'>buy<div>now</div></div><p>t</p><div class='comment-list'><p>nice</p></div>", ["t"]),
        ("<div id=cookie-notice>ok?</div><div class=sidebar><p>s</p></div><form><p>mail</p></form><p>t</p>", ["t"]),
        ("<div role=navigation>m</div><div hidden>h</div><div style='display: none'>n</div><p>t</p>", ["t"]),
        ("<p title='a > b'>x 1 < 2 y</p>", ["x 1 < 2 y"]),
        ("<p>cut <a href='no end", ["cut"]),
        ("<style>p{}</style><title>T</title><P>Upper</P>", ["Upper"]),
        ("<body class='has-sidebar'><p>t</p>", ["t"]),
        ("<div><div class=alert-level-high>a</div><div class=banner-image>b</div><div class=ad-slot>c</div></div>", ["a", "b"]),
        ("<div class=share><ul><li>x</ul><p>Body</p>", ["Body"]),
        ("<div><footer>f<div>g</div></div><p>t</p>", ["t"]),
        ("<p>a <span class=share>s</b></span> b</p><p>c", ["a b", "c"]),
        ("<p class=ad>buy<p>t", ["t"]),
    ],
)
def test_lines(html, lines):
    assert page_lines(html) == [(OTHER, t) for t in lines]


def test_marked_article():
    html = "<p>before</p><article><header><h1>T</h1></header><p>one<p>two<div class=share>s</div></article><p>after</p>"
    assert page_lines(html) == [(OTHER, "before"), (MAIN, "T"), (MAIN, "one"), (MAIN, "two"), (OTHER, "after")]


@pytest.mark.parametrize(
    ("html", "marked"),
    [
        ("<nav><ul><li>Menu</ul><main><p>Article</p></main>", ["Article"]),
        ("<header>H<article><p>Article</article>", ["Article"]),
        ("<article><h1>T</h1><div class='share'>s<p>Body</article>", ["T", "Body"]),
        ("<article class=post-comments-free><p>Body</article>", ["Body"]),
        ("<article class=comments><p>Body</article><article class=comment>c</article>", ["Body"]),
        ("<article><p class=alert-level-high>a<p class=banner-image>b</article>", ["a", "b"]),
    ],
)
def test_article_survives_elements_without_an_end(html, marked):
    assert page_lines(html) == [(MAIN, t) for t in marked]


def test_unclosed_elements_take_linear_time():
    html = "<div class=ad><i>" * 30_000 + "</b></i></span>" * 30_000 + "<p>end"
    assert page_lines(html)[-1] == (OTHER, "end")


def test_nearest_neighbour_decides():
    page = ("h", "/a/1", [1, 2, 3], [OTHER] * 3)
    near, far = ("h", "/a/2", [1, 9, 3], [OTHER] * 3), ("h", "/b", [2], [OTHER])
    assert template_lines(page, [far, near]) == [0, 2]
    assert template_lines(page, [("h", "/a/1", [1, 2, 3], [OTHER] * 3), far]) == [1]  # a copy says nothing
    assert template_lines(page, [("other", "/a/2", [1], [OTHER])]) == []
    assert template_lines(("h", "/a/1", [1, 2, 3, 3], [OTHER, MAIN, MAIN, OTHER]), [near]) == [0]
    assert template_lines(("h", "/a/1", [1, 2], [MAIN, MAIN]), [near]) == []


def site(n, host="s.example"):
    return [(i, f"http://{host}/p/{i:04d}", f"<div>Menu {host}</div><p>Story number {i} {host}</p><div>Imprint</div>") for i in range(n)]


@pytest.mark.parametrize("parts", ["1", "7", "60"])
def test_templates_go_whatever_the_partitions(spark, parts):
    rows = site(50) + site(1, "lonely.example") + site(3, "small.example")
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.url: r.text for r in extract_pages(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 54
    for i, url, _ in rows:
        host = host_and_path(url)[0]
        alone = host == "lonely.example"
        assert got[url] == (f"Menu {host}\n\nStory number {i} {host}\n\nImprint" if alone else f"Story number {i} {host}")


def test_odd_rows(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x"), (2, None, "", "x"), (3, "nourl", "<p>t</p>", "x"), (None, "http://a/", "<p>u</p>", "x"),
            (4, "http://a/", long, "x"), (4, "http://a/", long, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = extract_pages(df)
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in out.collect())
    text = "\n\n".join(["word & word"] * 20_000)
    assert got == [(0, "u", 1), (1, "", 0), (2, "", 0), (3, "t", 1), (4, text, len(text)), (4, text, len(text))]
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert extract_pages(df.limit(0)).count() == 0


def test_marks_check_what_differencing_leaves(spark):
    menu, card = "<div>Menu</div>", "<article class=card>teaser</article>"
    rows = [(i, f"http://h/{i}", f"{menu}<div id=content><p>Real body of page {i}</div>{card}") for i in range(4)]
    rows += [(i, f"http://k/{i}", f"{menu}<article><p>Article {i}<p>Shared line</article><div>x{i}</div>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.url: r.text for r in extract_pages(df).collect()}
    assert all(got[f"http://h/{i}"] == f"Real body of page {i}" for i in range(4))
    assert all(got[f"http://k/{i}"] == f"Article {i}\n\nShared line" for i in range(4))


def test_given_pages(spark):
    import html
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    for r in df.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inside)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
