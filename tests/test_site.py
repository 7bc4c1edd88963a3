"""Cases of the site engine, as data."""

import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import cleaning, html, text, urls
from marlstone.operators import site
from marlstone.sources import web


def run(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [x[0] for x in rows.orderBy("k").select(f(F.col("v"))).collect()]


def test_paths(spark):
    cases = {"https://a.org/docs/guide": "docs/guide.md", "https://a.org/": "index.md", "https://a.org/x.html": "x.md", "https://a.org/x.htm": "x.md", "https://a.org/a/b/c/d": "a/b/c/d.md", "https://a.org/é b": "é_b.md"}
    assert run(spark, urls.to_file, cases) == list(cases.values())


def test_canonical_and_navigable(spark):
    assert run(spark, urls.canonical, ["https://a.org/x/", "https://a.org", "", "https://a.org/x?q#f"]) == ["https://a.org/x", "https://a.org/", None, "https://a.org/x"]
    assert run(spark, urls.navigable, ["https://a.org/x", "https://a.org/x.PDF", "https://a.org/x.html"]) == [True, False, True]


def test_scope(spark):
    s = site.Scope("https://a.org", ["/docs/"], ["/docs/old", "([bad"])
    cases = {"https://a.org/docs/x": True, "https://a.org/docs-old": False, "https://a.org/docs/old/x": False, "https://b.org/docs/x": False, "https://a.org/blog": False}
    assert run(spark, s.column, cases) == list(cases.values())
    assert run(spark, site.Scope("https://a.org", ["([bad"]).column, ["https://a.org/x"]) == [False]


def test_title():
    assert html.convert("<h1>A <b>B</b></h1><title>T</title>")[0] == "AB"
    assert html.convert("<title>T</title>")[0] == "T"
    assert html.convert("<p>x</p>", fallback_title="F")[0] == "F"
    assert html.convert("")[0] == "Untitled"


def test_markdown():
    md = html.convert("<main><nav>n</nav><h2>H</h2><p>a <b>b</b> <a href='/x'>x</a></p><ul><li>1</li><li>2</li></ul><pre class='language-py'><span class='line'>p</span><span class='line'>q</span></pre></main>")[1]
    assert md == "## H\n\na **b** [x](/x)\n\n* 1\n* 2\n\n```py\np\nq\n```"


def test_sidebar():
    links = lambda n: "<main><div class='sidebar'>" + "<a href='x'>x</a>" * n + "</div><p>body</p></main>"
    assert "[x]" in html.convert(links(7))[1] and "[x]" not in html.convert(links(8))[1]


def test_clean(spark):
    cases = {
        "```language-js\nx = 1\n```": ("```javascript", "language-js"), "```Python\nx = 1\n```": ("```python", "Python"), "```sh\nls\n```": ("```bash", "```sh\n"),
        "text\nCopy to clipboard\nmore": ("more", "Copy"), "text\n[Edit this page](https://x)\n": ("text", "Edit"), "“a” — b’s": ('"a" -- b\'s', "“"),
        "## H¶\n\ntext": ("## H", "¶"), "a\n\n```\n\n```\nb": ("b", "```"), "a\n\n\n\n\n\nb": ("b", "\n\n"),
    }
    for (given, (has, lacks)), out in zip(cases.items(), run(spark, cleaning.clean, cases), strict=True):
        assert has in out and lacks not in out, (given, out)


def test_duplicate_headings(spark):
    assert run(spark, cleaning.duplicate_headings, ["# A\n# A\nx\n## A\n# B\n# a"]) == ["# A\nx\n## A\n# B"]


def test_toc_and_footer(spark):
    assert run(spark, cleaning.toc_after_title, ["# T\n\n* [One](#one)\n* [Two](#two)\n---\nbody of text", "# T\nbody of text\n* [One](#one)"]) == ["# T\nbody of text", "# T\nbody of text\n* [One](#one)"]
    assert run(spark, cleaning.footer, ["a b\nc d\ne f\ng h\nCopyright X\n\nMenu", "a\nMenu"]) == ["a b\nc d\ne f\ng h", "a\nMenu"]


def test_ui_patterns_equal_python(spark):
    words = ["Copy code", "Expand", "v1.2", "[](#a)", "Back", "or", "text", "Copyright © X", "Home > a", "12", "Subscribe."]
    given = ["\n".join(words[k:] + words[:k]) for k in range(len(words))]

    def plain(x):
        for p in cleaning.UI_ARTIFACT_PATTERNS:
            x = re.sub(p, "", x, flags=re.I | re.M)
        return x

    assert run(spark, cleaning.ui_artifacts, given) == [plain(x) for x in given]


def test_repeated_blocks(spark):
    long = "a block that repeats on every page"
    rows = spark.createDataFrame([(p, k, b) for p in "xyz" for k, b in enumerate([long, f"the only text of page {p}", "short"])] + [("w", 0, long)], "page string, pos int, block string")
    repeated = site.repeated_blocks(rows)
    assert [tuple(x) for x in repeated.collect()] == [(long, 4)]
    out = {x["page"]: (x["content"], x["removed"]) for x in site.remove_repeated(rows, repeated).collect()}
    assert out["w"] == ("", 1) and out["x"] == ("the only text of page x\n\nshort", 1)


def test_blocks(spark):
    rows = spark.createDataFrame([("a\nb\n\n \n# T\nc\n## U\n\n\nd",)], "v string")
    assert rows.select(text.blocks(F.col("v"))).first()[0] == ["a\nb", "# T\nc\n## U", "d"]


def test_rules():
    index = "[X]|root: ./md/raw|a/:{b}"
    once = site.render_rule("claude", "x", index, "hello\n")
    assert site.render_rule("claude", "x", index, once) == once
    assert site.remove_rule(once, "x") == "hello\n"
    assert site.render_rule("cursor", "x", index).startswith("---\ndescription: x")
    with pytest.raises(ValueError, match="name"):
        site.render_rule("claude", "../x", index)


def test_fetch(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "url string")
    assert [x["url"] for x in web.fetch(rows, 2, lambda u: "<p>" if u == "a" else None).collect()] == ["a"]


def test_robots(spark):
    rows = spark.createDataFrame([("https://a", "User-agent: *\nSitemap: https://a/s.xml"), ("https://b", "")], "base string, txt string")
    out = sorted((x["base"], x["ord"], x["location"]) for x in web.robots_sitemaps(rows).collect())
    assert out[0] == ("https://a", 0, "https://a/s.xml") and out[1] == ("https://b", 0, "https://b/sitemap.xml") and len(out) == 5


def test_crawl(spark):
    page = lambda *to: "".join(f'<a href="{x}">x</a>' for x in to)
    rows = spark.createDataFrame([("https://a.org/", page("/b", "/c.pdf", "https://z.org/")), ("https://a.org/b", page("/", "/d#x")), ("https://a.org/d", page()), ("https://a.org/e", page())], "url string, html string")
    assert {(x["c"], x["depth"]) for x in site.crawl(rows, "https://a.org/").collect()} == {("https://a.org/", 0), ("https://a.org/b", 1), ("https://a.org/d", 2)}
