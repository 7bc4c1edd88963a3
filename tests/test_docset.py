"""Pages of all kinds, links, sources, rules, document sets, and their catalogue."""

import hashlib
import json
import re
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone import queries
from marlstone.cli import main
from marlstone.functions import cleaning, html, urls
from marlstone.operators import rules, site
from marlstone.plans import site as plan
from marlstone.sources import web
from marlstone.streaming.pages import stream_pages


def column(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [x[0] for x in rows.orderBy("k").select(f(F.col("v"))).collect()]


def test_content_is_sought_in_order():
    page = "<body><div class='ad'>buy this</div><article><p>the article</p></article><div class='content'>other</div></body>"
    assert html.convert(page)[1] == "the article" and html.convert(page, ".content")[1] == "other" and html.convert(page, "[[bad")[1] == "the article"
    assert html.convert(page.replace("article>", "b>"))[1] == "other" and html.convert("<p>x</p>")[1] == ""


def test_page_content_is_as_its_sql_has_it(spark, tmp_path):
    import duckdb

    ad = '<div class="ad">twenty &amp; chars &quot; and more</div>'
    given = [None, "", "<p>x", "<title>t</title>", "<h1>a&quot;b &amp;amp; &lt;c&gt; d&amp</h1>", "<h1> \n T\u00a0</h1>", "<h1></h1>", f"<h1>{'&amp;' * 150}{'x' * 100}</h1>", "<h1><b>n</b></h1>", "<h1>&nbsp;&#65;\ue000</h1>", ad + "<article>t</article>", f"{ad}<article>x{ad}</article>", '<main><a href="x&amp;y">1</a></main>']
    spark.createDataFrame([(k, f"https://a.org/{k}", x) for k, x in enumerate(given)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(queries.ORACLES["page_content"]).fetchall())
    assert sorted(tuple(x) for x in queries.QUERIES["page_content"](spark, str(tmp_path)).collect()) == want and want[4][1] == "a&quot;b &amp; <c> d&amp"
    assert html.convert(given[4])[0] == 'a"b &amp; <c> d&' and html.convert(given[12], written=True)[2] == ["x&amp;y"]


def test_pages_of_any_depth(spark):
    began = time.time()
    for tag in ("p", "div", "ul><li", "blockquote", "b", "table><tr><td"):
        n = 50_000 if tag in ("p", "div", "b") else 2_000
        got = html.convert("<main>" + f"<{tag}>" * n + "deep text")
        assert "deep text" in got[1], tag
    assert html.sanitize("<div>" * 50_000 + "x").count("<div>") > 2000 and html.title_of(html.parse("<h1>" + "<b>" * 30_000 + "T")) == "T"
    assert "row" in html.convert("<main><pre>" + "row<br>" * 50_000 + "</pre></main>")[1] and time.time() - began < 60
    pages = spark.createDataFrame([("https://a.org/x", "<main>" + "<p>" * 2000 + "a text of more than twenty characters"), ("https://a.org/y", None)], "url string, html string")
    assert [x["url"] for x in plan.documents(pages).collect()] == ["https://a.org/x"]


def test_workers_hold_few_pages(spark, tmp_path):
    pages = pa.array([f"<main><p>{k}{'x' * 20_000}</p><a href='{k}'>y</a></main>" for k in range(1000)] + [None])
    for f in (html.previews, html.links, html.page()):
        n, last = 0, None
        tracemalloc.start()
        for part in f.func(iter([pages])):
            n, last = n + len(part), part[-1].as_py()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 1001 and peak < 8e6, peak  # of 20 MB of pages
        assert last in ([], {"preview": "", "sanitized": ""}, {"title": "Untitled", "markdown": "", "links": [], "selector": "main", "error": None})

    given = ["<h1>é</h1>", None, "", "<b>" + "y" * (html.PART + 5), "<script>x</script>z"] * 3
    spark.createDataFrame(list(enumerate(given)), "page_id int, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["html_preview"](spark, str(tmp_path)).collect()
    assert {tuple(x) for x in got} == {(k, html.preview(x), html.sanitize(x)) for k, x in enumerate(given)} and len(got) == len(given)


def test_a_page_that_fails_says_why(spark, monkeypatch):
    one = spark.createDataFrame([("<main>x</main>",)], "html string").select(html.page("main", (7,))("html").alias("p")).select("p.*").first()
    assert one["markdown"] is None and "Error" in one["error"]


def test_relative_urls(spark):
    page = F.lit("https://a.org/docs/guide/")
    cases = {"x": "https://a.org/docs/guide/x", "../y/": "https://a.org/docs/y", "/z": "https://a.org/z", "//b.org/q?x": "https://b.org/q", "https://c.org": "https://c.org/", "": None, "?p": "https://a.org/docs/guide"}
    assert column(spark, lambda c: urls.canonical(c, page), cases) == list(cases.values())
    assert column(spark, urls.canonical, ["guide/x", "/z", ""]) == [None, None, None]
    assert html.links_of("<a href='x&amp;y'><A HREF=z><a name=q><area href=n>") == ["x&y", "z"]


def test_sitemaps_that_are_broken(spark):
    ns = "http://www.sitemaps.org/schemas/sitemap/0.9"
    files = [("i", f'<sitemapindex xmlns="{ns}"><sitemap><loc>b</loc></sitemap><sitemap><loc>a</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>'), ("a", f'<urlset xmlns="{ns}"><url><loc>a1</loc></url></urlset>'), ("b", f'<urlset xmlns="{ns}"><url><loc>b1'), ("c", None), ("d", "no xml")]
    top = spark.createDataFrame([(0, "i"), (1, "b"), (2, "c"), (3, "d"), (4, "a")], "ord int, location string")
    got = [(x["ord"], x["url"]) for x in web.sitemap_urls(spark.createDataFrame(files, "location string, xml string"), top).orderBy("ord", "pos").collect()]
    assert set(got) == {(0, "a1"), (4, "a1")}
    first = web.robots_sitemaps(spark.createDataFrame([("https://b", "")], "base string, txt string"), lambda u: u.endswith("index.xml"))
    assert [x["location"] for x in first.collect()] == ["https://b/sitemap_index.xml"]


def test_fetching(spark, monkeypatch):
    tried = []

    def answer(request, timeout):
        tried.append(request.full_url)
        raise web.urllib.error.HTTPError(request.full_url, 404 if "gone" in request.full_url else 500, "", {}, None)

    monkeypatch.setattr(web.urllib.request, "urlopen", answer)
    assert web.fetch_one("https://a.org/gone", pause=lambda s: None) is None and len(tried) == 1
    assert web.fetch_one("https://a.org/x", pause=lambda s: None) is None and len(tried) == 5
    rows = spark.createDataFrame([("a",), ("b",)], "url string")
    shown = web.fetch(rows, engine="selenium", render=lambda us: ((u, f"<p>{u}" if u == "a" else None) for u in us))
    assert [tuple(x) for x in shown.collect()] == [("a", "<p>a")]
    assert web.trial("u", lambda u: "plain", lambda us: iter([("u", "shown")])) == ("plain", "shown") and web.trial("u", lambda u: None, lambda us: 1 / 0) == (None, None)
    with pytest.raises(ValueError, match="engine"):
        web.fetch(rows, engine="other")


def test_patterns_of_either_dialect(spark):
    s = site.Scope("https://a.org", [r"/(?P<kind>docs|doc)/", "(?(1)x)", "([bad"])
    assert site.Scope.valid(s.include) == [s.include[0]]
    assert column(spark, s.column, ["https://a.org/docs/x", "https://a.org/x"]) == [True, False]


def test_artifacts_without_signs_stay(spark):
    given = ["plain text", "text\nsend\nmore", "a\n 12 \nb", "ſubscribe", "x\nor\ny", "SIGN UP.", "an expandable tent", "v1.2\n", "[](#x)", "hoKme > x", "menu"]
    def plain(x):
        for p in cleaning.UI_ARTIFACT_PATTERNS:
            x = re.sub(p, "", x, flags=re.I | re.M)
        return x

    assert column(spark, cleaning.ui_artifacts, given) == [plain(x) for x in given]


class Said:
    def __init__(self, *answers):
        self.answers, self.prompts = list(answers), []

    def propose(self, text):
        self.prompts.append(text)
        x = self.answers.pop(0) if self.answers else None
        if isinstance(x, Exception):
            raise x
        return x


def test_rules(spark):
    links = spark.createDataFrame([(f"https://a.org/{k}/p{i}",) for k in ("guide", "blog") for i in range(5)], "url string")
    start, still = "https://a.org/guide/", lambda s: None
    good = '```json\n{"scope_rules": {"include_patterns": ["/guide/", "([bad"], "exclude_patterns": []}, "selector_spec": {"content_selector": ".doc", "prune_selectors": [".x"]}}\n```'
    bad = '{"scope_rules": {"include_patterns": ["/none/"]}, "selector_spec": {"content_selector": ".seen"}}'
    a = rules.analyze(links, start, "", Said(bad, ValueError("busy"), "", good), pause=still)
    assert a.scope.include == ["/guide/"] and a.selector == ".doc" and a.prunes == [".x"]
    p = Said(bad, bad, bad, good)
    b = rules.analyze(links, start, "", p, pause=still)
    assert b.scope.include == ["/guide/"] and b.selector == ".seen" and len(p.prompts) == 3 and "no include match" in p.prompts[1] and "/guide/p0" in p.prompts[1]
    c = rules.analyze(links, start, "<article>x</article>", Said("no json"), pause=still)
    assert c.selector == "article" and c.scope.exclude == list(site.EXCLUDES)
    assert rules.refined(a, ["page"], Said('[".y", ".x", 3]'), still).prunes == [".x", ".y"] and rules.refined(a, [], Said("?"), still) is a
    assert rules.asked(Said(), "", still) is None and json.loads(json.dumps(a.as_dict()))["selector_spec"]["content_selector"] == ".doc"


def test_docset_round_trip(spark, tmp_path):
    body = lambda k: f"<html><body><div class='ad'>buy now</div><article><h1>Page {k}</h1><p>The text of page number {k}, long enough to stay.</p><p>The same footer on every page.</p></article></body></html>"
    rows = [(f"https://a.org/guide/p{k}", body(k)) for k in range(6)] + [("https://a.org/guide/p1?x=1", body(99)), ("https://a.org/blog/b", body(7)), ("https://a.org/guide/", body("start")), ("https://a.org/guide/empty", "<p></p>")]
    pages = spark.createDataFrame(rows, "url string, html string")
    root = f"{tmp_path}/sets"
    totals = plan.build_docset(pages, "https://a.org/guide/", f"{root}/a-docs", "a-docs")
    assert totals["total_pages"] == totals["total_files"] == 7
    said = json.loads((tmp_path / "sets/a-docs/manifest.json").read_text())
    for x in said["entries"]:
        raw = (tmp_path / "sets/a-docs/md/raw" / x["md_raw_path"]).read_bytes()
        assert (len(raw), hashlib.md5(raw).hexdigest()) == (x["size_bytes"], x["content_hash"]) and b"buy now" not in raw
    index = (tmp_path / "sets/a-docs/AGENTS.md").read_text()
    assert index.startswith("[a-docs Docs Index]|root: ./md/raw|") and "guide/:{p0.md,p1.md" in index and index.endswith("}\n")
    (tmp_path / "sets/other").mkdir()
    (tmp_path / "sets/other/AGENTS.md").write_text("[o]|root: x|source: https://o.org |a/:{b}\n")
    got = {x["name"]: x for x in site.catalog(spark, root).collect()}
    assert got["a-docs"]["total_pages"] == 7 and got["a-docs"]["source_url"] == "https://a.org/guide/" and got["other"]["source_url"] == "https://o.org"
    assert got["a-docs"]["size_bytes"] == sum(p.stat().st_size for p in (tmp_path / "sets/a-docs").rglob("*") if p.is_file() and p.suffix != ".crc")
    assert {x["path"] for x in web.markdown_tree(spark, f"{root}/a-docs/md/raw").collect()} == {x["md_raw_path"] for x in said["entries"]} and web.first_files(spark, f"{root}/a-docs/md/raw").count() == 3

    project = str(tmp_path / "project")
    for tool in site.ROOTS:
        site.install(spark, root, "a-docs", project, tool)
        site.install(spark, root, "a-docs", project, tool)
        assert site.installed(spark, project, tool) == ["a-docs"]
        assert (tmp_path / "project" / site.ROOTS[tool] / "a-docs/guide/p0.md").exists()
    (tmp_path / "project/CLAUDE.md").write_text("mine\n\n" + (tmp_path / "project/CLAUDE.md").read_text())
    for tool in site.ROOTS:
        assert site.uninstall(spark, "a-docs", project, tool) and site.installed(spark, project, tool) == []
    assert (tmp_path / "project/CLAUDE.md").read_text() == "mine\n"
    assert site.docset_path(spark, root, "a-docs", raw=True).endswith("md/raw") and site.docset_path(spark, root, "none") is None
    for bad in ("../a-docs", "", "a/b"):
        with pytest.raises(ValueError, match="name"):
            site.delete_docset(spark, root, bad)
    assert main(["list", "--root", root]) == 0 and main(["delete", "--root", root, "a-docs"]) == 0 and not site.delete_docset(spark, root, "a-docs")
    assert site.plan_scrape("https://a.org/x", "n", "/s").endswith("--name n --out /s/n --max-pages 500")
    with pytest.raises(ValueError, match="URL"):
        site.plan_scrape("https://a.org/x; rm", "n", "/s")
    assert site.catalog(spark, f"{tmp_path}/nowhere").count() == 0 and site.storage_root({"HOME": "/h"}) == "/h/.local/share/docs"


def test_a_poor_crawl_asks_once_more(spark, tmp_path):
    rows = [(f"https://a.org/{k}/p{i}", "<p></p>" if k == "api" else f"<main><p>A text that is long enough, number {i}.</p></main>") for k in ("api", "guide") for i in range(8)]
    answer = lambda k: json.dumps({"scope_rules": {"include_patterns": [f"/{k}/"]}})
    p = Said(answer("api"), answer("guide"))
    pages = spark.createDataFrame([*rows, ("https://a.org/api/guide/", "<p></p>")], "url string, html string")
    totals = plan.build_docset(pages, "https://a.org/api/guide/", f"{tmp_path}/s", provider=p)
    assert totals["total_pages"] == 8 and "0%" in p.prompts[1]


def test_ledger(spark, tmp_path):
    path, ran = f"{tmp_path}/ledger.json", []

    def scrape(name):
        ran.append(name)
        if name == "b" and len(ran) < 3:
            raise OSError("down")
        return 4

    site.run_batch(site.Ledger(spark, path), ["a", "b"], scrape)
    again = site.Ledger(spark, path)
    assert [tuple(x) for x in site.batch_totals(again.table()).collect()] == [(1, 1, 4)]
    site.run_batch(again, ["a", "b"], scrape)
    assert ran == ["a", "b", "b"] and [tuple(x) for x in site.batch_totals(site.Ledger(spark, path).table()).collect()] == [(2, 0, 8)]
    (tmp_path / "broken.json").write_text("[{")
    assert site.Ledger(spark, f"{tmp_path}/broken.json").rows == []


def test_small_operators(spark):
    links = spark.createDataFrame([(f"https://a.org/docs/p{k:02d}",) for k in range(12)] + [("https://a.org/blog/x",)], "url string")
    assert site.scope_report(links, site.Scope("https://a.org", ["/docs/"]), "https://a.org/docs/").first() == (12, 1)
    assert site.examples(links).count() == 10 and site.scope_report(links, site.Scope("https://a.org", ["/docs/"]), "https://a.org/x").first()["n_match"] == 0
    assert [x["reason"] for x in site.reject_reasons(links, site.Scope("https://a.org", [], ["/blog"])).collect()] == ["excluded by '/blog'"]
    assert spark.range(1).select(site.size_mb(F.lit(1_600_000))).first()[0] == 1.5
    assert json.loads(site.decision_json(queries.engine_choice(spark, "").filter("variant = 'all'")))["mode"] == "selenium"
    en = spark.createDataFrame([(f"https://a.org/{loc}/p{k}",) for loc in ("en", "de") for k in range(6)] + [("https://a.org/x",)], "url string")
    assert site.one_locale(en, "https://a.org/en/docs").count() == 7
    many = site.frontier(spark.range(50).select(F.lit("https://a.org/x/").alias("url"), (-F.col("id")).alias("ord"), F.lit(0).alias("priority"), F.col("id").alias("more")))
    assert [(x["canonical"], x["ord"], x["more"]) for x in many.collect()] == [("https://a.org/x", -49, 49)]
    assert html.detect_selector("<article>") == "article" and html.sanitize('<script>x</script><b>"""</b>') == "<b>'''</b>"


def test_stream(spark, tmp_path):
    rows = [("https://a.org/x", "<main><p>A text that is long enough to stay.</p></main>", "2024-01-01 00:00:00")] * 2 + [("https://a.org/y", "<p>", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "url string, html string, at string").select("url", "html", F.to_timestamp("at").alias("fetched_at")).write.parquet(f"{tmp_path}/in")
    q = stream_pages(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [x["url"] for x in spark.table("streamed").collect()] == ["https://a.org/x"]
