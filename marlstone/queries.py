"""Queries of the site engine and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cleaning, html, text, urls
from .functions.cleaning import UI_ARTIFACT_PATTERNS
from .operators import site
from .plans import site as plan
from .sources import web

START = "https://src0.example.org/en/"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_S = r"'^([^:/?#]+)://([^/?#]*)([^?#;]*)'"
_PATH, _HOST, _BASE = f"regexp_extract(url, {_S}, 3)", f"regexp_extract(url, {_S}, 2)", f"regexp_extract(url, {_S}, 1) || '://' || regexp_extract(url, {_S}, 2)"
_CANON = f"({_BASE} || coalesce(nullif(rtrim({_PATH}, '/'), ''), '/'))"
_FILE = rf"(regexp_replace(regexp_replace(coalesce(nullif(trim({_PATH}, '/'), ''), 'index'), '\.html?$', ''), '[^\w/\-.]', '_', 'g') || '.md')"
_NAV = "'" + urls.NAVIGABLE + "'"
_SEG = rf"CASE WHEN regexp_extract({_PATH}, '^/*([^/]*)', 1) = '' THEN '/' ELSE '/' || regexp_extract({_PATH}, '^/*([^/]*)', 1) || '/' END"


@query(f"SELECT page_id, {_CANON} AS canonical, {_HOST} AS host, {_PATH} AS path FROM pages")
def url_canonicalize(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", urls.canonical(u).alias("canonical"), urls.host(u).alias("host"), urls.path(u).alias("path"))


@query(f"SELECT page_id, {_FILE} AS md_path, NOT regexp_matches(lower({_PATH}), {_NAV}) AS navigable FROM pages")
def url_to_path(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.to_file(F.col("url")).alias("md_path"), urls.navigable(F.col("url")).alias("navigable"))


@query(f"""WITH t AS (SELECT {_SEG} AS segment, {_PATH} AS path, url FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY path, url) AS k FROM t)
SELECT segment, count(*) AS n, string_agg(path, ',' ORDER BY k) FILTER (k <= 5) AS paths, greatest(0, count(*) - 5)::BIGINT AS more FROM r GROUP BY segment""")
def url_group_summary(spark, d):
    return site.link_summary(_t(spark, d, "pages"))


@query(f"""WITH a AS (SELECT url, 0 AS priority, page_id AS ord FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 1, page_id FROM pages),
b AS (SELECT *, {_CANON} AS canonical, row_number() OVER (PARTITION BY {_CANON} ORDER BY priority, ord, url) AS k FROM a)
SELECT canonical, url, priority, ord FROM b WHERE k = 1""")
def frontier_first_wins(spark, d):
    """Two sources of one frontier: even pages come from the first, all pages from the second."""
    p = _t(spark, d, "pages").select("url", F.col("page_id").alias("ord"))
    both = p.filter("ord % 2 = 0").withColumn("priority", F.lit(0)).unionByName(p.withColumn("priority", F.lit(1)))
    return site.frontier(both).select("canonical", "url", "priority", "ord")


@query(rf"""WITH l AS (SELECT page_id, url, trim(regexp_extract(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '^([^#]*)', 1)) AS h FROM pages),
f AS (SELECT page_id, url, CASE WHEN h LIKE '/%' AND h NOT LIKE '//%' THEN {_BASE} || h ELSE h END AS x FROM l WHERE h <> '' AND NOT regexp_matches(h, '^(javascript|mailto|tel):'))
SELECT page_id, count(*) AS n_internal, count(DISTINCT regexp_extract(x, {_S}, 3)) AS n_paths FROM f WHERE regexp_extract(x, {_S}, 2) = {_HOST} GROUP BY page_id""")
def internal_links(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.explode(urls.internal_links(html.links("html"), F.col("url"))).alias("l"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_internal"), F.countDistinct(urls.path(F.col("l"))).alias("n_paths"))


@query(f"SELECT page_id, starts_with(url, 'https://') AND NOT regexp_matches({_PATH}, '(?i)(?:^|/)blog(?:/|$)') AND regexp_matches({_PATH}, '(?i)(?:^|/)en(?:/|$)') AS in_scope FROM pages")
def scope_filter(spark, d):
    scope = site.Scope("https://", ["/en/", "([bad"], ["/blog"])
    return _t(spark, d, "pages").select("page_id", scope.column(F.col("url")).alias("in_scope"))


_IN = f"starts_with(url, 'https://') AND regexp_matches({_PATH}, '(?i)(?:^|/)en(?:/|$)')"


@query(f"SELECT count(*) FILTER ({_IN}) AS n_match, count(*) FILTER (NOT ({_IN})) AS n_reject FROM pages")
def scope_validate(spark, d):
    return site.scope_report(_t(spark, d, "pages").select("url"), site.Scope("https://", ["/en/"], []), START)


@query(f"""WITH l AS (SELECT page_id, lower(regexp_extract({_PATH}, '(?i)^/([a-z]{{2}}(?:-[a-z]{{2,8}})?)/', 1)) AS loc FROM pages), c AS (SELECT loc, count(*) AS n FROM l WHERE loc <> '' GROUP BY 1)
SELECT page_id FROM l WHERE (SELECT count(*) FROM l) < 10 OR (SELECT count(*) FROM c WHERE n >= 3) < 2 OR loc IN ('', 'en')""")
def locale_dedup(spark, d):
    return site.one_locale(_t(spark, d, "pages"), "https://x.org/en/docs").select("page_id")


@query("SELECT url, page_id AS ord FROM pages ORDER BY page_id, url LIMIT 100")
def cap_top_n(spark, d):
    """The frontier's cap, which is a feature: the first 100 in its order."""
    return site.top(_t(spark, d, "pages").select("url", F.col("page_id").alias("ord"), F.lit(0).alias("priority")), 100).select("url", "ord")


@query(f"SELECT page_id, {' OR '.join(f'contains(lower({_PATH}), {s!r})' for s in ('/en/', *urls.DOC_SIGNALS))} AS is_doc FROM pages")
def looks_like_doc(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.looks_like_doc(F.col("url"), START).alias("is_doc"))


_H = r"'(?m)^#{1,6}[ \t]+'"


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, {_H})) AS n_headings, len(regexp_extract_all(text, '(?m)^```')) // 2 AS n_code, md5(text) AS content_hash, strlen(text) AS size_bytes, length(text) AS n_chars FROM documents""")
def content_metrics(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", text.headings(t).alias("n_headings"), text.code_blocks(t).alias("n_code"), text.content_hash(t).alias("content_hash"), text.size_bytes(t).alias("size_bytes"), F.length(t).cast("long").alias("n_chars"))


@query("SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(spark, d):
    return _t(spark, d, "documents").groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH b AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '(^|\n)([^\S\n]*# [^\S\n]*\S)', '\1' || chr(10) || chr(10) || '\2', 'g'), '\n\s*\n')) AS x FROM documents),
t AS (SELECT doc_id, {_TRIM.format('x')} AS x FROM b)
SELECT doc_id, count(*) AS n_blocks, sum(length(trim(regexp_replace(x, '\s+', ' ', 'g'))))::BIGINT AS n_normal FROM t WHERE x <> '' GROUP BY 1""")
def split_blocks(spark, d):
    b = _t(spark, d, "documents").select("doc_id", F.explode(text.blocks(F.col("text"))).alias("b"))
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length(text.normal(F.col("b")))).alias("n_normal"))


def _line_parts(spark, d):
    """Lines as blocks, a source as a set of pages."""
    return _t(spark, d, "documents").select("source", F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("source", "page", "pos", text.strip(F.col("line")).alias("block")).filter("block <> ''")


_PARTS = rf"""p AS MATERIALIZED (SELECT source, doc_id, pos, {_TRIM.format('x')} AS b FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE {_TRIM.format('x')} <> ''),
k AS MATERIALIZED (SELECT *, CASE WHEN length(b) >= 15 THEN lower(trim(regexp_replace(b, '\s+', ' ', 'g'))) END AS norm FROM p),
n AS (SELECT source, count(DISTINCT doc_id) AS n FROM k GROUP BY 1),
r AS MATERIALIZED (SELECT k.source, norm, count(DISTINCT doc_id) AS pages FROM k JOIN n USING (source) WHERE norm IS NOT NULL GROUP BY k.source, norm, n.n HAVING n.n >= 3 AND count(DISTINCT doc_id) >= greatest(2, floor(n.n * RATIO)))"""


@query(f"WITH {_PARTS.replace('RATIO', '0.1')} SELECT source, norm, pages FROM r")
def repeated_blocks(spark, d):
    return site.repeated_blocks(_line_parts(spark, d), 0.1, by=["source"])


@query(f"WITH {_PARTS.replace('RATIO', '0.5')} SELECT source, norm, pages FROM r")
def repeated_blocks_default(spark, d):
    return site.repeated_blocks(_line_parts(spark, d), by=["source"])


@query(f"""WITH {_PARTS.replace('RATIO', '0.1')}
SELECT k.doc_id AS page, k.source, coalesce(string_agg(b, chr(10) ORDER BY pos) FILTER (r.norm IS NULL), '') AS content, count(r.norm) AS removed FROM k LEFT JOIN r ON k.source = r.source AND k.norm = r.norm GROUP BY 1, 2""")
def remove_repeated(spark, d):
    parts = _line_parts(spark, d)
    return site.remove_repeated(parts, site.repeated_blocks(parts, 0.1, by=["source"]), by=["source"], joiner="\n")


@query(f"""WITH {_PARTS.replace('RATIO', '0.1')}, c AS (SELECT k.doc_id, count(r.norm) AS c FROM k LEFT JOIN r ON k.source = r.source AND k.norm = r.norm GROUP BY 1)
SELECT count(*) FILTER (c > 0) AS files, sum(c)::BIGINT AS blocks FROM c""")
def dedup_stats(spark, d):
    return remove_repeated(spark, d).agg(F.count_if(F.col("removed") > 0).alias("files"), F.sum("removed").alias("blocks"))


def _sql_ui() -> str:
    out = "text"
    for p in UI_ARTIFACT_PATTERNS:
        out = f"regexp_replace({out}, '(?im){p}', '', 'g')"
    return out


@query(f"SELECT doc_id, md5({_sql_ui()}) AS cleaned FROM documents")
def ui_artifacts(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(cleaning.ui_artifacts(F.col("text"))).alias("cleaned"))


def _sql_encoding() -> str:
    out = "text"
    for a, b in [*cleaning.MOJIBAKE_FIXES, *cleaning.SMART_QUOTE_FIXES]:
        out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({out}, '{cleaning.EMOJI_RESIDUE}', '', 'g')".replace(r"\xc3\xc2", "ÃÂ").replace(r"\x80-\xbf", "\u0080-¿").replace(r"\xc2-\xc3", "Â-Ã")


@query(f"SELECT doc_id, md5({_sql_encoding()}) AS cleaned FROM documents")
def fix_encoding(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(cleaning.encoding(F.col("text"))).alias("cleaned"))


CASES = [
    ("nav", "[Docs](/docs)[Blog](/blog)\nBack\nv4.1\n# Guide\ntext"),
    ("dup", "# A\nx\n## B\ny\n## B\nz\n# a"),
    ("anchor", "## H¶\n## [Name](#name)\n##\n[](#x)\ntext"),
    ("toc", "# T\n\n* [One](#one)\n* [Two](#two)\n\nbody text here\n"),
    ("code", "```language-js\nx\n```\n```Python\ny\n```\n```shiki\nz\n```\n```language-json\n{}\n```"),
    ("space", "a  \n\n\n\n\n\nb\t\n"),
    ("fence", "a\n```js\n\n```\nb\n```\n```\nc"),
    ("foot", "one line\ntwo line\nthree line\nfour line\n\nCopyright 2020 X\nMenu"),
]


def _cases(spark):
    return spark.createDataFrame(CASES, "name string, md string")


_VALUES = "(VALUES " + ", ".join(f"('{n}', '{m}')" for n, m in CASES) + ") AS c(name, md)"


@query(rf"SELECT name, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(md, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '^\s+', ''), '\s+$', '') AS out FROM {_VALUES}")
def whitespace_rules(spark, d):
    return _cases(spark).select("name", cleaning.whitespace(F.col("md")).alias("out"))


@query(rf"SELECT name, regexp_replace(regexp_replace(md, '```\w*\n\s*\n```', '', 'g'), '```\w*\n```', '', 'g') AS out FROM {_VALUES}")
def empty_fences(spark, d):
    return _cases(spark).select("name", cleaning.empty_fences(F.col("md")).alias("out"))


@query()
def clean_full(spark, d):
    """All cleaning steps on every document's text."""
    return _t(spark, d, "documents").select("doc_id", cleaning.clean(F.col("text")).alias("cleaned"))


@query()
def clean_steps(spark, d):
    """Each step alone on the inline cases."""
    return _cases(spark).select("name", *[f(F.col("md")).alias(f.__name__) for f in cleaning.STEPS])


ENGINE = [("same", 100, 100, 1, 1, 0, 0, 20, 20), ("long", 100, 200, 1, 1, 0, 0, 20, 20), ("heads", 100, 100, 1, 5, 0, 0, 20, 20), ("code", 100, 100, 1, 1, 0, 3, 20, 20), ("links", 100, 100, 1, 1, 0, 0, 4, 11), ("all", 10, 100, 0, 9, 0, 9, 0, 99), ("short", 200, 100, 1, 1, 0, 0, 20, 20)]
_ENGINE = "variant string, a_length long, b_length long, a_headings long, b_headings long, a_code long, b_code long, a_links long, b_links long"


@query(f"""WITH e AS (SELECT *, abs(b_length - a_length) / greatest(b_length, a_length, 1) AS diff_ratio FROM (VALUES {', '.join(map(str, ENGINE))}) AS t({', '.join(x.split()[0] for x in _ENGINE.split(', '))})),
w AS (SELECT variant, diff_ratio, array_to_string(list_filter([
  CASE WHEN diff_ratio > 0.3 AND b_length > a_length THEN printf('content length diff %.1f%% > 30%%', diff_ratio * 100) END, CASE WHEN b_headings > a_headings + 3 THEN printf('Selenium has %d more headings', b_headings - a_headings) END,
  CASE WHEN b_code > a_code + 2 THEN printf('Selenium has %d more code blocks', b_code - a_code) END, CASE WHEN a_links < 5 AND b_links > 10 THEN printf('SPA detected: cURL %d links vs Selenium %d links', a_links, b_links) END], lambda x: x IS NOT NULL), '; ') AS reason FROM e)
SELECT variant, CASE WHEN reason <> '' THEN 'selenium' ELSE 'curl' END AS mode, diff_ratio, coalesce(nullif(reason, ''), 'cURL content sufficient') AS reason FROM w""")
def engine_choice(spark, d):
    return site.engine_choice(spark.createDataFrame(ENGINE, _ENGINE))


_DIRS = f"SELECT CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, string_agg(regexp_extract(p, '([^/]*)$', 1), ',' ORDER BY p) AS files FROM (SELECT {_FILE} AS p FROM pages) GROUP BY 1"


@query(_DIRS)
def dir_index(spark, d):
    return site.dir_index(_t(spark, d, "pages").select(urls.to_file(F.col("url")).alias("path")))


@query(f"SELECT '[Test Docs Index]|root: ./md/raw|{site.INSTRUCTION}|source: {START}|' || string_agg(dir || '/:{{' || files || '}}', '|' ORDER BY dir) || chr(10) AS index_line FROM ({_DIRS})")
def compact_index(spark, d):
    return site.compact_index(_t(spark, d, "pages").select(urls.to_file(F.col("url")).alias("path")), "Test", START)


@query()
def html_to_markdown(spark, d):
    return plan.documents(_t(spark, d, "pages"))


@query()
def manifest(spark, d):
    return plan.manifest(plan.documents(_t(spark, d, "pages")))


@query()
def docset_dedup(spark, d):
    return plan.deduplicated(plan.wrapped(plan.documents(_t(spark, d, "pages"))))


@query()
def html_preview(spark, d):
    return _t(spark, d, "pages").select("page_id", html.previews("html").alias("p")).select("page_id", "p.preview", "p.sanitized")


@query()
def sitemap_titles(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.sitemap_title(urls.path(F.col("url"))).alias("title"))


@query()
def bfs_frontier(spark, d):
    """The crawl over fetched pages from the first URL; its cap is a feature."""
    p = _t(spark, d, "pages").select("url", "html")
    start = p.agg(F.min("url")).first()[0]
    return site.crawl(p, start)


def _page(*links):
    return "<html><body>" + "".join(links) + "</body></html>"


SITE = [
    ("https://a.org/docs/", _page("<a href='guide/x'>", '<A HREF="../up">', "<a class=c href=/z?q=1>", '<a href="//a.org/host#f">', '<a href="https://b.org/docs/">', '<a href="mailto:x@a.org">')),
    ("https://a.org/docs/guide/x", _page('<a href="./y">', '<a href="../../docs/guide/deep/">', '<a href="pic.PNG">')),
    ("https://a.org/up", _page('<a href="docs/guide/x">')), ("https://a.org/z", _page('<a href="?p=2">')), ("https://a.org/host", _page()),
    ("https://a.org/docs/guide/y", _page('<a href="z">')), ("https://a.org/docs/guide/deep/", _page()), ("https://a.org/docs/guide/z", _page('<a href="/docs/">')),
    ("https://a.org/lost", _page('<a href="/docs/">')), ("https://b.org/docs/", _page()),
]


@query("""SELECT * FROM (VALUES ('https://a.org/docs', 0), ('https://a.org/docs/guide/x', 1), ('https://a.org/host', 1), ('https://a.org/up', 1), ('https://a.org/z', 1),
('https://a.org/docs/guide/deep', 2), ('https://a.org/docs/guide/y', 2), ('https://a.org/docs/guide/z', 3)) AS t(c, depth)""")
def crawl_depths(spark, d):
    """A site whose links are written in all ways, with known distances."""
    return site.crawl(spark.createDataFrame(SITE, "url string, html string"), "https://a.org/docs/", most=50)


RESOLVED = [("g", "b/c/g"), ("./g", "b/c/g"), ("g/", "b/c/g/"), ("/g", "g"), ("?y", "b/c/d;p?y"), ("g?y", "b/c/g?y"), ("#s", "b/c/d;p#s"), ("g#s", "b/c/g#s"), (";x", "b/c/;x"), (".", "b/c/"), ("./", "b/c/"), ("..", "b/"), ("../", "b/"), ("../g", "b/g"), ("../..", ""), ("../../g", "g"), ("../../../g", "g"), ("/./g", "g"), ("/../g", "g"), ("g.", "b/c/g."), ("..g", "b/c/..g"), ("./g/.", "b/c/g/"), ("g/./h", "b/c/g/h"), ("g/../h", "b/c/h"), ("g?y/../x", "b/c/g?y/../x")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', 'http://a/{w}')" for h, w in RESOLVED) + ") AS t(href, url)")
def resolve_links(spark, d):
    """The resolution examples of RFC 3986, 5.4."""
    return spark.createDataFrame([(h,) for h, _ in RESOLVED], "href string").select("href", urls.absolute(F.col("href"), F.lit("http://a/b/c/d;p")).alias("url"))


@query(r"""SELECT page_id, substr(trim(replace(replace(replace(regexp_extract(html, '(?s)<h1[^>]*>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), 1, 200) AS title,
  CASE WHEN contains(html, '<main') THEN 'main' WHEN contains(html, '<article') THEN 'article' ELSE 'body' END AS selector,
  regexp_extract(html, '<div class="ad">([^<]{20})', 1) <> '' AND contains(regexp_extract(html, '(?s)<article.*', 0), regexp_extract(html, '<div class="ad">([^<]{20})', 1)) AS has_ad,
  (len(regexp_extract_all(html, '<a href="')))::BIGINT AS n_links FROM pages""")
def page_content(spark, d):
    """What is taken from each page: title, where its content is, and nothing of an ad that stands before it.

    As in the SQL, all is compared as written, and a title has three kinds of references resolved, others stay.
    """
    p = _t(spark, d, "pages").select("page_id", "html", html.page(written=True)("html").alias("p"))
    ad, title = F.regexp_extract("html", '<div class="ad">([^<]{20})', 1), F.col("p.title")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(a), F.lit(b))
    title = F.substring(F.regexp_replace(title, r"\A\p{Zs}+|\p{Zs}+\z", ""), 1, 200)
    title = F.when(F.rlike("html", F.lit("<h1[^>]*>[^<]*</h1>")), title).when(F.isnotnull("html"), "")
    selector, links = F.when(F.col("html") != "", F.col("p.selector")).otherwise("body"), F.when(F.isnotnull("html"), F.size("p.links").cast("long"))
    return p.select("page_id", title.alias("title"), selector.alias("selector"), (F.contains("p.markdown", ad) & (ad != "")).alias("has_ad"), links.alias("n_links"))


TAGS = ["language-js", "Python", "SH", "language-json", "shiki", "language-c++", "highlight-python", "js", "", "language-undefined", "rs", "index-module__DOXIJG__content"]
_TAG = f"[{', '.join(repr(x) for x in TAGS)}][doc_id % {len(TAGS)} + 1]"


def _sql_languages() -> str:
    out = f"'```' || {_TAG} || chr(10) || replace(text, '`', '')"
    for a, b in cleaning.CSS_CLASS_TO_LANGUAGE.items():
        out = f"replace({out}, '```{a}', '```{b}')"
    for a in cleaning.BAD_LANGUAGES:
        out = f"replace({out}, '```{a}', '```')"
    return out


_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in cleaning.ALIASES.items())


@query(rf"""WITH m AS (SELECT doc_id, {_sql_languages()} AS md FROM documents), t AS (SELECT doc_id, lower(regexp_extract(md, '^```(\w*)', 1)) AS tag, regexp_replace(md, '^```\w*', '') AS rest FROM m)
SELECT doc_id, '```' || CASE tag {_ALIAS} ELSE tag END || rest AS md FROM t""")
def code_languages(spark, d):
    """Every text in a fence of one of the tags."""
    tag = F.element_at(F.array(*[F.lit(x) for x in TAGS]), (F.col("doc_id") % len(TAGS) + 1).cast("int"))
    md = F.concat(F.lit("```"), tag, F.lit("\n"), F.replace("text", F.lit("`"), F.lit("")))
    return _t(spark, d, "documents").select("doc_id", cleaning.code_languages(md).alias("md"))


_HEADED = "concat('# ', source, chr(10), replace(text, '#', ''), chr(10), '## ', lang, chr(10), '#  ', upper(source), chr(10), '## ', source, chr(10), '## ', lang, chr(10), '##', chr(10), '##')"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS x, generate_subscripts(string_split(md, chr(10)), 1) AS k FROM (SELECT doc_id, {_HEADED} AS md FROM documents)),
h AS (SELECT *, CASE WHEN trim(x) LIKE '#%' AND trim(regexp_replace(trim(x), '^#+', '')) <> '' THEN regexp_extract(trim(x), '^(#+)', 1) || ':' || lower(trim(regexp_replace(trim(x), '^#+', ''))) END AS key FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY k) AS r FROM h)
SELECT doc_id, string_agg(x, chr(10) ORDER BY k) AS md FROM n WHERE key IS NULL OR r = 1 GROUP BY doc_id""")
def duplicate_headings(spark, d):
    """Every text with headings before and after it that come again."""
    return _t(spark, d, "documents").select("doc_id", cleaning.duplicate_headings(F.expr(_HEADED.replace("chr(10)", "char(10)"))).alias("md"))


_ANCHORED = "concat('# ', source, '¶', chr(10), '## [', lang, '](#', lang, ')', chr(10), replace(replace(text, '#', ''), '¶', ''), chr(10), '### ', source, ' []( #x)', chr(10), '##', chr(10), 'see [', lang, '](#', lang, ')')"


@query("SELECT doc_id, concat('# ', source, chr(10), '## ', lang, chr(10), replace(replace(text, '#', ''), '¶', ''), chr(10), '### ', source, chr(10), 'see [', lang, '](#', lang, ')') AS md FROM documents")
def permalinks(spark, d):
    """Every text with headings that carry anchors."""
    return _t(spark, d, "documents").select("doc_id", cleaning.permalinks(F.expr(_ANCHORED.replace("chr(10)", "char(10)"))).alias("md"))


@query("SELECT DISTINCT url FROM pages ORDER BY url LIMIT 10")
def example_urls(spark, d):
    """The first ten URLs, which is the feature."""
    return site.examples(_t(spark, d, "pages"))


@query(f"""SELECT url, {_PATH} AS path, CASE WHEN regexp_matches({_PATH}, '(?i)/7') THEN 'excluded by ''/7''' ELSE 'no include match' END AS reason
FROM pages WHERE regexp_matches({_PATH}, '(?i)(?:^|/)7(?:/|$)') OR NOT regexp_matches({_PATH}, '(?i)(?:^|/)en(?:/|$)') ORDER BY url LIMIT 20""")
def reject_reasons(spark, d):
    """The first twenty rejected URLs with their reasons, which is the feature."""
    return site.reject_reasons(_t(spark, d, "pages").select("url"), site.Scope("", ["/en/"], ["/7"]))


_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAPS = [("https://a.org/s.xml", f'<sitemapindex xmlns="{_NS}"><sitemap><loc>https://a.org/1.xml</loc></sitemap><sitemap><loc>https://a.org/2.xml</loc></sitemap></sitemapindex>'), ("https://a.org/1.xml", f'<urlset xmlns="{_NS}"><url><loc>https://a.org/x</loc></url><url><loc>https://a.org/y</loc></url></urlset>'), ("https://a.org/2.xml", f'<urlset xmlns="{_NS}"><url><loc> https://a.org/z </loc></url></urlset>'), ("https://a.org/3.xml", "<urlset><url><loc>https://a.org/no</loc></url></urlset>"), ("https://a.org/4.xml", f'<urlset xmlns="{_NS}"><url><loc>https://a.org/cut')]


@query("SELECT * FROM (VALUES ('https://a.org/s.xml', 0, 'https://a.org/x'), ('https://a.org/s.xml', 1, 'https://a.org/y'), ('https://a.org/s.xml', 2, 'https://a.org/z')) AS t(location, pos, url)")
def sitemap_parse(spark, d):
    return web.sitemap_urls(spark.createDataFrame(MAPS, "location string, xml string"), spark.createDataFrame([("https://a.org/s.xml",), ("https://a.org/3.xml",), ("https://a.org/4.xml",)], "location string"))


LEDGER = [("a", "success", 10), ("b", "failed", 0), ("c", "success", 5)]


@query("SELECT 2::BIGINT AS succeeded, 1::BIGINT AS failed, 15::BIGINT AS pages")
def batch_totals(spark, d):
    return site.batch_totals(spark.createDataFrame(LEDGER, "name string, status string, pages long"))


@query("SELECT * FROM (VALUES ('b'), ('d')) AS t(name)")
def pending_sites(spark, d):
    return site.pending(spark.createDataFrame([(x,) for x in "abcd"], "name string"), spark.createDataFrame(LEDGER, "name string, status string, pages long"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY 1, 2")
def group_count(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum("l_linenumber").alias("numbers"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_k_per_group(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).filter("k <= 3").drop("k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS events FROM events GROUP BY 1")
def ordered_concat(spark, d):
    own = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return _t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(own, lambda x: x["event_type"]), ",").alias("events"))
