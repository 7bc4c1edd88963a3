"""Relational operators of the site engine: frontier, scope, locales, repeated blocks, index, catalogue."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..tables import cut, delete, exists, files_of, found, read_text, write_text

# Fixed values.
EXCLUDES = ("/blog/", "/news/", "/pricing/", "/login/", "/changelog/")
MAX_PAGES, SAMPLE_PAGES, MIN_RATE, MIN_MARKDOWN = 500, 5, 0.2, 20
MIN_BLOCK, MIN_PAGES, REPEAT_RATIO, LEARN_PAGES = 15, 3, 0.5, 30
LOCALE = r"(?i)^/([a-z]{2}(?:-[a-z]{2,8})?)/"
INSTRUCTION = "IMPORTANT: Prefer retrieval-led reasoning over pre-training-led reasoning."


@dataclass
class Scope:
    base_url: str
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    strict_host: bool = False

    @staticmethod
    def anchored(pattern: str) -> str:
        """A plain path segment matches whole segments only; anything with metacharacters stays."""
        if set(pattern) & set("\\^$*+?{}()[]|."):
            return pattern
        return f"(?:^|/){re.escape(pattern.strip('/'))}(?:/|$)"

    @staticmethod
    def dialect(pattern: str) -> str:
        """Named groups as Java writes them."""
        return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))

    @classmethod
    def valid(cls, patterns: list[str]) -> list[str]:
        """Patterns that compile, in Python's dialect and, where a session is there, in Java's."""
        spark, out = SparkSession.getActiveSession(), []
        for p in patterns:
            try:
                re.compile(p)
                if spark is not None:
                    spark.sparkContext._jvm.java.util.regex.Pattern.compile(cls.dialect(p))
                out.append(p)
            except (re.error, Py4JJavaError):
                continue
        return out

    def column(self, url: Column) -> Column:
        """Excludes win; with includes one must hit, and if none of them compiles nothing matches. Pushable to the scan."""
        hit = lambda ps: [F.rlike(urls.path(url), F.lit("(?iudU)" + self.dialect(self.anchored(p)))) for p in self.valid(ps)]
        out = urls.base(url) == F.lit(self.base_url.rstrip("/")) if self.strict_host else F.startswith(url, F.lit(self.base_url))
        for x in hit(self.exclude):
            out = out & ~x
        if self.include:
            some = F.lit(False)
            for x in hit(self.include):
                some = some | x
            out = out & some
        return out


def heuristic_scope(start_url: str) -> Scope:
    """Without a rule provider: the start path's first segment, and five excludes."""
    m = re.match(urls.SPLIT, start_url)
    first = m[3].strip("/").split("/")[0] if m else ""
    return Scope(f"{m[1]}://{m[2]}" if m else start_url, [f"/{first}/"] if first else [], list(EXCLUDES))


def scope_report(links: DataFrame, scope: Scope, start_url: str) -> DataFrame:
    """n_match and n_reject over links; no match counts if the start URL itself is rejected."""
    start = links.sparkSession.range(1).select(scope.column(F.lit(start_url)).alias("ok")).first()[0]
    ok = scope.column(F.col("url")) & F.lit(bool(start))
    return links.agg(F.count_if(ok).alias("n_match"), F.count_if(~ok).alias("n_reject"))


def reject_reasons(links: DataFrame, scope: Scope, most: int = 20) -> DataFrame:
    """url, path, reason of the first rejected links: the exclude pattern, as it was given, that hits, or no include."""
    why = F.lit("no include match")
    for p in reversed(Scope.valid(scope.exclude)):
        why = F.when(F.rlike(urls.path(F.col("url")), F.lit("(?iudU)" + Scope.dialect(p))), F.lit(f"excluded by '{p}'")).otherwise(why)
    return links.filter(~scope.column(F.col("url"))).select("url", urls.path(F.col("url")).alias("path"), why.alias("reason")).orderBy("url").limit(most)


def examples(links: DataFrame, n: int = 10) -> DataFrame:
    """The first URLs in order, to show what a site has."""
    return links.select("url").distinct().orderBy("url").limit(n)


def sample(rows: DataFrame) -> DataFrame:
    """The first SAMPLE_PAGES of a frontier."""
    return top(rows, SAMPLE_PAGES)


def frontier(rows: DataFrame) -> DataFrame:
    """First of each canonical URL by (priority, ord, url), added up on the map side: a hot URL is no hot task."""
    others = [c for c in rows.columns if c not in ("priority", "ord", "url", "canonical")]
    first = F.min(F.struct("priority", "ord", "url", *[F.struct(F.col(c)).alias(c) for c in others])).alias("x")
    got = rows.withColumn("canonical", urls.canonical(F.col("url"))).filter("canonical is not null").groupBy("canonical").agg(first)
    of = {"canonical": F.col("canonical"), **{c: F.col(f"x.{c}") for c in ("priority", "ord", "url")}, **{c: F.col(f"x.{c}.{c}").alias(c) for c in others}}
    return got.select(*[of[c].alias(c) for c in [*rows.columns, *([] if "canonical" in rows.columns else ["canonical"])]])


def locale_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(urls.path(url), LOCALE, 1))


def one_locale(rows: DataFrame, start_url: str, least: int = 10, per_locale: int = 3) -> DataFrame:
    """Keeps the start URL's locale and pages without one, if at least two locales have three pages."""
    m = re.match(urls.SPLIT, start_url)
    own = re.match(LOCALE, m[3].rstrip("/")) if m else None
    if not own:
        return rows
    counts = rows.groupBy(locale_of(F.col("url")).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    total, many = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("l") != "") & (F.col("n") >= per_locale))).first()
    if total < least or many < 2:
        return rows
    return rows.filter(locale_of(F.col("url")).isin("", own[1].lower()))


def top(rows: DataFrame, n: int = MAX_PAGES) -> DataFrame:
    return rows.orderBy("priority", "ord", "url").limit(n)


def crawl(pages: DataFrame, start_url: str, most: int = 10, rounds: int = 10) -> DataFrame:
    """Breadth-first over pages(url, html): (c, depth) of the pages reached, by canonical URL.

    A round joins keys alone, takes from its new pages only as many as are still wanted, and parses
    the links of those. At most ``most`` rows in all, the first by depth and URL.
    """
    spark = pages.sparkSession
    known = pages.withColumn("c", urls.canonical(F.col("url"))).filter("c is not null")
    keys = cut(known.select("c").distinct(), "crawl-keys")
    todo = spark.createDataFrame([(start_url,)], "url string").select(urls.canonical(F.col("url")).alias("c"))
    out, depth = cut(todo.limit(0).withColumn("depth", F.lit(0)), "crawl"), 0
    while depth < rounds:
        left = most - out.count()
        now = cut(todo.join(keys, "c", "left_semi").join(out, "c", "left_anti").orderBy("c").limit(left).withColumn("depth", F.lit(depth)), "crawl-round")
        if not left or not now.limit(1).count():
            break
        html_of = known.join(F.broadcast(now.select("c")), "c", "left_semi").dropDuplicates(["c"])  # at most ``most`` rows
        found = html_of.select(F.explode(urls.internal_links(html.links("html"), F.col("url"))).alias("u")).filter(urls.navigable(F.col("u")))
        todo = cut(found.select(urls.canonical(F.col("u")).alias("c")).distinct(), "crawl-todo")
        out = cut(out.unionByName(now), "crawl")
        depth += 1
    return out.orderBy("depth", "c")


def repeated_blocks(parts: DataFrame, ratio: float = REPEAT_RATIO, min_pages: int = MIN_PAGES, min_block: int = MIN_BLOCK, by: list[str] | None = None) -> DataFrame:
    """Of parts(by..., page, block): the normalised blocks on at least max(2, floor(n * ratio)) of n pages."""
    by = by or []
    pages = parts.select(*by, "page").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    counts = parts.filter(F.length("block") >= min_block).select(*by, "page", text.normal(F.col("block")).alias("norm")).distinct().groupBy(*by, "norm").agg(F.count(F.lit(1)).alias("pages"))
    joined = counts.join(pages, by) if by else counts.join(F.broadcast(pages))  # one row
    return joined.filter((F.col("n") >= min_pages) & (F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") * ratio)))).select(*by, "norm", "pages")


def remove_repeated(parts: DataFrame, repeated: DataFrame, min_block: int = MIN_BLOCK, by: list[str] | None = None, joiner: str = "\n\n") -> DataFrame:
    """page, content, removed: pages that lose all their blocks stay, as ''."""
    by = by or []
    rows = parts.withColumn("norm", F.when(F.length("block") >= min_block, text.normal(F.col("block"))))
    marked = rows.join(repeated.select(*by, "norm", F.lit(True).alias("_r")), [*by, "norm"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("_r").isNull(), F.struct("pos", "block"))))
    return marked.groupBy(*by, "page").agg(F.array_join(F.transform(kept, lambda x: x["block"]), joiner).alias("content"), F.count("_r").alias("removed"))


def dir_index(entries: DataFrame) -> DataFrame:
    """Of entries(path): dir and its files by path, comma-joined."""
    p = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    rows = entries.select(p.alias("path"), F.regexp_extract(p, "^(.*)/[^/]*$", 1).alias("d"), F.regexp_extract(p, "([^/]*)$", 1).alias("file"))
    return rows.groupBy(F.when(F.contains("path", F.lit("/")), F.col("d")).otherwise(".").alias("dir")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "file"))), lambda x: x["file"]), ",").alias("files"))


def compact_index(entries: DataFrame, name: str, start_url: str) -> DataFrame:
    dirs = dir_index(entries).agg(F.array_sort(F.collect_list(F.struct("dir", "files"))).alias("d"))
    head = [F.lit(x) for x in (f"[{name} Docs Index]", "root: ./md/raw", INSTRUCTION, f"source: {start_url}")]
    return dirs.select(F.concat(F.array_join(F.concat(F.array(*head), F.transform("d", lambda x: F.concat(x["dir"], F.lit("/:{"), x["files"], F.lit("}")))), "|"), F.lit("\n")).alias("index_line"))


def link_summary(rows: DataFrame, most: int = 5) -> DataFrame:
    """Per first segment: count, the first five paths, how many more."""
    w = Window.partitionBy("segment").orderBy("path", "url")
    ranked = rows.select(urls.first_segment(F.col("url")).alias("segment"), urls.path(F.col("url")).alias("path"), "url").withColumn("k", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "path"))))
    return ranked.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(first, lambda x: x["path"]), ",").alias("paths")).withColumn("more", F.greatest(F.lit(0).cast("long"), F.col("n") - most))


def engine_choice(rows: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Of a_*/b_* (plain and browser) length, headings, code, links: mode, ratio and reasons."""
    c = F.col
    number = lambda x: F.format_string("%d", x.cast("long"))
    ratio = F.abs(c("b_length") - c("a_length")) / F.greatest(c("b_length"), c("a_length"), F.lit(1))
    why = F.array_compact(F.array(
        F.when((ratio > threshold) & (c("b_length") > c("a_length")), F.format_string(f"content length diff %.1f%% > {threshold:.0%}%", ratio * 100)),
        F.when(c("b_headings") > c("a_headings") + 3, F.concat(F.lit("Selenium has "), number(c("b_headings") - c("a_headings")), F.lit(" more headings"))),
        F.when(c("b_code") > c("a_code") + 2, F.concat(F.lit("Selenium has "), number(c("b_code") - c("a_code")), F.lit(" more code blocks"))),
        F.when((c("a_links") < 5) & (c("b_links") > 10), F.concat(F.lit("SPA detected: cURL "), number(c("a_links")), F.lit(" links vs Selenium "), number(c("b_links")), F.lit(" links"))),
    ))
    said = F.when(F.size(why) > 0, F.array_join(why, "; ")).otherwise("cURL content sufficient")
    return rows.select("variant", F.when(F.size(why) > 0, "selenium").otherwise("curl").alias("mode"), ratio.alias("diff_ratio"), said.alias("reason"))


def decision_json(decision: DataFrame) -> str:
    """The first row of an engine choice as a JSON document; nulls stay."""
    row = decision.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, indent=2, ensure_ascii=False)


def success_rate(frontier_rows: DataFrame, fetched: DataFrame) -> DataFrame:
    """Share of the frontier that has Markdown; below MIN_RATE the caller plans once more."""
    return frontier_rows.join(fetched.select("url", F.lit(1).alias("_ok")).distinct(), "url", "left").agg((F.count("_ok") / F.count(F.lit(1))).alias("rate"))


def pending(sites: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sites without a successful run."""
    return sites.join(ledger.filter("status = 'success'").select("name"), "name", "left_anti")


def batch_totals(ledger: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return ledger.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("pages"))), F.lit(0)).alias("pages"))


class Ledger:
    """A batch's results (name, status, pages) in one JSON file, saved after each site; a broken file counts as empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            self.rows: list[dict] = json.loads(read_text(spark, path) or "[]")
        except ValueError:
            self.rows = []

    def save(self, name: str, status: str, pages: int = 0, **more) -> None:
        self.rows = [x for x in self.rows if x["name"] != name] + [{"name": name, "status": status, "pages": pages, **more}]
        write_text(self.spark, self.path, json.dumps(self.rows, indent=2, ensure_ascii=False))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(x["name"], x["status"], x["pages"]) for x in self.rows], "name string, status string, pages long")


def run_batch(ledger: Ledger, sites: list[str], scrape) -> None:
    """``scrape(name)`` gives the pages of a site; what succeeded before is not done again, what fails is noted."""
    done = {x["name"] for x in ledger.rows if x["status"] == "success"}
    for name in sites:
        if name not in done:
            try:
                ledger.save(name, "success", scrape(name))
            except Exception as e:  # noqa: BLE001
                ledger.save(name, "failed", 0, error=str(e)[:500])


def size_mb(size_bytes: Column) -> Column:
    return F.round(size_bytes / 1048576, 1)


# Fixed formats of rule files by tool; C keeps one shared file with marked blocks.
ROOTS = {"windsurf": ".windsurf/docs", "cursor": ".cursor/docs", "claude": ".docs", "antigravity": ".agent/docs"}
HEADS = {
    "windsurf": "---\ntrigger: always_on\n---\n\n",
    "cursor": "---\ndescription: {name} documentation index\nglobs: **/*\nalwaysApply: true\n---\n\n",
    "claude": "",
    "antigravity": "# {name} Documentation Index\n\n> Activation: Always On\n\n",
}


def render_rule(tool: str, name: str, index: str, existing: str = "", marker: str = "DOCS") -> str:
    """The rule file that installs an index; an unknown tool counts as the first."""
    if not re.fullmatch("[A-Za-z0-9_-]+", name):
        raise ValueError(f"not a name: {name!r}")
    tool = tool if tool in ROOTS else "windsurf"
    body = re.sub(r"\|root:\s*[^|]+", lambda m: f"|root: ./{ROOTS[tool]}/{name}", index, count=1)
    if tool != "claude":
        return HEADS[tool].format(name=name) + body + "\n"
    first, last = f"<!-- {marker}-START:{name} -->", f"<!-- {marker}-END:{name} -->"
    block = f"{first}\n{body}\n{last}"
    if first in existing and last in existing:
        return existing[: existing.index(first)] + block + existing[existing.index(last) + len(last) :]
    return f"{existing.rstrip()}\n\n{block}\n" if existing else f"{block}\n"


def remove_rule(existing: str, name: str, marker: str = "DOCS") -> str:
    first, last = f"<!-- {marker}-START:{name} -->", f"<!-- {marker}-END:{name} -->"
    if first in existing and last in existing:
        existing = existing[: existing.index(first)] + existing[existing.index(last) + len(last) :]
    return re.sub(r"\n{3,}", "\n\n", existing).strip() + "\n"


CATALOG = "name string, index string, total_pages long, source_url string, scraped_at string, size_bytes long"


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """CATALOG of every document set below ``folder`` that has an index; the manifest may be missing or broken."""
    folder = folder.rstrip("/")
    if not found(spark, f"{folder}/*/AGENTS.md"):
        return spark.createDataFrame([], CATALOG)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("name")
    index = spark.read.text(f"{folder}/*/AGENTS.md", wholetext=True).select(name, text.strip(F.col("value")).alias("index"))
    if found(spark, f"{folder}/*/manifest.json"):
        said = F.from_json("value", "start_url string, total_pages long, scraped_at string")
        manifest = spark.read.text(f"{folder}/*/manifest.json", wholetext=True).select(name, said.alias("m")).select("name", "m.*")
    else:
        manifest = spark.createDataFrame([], "name string, start_url string, total_pages long, scraped_at string")
    below = F.regexp_extract("path", re.escape(folder.split("/")[-1]) + "/([^/]+)/", 1).alias("name")
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(below, "length")
    source = F.coalesce(F.nullif("start_url", F.lit("")), F.trim(F.regexp_extract("index", r"\|source:\s*([^|]+)", 1)))
    rows = index.join(manifest, "name", "left").join(sizes.groupBy("name").agg(F.sum("length").alias("size_bytes")), "name", "left")
    return rows.select("name", "index", F.coalesce("total_pages", F.lit(0)).alias("total_pages"), source.alias("source_url"), F.coalesce("scraped_at", F.lit("")).alias("scraped_at"), "size_bytes")


def storage_root(env: dict[str, str]) -> str:
    """Where document sets are kept: what the environment says, or the user's data folder."""
    return env.get("DOCS_STORAGE_DIR") or (f"{env['APPDATA']}/docs" if env.get("APPDATA") else f"{env.get('HOME', '')}/.local/share/docs")


def _named(name: str) -> str:
    if not re.fullmatch("[A-Za-z0-9_-]+", name):
        raise ValueError(f"not a name: {name!r}")
    return name


def docset_path(spark: SparkSession, folder: str, name: str, raw: bool = False) -> str | None:
    """A document set's folder, or that of its Markdown; None if it is not there."""
    at = f"{folder.rstrip('/')}/{_named(name)}" + ("/md/raw" if raw else "")
    return at if exists(spark, at) else None


def delete_docset(spark: SparkSession, folder: str, name: str) -> bool:
    """False if there is none. Names are checked: nothing outside ``folder`` can go."""
    at = docset_path(spark, folder, name)
    return at is not None and delete(spark, at)


def plan_scrape(url: str, name: str, folder: str, max_pages: int = MAX_PAGES) -> str:
    """The command that scrapes a site into a document set; nothing runs."""
    if not re.match(r"^https?://[^/?#\s'\"]+[^\s'\"]*$", url):
        raise ValueError(f"not a URL: {url!r}")
    return f"python -m marlstone.cli scrape {url} --name {_named(name)} --out {folder.rstrip('/')}/{name} --max-pages {int(max_pages)}"


#: File of a rule by tool; C has one file for all.
RULE_FILES = {"windsurf": ".windsurf/rules/{name}.md", "cursor": ".cursor/rules/{name}.mdc", "claude": "CLAUDE.md", "antigravity": ".agent/rules/{name}.md"}


def install(spark: SparkSession, folder: str, name: str, project: str, tool: str = "windsurf") -> str:
    """Copies a document set into a project and writes its rule file; gives that file's path."""
    tool = tool if tool in ROOTS else "windsurf"
    source = docset_path(spark, folder, name)
    index = read_text(spark, f"{source}/AGENTS.md") if source else None
    if index is None:
        raise ValueError(f"no document set: {name!r}")
    project = project.rstrip("/")
    raw, target = f"{source}/md/raw", f"{project}/{ROOTS[tool]}/{name}"
    delete(spark, target)
    (from_, a), (to, b) = (files_of(spark, x) for x in (raw if exists(spark, raw) else source, target))
    to.mkdirs(b.getParent())
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(from_, a, to, b, False, spark.sparkContext._jsc.hadoopConfiguration())
    file = f"{project}/{RULE_FILES[tool].format(name=name)}"
    write_text(spark, file, render_rule(tool, name, index.strip(), read_text(spark, file) or ""))
    return file


def uninstall(spark: SparkSession, name: str, project: str, tool: str = "windsurf") -> bool:
    """Removes what ``install`` has put there; False if there was nothing."""
    tool = tool if tool in ROOTS else "windsurf"
    project = project.rstrip("/")
    gone = delete(spark, f"{project}/{ROOTS[tool]}/{_named(name)}")
    file = f"{project}/{RULE_FILES[tool].format(name=name)}"
    if tool != "claude":
        return delete(spark, file) or gone
    if (old := read_text(spark, file)) is not None:
        write_text(spark, file, remove_rule(old, name))
    return gone


def installed(spark: SparkSession, project: str, tool: str = "windsurf") -> list[str]:
    """Names of the document sets of a project: folders that have a rule file, or all where one file serves all."""
    tool = tool if tool in ROOTS else "windsurf"
    project = project.rstrip("/")
    names = [x.rstrip("/").split("/")[-1] for x in found(spark, f"{project}/{ROOTS[tool]}/*")]
    return [x for x in names if tool == "claude" or exists(spark, f"{project}/{RULE_FILES[tool].format(name=x)}")]
