"""Sources: fetching over HTTP, sitemaps, robots.txt, trees of Markdown files."""

from __future__ import annotations

import gzip
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import cut

GONE = frozenset({401, 403, 404, 410})
# Places tried where robots.txt names no sitemap, and the most URLs of one location.
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap1.xml")
MAX_URLS, MAX_DEPTH = 5000, 3


def fetch_one(url: str, retries: int = 3, timeout: float = 30, pause=time.sleep) -> str | None:
    """The page, or None: at once if it is gone, after ``retries`` more tries otherwise."""
    for k in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "marlstone"}), timeout=timeout) as r:
                raw = r.read()
                return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode(r.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code in GONE:
                return None
        except (OSError, ValueError):
            pass
        if k < retries:
            pause(2**k + random.random())
    return None


ENGINES = ("curl", "selenium")


def fetch(frontier: DataFrame, workers: int = 10, get=fetch_one, engine: str = "curl", render=None) -> DataFrame:
    """pages(url, html) of frontier(url); pages that fail are left out.

    ``engine`` "selenium" calls ``render(urls)``, a generator of (url, html or None) that keeps one
    browser for a partition's pages; one partition, as a browser is. Without ``render`` it falls back
    to plain fetching.
    """
    if engine not in ENGINES:
        raise ValueError(f"not an engine: {engine!r}")
    if engine == "selenium" and render is not None:

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in it:
                yield pd.DataFrame(list(render(rows["url"])), columns=["url", "html"])

        dealt = frontier.select("url").coalesce(1)
    else:

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in it:
                yield pd.DataFrame({"url": rows["url"], "html": [get(u) for u in rows["url"]]})

        dealt = frontier.select("url").repartition(workers, "url")
    return dealt.mapInPandas(run, "url string, html string").filter("html is not null")


def trial(url: str, get=fetch_one, render=None) -> tuple[str | None, str | None]:
    """One try for each engine, without retries: what plain fetching and the browser give."""
    plain = get(url, 0) if get is fetch_one else get(url)
    try:
        shown = next((h for _, h in render([url])), None) if render is not None else None
    except Exception:  # noqa: BLE001  a browser that fails is one that is not there
        shown = None
    return plain, shown


def robots_sitemaps(robots: DataFrame, there=None) -> DataFrame:
    """Of robots(base, txt): base, ord, location.

    Where none is named, the first standard place that ``there(url)`` says exists, or, without
    ``there``, all of them.
    """
    named = robots.select("base", F.transform(F.regexp_extract_all("txt", F.lit(r"(?im)^Sitemap:[ \t]*(\S.*)$"), F.lit(1)), F.trim).alias("l"))
    usual = F.array(*[F.concat("base", F.lit(x)) for x in SITEMAPS])
    if there is not None:

        @F.pandas_udf("array<string>")
        def first(named: pd.Series, usual: pd.Series) -> pd.Series:
            return pd.Series([[] if len(n) else [x for x in [next((y for y in u if there(y)), None)] if x] for n, u in zip(named, usual, strict=True)])

        usual = first("l", usual)
    return named.select("base", F.posexplode(F.when(F.size("l") > 0, F.col("l")).otherwise(usual)).alias("ord", "location"))


_NS = "{http://www.sitemaps.org/schemas/sitemap/0.9}"


def _locations(xml: str | None) -> tuple[list[str], list[str]]:
    """Pages and further sitemaps of a sitemap; nothing if it is broken or of another namespace."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except (ElementTree.ParseError, ValueError):
        return [], []
    of = lambda kind: [t for x in root.iter(f"{_NS}{kind}") if (t := (x.findtext(f"{_NS}loc") or "").strip())]
    return of("url"), of("sitemap")


@F.pandas_udf(T.StructType([T.StructField(x, T.ArrayType(T.StringType())) for x in ("urls", "maps")]))
def sitemap_locations(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_locations(x) for x in xml], columns=["urls", "maps"])


def sitemap_urls(files: DataFrame, top: DataFrame) -> DataFrame:
    """location, pos, url of the sitemaps files(location, xml), from top(location) down through indexes.

    A bad file gives nothing. A location's index is followed MAX_DEPTH levels deep, and each top
    location gives at most MAX_URLS, in the order of the indexes. With a column ``ord`` in ``top``
    it is kept, so that (ord, pos) is the order of all.
    """
    good = cut(files.select("location", sitemap_locations("xml").alias("x")).select("location", "x.urls", "x.maps"), "sitemaps")
    keep = ["ord"] if "ord" in top.columns else []
    at = top.select(*keep, F.col("location").alias("root"), "location", F.lit("").alias("order"))
    found: DataFrame | None = None
    for _ in range(MAX_DEPTH + 1):
        now = at.join(good, "location")
        rows = now.select(*keep, "root", "order", F.posexplode("urls").alias("pos", "url"))
        found = rows if found is None else found.unionByName(rows)
        at = now.select(*keep, "root", "order", F.posexplode("maps").alias("pos", "location")).select(*keep, "root", "location", F.concat("order", F.format_string("%06d.", "pos")).alias("order"))
    w = Window.partitionBy(*keep, "root").orderBy("order", "pos")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MAX_URLS).select(*keep, F.col("root").alias("location"), (F.col("n") - 1).alias("pos"), "url")


def markdown_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path (below ``folder``) and content of all Markdown files, in the order of path parts."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return rows.select(F.regexp_replace("_metadata.file_path", ".*" + folder.rstrip("/").replace(".", r"\.") + "/", "").alias("path"), F.col("value").alias("content")).orderBy(F.split("path", "/"))


def first_files(spark: SparkSession, folder: str, n: int = 3) -> DataFrame:
    """The first files of a Markdown tree, for a look at what a crawl has given."""
    return markdown_tree(spark, folder).limit(n)


def site_pages(spark: SparkSession, start_url: str, most: int, workers: int = 10, get=fetch_one) -> DataFrame:
    """pages(url, html) of a site: what its sitemaps name below the start URL's host, the start page first."""
    base = re.match(r"^[^:/?#]+://[^/?#]*", start_url)[0]
    robots = spark.createDataFrame([(base, get(f"{base}/robots.txt") or "")], "base string, txt string")
    places = robots_sitemaps(robots, lambda u: get(u) is not None)
    files, at = [], [x["location"] for x in places.orderBy("ord").collect()]
    for _ in range(MAX_DEPTH + 1):  # sitemaps are few; what they name is a table
        now = [(u, get(u) or "") for u in at]
        files += now
        at = [x for _, xml in now for x in _locations(xml)[1]][:MAX_URLS]
    maps = spark.createDataFrame(files, "location string, xml string").dropDuplicates(["location"])
    named = sitemap_urls(maps, places.select("ord", "location")).orderBy("ord", "pos").select("url").limit(most)
    start = spark.createDataFrame([(start_url,)], "url string")
    return fetch(start.unionByName(named).distinct(), workers, get)
