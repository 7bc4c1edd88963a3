"""URL functions as Columns. One regular expression splits a URL into scheme, host and path."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = r"^([^:/?#]+)://([^/?#]*)([^?#;]*)"
# Endings of URLs that are no pages, and signs of documentation in a path.
SKIP_EXTENSIONS = ("pdf", "zip", "tar", "gz", "png", "jpg", "jpeg", "gif", "svg", "css", "js", "woff", "woff2", "ttf", "ico", "xml", "json", "mp4", "mp3", "webm", "webp", "avif")
DOC_SIGNALS = ("/docs/", "/doc/", "/guide/", "/tutorial/", "/api/", "/reference/", "/learn/", "/manual/", "/handbook/", "/getting-started", "/quickstart", "/overview")
NO_PAGE = ("javascript:", "mailto:", "tel:")
NAVIGABLE = rf"\.({'|'.join(SKIP_EXTENSIONS)})$"


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 3)


def base(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def _no_tail(p: Column) -> Column:
    return F.rtrim(p, F.lit("/"))


def _plain_path(p: Column) -> Column:
    """Without ``.`` and ``..`` segments (RFC 3986, 5.2.4); ``p`` starts with a slash."""
    none = F.array().cast("array<string>")
    parts = F.split(F.regexp_extract(p, "^/(.*)", 1), "/", -1)
    last = F.element_at(parts, -1)
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, none, lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.when(~F.rlike(p, F.lit(r"/\.\.?(/|$)")), p).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")))


def absolute(href: Column, page: Column) -> Column:
    """``href`` resolved against the URL of its page, by SQL functions alone."""
    p, tail = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)", 1)
    own = path(page)
    below = F.concat(F.when(own == "", "/").otherwise(F.regexp_extract(own, "^(.*/)", 1)), p)
    return (
        F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(page), F.lit(":"), href))
        .when(p == "", F.concat(base(page), F.regexp_extract(page, "^[^:/?#]+://[^/?#]*([^?#]*)", 1), tail))
        .when(F.startswith(href, F.lit("/")), F.concat(base(page), _plain_path(p), tail))
        .otherwise(F.concat(base(page), _plain_path(below), tail))
    )


def canonical(url: Column, page: Column | None = None) -> Column:
    """Without query, fragment, parameters and trailing slashes; null for an empty URL.

    A URL without scheme is resolved against ``page``; without one it is null.
    """
    whole = url if page is None else absolute(url, page)
    p = _no_tail(path(whole))
    return F.when((F.length(url) > 0) & (scheme(whole) != ""), F.concat(base(whole), F.when(p == "", "/").otherwise(p)))


def navigable(url: Column) -> Column:
    return ~F.rlike(F.lower(path(url)), F.lit(NAVIGABLE))


def to_file(url: Column) -> Column:
    """The path of the Markdown file of a URL. ``..`` segments stay: sinks must refuse them."""
    p = F.trim(path(url), F.lit("/"))
    p = F.when(p == "", "index").otherwise(p)
    return F.concat(F.regexp_replace(F.regexp_replace(p, r"\.html?$", ""), r"(?U)[^\w/\-.]", "_"), F.lit(".md"))


def safe_file(p: Column) -> Column:
    return ~F.rlike(p, F.lit(r"(^|[/\\])\.\.([/\\]|$)|^/"))


def first_segment(url: Column) -> Column:
    s = F.regexp_extract(path(url), "^/*([^/]*)", 1)
    return F.when(s == "", "/").otherwise(F.concat(F.lit("/"), s, F.lit("/")))


def under(url: Column, start_path: str) -> Column:
    """Plain prefix, as for sitemap rows: /docs also has /docs-old."""
    return F.startswith(_no_tail(path(url)), F.lit(start_path.rstrip("/")))


def looks_like_doc(url: Column, start_url: str) -> Column:
    import re

    p = F.lower(path(url))
    m = re.match(SPLIT, start_url)
    first = (m[3].lower().split("/") + [""])[1] if m and "/" in m[3] else ""
    signs = [*([f"/{first}/"] if first else []), *DOC_SIGNALS]
    found = F.lit(False)
    for x in signs:
        found = found | F.contains(p, F.lit(x))
    return found


def valid_name(name: Column) -> Column:
    return F.rlike(name, F.lit("^[A-Za-z0-9_-]+$"))


def internal_links(links: Column, url: Column) -> Column:
    """Same-host targets, resolved against the page, without fragment, query and parameters; all of them, in order."""
    own = F.transform(links, lambda x: F.trim(F.regexp_extract(x, "^([^#]*)", 1)))
    own = F.filter(own, lambda x: (x != "") & ~F.rlike(x, F.lit(f"^({'|'.join(NO_PAGE)})")))
    full = F.transform(own, lambda x: absolute(x, url))
    return F.transform(F.filter(full, lambda x: host(x) == host(url)), lambda x: F.concat(base(x), path(x)))


@F.pandas_udf(T.StringType())
def sitemap_title(p: pd.Series) -> pd.Series:
    """Path to title: slashes to `` > ``, hyphens to spaces, title case after every non-letter."""
    return p.map(lambda x: None if x is None else (x.strip("/").replace("/", " > ").replace("-", " ").title() or "Index"))
