"""The whole job: pages to cleaned documents, manifest and index. One Python call a page; the rest is declared."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, html, text, urls
from ..operators import rules, site
from ..tables import cut, delete, write_text


def documents(pages: DataFrame, selector: str = "main", mode: str = "compat", prunes: tuple[str, ...] = html.PRUNE_SELECTORS) -> DataFrame:
    """url, path, title, markdown of pages(url, html) with at least 20 characters of cleaned Markdown.

    A page that cannot be converted gives no row; ``html.page`` says why.
    """
    got = pages.select("url", html.page(selector, tuple(prunes))(F.coalesce("html", F.lit(""))).alias("p"))
    rows = got.select("url", urls.to_file(F.col("url")).alias("path"), F.col("p.title").alias("title"), cleaning.clean(F.col("p.markdown"), mode).alias("markdown"))
    # The marker keeps the length test above the cleaning, which would otherwise be computed twice.
    if rows.isStreaming:
        return rows.filter(F.length("markdown") >= site.MIN_MARKDOWN)
    return rows.withColumn("_row", F.monotonically_increasing_id()).filter((F.col("_row") >= 0) & (F.length(text.strip(F.col("markdown"))) >= site.MIN_MARKDOWN)).drop("_row")


def _content() -> Column:
    return F.concat(F.lit("# "), "title", F.lit("\n\n**Source:** "), "url", F.lit("\n\n"), "markdown", F.lit("\n"))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per file, of URLs that share a path the greatest; sizes and hashes are of the file as it is written. Unsafe paths are refused."""
    c = F.col("content")
    rows = docs.filter(urls.safe_file(F.col("path"))).groupBy("path").agg(F.max(F.struct("url", "title", "markdown", _content().alias("content"))).alias("x")).select("path", "x.*")
    return rows.select("url", F.col("path").alias("md_raw_path"), "title", text.size_bytes(c).alias("size_bytes"), F.array_join(text.heading_list(F.col("markdown")), "\n").alias("headings"), text.content_hash(c).alias("content_hash"))


def wrapped(docs: DataFrame) -> DataFrame:
    """path and content as files have it; of URLs that share a path the greatest wins. Unsafe paths are refused."""
    return docs.filter(urls.safe_file(F.col("path"))).groupBy("path").agg(F.max(F.struct("url", _content().alias("content")))["content"].alias("content"))


def deduplicated(files: DataFrame, ratio: float = site.REPEAT_RATIO, learn: int = site.LEARN_PAGES) -> DataFrame:
    """path, content, removed: blocks learned from the first files (by path parts) go from all of them.

    The files are written once: they are read for the sample, the blocks and the result.
    """
    files = cut(files, "files")
    parts = cut(files.select(F.col("path").alias("page"), F.posexplode(text.blocks(F.col("content"))).alias("pos", "block")), "blocks")
    sample = files.orderBy(F.split("path", "/")).limit(learn).select(F.col("path").alias("page"))
    repeated = cut(site.repeated_blocks(parts.join(F.broadcast(sample), "page", "left_semi"), ratio), "repeated")  # at most ``learn`` rows
    out = site.remove_repeated(parts, repeated).withColumnRenamed("page", "path")
    return files.join(out.withColumnRenamed("content", "_c"), "path", "left").select("path", F.when(F.col("removed") > 0, F.regexp_replace("_c", r"\n{4,}", "\n\n\n")).otherwise(F.col("content")).alias("content"), F.coalesce("removed", F.lit(0)).alias("removed"))


def write_tree(files: DataFrame, folder: str) -> DataFrame:
    """Writes each of files(path, content) as a file of its own below ``folder``; path and bytes of what was written.

    For any store that Arrow's file systems know by its URI. A task that runs again writes the same.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"/{folder}")
        for rows in it:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                at = f"{top.rstrip('/')}/{path}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as f:
                    f.write(content.encode())
            yield pd.DataFrame({"path": rows["path"], "size_bytes": [len(x.encode()) for x in rows["content"]]})

    safe = files.filter(urls.safe_file(F.col("path")))
    return cut(safe.select("path", "content").mapInPandas(run, "path string, size_bytes long"), "written")


def build_docset(pages: DataFrame, start_url: str, folder: str, name: str = "docs", provider: rules.RuleProvider | None = None, engine: str = "curl", max_pages: int = site.MAX_PAGES) -> dict:
    """A document set in ``folder``: md/raw, AGENTS.md, manifest.json, llm-analysis.json. Gives the manifest's totals.

    Rules come from the provider, checked against the site's URLs, or from the start URL. One locale,
    at most ``max_pages`` pages, so index and manifest are of a bounded size. If fewer than MIN_RATE of
    the frontier give documents, the provider is asked once more, over the whole frontier. Hashes and
    sizes are those of the files as they stand after repeated blocks went.
    """
    spark, folder = pages.sparkSession, folder.rstrip("/")
    known = site.frontier(pages.withColumns({"priority": F.lit(0), "ord": F.lit(0)}))
    first = pages.filter(urls.canonical(F.col("url")) == urls.canonical(F.lit(start_url))).select("html").first()
    analysis = rules.analyze(known.select("url"), start_url, first["html"] if first else "", provider)

    def attempt(a: rules.Analysis, locale: bool) -> tuple[DataFrame, float]:
        rows = known.filter(a.scope.column(F.col("url")))
        chosen = cut(site.top(site.one_locale(rows, start_url) if locale else rows, max_pages), "frontier")
        docs = cut(documents(chosen, a.selector, prunes=tuple(a.prunes)), "docs")
        return docs, site.success_rate(chosen, docs).first()["rate"] or 0.0

    docs, rate = attempt(analysis, True)
    if rate < site.MIN_RATE and provider is not None:
        again = rules.analyze(known.select("url"), start_url, first["html"] if first else "", provider, feedback=f"Only {rate:.0%} of the pages gave documents.")
        more, better = attempt(again, False)
        if better > rate:
            docs, analysis = more, again
    files = cut(deduplicated(wrapped(docs)), "files")
    about = docs.groupBy("path").agg(F.max(F.struct("url", "title", text.heading_list(F.col("markdown")).alias("headings"))).alias("x")).select("path", "x.*")
    entries = files.join(about, "path").select("url", F.col("path").alias("md_raw_path"), text.size_bytes(F.col("content")).alias("size_bytes"), "headings", text.content_hash(F.col("content")).alias("content_hash")).orderBy("md_raw_path")
    delete(spark, f"{folder}/md")
    written = write_tree(files, f"{folder}/md/raw").count()
    rows = [x.asDict() for x in entries.collect()]  # at most ``max_pages``
    totals = {"start_url": start_url, "engine_mode": engine, "total_pages": len(rows), "total_files": written}
    write_text(spark, f"{folder}/manifest.json", json.dumps({**totals, "entries": rows}, indent=2, ensure_ascii=False))
    write_text(spark, f"{folder}/llm-analysis.json", json.dumps(analysis.as_dict(), indent=2, ensure_ascii=False))
    index = site.compact_index(files.select("path"), name, start_url).first() if rows else None
    write_text(spark, f"{folder}/AGENTS.md", index["index_line"] if index else "\n")
    return totals
