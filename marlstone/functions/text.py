"""Metrics of Markdown, and blocks, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """All Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def headings(md: Column) -> Column:
    return F.regexp_count(md, F.lit(r"(?mdU)^#{1,6}\s+")).cast("long")


def code_blocks(md: Column) -> Column:
    return F.floor(F.regexp_count(md, F.lit("(?md)^```")) / 2).cast("long")


def heading_list(md: Column, most: int = 20) -> Column:
    return F.slice(F.transform(F.regexp_extract_all(md, F.lit(r"(?mdU)^(#{1,6}\s+.+)$"), F.lit(1)), strip), 1, most)


def content_hash(md: Column) -> Column:
    return F.md5(F.encode(md, "UTF-8"))


def size_bytes(md: Column) -> Column:
    return F.octet_length(md).cast("long")


def blocks(md: Column) -> Column:
    """Parts between blank lines; a line that starts ``# `` begins one. Trimmed, none empty."""
    parted = F.regexp_replace(md, r"(?mdU)^(?=[^\S\n]*# [^\S\n]*\S)", "\n\n")
    return F.filter(F.transform(F.split(parted, r"(?U)\n\s*\n"), strip), lambda b: b != "")


def normal(block: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(block, r"(?U)\s+", " ")))
