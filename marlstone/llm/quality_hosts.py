"""Quality rules for documents and, with shrunken failure rates, for the hosts they come from.

Only DataFrame functions. Each document's counts are computed inside its row; hosts are added up
from the counts alone. A host's failure rate is shrunk towards the corpus by a beta prior whose
mean and strength are estimated from all hosts: of the spread of their rates, what chance alone
gives at their sizes is taken off (method of moments for the beta-binomial). A host is rejected if
its posterior surely lies above MOST; the verdict is joined back. A document is kept if it breaks
no rule and its host is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: A document that breaks one of these rules fails.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "2 * n_dup_lines > n_lines",
}
#: A host is rejected if its posterior, less so many standard deviations, has more than this share fail.
MOST, SURE = 0.5, 3.09
#: Bytes of rejected hosts' names that may be broadcast.
BROADCAST_BYTES = 32 << 20


def _repeat_words(hashes: Column, order: Column) -> Column:
    """Words covered by windows whose hash another window has. order: (hash, place), sorted."""
    same = F.transform(order, lambda x, i: F.when((x["h"] == F.get(order, i + 1)["h"]) | (x["h"] == F.get(order, i - 1)["h"]), x["i"]))
    starts = F.array_compact(same)
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda k: F.array(k, k + 1, k + 2)))))


def counts(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, host, the counts, and the columns of ``keep``. 3-word windows are compared by 64-bit hash."""
    text = common.text_or_empty(docs)
    rows = docs.select(*keep, docs["doc_id"].alias("doc_id"), docs["source"].alias("host"), text.alias("_t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"), F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_l"))
    kept = rows.columns[: len(keep)]
    hashes = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)))
    rows = rows.select(
        *kept, "doc_id", "host", F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - F.regexp_count("_t", F.lit(WHITE))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        hashes.alias("_h"),
    )
    order = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    rows = rows.select(*kept, "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", order.alias("_o"))
    return rows.select(
        *kept, "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.col("_o").isNull(), 0).otherwise(_repeat_words(F.col("_o"), F.col("_o"))).cast("long").alias("n_repeat_words"),
    )


def failed(*rules: str) -> Column:
    return F.expr(" or ".join(f"({RULES[x]})" for x in rules or RULES))


def host_verdicts(rows: DataFrame, most: float = MOST) -> DataFrame:
    """host, rows, failures by rule, shrunken rate, its lower bound, host_kept. A null host is a host of its own.

    ``rows`` has host and, per rule, whether it is broken. A hot host is added up before the shuffle.
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.greatest(*RULES)).alias("failed"), *[F.count_if(k).alias(f"failed_{k}") for k in RULES])
    f, n = F.col("failed").cast("double"), F.col("n").cast("double")
    # one row, from sums over all hosts
    at = hosts.agg(F.sum(f).alias("f"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(f * f / n).alias("s2"), F.sum(n * n).alias("n2")).first()
    alpha, beta = beta_prior(at["f"] or 0.0, at["n"] or 0.0, at["k"], at["s2"] or 0.0, at["n2"] or 0.0)
    shrunk = (f + F.lit(alpha)) / (n + F.lit(alpha + beta))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + F.lit(alpha + beta + 1)))
    return hosts.withColumn("rate", shrunk).withColumn("rate_low", F.col("rate") - F.lit(SURE) * spread).withColumn("host_kept", F.col("rate_low") <= F.lit(most))


def beta_prior(failed: float, n: float, hosts: int, squares: float, sizes2: float) -> tuple[float, float]:
    """From the sums over hosts of failures, rows, hosts, failures^2 / rows, and rows^2.

    With equal true rates the size-weighted spread is (hosts - 1) * mean * (1 - mean) by chance;
    what is more is 1 / (alpha + beta + 1) of what rates of 0 and 1 alone would give.
    """
    if not n:
        return 1.0, 1.0
    mean = failed / n
    if not 0 < mean < 1:
        return 2 * mean + 0.5, 2 * (1 - mean) + 0.5
    share = mean * (1 - mean)
    more = squares - n * mean * mean - (hosts - 1) * share
    room = share * (n - sizes2 / n - (hosts - 1))
    strength = 1000.0 if hosts < 2 or more <= 0 or room <= 0 else min(1000.0, max(2.0, room / more - 1))
    return mean * strength, (1 - mean) * strength


def rule_columns() -> list[Column]:
    """Of rows with counts: whether each rule is broken."""
    return [F.expr(x).alias(k) for k, x in RULES.items()]


def judge(docs: DataFrame, most: float = MOST) -> DataFrame:
    """One row per document: counts, ``base_failed``, the host's shrunken rate, and ``kept``.

    Null and empty texts have counts of 0 and fail as short. Documents with a null source share one
    host. Repeated rows give a row each and all count; an empty table gives no rows. Only doc_id,
    text and source are read, so other columns may have any name. A hot host is added up before the
    shuffle; in the join back Spark may split its rows, as each meets one row of the other side.
    """
    scratch = common.Scratch(docs.sparkSession, "quality")
    rows = scratch.cut(counts(docs), "counts")
    hosts = scratch.cut(host_verdicts(rows.select("host", *rule_columns()), most).select(F.col("host").alias("_host"), "rate", "host_kept"), "hosts")
    rows = rows.join(hosts, rows["host"].eqNullSafe(hosts["_host"]))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed("short", "repetitive").alias("base_failed"), (~failed() & F.col("host_kept")).alias("kept"), F.col("rate").alias("host_rate")
    )


def keep(docs: DataFrame, most: float = MOST) -> DataFrame:
    """The documents that ``judge`` keeps, with all columns as they were.

    Texts are read and counted once: beside each document's host and the rules it breaks, a table
    holds the document itself if it breaks none. Null, repeated and empty cases are as in ``judge``.
    """
    scratch = common.Scratch(docs.sparkSession, "quality")
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), docs["text"].alias("text"))
    rows = counts(whole, F.col("_doc"))
    rows = rows.select("host", *rule_columns(), "_doc")
    rows = scratch.cut(rows.select("host", *RULES, F.when(~F.greatest(*RULES), F.col("_doc")).alias("_doc")), "rows")
    bad = scratch.cut(host_verdicts(rows.select("host", *RULES), most).filter(~F.col("host_kept")).select(F.col("host").alias("_bad")), "bad")
    held = bad.agg(F.sum(F.coalesce(F.octet_length("_bad"), F.lit(0)) + F.lit(32)).alias("x")).first()["x"] or 0
    if held <= BROADCAST_BYTES:  # else the documents are dealt by host
        bad = F.broadcast(bad)
    good = rows.filter(~F.greatest(*RULES)).select("host", "_doc")
    return good.join(bad, F.col("host").eqNullSafe(F.col("_bad")), "left_anti").select("_doc.*")
