"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Only DataFrame functions. The battery takes every run of 20 or more characters of
``[A-Za-z0-9+/_=-]``, infers its encoding from the characters it uses, and tests

* uniformity over the alphabet (chi-squared),
* runs of characters of one kind (upper case, lower case, digits, others), and of digits,
* serial correlation of neighbouring characters.

A run that one of them rejects as random (Bonferroni over the three) is left alone. For the rest,
``p_natural`` is the chance that natural text of the same encoding and length would look as random:
the distances of chi-squared and of both numbers of runs from what words joined to identifiers give,
added up with fixed weights. All three grow with the length. Benjamini-Hochberg over all runs of a
length class in the corpus sets the largest ``p_natural`` that counts as a find, from a histogram of
fixed size. Digits alone are numbers and never a find.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Words of which one must stand in a text with an assignment, for a cheap test before the pattern.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Pattern, alphabet; a smaller alphabet is tried first. The last takes what is left. Hyphens that are
#: not in the alphabet stand between groups and go before the tests. Letters alone are no key of 36 characters.
ENCODINGS = (
    (r"\A[0-9]+\z", "0123456789"),
    (r"\A[0-9a-f]+\z", "0123456789abcdef"),
    (r"\A[0-9A-F]+\z", "0123456789ABCDEF"),
    (r"\A[A-Z2-7]+\z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"\A[A-Za-z0-9]+\z", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"\A(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]+\z", _LOWER + _DIGITS),
    (r"\A(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]+\z", _UPPER + _DIGITS),
    (r"\A(?=[0-9-]*[a-f])[0-9a-f]+(?:-[0-9a-f]+)+\z", "0123456789abcdef"),
    (r"\A(?=[0-9-]*[A-F])[0-9A-F]+(?:-[0-9A-F]+)+\z", "0123456789ABCDEF"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
)
TRIED = sorted(range(len(ENCODINGS) - 1), key=lambda k: len(ENCODINGS[k][1]))
GROUPED = tuple(k for k, (x, _) in enumerate(ENCODINGS) if "(?:-" in x)
#: What natural text has, by encoding: the chance that two characters are equal, that a character is of
#: another kind than the one before, and that one of the two is a digit and the other is not.
NATURAL = (
    (0.1, 0.0, 0.0), (0.1, 0.15, 0.15), (0.1, 0.15, 0.15), (0.066, 0.05, 0.04), (0.054, 0.33, 0.04),
    (0.062, 0.1, 0.06), (0.062, 0.1, 0.06), (0.1, 0.15, 0.15), (0.1, 0.15, 0.15), (0.052, 0.36, 0.05),
)
#: Weights of chi-squared, runs of a kind, runs of digits; how many times the variance of independent
#: characters the last has; mean and spread of the sum, and most that runs of digits may count.
WEIGHTS, DIGIT_SPREAD, SUM_MEAN, SUM_SPREAD, DIGIT_MOST = (1.0, 0.7, 0.7), 2.0, 0.1, 1.15, 6.0
KIND_RUN, DIGIT_RUN = "[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+", "[0-9]+|[^0-9]+"
#: Least lengths of the classes in which discoveries are controlled.
CLASSES = (20, 32, 48, 80)
#: Bins of -ln(p), each 1 / BIN wide.
BIN, BINS = 20, 2000
SPAN = "array<struct<start:int,kind_no:int,end:int>>"


def _spans(found: Column, between: Column, kind: int, keep) -> Column:
    """Spans of the matches ``found`` that stand between the parts ``between``; keep(place) drops some."""
    n = F.size(found)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        start = acc["at"] + F.length(F.get(between, k))
        end = start + F.length(F.get(found, k))
        span = F.array(F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind_no"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(keep(k), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), zero, step)["out"]).otherwise(F.array().cast(SPAN))


def _phi(z: Column) -> Column:
    """The normal distribution function (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _changes(alphabet: str) -> tuple[float, float]:
    """Of characters drawn evenly: the chance that neighbours are of different kinds, and the covariance of that with the next."""
    kinds = [sum(c in own for c in alphabet) / len(alphabet) for own in (_UPPER, _LOWER, _DIGITS)]
    kinds.append(1 - sum(kinds))
    chance = 1 - sum(x * x for x in kinds)
    return chance, sum(x * (1 - x) ** 2 for x in kinds) - chance * chance


def battery(token: Column) -> Column:
    """struct<p_random, p_natural> of a run of characters without padding."""
    which = F.lit(len(ENCODINGS) - 1)
    for k in reversed(TRIED):
        which = F.when(F.rlike(token, F.lit(ENCODINGS[k][0])), F.lit(k)).otherwise(which)
    one = lambda s, f: F.transform(F.array(s), f)[0]  # noqa: E731  names a value, so that it is computed once

    def with_encoding(k: Column) -> Column:
        of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), k + 1)
        alphabet = of([a for _, a in ENCODINGS])
        bare = F.when(k.isin(*GROUPED), F.replace(token, F.lit("-"), F.lit(""))).otherwise(token)
        random = [_changes(a) for _, a in ENCODINGS]

        def with_places(at: Column) -> Column:
            return _tests(at, F.length(alphabet), F.regexp_count(bare, F.lit(KIND_RUN)) - 1, F.regexp_count(bare, F.lit(DIGIT_RUN)) - 1, [of(x) for x in zip(*NATURAL, strict=True)], [of(x) for x in zip(*random, strict=True)])

        tested = one(F.transform(F.split(bare, ""), lambda c: F.position(c, alphabet) - 1), with_places)
        return F.when(k != 0, tested)

    return one(which, with_encoding)


def _tests(at: Column, size: Column, changes: Column, digit_changes: Column, natural: list[Column], random: list[Column]) -> Column:
    """at: places of the characters in an alphabet of ``size``. natural: see NATURAL; random: see ``_changes``."""
    n, a, df = F.size(at).cast("double"), size.cast("double"), (size - 1).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    seen = F.aggregate(F.array_distinct(at), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter(at, lambda y: y == x)).cast("double"), 2.0))
    chi = a / n * seen - n
    z_chi = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    chance, covariance = random
    z_runs = (changes - (n - 1) * chance) / F.sqrt((n - 1) * chance * (1 - chance) + 2 * (n - 2) * covariance)
    mean = total(F.transform(at, lambda x: x.cast("double"))) / n
    spread = total(F.transform(at, lambda x: x.cast("double") * x)) - n * mean * mean
    # Deviations are multiplied, not the places themselves: the ends count as often as the middle.
    lag = total(F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: (F.get(at, k).cast("double") - mean) * (F.get(at, k - 1).cast("double") - mean)))
    z_serial = F.when(spread > 0, lag / F.when(spread > 0, spread).otherwise(1.0) * F.sqrt(n)).otherwise(8.0)
    worst = F.least(_phi(-z_chi), 2 * _phi(-F.abs(z_runs)), 2 * _phi(-F.abs(z_serial)))
    same, change, digit_change = natural
    gap = (n - 1) * (a * same - 1)
    z = [
        (df + gap - chi) / F.sqrt(2 * (df + 2 * gap)),
        (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change)),
        F.least(F.lit(DIGIT_MOST), (digit_changes - (n - 1) * digit_change) / F.sqrt((n - 1) * digit_change * (1 - digit_change) * DIGIT_SPREAD)),
    ]
    sum_ = (sum(w * x for w, x in zip(WEIGHTS, z, strict=True)) / math.sqrt(sum(w * w for w in WEIGHTS)) - SUM_MEAN) / SUM_SPREAD
    return F.struct(F.least(F.lit(1.0), 3 * worst).alias("p_random"), _phi(-sum_).alias("p_natural"))


def _candidates(runs: Column, spans: Column, alpha: float) -> Column:
    """Spans of the runs with their length class and bin; those rejected as random have bin -1."""

    def one(k: Column) -> Column:
        token = F.rtrim(F.get(runs, k), F.lit("="))
        size = F.length(token)
        cls = sum((F.when(size >= x, 1).otherwise(0) for x in CLASSES[1:]), F.lit(0))
        p = F.when(size >= CLASSES[0], battery(token))
        return F.transform(F.array(p), lambda p: F.struct(
            F.get(spans, k)["start"].alias("start"), F.get(spans, k)["end"].alias("end"), cls.cast("int").alias("cls"),
            F.when(p.isNull() | (p["p_random"] < alpha), -1).otherwise(F.least(F.lit(BINS), F.floor(-F.ln(F.greatest(p["p_natural"], F.lit(1e-60))) * BIN))).cast("int").alias("bin"),
            p.isNotNull().alias("tested"),
        ))[0]

    return F.when(F.size(runs) > 0, F.transform(F.sequence(F.lit(0), F.size(runs) - 1), one))


def candidates(docs: DataFrame, *keep: Column, alpha: float = 0.001) -> DataFrame:
    """doc_id, spans of the fixed patterns by kind, and the battery's candidates."""
    text = common.text_or_empty(docs)
    lower = F.lower(text)
    has = F.contains(lower, F.lit(KEYWORDS[0]))
    for x in KEYWORDS[1:]:
        has = has | F.contains(lower, F.lit(x))
    none = F.array().cast("array<string>")
    found = lambda pattern, when=None: (F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)) if when is None else F.when(when, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(none))
    rows = docs.select(*keep, docs["doc_id"].alias("doc_id"), text.alias("_t"), has.alias("_has"))
    kept = rows.columns[: len(keep)]
    rows = rows.select(*kept, "doc_id", "_t", found(ASSIGN, F.col("_has")).alias("_a"), found(ACCESS, F.contains("_t", F.lit("AKIA"))).alias("_k"), found(RUN).alias("_r"))
    any_hex = F.exists("_r", lambda x: F.rlike(x, F.lit(HEX))) | F.rlike("_t", F.lit(HEX))
    rows = rows.withColumn("_x", found(HEX, any_hex))
    between = lambda c, pattern: F.when(F.size(c) > 0, F.split("_t", pattern, -1))
    rows = rows.select(
        *kept, "doc_id", "_a", "_k", "_x", "_r", between("_a", ASSIGN).alias("_ab"), between("_k", ACCESS).alias("_kb"), between("_x", HEX).alias("_xb"), between("_r", RUN).alias("_rb"),
        F.when(F.size("_a") > 0, F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2))).alias("_av"),
    )
    yes = lambda k: F.lit(True)
    rows = rows.select(
        *kept, "doc_id", "_r",
        _spans(F.col("_a"), F.col("_ab"), 0, lambda k: F.length(F.get(F.col("_av"), k)) >= 6).alias("assign"),
        _spans(F.col("_k"), F.col("_kb"), 1, yes).alias("access"), _spans(F.col("_x"), F.col("_xb"), 2, yes).alias("hex"), _spans(F.col("_r"), F.col("_rb"), 3, yes).alias("_rs"),
    )
    return rows.select(*kept, "doc_id", "assign", "access", "hex", _candidates(F.col("_r"), F.col("_rs"), alpha).alias("runs"))


def thresholds(rows: DataFrame, rate: float = 0.01) -> list[int]:
    """Least bin that is a find, by length class: Benjamini-Hochberg over all runs of the corpus."""
    bins = rows.select(F.explode("runs").alias("x")).filter("x.tested").groupBy("x.cls", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    by: dict[int, dict[int, int]] = {}
    for cls, b, n in bins.collect():  # at most len(CLASSES) * (BINS + 2) rows
        by.setdefault(cls, {})[b] = n
    return [least_bin(by.get(k, {}), rate) for k in range(len(CLASSES))]


def least_bin(bins: dict[int, int], rate: float) -> int:
    tests, finds, least = sum(bins.values()), 0, BINS + 1
    for b in sorted((b for b in bins if b >= 0), reverse=True):
        finds += bins[b]
        if math.exp(-b / BIN) <= rate * finds / tests:
            least = b
    return least


def _finds(least: list[int]) -> Column:
    cut = F.array(*[F.lit(x) for x in least])
    good = F.filter(F.coalesce("runs", F.array().cast("array<struct<start:int,end:int,cls:int,bin:int,tested:boolean>>")), lambda x: x["bin"] >= F.get(cut, x["cls"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind_no"), x["end"].alias("end")))


def _said(spans: Column) -> Column:
    kinds = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind_no"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, alpha: float = 0.001, rate: float = 0.01) -> DataFrame:
    """One row per document with its spans; places are code points, ends exclusive.

    Null and empty texts have no spans. Repeated rows and doc_ids give a row each, and each counts
    as a test. An empty table gives no rows. Only doc_id and text are read; other columns may have
    any name. Texts are read once; only spans are written in between.
    """
    scratch = common.Scratch(docs.sparkSession, "secrets")
    rows = scratch.cut(candidates(docs, alpha=alpha), "spans")
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.select("doc_id", "assign", "access", "hex", base.alias("base"), F.array_sort(F.concat(base, _finds(thresholds(rows, rate)))).alias("all"))
    return rows.select(
        "doc_id", *[F.size(x).cast("long").alias(f"n_{x}") for x in KINDS[:3]], F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"), _said(F.col("all")).alias("spans")
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", alpha: float = 0.001, rate: float = 0.01) -> DataFrame:
    """The documents with every span replaced by ``mask``, n_chars following the text; no document goes.

    Of overlapping spans the earlier one's start and the later one's end hold. All columns stay as
    they were but text and, where it is there, n_chars.
    """
    scratch = common.Scratch(docs.sparkSession, "secrets")
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    rows = scratch.cut(candidates(whole, F.col("_doc"), alpha=alpha), "spans")
    spans = F.array_sort(F.concat("assign", "access", "hex", _finds(thresholds(rows, rate))))
    text = F.col("_doc")["text"]

    def step(acc: Column, x: Column) -> Column:
        begins = x["start"] >= acc["at"]
        between = F.when(begins, F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], between).alias("out"))

    rows = rows.select("_doc", spans.alias("_s"))
    masked = F.aggregate("_s", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.size("_s") > 0, masked).otherwise(text)
    rows = rows.select("_doc", new.alias("_new"))
    return rows.select(*[F.col("_new").alias(c) if c == "text" else F.length("_new").cast("long").alias(c) if c == "n_chars" else F.col("_doc")[c].alias(c) for c in docs.columns])
