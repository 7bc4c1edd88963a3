"""License scans: fuzzy search of short notices.

A notice of m characters that may have k errors is split into k + 1 pieces; whatever matches with at
most k edits has one of the pieces unchanged (pigeonhole). One automaton finds all pieces of all
notices in a text, and the regex library's bounded-error matching verifies the window around each.
Texts are searched as their words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) joined by
single spaces; spans are given in words.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class Notice(NamedTuple):
    label: str
    phrase: str
    errors: int
    base: bool = False


#: Phrases are words as texts are normalised. Those of ``base`` also count exactly, place by place.
NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 1, True),
    Notice("gpl", "general public license", 2, True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache", "licensed under the apache license version", 4),
    Notice("gpl", "free software foundation either version", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "neither the name of the copyright holder nor the names of its contributors", 6),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc", "creative commons attribution", 2),
    Notice("no-warranty", "provided as is without warranty of any kind", 4),
    Notice("all-rights", "all rights reserved", 1),
)
NOT_WORD = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_SPACED = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))
_LETTER = "0-9a-z\\x80-\\U0010ffff"
SPANS = "array<struct<label:string,first_word:int,end_word:int,errors:int>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPACED).split()


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 parts of nearly equal length, with their places."""
    n, k = len(phrase), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        import ahocorasick
        import regex

        self.notices = notices
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for k, x in enumerate(notices):
            if len(x.phrase) <= x.errors:
                raise ValueError(f"too many errors for {x.phrase!r}")
            for nth, (at, piece) in enumerate(pieces(x.phrase, x.errors)):
                seeds.setdefault(piece, []).append((k, at, nth))
        self.automaton = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?<![{_LETTER}])(?:{regex.escape(x.phrase, literal_spaces=True)}){{e<={x.errors}}}(?![{_LETTER}])") for x in notices]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Words; places of base phrases (notice, first word); verified spans (notice, first word, end word, errors)."""
        own = words(text)
        line = b" ".join(own).decode("utf-8", "replace")  # an edit is a code point; what is no UTF-8 is part of a word
        exact: list[tuple[int, int]] = []
        found: list[tuple[int, int, int, int]] = []
        done = [0] * len(self.notices)
        hits = [(end + 1 - size - at, k, nth) for end, (size, of) in self.automaton.iter(line) for k, at, nth in of]
        hits.sort()
        for begin, k, nth in hits:
            x = self.notices[k]
            size = len(x.phrase)
            if x.base and not nth and line.startswith(x.phrase, begin) and (not begin or line[begin - 1] == " ") and (begin + size == len(line) or line[begin + size] == " "):
                exact.append((begin, k))
            low = max(begin - x.errors, done[k], 0)
            high = line.find(" ", begin + size + x.errors)
            high = len(line) if high < 0 else high
            if low < high and (m := self.patterns[k].search(line, low, high)):
                if any(m.fuzzy_counts) or m.end() > m.start():
                    done[k] = m.end()
                    found.append((m.start(), m.end(), k, sum(m.fuzzy_counts)))
        at = counted = 0
        place: dict[int, int] = {}
        for p in sorted({p for p, _ in exact} | {p for a, b, _, _ in found for p in (a, b)}):
            counted += line.count(" ", at, p)
            at = p
            place[p] = counted
        whole = lambda a: place[a] + (line[a : a + 1] == " ")  # noqa: E731  an edit may take in the space before
        return len(own), [(k, place[p]) for p, k in exact], [(k, whole(a), place[b] + (line[b - 1 : b] != " "), e) for a, b, k, e in sorted(found)]


#: Notices that are sent to the tasks, at most.
MOST_NOTICES = 10_000


def notices_of(table: DataFrame) -> tuple[Notice, ...]:
    """Notices from a table (label, phrase, errors, base), with phrases normalised as texts are; at most MOST_NOTICES.

    Rows without label or words are left out, repeated rows count once; null errors are 0, null base is false.
    """
    found = {}
    for x in table.select("label", "phrase", "errors", "base").limit(MOST_NOTICES + 1).collect():
        phrase = b" ".join(words((x["phrase"] or "").encode())).decode()
        if x["label"] and phrase:
            found[Notice(x["label"], phrase, x["errors"] or 0, bool(x["base"]))] = None
        if len(found) > MOST_NOTICES:
            raise ValueError(f"more than {MOST_NOTICES} notices")
    return tuple(found)


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per document: counts and places of base phrases, labels, score and verified spans.

    ``score`` is the best match's share of unchanged characters, 0 without a match. A null or empty
    text has no words, no labels ('') and null places. ``notices`` are the few well-known ones above
    unless others are given (see ``notices_of``). Repeated rows and doc_ids give a row each; an
    empty table gives none. Only doc_id and text are read; other columns may have any name.
    """

    def make():
        scanner = Scanner(notices)

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                n, exact, found = scanner.scan(text)
                base = sorted({notices[k].label for k, _ in exact})
                labels = sorted({*base, *(notices[k].label for k, *_ in found)})
                score = max([0.0, *(1 - e / len(notices[k].phrase) for k, _, _, e in found)]) if not exact else 1.0
                places = [p for _, p in exact]
                out.append((doc_id, n, len(exact), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), score,
                            [{"label": notices[k].label, "first_word": a, "end_word": b, "errors": e} for k, a, b, e in found]))
            spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("errors", pa.int32())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        return f

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(docs).cast("binary").alias("text"))
    return common.map_arrow(rows, make, SCHEMA, text=1)
