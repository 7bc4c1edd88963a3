"""Cleaning of Markdown in eleven ordered steps, each a Column function of the text.

Only SQL functions, so the steps fuse into the scan's stage. ``mode="compat"`` keeps the known
surprises of the established behaviour; ``"strict"`` maps code languages only where the whole tag
is equal and leaves accented letters alone.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rstrip, strip

# Tables that results depend on, in the order in which they apply.
BAD_LANGUAGES = [
    "sp-pre-placeholder", "shiki", "index-module__DOXIJG__content",
    "language-undefined", "highlight", "code-block",
]

CSS_CLASS_TO_LANGUAGE = {
    "language-js": "javascript", "language-javascript": "javascript",
    "language-jsx": "jsx", "language-ts": "typescript",
    "language-typescript": "typescript", "language-tsx": "tsx",
    "language-py": "python", "language-python": "python",
    "language-python3": "python", "highlight-python": "python",
    "language-sh": "bash", "language-shell": "bash",
    "language-bash": "bash", "language-zsh": "bash",
    "language-console": "bash", "language-terminal": "bash",
    "language-html": "html", "language-xml": "xml",
    "language-css": "css", "language-scss": "scss",
    "language-json": "json", "language-yaml": "yaml",
    "language-yml": "yaml", "language-toml": "toml",
    "language-md": "markdown", "language-markdown": "markdown",
    "language-rs": "rust", "language-rust": "rust",
    "language-go": "go", "language-golang": "go",
    "language-c": "c", "language-cpp": "cpp", "language-c++": "cpp",
    "language-java": "java", "language-kt": "kotlin",
    "language-kotlin": "kotlin", "language-swift": "swift",
    "language-vue": "vue", "language-svelte": "svelte",
    "language-astro": "astro", "language-dockerfile": "dockerfile",
    "language-docker": "dockerfile", "language-sql": "sql",
    "language-graphql": "graphql", "language-diff": "diff",
}

UI_ARTIFACT_PATTERNS = [
    r"ReloadClear\[Fork\]\([^)]*\)",
    r"\[Fork\]\(https://codesandbox\.io[^)]*\)",
    r"\[Open in CodeSandbox\]\([^)]*\)",
    r"\[Open in StackBlitz\]\([^)]*\)",
    r"\[Try it\]\([^)]*\)",
    r"Copy to clipboard", r"Copy code", r"Copied!",
    r"TypeScriptCopy to clipboard", r"JavaScriptCopy to clipboard",
    r"ShellCopy to clipboard", r"BashCopy to clipboard",
    r"\[Previous[^\]]*\]\[Next[^\]]*\]",
    r"\[Previous[^\]]*\]\([^)]*\)\[Next[^\]]*\]\([^)]*\)",
    r"PreviousNext",
    r"Show more", r"Show less", r"Expand", r"Collapse",
    r"\[Edit this page[^\]]*\]\([^)]*\)",
    r"\[Edit on GitHub\]\([^)]*\)",
    r"\[View source\]\([^)]*\)",
    r"Was this page helpful\?",
    r"Was this helpful\?",
    r"\[Yes\]\([^)]*\)\s*\[No\]\([^)]*\)",
    r"We use cookies", r"Cookie Policy", r"Accept cookies", r"Cookie consent",
    r"Accept all cookies?", r"Manage cookies",
    r"On this page", r"Table of Contents",
    r"Skip to [Mm]ain [Cc]ontent", r"Skip to content",
    r"Report an issue", r"\[Report an issue\]\([^)]*\)",
    r"Give feedback", r"Send feedback",
    r"Subscribe\.?$", r"Newsletter\.?$",
    r"Sign in\.?$", r"Log in\.?$", r"Sign up\.?$",
    r"Download this Manual",
    r"Copyright ©.*$", r"Copyright Â©.*$",
    r"MIT License\.?$",
    r"^supported\.$", r"^Send$",
    r"Home\s*>\s*[^\n]+", r"\[Home\]\([^)]*\)\s*>",
    r"Version:\s*\[\d+\.\d+\]", r"Select version",
    r"Copy as Markdown", r"Open Markdown",
    r"Ask Docs AI", r"Open in Claude",
    r"`⌘K``Ctrl K`", r"`⌘K`", r"`Ctrl K`",
    r"^\d{2}\s*$",
    r"^Back$",
    r"^Terminal$",
    r"^\[Docs\]\([^)]*\)\[Blog\]\([^)]*\).*$",
    r"^v\d+\.\d+\s*$",
    r"^\[« Back to all guides\]\([^)]*\)",
    r"^\d+\s+minutes?\s*$",
    r"^\[\d+\]\([^)]*\)\s*$",
    r"^\[Â« Back[^\]]*\]\([^)]*\)",
    r"^Menu$",
    r"^\[.+ on X\]\([^)]*\)\[.+ on .+\]\([^)]*\).*$",
    r"\[\]\([^)]*\)",
    r"^\s*or\s*$",
]

MOJIBAKE_FIXES = [
    ("\u00c3\u00a9", "\u00e9"), ("\u00c3\u00a8", "\u00e8"),
    ("\u00c3\u00aa", "\u00ea"), ("\u00c3\u00ab", "\u00eb"),
    ("\u00c3\u00a0", "\u00e0"), ("\u00c3\u00a1", "\u00e1"),
    ("\u00c3\u00a2", "\u00e2"), ("\u00c3\u00a3", "\u00e3"),
    ("\u00c3\u00a4", "\u00e4"), ("\u00c3\u00a5", "\u00e5"),
    ("\u00c3\u00a7", "\u00e7"), ("\u00c3\u00b1", "\u00f1"),
    ("\u00c3\u00b6", "\u00f6"), ("\u00c3\u00bc", "\u00fc"),
    ("Â©", "©"), ("Â®", "®"), ("Â»", "»"), ("Â«", "«"),
]

SMART_QUOTE_FIXES = [
    ("\u2019", "'"), ("\u2018", "'"),
    ("\u201c", '"'), ("\u201d", '"'),
    ("\u2013", "-"), ("\u2014", "--"),
    ("\u2026", "..."),
]

EMOJI_RESIDUE = r"[\xc3\xc2][\x80-\xbf][\xc2-\xc3]?[\x80-\xbf]?|ðŸ[^\s]{0,8}|â[^\s]{0,4}|Ã[^\s]{0,2}"
ALIASES = {"js": "javascript", "py": "python", "ts": "typescript", "rs": "rust", "sh": "bash", "shell": "bash"}
NAV_LINE = r"^\d+\.\s+\w|^`[^`]+`\[|^\[.+\]\(.+\)\[.+\]\(.+\)|^\[.+\]\(https?://[^)]+\)$|^v\d+\.\d+|^(Back|Claude|Light|Dark|/|>)$|^\d+\s+minutes?$"
FOOTER_LINE = r"(?i:copyright)|(?i:MIT License)|(?i:^\[.+ on (X|GitHub|Discord|Twitter|BlueSky|LinkedIn)\])|(?i:^(Was this helpful|Give feedback|Send feedback))|(?i:^(Subscribe|Newsletter|Sign up for))|^Menu$|^supported\.$|^Send$"
TOC_LINE = r"^[\*\-\+]\s+\[.+\]\(#"
# End of the fixed values.

#: A text without any of these in lower case, and without a line that LINE_ALONE matches, has nothing that a
#: pattern of UI_ARTIFACT_PATTERNS matches: each needs one of them.
ARTIFACT_SIGNS = (
    "[fork](", "[open in", "[try it]", "copy", "copied!", "[previous", "previousnext", "show more", "show less", "expand", "collapse",
    "[edit ", "[view source]", "was this ", "[yes](", "cookie", "on this page", "table of contents", "skip to", "report an issue",
    "give feedback", "send feedback", "subscribe", "newsletter", "sign in", "log in", "sign up", "download this manual", "mit license",
    "supported.", "home", "version:", "select version", "open markdown", "ask docs ai", "open in claude", "`⌘k`", "`ctrl k`",
    "minute", "](", "[docs]",
)
LINE_ALONE = r"^(Send|Back|Terminal|Menu|\s*or|\d{2}|v\d+\.\d+)\s*$"
#: Letters that a search without case takes for i, k or s, though lower case leaves them as they are.
FOLDED = "[\u017f\u0131\u0130\u212a]"
#: Java's flags for which its patterns match as those of Python do: case, lines, Unicode.
PYTHON = "(?imudU)"
#: A non-character that marks where a block begins.
_MARK = "\ufdd0"


def _lines(md: Column) -> Column:
    return F.split(md, "\n", -1)


def _join(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _named(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def _is_title(line: Column) -> Column:
    return F.startswith(line, F.lit("# "))


def _first(lines: Column, test) -> Column:
    """Place of the first line for which test(stripped line) holds, from 0; -1 if there is none."""
    return F.array_position(F.transform(lines, lambda x: test(strip(x))), True).cast("int") - 1


def nav_header(md: Column) -> Column:
    """Lines before the first title go if it is not among the first two lines and 0.3 of them look like navigation."""

    def f(lines: Column) -> Column:
        def g(at: Column) -> Column:
            before = F.filter(F.transform(F.slice(lines, 1, F.greatest(at, F.lit(0))), strip), lambda x: x != "")
            nav = F.size(F.filter(before, lambda x: F.rlike(x, F.lit("(?U)" + NAV_LINE))))
            return F.when((at >= 2) & (F.size(before) > 0) & (nav >= 0.3 * F.size(before)), _join(F.slice(lines, at + 1, F.size(lines)))).otherwise(md)

        return _named(_first(lines, _is_title), g)

    return _named(_lines(md), f)


def duplicate_headings(md: Column) -> Column:
    """Later headings of equal level and text go, wherever they stand; those without text stay."""

    def f(lines: Column) -> Column:
        def key(x: Column) -> Column:
            s = strip(x)
            text = F.lower(strip(F.regexp_extract(s, r"(?dU)^#+\s*(.*)", 1)))
            return F.when(F.startswith(s, F.lit("#")) & (text != ""), F.concat(F.regexp_extract(s, "^(#+)", 1), F.lit(":"), text))

        return _named(F.transform(lines, key), lambda keys: _join(F.filter(lines, lambda x, i: F.get(keys, i).isNull() | (F.array_position(keys, F.get(keys, i)) == i + 1))))

    return _named(_lines(md), f)


def permalinks(md: Column) -> Column:
    """Anchors of headings go, links to anchors become text, headings without text go."""

    def one(x: Column) -> Column:
        y = x
        for pattern, to in ((r"(?U)¶\s*$", ""), (r"\[¶\]\(#[^)]*\)", ""), (r"(?U)\[\]\(\s*#[^)]*\)", ""), (r"(?U)(#+\s*)\[([^\]]+)\]\(#[^)]*\)", "$1$2")):
            y = F.regexp_replace(y, pattern, to)
        return F.when(F.startswith(strip(x), F.lit("#")), rstrip(y)).otherwise(x)

    return _join(F.filter(F.transform(_lines(md), one), lambda x: ~F.rlike(strip(x), F.lit(r"^#{1,6}\z"))))


def toc_after_title(md: Column) -> Column:
    """Bullets that link to anchors right after the first title go, with what stands between and a rule after them."""

    def f(lines: Column) -> Column:
        def g(at: Column) -> Column:
            rest = F.transform(F.slice(lines, at + 2, F.size(lines)), strip)
            skip = lambda x: (x == "") | (~F.rlike(x, F.lit(r"(?U)\S\s+\S")) & ~F.rlike(x, F.lit("^(#|```)")))

            def h(own: Column) -> Column:
                begin = F.array_position(F.transform(own, lambda x: ~skip(x)), True).cast("int")

                def i(k: Column) -> Column:
                    tail = F.slice(own, k, F.size(own))
                    rule = F.array_position(F.transform(tail, lambda x: F.startswith(x, F.lit("---"))), True).cast("int")
                    other = F.array_position(F.transform(tail, lambda x: ~((x == "") | F.startswith(x, F.lit("---")) | F.rlike(x, F.lit("(?U)" + TOC_LINE)))), True).cast("int")
                    stop = F.when((rule > 0) & ((other == 0) | (rule < other)), k + rule).when(other > 0, k + other - 1).otherwise(F.size(own) + 1)
                    kept = F.concat(F.slice(lines, 1, at + 1), F.slice(lines, at + 1 + stop, F.size(lines)))
                    return F.when((at >= 0) & (k > 0) & F.rlike(F.get(own, k - 1), F.lit("(?U)" + TOC_LINE)), _join(kept)).otherwise(md)

                return _named(F.greatest(begin, F.lit(0)), lambda k: F.when(k == 0, md).otherwise(i(F.greatest(k, F.lit(1)))))

            return F.when(at < 0, md).otherwise(_named(rest, h))

        return _named(F.greatest(_first(lines, _is_title), F.lit(-1)), g)

    return _named(_lines(md), f)


def code_languages(md: Column, mode: str = "compat") -> Column:
    if mode == "compat":
        out = functools.reduce(lambda c, x: F.replace(c, F.lit("```" + x[0]), F.lit("```" + x[1])), CSS_CLASS_TO_LANGUAGE.items(), md)
    else:
        out = functools.reduce(lambda c, x: F.regexp_replace(c, r"```\Q" + x[0] + r"\E(?![\w+-])", "```" + x[1]), CSS_CLASS_TO_LANGUAGE.items(), md)
    out = functools.reduce(lambda c, x: F.replace(c, F.lit("```" + x), F.lit("```")), BAD_LANGUAGES, out)

    def one(x: Column, i: Column) -> Column:
        tag = F.lower(F.regexp_extract(x, r"(?U)^(\w*)", 1))
        name = functools.reduce(lambda c, kv: F.when(tag == kv[0], kv[1]).otherwise(c), ALIASES.items(), tag)
        return F.when(i == 0, x).otherwise(F.concat(name, F.regexp_replace(x, r"(?U)^\w+", "")))

    return F.array_join(F.transform(F.split(out, "```(?!`)", -1), one), "```")


def ui_artifacts(md: Column) -> Column:
    """The patterns go one after the other: earlier ones decide what later ones see. Texts without any sign of them stay."""
    low = F.lower(md)
    some = F.rlike(md, F.lit(PYTHON + LINE_ALONE)) | F.rlike(md, F.lit(FOLDED))
    for x in ARTIFACT_SIGNS:
        some = some | F.contains(low, F.lit(x))
    return F.when(some, functools.reduce(lambda c, p: F.regexp_replace(c, PYTHON + p, ""), UI_ARTIFACT_PATTERNS, md)).otherwise(md)


def encoding(md: Column, mode: str = "compat") -> Column:
    """All that is replaced is beyond ASCII."""
    out = functools.reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), [*MOJIBAKE_FIXES, *SMART_QUOTE_FIXES], md)
    out = F.regexp_replace(out, "(?U)" + EMOJI_RESIDUE, "") if mode == "compat" else out
    return F.when(F.rlike(md, F.lit("[^\\x00-\\x7f]")), out).otherwise(md)


def footer(md: Column) -> Column:
    """Cuts at the topmost footer line of the last ones, as far as only footer lines and short gaps follow."""

    def f(lines: Column) -> Column:
        n = F.size(lines)
        tail = F.reverse(F.slice(lines, F.greatest(n - 30, F.lit(0)) + 2, n))
        zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("cut"), F.lit(0).alias("blank"), F.lit(False).alias("stop"))

        def step(acc: Column, x: Column) -> Column:
            s = strip(x)
            blank, foot = s == "", F.rlike(s, F.lit(FOOTER_LINE))
            k = acc["k"] + 1
            return F.struct(
                k.alias("k"),
                F.when(~acc["stop"] & ~blank & foot, k).otherwise(acc["cut"]).alias("cut"),
                F.when(blank, acc["blank"] + 1).when(foot, 0).otherwise(acc["blank"]).alias("blank"),
                (acc["stop"] | (~blank & ~foot & ~((acc["blank"] <= 2) & (acc["cut"] > 0)))).alias("stop"),
            )

        return _named(F.aggregate(tail, zero, step)["cut"], lambda cut: F.when((n >= 5) & (cut > 0), _join(F.slice(lines, 1, F.greatest(n - cut, F.lit(0))))).otherwise(md))

    return _named(_lines(md), f)


def empty_fences(md: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(md, r"(?U)```\w*\n\s*\n```", ""), r"(?U)```\w*\n```", "")


def repeated_blocks_in_page(md: Column) -> Column:
    """Blocks of over 50 characters stay once; a block begins at a heading, a fence, a blank line, and after the latter two. Blank lines go."""

    def f(lines: Column) -> Column:
        alone = lambda x: (strip(x) == "") | F.startswith(strip(x), F.lit("```"))
        begins = lambda x, i: (i > 0) & (alone(x) | F.startswith(strip(x), F.lit("#")) | alone(F.get(lines, F.greatest(i - 1, F.lit(0)))))
        marked = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(begins(x, i), _MARK).otherwise(""), x)), "\n")
        parts = F.split(marked, "\n" + _MARK, -1)
        keep = lambda whole: F.filter(whole, lambda b, i: (strip(b) != "") & ((F.length(strip(b)) <= 50) | (F.array_position(F.transform(whole, strip), strip(b)) == i + 1)))
        return _named(parts, lambda whole: _join(keep(whole)))

    return _named(_lines(md), f)


def whitespace(md: Column) -> Column:
    return strip(_join(F.transform(_lines(F.regexp_replace(md, r"\n{4,}", "\n\n\n")), rstrip)))


#: What a text must hold for a step to change it.
NEEDS = {nav_header: "# ", duplicate_headings: "#", permalinks: "#", toc_after_title: "# ", code_languages: "```", empty_fences: "```"}
STEPS = (nav_header, duplicate_headings, permalinks, toc_after_title, code_languages, ui_artifacts, encoding, footer, empty_fences, repeated_blocks_in_page, whitespace)


def clean(md: Column, mode: str = "compat") -> Column:
    """All steps, in their order; each one's result is computed once."""

    def then(rest: tuple, value: Column) -> Column:
        if not rest:
            return value
        step = rest[0]
        now = step(value, mode) if step in (code_languages, encoding) else step(value)
        if step in NEEDS:
            now = F.when(F.contains(value, F.lit(NEEDS[step])), now).otherwise(value)
        return _named(now, lambda x: then(rest[1:], x))

    return _named(md, lambda x: then(STEPS, x))
