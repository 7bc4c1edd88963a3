"""Which pages belong to a documentation site and where their content is: rules from a provider, checked, or from the start URL.

A provider is anything with ``propose``; what it answers is JSON, with or without a fence around it.
Nothing here runs inside a task: providers are asked on the driver.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from . import site

# How often a provider is asked again, and how many links its scope must match.
RETRIES, LEAST_LINKS = 2, 3
CALLS, FIRST_DELAY, LONGEST_DELAY = 5, 3, 30


class RuleProvider(Protocol):
    def propose(self, prompt: str) -> str | None: ...


@dataclass
class Analysis:
    scope: site.Scope
    selector: str = "main"
    prunes: list[str] = field(default_factory=lambda: list(html.PRUNE_SELECTORS))
    notes: str = ""

    def as_dict(self) -> dict:
        s = self.scope
        return {
            "scope_rules": {"include_patterns": s.include, "exclude_patterns": s.exclude, "base_url": s.base_url, "description": self.notes},
            "selector_spec": {"content_selector": self.selector, "prune_selectors": self.prunes, "notes": self.notes},
        }


def heuristic(start_url: str, start_html: str = "", before: Analysis | None = None) -> Analysis:
    """Scope from the start URL's first segment; selectors from an earlier analysis, or as the start page has them."""
    scope = site.heuristic_scope(start_url)
    if before is not None:
        return Analysis(scope, before.selector, list(before.prunes), "scope of the start URL")
    return Analysis(scope, html.detect_selector(start_html), notes="heuristic")


def without_fence(said: str) -> str:
    """What stands in a Markdown fence, if the whole answer is one."""
    m = re.match(r"\s*```[A-Za-z]*[ \t]*\n(.*?)(?:\n```\s*)?\Z", said, re.S)
    return (m[1] if m else said).strip()


def parsed(said: str, start_url: str) -> Analysis:
    """ValueError for what is no JSON object. Patterns that do not compile are left out."""
    raw = json.loads(without_fence(said))
    if not isinstance(raw, dict):
        raise ValueError("not an object")
    scope, spec = raw.get("scope_rules") or {}, raw.get("selector_spec") or {}
    texts = lambda x: [str(y) for y in x or [] if isinstance(y, str) and y]
    own = site.Scope(site.heuristic_scope(start_url).base_url, site.Scope.valid(texts(scope.get("include_patterns"))), site.Scope.valid(texts(scope.get("exclude_patterns"))))
    return Analysis(own, spec.get("content_selector") or "main", texts(spec.get("prune_selectors")) or list(html.PRUNE_SELECTORS), str(scope.get("description") or ""))


def prompt(links: DataFrame, start_url: str, start_html: str, feedback: str = "") -> str:
    """What a provider is told: the start page, groups of links, examples, and why an earlier answer failed."""
    groups = "\n".join(f"{x['segment']}: {x['n']} pages, such as {x['paths']}" + (f" and {x['more']} more" if x["more"] else "") for x in site.link_summary(links).orderBy("segment").limit(100).collect())
    shown = "\n".join(x["url"] for x in site.examples(links).collect())
    asked = 'Answer with JSON: {"scope_rules": {"include_patterns": [], "exclude_patterns": [], "description": ""}, "selector_spec": {"content_selector": "", "prune_selectors": []}}'
    return "\n\n".join(x for x in (f"Documentation site: {start_url}", f"Links by first path segment:\n{groups}", f"Examples:\n{shown}", f"Start page:\n{html.sanitize(start_html)}", feedback, asked) if x)


def feedback_of(links: DataFrame, scope: site.Scope, start_url: str, matched: int, total: int) -> str:
    """Why the last scope will not do: ten links it rejects, and ten that look like documentation."""
    rejected = "\n".join(f"- {x['path']}: {x['reason']}" for x in site.reject_reasons(links, scope, 10).collect())
    wanted = "\n".join(f"- {x['p']}" for x in links.filter(urls.looks_like_doc(F.col("url"), start_url)).select(urls.path(F.col("url")).alias("p")).distinct().orderBy("p").limit(10).collect())
    return f"The last rules matched {matched} of {total} links.\nRejected:\n{rejected}\nThese look like documentation and must match:\n{wanted}\nPatterns are searched in paths such as {urls_path(start_url)}; do not anchor them."


def urls_path(url: str) -> str:
    m = re.match(urls.SPLIT, url)
    return m[3] if m else ""


def asked(provider: RuleProvider, text: str, pause=time.sleep) -> str | None:
    """The provider's answer; an empty one or an error is tried again, with longer and longer pauses."""
    for k in range(CALLS):
        try:
            if said := provider.propose(text):
                return said
        except Exception:  # noqa: BLE001  providers fail in ways of their own
            if k == CALLS - 1:
                return None
        if k < CALLS - 1:
            pause(min(FIRST_DELAY * 2**k, LONGEST_DELAY))
    return None


def analyze(links: DataFrame, start_url: str, start_html: str = "", provider: RuleProvider | None = None, feedback: str = "", pause=time.sleep) -> Analysis:
    """The provider's rules if they match the start URL and LEAST_LINKS links of links(url); else, after RETRIES more, heuristic ones.

    Without a provider, or if its answers are no rules, the heuristic. Without links the first answer counts.
    """
    if provider is None:
        return heuristic(start_url, start_html)
    last: Analysis | None = None
    total = links.count()
    for _ in range(RETRIES + 1):
        said = asked(provider, prompt(links, start_url, start_html, feedback), pause)
        try:
            last = parsed(said or "", start_url)
        except ValueError:
            return heuristic(start_url, start_html, last)
        if not total:
            return last
        matched = site.scope_report(links, last.scope, start_url).first()["n_match"]
        if matched >= LEAST_LINKS:
            return last
        feedback = feedback_of(links, last.scope, start_url, matched, total)
    return heuristic(start_url, start_html, last)


def refined(now: Analysis, samples: list[str], provider: RuleProvider, pause=time.sleep) -> Analysis:
    """With further prune selectors that the provider names on seeing cleaned pages; whatever fails leaves all as it is."""
    said = asked(provider, "Name selectors of what does not belong in these pages, as a JSON list:\n\n" + "\n\n---\n\n".join(samples), pause)
    try:
        more = json.loads(without_fence(said or ""))
    except ValueError:
        return now
    if not isinstance(more, list):
        return now
    prunes = list(dict.fromkeys([*now.prunes, *(x for x in more if isinstance(x, str) and x)]))
    return Analysis(now.scope, now.selector, prunes, now.notes)
