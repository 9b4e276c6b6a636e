"""URL filter: rules indexed by their rarest literal token.

A pattern rule blocks the addresses its regular expression finds. Each rule is filed under the one of its literal tokens
that the fewest addresses have; the tokens of an address fetch candidate rules, and only these run. A rule without literal
tokens runs on every address; a rule with alternatives is split, so that each part has its own tokens. Site rules give a
verdict to a host, its subdomains and a leading path, the longest rule wins and goes before all pattern rules; they are
filed in the same index under a token of their host. Only DataFrame functions are used.

Defined cases: a null address, or one without ``://``, has an empty host and path and is allowed; repeated rows are
judged alike; an empty table gives an empty table; other columns are carried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelfill.llm.common import names_apart

TAKEN = ["host", "path", "rule", "pattern", "verdict", "_sites", "_patterns", "_site", "_found"]
MAX_RULES = 10_000
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class SiteRule:
    host: str
    path: str
    verdict: str

    @property
    def tokens(self) -> list[str]:
        return re.findall(TOKEN, self.host)


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` (Java syntax, over the lower-case address) needs all of its literal ``tokens`` to be there as whole tokens,
    that is, without letters or digits beside them; if there is none such, ``tokens`` is empty."""
    name: str
    pattern: str
    tokens: tuple[str, ...] = ()


SITE_RULES = [SiteRule("org", "/", "allow"), SiteRule("example.org", "/es/", "block"), SiteRule("example.org", "/en/1", "block"),
              SiteRule("com", "/fr/", "allow"), SiteRule("com", "/de/", "block")]
PATTERN_RULES = [
    PatternRule("spam farm", r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("cheap pills", r"://([^/?#]*[.-])?cheap-pills?[.-]", ("cheap",)),
    PatternRule("casino", r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    PatternRule("casino", r"://([^/?#]*[.-])?casino[0-9]"),
    PatternRule("adult", r"://([^/?#]*[.-])?xxx[.-]", ("xxx",)),
    PatternRule("adult word", r"://([^/?#]*[.-])?porn[.-]", ("porn",)),
    PatternRule("tracking redirect", r"/redirect\?(.*&)?url=https?(:|%3a)", ("redirect", "url")),
    PatternRule("tracking redirect", r"/out\?(.*&)?url=https?(:|%3a)", ("out", "url")),
]


def with_parts(pages: DataFrame) -> DataFrame:
    """The pages with ``host`` (A-Z lower-cased) and ``path``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def _tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0)))


def _literals(tokens: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in tokens]).cast("array<string>")


def rarest_tokens(pages: DataFrame, rules: list) -> dict[str, list]:
    """The index: rules by the token of theirs that the fewest addresses have, those without tokens under an empty one.
    Tokens of rules only are counted."""
    wanted = sorted({t for r in rules for t in r.tokens})
    own = F.array_intersect(_tokens(), _literals(wanted))
    counts = {r["token"]: r["n"] for r in pages.select(F.explode(own).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=""), []).append(rule)
    return index


def _candidates(index: dict[str, list], columns: list[tuple]) -> Column:
    """Rules that the tokens of an address fetch, and those without tokens, as an array of structs."""
    if not index:
        return F.array()
    entries = F.create_map(*[x for token, rules in sorted(index.items()) for x in (
        F.lit(token), F.array(*[F.struct(*[F.lit(get(r)).alias(name) for name, get in columns]) for r in rules]))])
    hit = F.array_intersect(F.concat(_tokens(), _literals([""])), _literals(sorted(index)))
    return F.flatten(F.transform(hit, lambda t: F.element_at(entries, t)))


@names_apart(*TAKEN)
def with_verdict(pages: DataFrame, sites: list[SiteRule] = SITE_RULES, patterns: list[PatternRule] = PATTERN_RULES) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (the site rule that fits, else null), ``pattern`` and ``verdict``."""
    if len(sites) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; they are part of the plan")
    kept = pages.columns
    index = rarest_tokens(pages, [*sites, *patterns])
    by_kind = lambda kind: {t: own for t, rules in index.items() if (own := [r for r in rules if isinstance(r, kind)])}
    out = with_parts(pages).withColumns({
        "_sites": _candidates(by_kind(SiteRule), [("size", lambda r: len(r.host + r.path)), ("host", lambda r: r.host), ("path", lambda r: r.path),
                                                  ("verdict", lambda r: r.verdict)]),
        "_patterns": _candidates(by_kind(PatternRule), [("name", lambda r: r.name), ("pattern", lambda r: r.pattern)])})
    host, path, url = F.col("host"), F.col("path"), F.lower("url")
    fits = F.filter("_sites", lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    out = out.withColumns({"_site": F.array_max(fits) if sites else F.lit(None),
                           "_found": F.filter("_patterns", lambda r: F.regexp_like(url, r["pattern"])) if patterns else F.array()})
    rule = F.concat(F.col("_site.host"), F.col("_site.path")) if sites else F.lit(None).cast("string")
    pattern = F.array_min(F.transform("_found", lambda r: r["name"])) if patterns else F.lit(None).cast("string")
    given = F.col("_site.verdict") if sites else F.lit(None).cast("string")
    out = out.withColumns({"rule": rule, "pattern": pattern})
    return out.select(*[f"`{c}`" for c in kept], "host", "path", "rule", "pattern",
                      F.coalesce(given, F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"))
