"""URL filters: rules indexed by their rarest literal token; only the rules that a URL's tokens fetch run regular expressions.

Everything is a column expression. A few rules travel in the plan and need no shuffle but the count of rule tokens; a
long list is a table that URL tokens are joined with.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``pattern`` runs over host + path; each of ``tokens`` is among any fitting URL's tokens.

    A rule without tokens runs on every URL. Rules with ``site`` win over pattern rules; among site rules the longest name wins.
    """

    action: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path`` (which starts with a slash)."""
    segments = path.split("/")[1:-1]  # the last one may go on in the URL
    tokens = tuple(x for x in (*host.split("."), *segments) if x)
    return Rule(action, host + path, rf"^(?:[^/]*\.)?{_quote(host)}{_quote(path)}", tokens, True)


def pattern_rule(action: str, pattern: str, *tokens: str) -> Rule:
    return Rule(action, pattern, pattern, tokens, False)


def host_word_rule(action: str, word: str) -> Rule:
    """Fits hosts with ``word`` between dots, hyphens or their ends."""
    return pattern_rule(action, rf"^([^/]*[.-])?{_quote(word)}([.-][^/]*)?(/|\z)", word)


#: The site rules of the query's contract.
SITE_RULES = (
    site_rule("block", "com", "/en/"),
    site_rule("allow", "example.com", "/en/7"),
    site_rule("allow", "net", "/de/"),
    site_rule("block", "example.net", "/de/8"),
    site_rule("block", "org", "/es/"),
)
#: What decides where no site rule fits: any of these blocks, else the URL is allowed.
PATTERN_RULES = (
    pattern_rule("block", r"(^|\.)ad[0-9]*\.[^/]*/", "ad"),
    pattern_rule("block", r"(^|\.)ads[0-9]*\.[^/]*/", "ads"),
    pattern_rule("block", r"/login(/|\z)", "login"),
    pattern_rule("block", r"/signin(/|\z)", "signin"),
    pattern_rule("block", r"/cgi-bin/[^/]+\.(exe|dll)\z", "cgi-bin"),
    pattern_rule("block", r"\.(exe|scr|msi)\z"),
    *(host_word_rule("block", w) for w in ("adult", "bets", "casino", "pills", "spam")),
)


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty for a null URL or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    return df.withColumns({
        "host": F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    })


def tokens_of(host: Column, path: Column) -> Column:
    """Labels of the host and their words between hyphens, segments of the path, and what stands between dots without the digits at its end."""
    dotted = F.transform(F.split(F.concat(host, path), r"\."), lambda x: F.regexp_replace(x, r"[0-9]+\z", ""))
    return F.array_distinct(F.concat(F.split(host, r"\."), F.split(host, r"[.-]"), F.split(path, "/"), dotted))


def rarest_tokens(parts: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Token -> rules; each rule stands at that one of its tokens which the fewest URLs have (ties: the first in order).

    Rules without tokens stand at the empty string. The counts come from all rows; what reaches the driver is at most
    one number for each distinct rule token.
    """
    words = sorted({t for r in rules for t in r.tokens})
    rule_words = parts.sparkSession.createDataFrame([(w,) for w in words], "t string")
    found = parts.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("t"))
    if len(words) <= INLINE:
        found = found.where(F.col("t").isin(words))
    else:
        found = found.join(rule_words, "t", "left_semi")
    seen = {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        index[min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else ""].append(r)
    return dict(index)


ENTRY = "struct<n:int,name:string,action:string,pattern:string,site:boolean>"
#: So many rules travel in the plan; more are a table.
INLINE = 1_000


def _literal(r: Rule) -> Column:
    return F.struct(F.lit(len(r.name)).alias("n"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"), F.lit(r.site).alias("site"))


def judge_urls(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, inline: int = INLINE) -> DataFrame:
    """Adds ``host, path, rule, verdict`` (clashing columns are replaced); keeps every row.

    ``rule`` names the longest fitting site rule, else null; ``verdict`` is that rule's, else ``block`` if a
    pattern rule that blocks fits, else ``allow``. Null, empty and scheme-less URLs have empty parts and are
    allowed unless a rule fits empty parts. Repeated rows are judged alike; an empty table stays empty. Up to ``inline``
    rules travel in the plan. More stand in a table that is joined with each URL's tokens (by broadcast only if Spark
    finds the table small enough); rules without a token always travel in the plan.
    """
    parts = with_parts(df.drop("host", "path", "rule", "verdict"), url)
    index = rarest_tokens(parts, rules)
    text = F.concat("host", "path")
    always = index.pop("", [])
    if len(always) > inline:
        raise ValueError(f"{len(always)} rules without a token; {inline} at most run on every URL")
    none = F.array().cast(f"array<{ENTRY}>")
    fetched = [F.array(*map(_literal, always))] if always else [none]
    if len(rules) <= inline:
        if index:
            table = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(_literal, rs)))])
            fetched.append(F.flatten(F.transform(tokens_of(F.col("host"), F.col("path")), lambda t: F.coalesce(F.try_element_at(table, t), none))))
        judged = parts.withColumn("__fits", F.filter(F.concat(*fetched), lambda r: F.regexp_like(text, r["pattern"])))
    else:
        rows = [(t, (len(r.name), r.name, r.action, r.pattern, r.site)) for t, rs in sorted(index.items()) for r in rs]
        listed = parts.sparkSession.createDataFrame(rows, f"__token string, __rule {ENTRY}")
        # equal host and path are judged once, so a page that is listed often is one row
        distinct = parts.select("host", "path").distinct()
        met = distinct.withColumn("__token", F.explode(tokens_of(F.col("host"), F.col("path")))).join(listed, "__token").where(F.regexp_like(text, F.col("__rule.pattern")))
        fits = met.groupBy("host", "path").agg(F.collect_set("__rule").alias("__met"))
        more = F.filter(fetched[0], lambda r: F.regexp_like(text, r["pattern"]))
        judged = parts.join(fits, ["host", "path"], "left").withColumn("__fits", F.concat(F.coalesce("__met", none), more)).select(*parts.columns, "__fits")
    best = F.array_max(F.filter("__fits", lambda r: r["site"]))
    blocked = F.exists("__fits", lambda r: ~r["site"] & (r["action"] == "block"))
    return judged.withColumns({"rule": best["name"], "verdict": F.coalesce(best["action"], F.when(blocked, "block").otherwise("allow"))}).drop("__fits")
