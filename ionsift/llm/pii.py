"""Personal data: generators propose overlapping spans, boosted trees judge them, base spans always stay.

Everything on the main path is a column expression. The trees live in ``pii_model.json``; ``pii_train.py`` fits
them with Spark ML on seeded synthetic candidates and writes that file.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionsift.llm.common import fresh

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. The possessive forms and the anchors before the first class give the contract's leftmost
#: matches without trying each start inside one long run, and Java loops over possessive groups without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have before the base pattern is tried.
HINT = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9][\x20().0-9-]{6}"}
HAS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: High-recall generators of further candidates; those of one kind may overlap, and so may kinds.
MORE = {
    # one sign at least must be written out as such: a bare " at " with a bare "." is how any sentence ends
    "email": (
        r"[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?| dot |\.)[A-Za-z]{2,24}){1,3}",
        r"[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?| dot )[A-Za-z]{2,24}){1,3}",
        r"[A-Za-z0-9._%+-]{1,64}(?:\x20@\x20?|@\x20)[A-Za-z0-9-]{1,63}(?:\x20?\.\x20?[A-Za-z0-9-]{2,24}){1,3}",
    ),
    "ip": (
        r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])",
        r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\])\x20?[0-9]{1,3}){3}(?![0-9])",
    ),
    "card": (
        r"(?<![0-9])[0-9]{4}[./\x20-]{1,3}[0-9]{4}[./\x20-]{1,3}[0-9]{4}[./\x20-]{1,3}[0-9]{1,7}(?![0-9])",
        r"(?<![0-9])3[47][0-9]{2}[./\x20-]{1,3}[0-9]{6}[./\x20-]{1,3}[0-9]{5}(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{3,5}(?:[\x20./-][0-9]{2,4})?(?![0-9])",
        r"(?<![0-9+])00[1-9][0-9]{0,2}[\x20./-]?[0-9]{2,4}[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{2,4}(?![0-9])",
    ),
}
MORE_HINT = {"email": r"[(\[{]at[)\]}]|\x20at\x20[A-Za-z0-9-]+(?:\s?[(\[{]|\x20)dot|\x20@|@\x20", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:|[0-9]\x20?(?:\[\.\]|\(\.\)|\[dot\])", "card": r"[0-9]{4}[./\x20-]{1,3}[0-9]{4}[./\x20-]{1,3}[0-9]{4}|3[47][0-9]{2}[./\x20-]{1,3}[0-9]{6}", "phone": r"[0-9]\)?[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{3}|(?<![0-9+])00[1-9][0-9]"}
MORE_HAS = {"email": "at) at] at} dot @", "ip": ": .] .) dot]", "card": "", "phone": ""}
BEFORE, AFTER = 40, 12
#: Words before or after a span that speak for a kind of personal data.
CONTEXT = {
    "email": r"(?i)mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|ipv6|host|server|addr|client|peer",
    "card": r"(?i)card|visa|master|credit|karte|tarjeta|carte|payment|\bcc\b",
    "phone": r"(?i)phone|call|tel\b|tel[:.]|mobile|fax|dial|whatsapp|anruf",
}
FEATURES = ("kind_email", "kind_ip", "kind_card", "kind_phone", "n_chars", "n_digits", "n_groups", "n_seps", "n_sep_kinds", "parens", "luhn", "context", "number_word", "touches_word", "date_like", "hex_letters", "longest_group")
SPAN = "array<struct<start:int,end:int,text:string>>"
SCORED = "array<struct<order:struct<score:double,at:int,to:int,kind:int>,rank:int,start:int,end:int>>"


def spans_of(text: Column, pattern: str) -> Column:
    """Matches with code-point bounds (end exclusive), leftmost and non-overlapping."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def guarded(text: Column, has: str, hint: str, found: Column) -> Column:
    """``found`` only where the text has one of the literals ``has`` (blank-separated; a byte search) and fits ``hint``."""
    some = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in has.split()], F.lit(not has))
    return F.when(some & text.rlike(hint), found).otherwise(F.array().cast(SPAN))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    ds = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(ds, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of a kind, checked; failing matches are dropped without retries."""
    found = guarded(text, HAS[kind], HINT[kind], spans_of(text, BASE[kind]))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "")
        return F.filter(found, lambda s: F.forall(F.split(s["text"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255")))
    if kind == "card":
        return F.filter(found, lambda s: F.length(digits(s["text"])).between(13, 19) & luhn(F.substring(digits(s["text"]), 1, 19)))
    if kind == "phone":
        return F.filter(found, lambda s: F.length(digits(s["text"])).between(9, 15))
    return found


def features(kind: str, hit: Column, before: Column, after: Column) -> list[Column]:
    """Format and context features of a candidate, in the order of ``FEATURES``, as doubles."""
    ds = digits(hit)
    groups = F.filter(F.split(hit, r"[^0-9A-Za-z]+"), lambda g: g != "")
    seps = F.regexp_replace(hit, r"[0-9A-Za-z]", "")
    num = lambda c: c.cast("double")
    return [
        *[F.lit(float(k == kind)) for k in KINDS],
        num(F.length(hit)), num(F.length(ds)), num(F.size(groups)), num(F.length(seps)),
        num(F.size(F.array_distinct(F.filter(F.split(seps, ""), lambda c: c != "")))),
        num(hit.rlike(r"[()\[\]{}]")), num((F.length(ds) >= 13) & luhn(F.substring(ds, 1, 19))),
        num(F.concat(before, F.lit(" | "), after).rlike(CONTEXT[kind])),
        num(before.rlike(r"(?i)(order|invoice|version|ver|no|nr|id|page|isbn|serial|total|ref|chapter|section)[.:# ]*$")),
        num(before.rlike(r"[\p{L}0-9_]$") | after.rlike(r"^[\p{L}0-9_]")),
        num(hit.rlike(r"^(19|20)[0-9]{2}[./-][0-9]{2}[./-]|^[0-9]{1,2}[./-][0-9]{1,2}[./-](19|20)[0-9]{2}")),
        num(F.length(F.regexp_replace(hit, r"[^A-Fa-f]", ""))),
        F.coalesce(F.array_max(F.transform(groups, lambda g: num(F.length(g)))), F.lit(0.0)),
    ]


def model() -> dict:
    return json.loads((Path(__file__).parent / "pii_model.json").read_text())


def margin(fs: list[Column], trees: list[dict]) -> Column:
    """Weighted sum of the trees' values; a tree is ``{"w", "node"}``, a node a number or [feature, threshold, left, right]."""

    def walk(node) -> Column:
        if not isinstance(node, list):
            return F.lit(float(node))
        return F.when(fs[node[0]] <= F.lit(float(node[1])), walk(node[2])).otherwise(walk(node[3]))

    return reduce(lambda a, b: a + b, [walk(t["node"]) * F.lit(float(t["w"])) for t in trees], F.lit(0.0))


def candidates(text: Column, kind: str, rank: int, fitted: dict) -> Column:
    """Candidates of a kind, from all its generators, whose boosted score reaches the kind's calibrated threshold.

    ``order`` sorts them: by falling score above the threshold, then place, then kind.
    """

    def scored(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE)))
        after = F.substring(text, s["end"] + 1, F.lit(AFTER))
        score = margin(features(kind, s["text"], before, after), fitted["trees"]) - F.lit(float(fitted["thresholds"][kind]))
        return F.struct(F.struct((-score).alias("score"), s["start"].alias("at"), s["end"].alias("to"), F.lit(rank).alias("kind")).alias("order"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"))

    found = F.array_distinct(F.concat(*[spans_of(text, g) for g in MORE[kind]]))
    return F.filter(F.transform(guarded(text, MORE_HAS[kind], MORE_HINT[kind], found), scored), lambda s: s["order"]["score"] <= 0)


def find_spans(df: DataFrame, text: str = "text", fitted: dict | None = None, base: str = "pii_base", spans: str = "pii_spans") -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of struct<rank, kind, start, end>, by kind as listed, then start (clashing columns are replaced).

    Bounds are code points, end exclusive; a null text counts as empty. Added candidates may overlap, within a kind or
    across kinds; one goes if it overlaps a base span or another candidate with a higher score (equal scores: the one
    that begins first, then of the earlier kind). Rows, repeats and other columns stay.
    """
    fitted = fitted or model()
    t = F.coalesce(F.col(text), F.lit(""))
    tag = lambda found, i: F.transform(found, lambda s: F.struct(F.lit(i).alias("rank"), F.lit(KINDS[i]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = df.withColumn(base, F.concat(*[tag(base_spans(t, k), i) for i, k in enumerate(KINDS)]))
    more = fresh(out, "more")
    out = out.withColumn(more, F.concat(*[candidates(t, k, i, fitted) for i, k in enumerate(KINDS)]))
    clash = lambda s, other: (other["start"] < s["end"]) & (s["start"] < other["end"])
    free = F.filter(more, lambda s: ~F.exists(base, lambda b: clash(s, b)))
    # highest scores first; each stays that overlaps none that stays before it
    best = F.array_sort(free, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0))
    kept = F.aggregate(best, F.array().cast(SCORED), lambda acc, s: F.when(F.exists(acc, lambda k: clash(s, k)), acc).otherwise(F.concat(acc, F.array(s))))
    added = F.transform(F.when(F.size(more) > 0, kept).otherwise(F.array().cast(SCORED)), lambda s: F.struct(s["rank"], F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"), s["start"], s["end"]))
    return out.withColumn(spans, F.array_sort(F.concat(base, added))).drop(more)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", fitted: dict | None = None) -> DataFrame:
    """Replaces each span in ``text`` by its kind in brackets (``[EMAIL]``); spans that overlap an earlier one go with it.

    A null text stays null; rows and other columns stay.
    """
    base = fresh(df, "pii_base")
    spans = fresh(df, "pii_spans")
    found = find_spans(df, text, fitted, base, spans)
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(by_place, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).drop(base, spans)
