"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a document. On a sample the cost of each rule (seconds above reading) and the share
it rejects are measured; rules then stand in the order of rejection per cost within one CASE expression, whose later
branches run only for rows that earlier ones let pass. The order changes the speed, never the verdict.

Words are runs of characters other than blank, tab, newline, vertical tab, form feed and carriage return.

Defined cases: a null text is an empty one, has no words and fails the base; repeated rows are judged alike; an empty
table gives an empty table and the given order of rules; other columns are carried.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelfill.llm.common import names_apart
from panelfill.sources.storage import stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
TAKEN = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept",
         "_text", "_words", "_lines", "_windows", "_sorted", "_twice", "_places"]
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_measures(docs: DataFrame) -> DataFrame:
    """The documents with ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines`` and ``n_repeat_words``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.columns
    out = docs.withColumn("_text", text)
    out = out.withColumns({
        "_words": F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")})
    many = F.size("_words") >= WINDOW
    out = out.withColumn("_windows", F.when(many, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))))
    again = many & (F.size(F.array_distinct("_windows")) < F.size("_windows"))
    out = out.withColumn("_sorted", F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("_twice", F.filter("_sorted", lambda s, i: (
        (F.get("_sorted", i - 1)["h"] == s["h"]) | (F.get("_sorted", i + 1)["h"] == s["h"]))))
    out = out.withColumn("_places", F.sort_array(F.transform("_twice", lambda s: s["i"])))
    covered = F.aggregate("_places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")))["n"]
    return out.select(
        *[f"`{c}`" for c in kept], F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"), _count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules over the measures and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("word_chars")),
        Rule("short words", F.col("word_chars") < 2 * F.col("n_words")),
        Rule("long words", F.col("word_chars") > 15 * F.col("n_words")),
        Rule("repeated lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("shouting", 2 * _count(text, CAPITALS) > F.col("word_chars")),
        Rule("exclamations", 10 * _count(text, "!") > F.col("word_chars")),
        Rule("digits", 3 * _count(text, "0123456789") > F.col("word_chars")),
        Rule("few words with letters", 10 * F.size(F.regexp_extract_all(text, F.lit(r"(?<!\S)[^\s\p{L}]*+\p{L}"), F.lit(0))) < 6 * F.col("n_words")),
    ]


def ordered(measured: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejection per cost, both measured on the given sample."""
    sample = stored(measured, "rule-sample")
    rows = max(1, sample.count())

    def seconds(condition: Column) -> tuple[float, float]:
        start = time.perf_counter()
        hits = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - start, hits / rows

    idle = min(seconds(F.length("text") < 0)[0] for _ in range(2))
    worth = {}
    for rule in rules:
        spent, share = seconds(rule.rejects)
        worth[rule.name] = (share + 0.5 / rows) / max(spent - idle, 1e-3)
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, null if none does. Later rules are not run once one rejects."""
    out = F.when(rules[0].rejects, F.lit(rules[0].name))
    for rule in rules[1:]:
        out = out.when(rule.rejects, F.lit(rule.name))
    return out


@names_apart(*TAKEN)
def with_verdict(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with measures, ``base_failed``, ``rejected_by`` (a rule's name, 'base' or null) and ``kept``."""
    measured = with_measures(docs)
    in_order = ordered(with_measures(docs.limit(sample_rows)), rules or default_rules())
    base = Rule("base", base_failed())
    judged = measured.withColumns({"base_failed": base_failed(), "rejected_by": cascade([base, *in_order])})
    return judged.withColumn("kept", F.col("rejected_by").isNull())
