"""Quality rules as a ledger of failure bits.

``ledger`` measures each text once and evaluates every rule once; a row keeps the
measurements and one ``failed`` number with a bit per rule. A policy is a set of rules, so
a verdict under any version of the policy is one ``&``, and what a rule alone decides is
counted from the masks without the texts: documents are first counted per mask.

DataFrame functions only. Windows of three words are sorted by hash inside a row, so no
word is shuffled. Rows do not meet, so no key, source or group of copies can be hot.

Defined cases: a null or empty text has no words and fails the rules that ask for some; a
very long text is one sort of its windows; repeated rows are judged alike; other columns
are not looked at; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from songloom.llm.common import SPACES, WORD, text_of, words_of

SYMBOLS = "#*$%&|<>"

#: Rules by name, true where a text fails; the bit of a rule is its place here. A rule is
#: only ever added at the end, so stored ledgers stay readable. ``ratio`` rules multiply
#: out, which keeps them exact and defined without words.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines",
    "short_words": "100 * word_chars < 250 * n_words",
    "long_words": "100 * word_chars > 1200 * n_words",
    "shouting": "100 * n_upper > 50 * n_letters",
    "exclamation": "100 * n_exclamation > 30 * n_words",
}

BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that each one enforces.
POLICIES: dict[str, Sequence[str]] = {
    "base": BASE,
    "2024-01": (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
    "2024-02": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "shouting", "exclamation"),
}
CURRENT = "2024-02"


def mask(rules: Sequence[str], known: Mapping[str, str] = RULES) -> int:
    places = {name: i for i, name in enumerate(known)}
    return reduce(lambda m, name: m | 1 << places[name], rules, 0)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words that occurs twice or more.

    Windows are sorted by (hash, place); a place next to one with the same hash is a
    repeated window. It covers three words, less those that the next repeated one covers.
    """
    last = F.size(words) - 3
    windows = F.transform(
        F.when(last >= 1, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return windows


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements that the rules use."""
    t, lines = F.col("_text"), F.col("_lines")
    has_word = lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0
    # Each step is a column of its own, or it would be computed for every element below it.
    df = (
        docs.withColumn("_text", text_of(text))
        .withColumn("_words", words_of(t))
        .withColumn("_sorted", F.sort_array(repeated_words(F.col("_words"))))
        .withColumn("_lines", F.filter(F.split(t, "\n"), has_word))
    )
    s = F.col("_sorted")
    same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    found = F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False)))
    df = df.withColumn("_places", F.sort_array(F.transform(found, lambda x: x["i"])))
    places = F.col("_places")
    covered = F.aggregate(
        F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    measures = {
        "n_words": F.size("_words"),
        "word_chars": F.length(_without(t, SPACES)),
        "n_symbols": F.length(t) - F.length(_without(t, SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
        "n_letters": letters,
        "n_exclamation": F.length(t) - F.length(_without(t, "!")),
    }
    return df.withColumns({name: value.cast("long") for name, value in measures.items()}).drop(
        "_text", "_words", "_sorted", "_lines", "_places"
    )


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """Per document the measurements and ``failed``, a bit for each rule that it fails."""
    df = measured(docs.select(F.col(id).alias("doc_id"), F.col(text)), text).drop(text)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules.values())]
    return df.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def kept_under(rules: Sequence[str], failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(rules)).cast("long")) == 0


def ablations(ledger: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """``policy, rule, failing, only``: documents that fail a rule, and no other of the policy.

    ``only`` is what the policy would keep more without the rule. The ledger is counted per
    mask first, of which there are at most 2^rules.
    """
    per_mask = ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rows = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rules)).cast("long").alias("all"), F.lit(mask([r])).cast("long").alias("bit")) for p, rules in policies.items() for r in rules]
    each = per_mask.select("failed", "n", F.explode(F.array(*rows)).alias("p"))
    fails = F.col("failed").bitwiseAND(F.col("p.bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("p.all")) == F.col("p.bit")
    return each.groupBy("p.policy", "p.rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only")
    )
