"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document; the ledger keeps one bit per failed rule beside the
measurements. A policy is a named, versioned set of rules: applying one, or asking what a rule alone
removes, reads the bits only and never the texts again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

#: Length in words of the windows that count as repeats.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; ``bit`` is the rule's place for ever."""

    name: str
    bit: int
    fails: str


#: All bounds are shares of the whole text, in whole numbers.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "n_symbols > 0.3 * n_words"),
    Rule("short_words", 3, "word_chars < 2 * n_words"),
    Rule("long_words", 4, "word_chars > 25 * n_words"),
    Rule("repeated_lines", 5, "n_lines > 3 and 2 * n_dup_lines > n_lines"),
)
#: Rule names by policy version; versions are added, never changed.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines"),
}


def mask(policy: str, rules: Sequence[Rule] = RULES) -> int:
    return sum(1 << r.bit for r in rules if r.name in POLICIES[policy])


def _repeat_words(hashes: Column, found: Column) -> Column:
    """How many words lie in a window that is found twice or more. found: (hash, place) in order."""
    n = F.size(found)
    same = lambda i, j: F.element_at(found, i)["h"] == F.element_at(found, j)["h"]
    twice = F.filter(F.sequence(F.lit(1), n), lambda i: (i > 1) & same(F.greatest(i - 1, F.lit(1)), i) | (i < n) & same(i, F.least(i + 1, n)))
    return F.transform(twice, lambda i: F.element_at(found, i)["at"])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All of ``docs``' columns, then n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Null counts as an empty text: all measurements are 0. A column of ``docs`` with one of these
    names is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    out = docs.drop(*(c for c in docs.columns if c in own or c.startswith("__q_")))
    out = out.withColumns({"__q_words": words(F.col(text)), "__q_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("__q_words")
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("__q_lines").cast("long"),
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "__q_h": F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__q_words", i, WINDOW)))),
    })
    # Nearly all texts repeat no window; only the others have their windows sorted with their places.
    out = out.withColumn("__q_twice", F.size(F.array_distinct("__q_h")) < F.size("__q_h"))
    out = out.withColumn("__q_found", F.when(F.col("__q_twice"), F.sort_array(F.transform("__q_h", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    out = out.withColumn("__q_at", F.when(F.col("__q_twice"), F.sort_array(_repeat_words(F.col("__q_h"), F.col("__q_found")))))
    covered = F.aggregate("__q_at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(x, a["end"])).alias("n"), (x + WINDOW).alias("end")))["n"]
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop(*(c for c in out.columns if c.startswith("__q_")))


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``measure`` and ``fail_bits``: bit ``rule.bit`` is set where the rule fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    # A generator: filters on the bits are not copied into the projections below, once for each use of a measurement.
    return measure(docs, text).select("*", F.explode(F.array(bits)).alias("fail_bits"))


def passes(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(book: DataFrame, policy: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule of the policy: how many documents fail it, and how many fail nothing else."""
    at = [r for r in rules if r.name in POLICIES[policy]]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sums = [F.count_if(hit.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"f{r.bit}") for r in at] + [F.count_if(hit == (1 << r.bit)).alias(f"o{r.bit}") for r in at]
    row = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only")) for r in at))
    return book.agg(*sums).select(F.inline(row)).withColumn("policy", F.lit(policy))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger without the texts, stored: policies and ablations are read from it."""
    return stored(ledger(docs.select("doc_id", "text")).drop("text"), "quality-ledger")


def op10_quality_rules(docs: DataFrame, policy: str = "full-1") -> DataFrame:
    """The verdict per document; empty tables give no rows, repeated rows are judged one by one."""
    book = stored_ledger(docs)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base-1")).alias("base_failed"), passes(policy).alias("kept"), "fail_bits")


def quality_ablation(docs: DataFrame, policy: str = "full-1") -> DataFrame:
    """``ablation`` of the stored ledger of ``docs``."""
    return ablation(stored_ledger(docs), policy)


_BITS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN n_symbols > 0.3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
      + (CASE WHEN word_chars > 25 * n_words THEN 16 ELSE 0 END) + (CASE WHEN n_lines > 3 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END) AS fail_bits FROM m)
"""
ORACLE = _BITS + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b"
ABLATION_ORACLE = (
    _BITS.rstrip()
    + """,
rl AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 8), ('long_words', 16), ('repeated_lines', 32)) v(rule, bit))
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only, 'full-1' AS policy FROM b, rl GROUP BY rule"""
)
