"""Mixing sources to target weights by hierarchical budgets.

A tree of domain, language and source shares a token budget from the root down: each node splits
its budget among its children by weight, a child that can't use its share leaves the rest to its
siblings, and only what no sibling can use goes back up to the node's own siblings. Each leaf then
takes that many tokens from its documents in a seeded order, epoch by epoch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, keyed, small, stored, text_or_empty

LEVELS = ("domain", "lang", "source")
#: Parts of a leaf's order; a leaf of any size is ranked in this many pieces.
PARTS = 4096
#: A tree of more leaves is joined by shuffle.
MAX_BROADCAST_LEAVES = 200_000
_BIG = T.DecimalType(38, 0)


def tokens(text: Column) -> Column:
    """Words between blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """Tables without a domain column get one of ``domains`` by the source's name."""
    return F.concat(F.lit("domain"), F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 2), 16, 10).cast("int") % domains)


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(w)).otherwise(out)
    return out.cast(_BIG)


def water_fill(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """children: parent's columns, ``name``, weight, cap and parent_budget. Adds ``budget``.

    Children are taken by cap / weight, smallest first. As long as a child's cap is at most its share
    of what is left, it is filled; all after it share the rest by weight. Tokens lost to rounding go one
    each to the first open children.
    """
    w = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))  # the root's children are few
    order = w.orderBy((F.col("cap").cast("double") / F.col("weight").cast("double")), F.col(name).asc_nulls_first())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    out = children.withColumns({
        "__c": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(_BIG),
        "__w": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).cast(_BIG),
    })
    fits = F.col("cap") * F.col("__w") <= (F.col("parent_budget") - F.col("__c")) * F.col("weight")
    out = out.withColumn("__full", F.min(fits.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) == 1)
    open_ = F.when(~F.col("__full"), 1)
    out = out.withColumns({"__left": F.greatest(F.max("parent_budget").over(w) - F.coalesce(F.sum(F.when(F.col("__full"), F.col("cap"))).over(w), F.lit(0)), F.lit(0)).cast(_BIG), "__open": F.sum(F.when(~F.col("__full"), F.col("weight"))).over(w).cast(_BIG), "__at": F.sum(open_).over(order.rowsBetween(W.unboundedPreceding, 0))})
    share = F.expr("(__left * weight) div __open").cast(_BIG)
    out = out.withColumn("__share", F.when(~F.col("__full"), share))
    spare = F.col("__left") - F.sum("__share").over(w)
    out = out.withColumn("__spare", F.coalesce(spare, F.lit(0)))
    mine = F.least(F.col("cap"), F.col("__share") + F.when(F.col("__at") <= F.col("__spare"), 1).otherwise(0))
    out = out.withColumn("budget", F.when(F.col("__full"), F.col("cap")).otherwise(mine).cast("long"))
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, int]], epochs: int, levels: Sequence[str] = LEVELS) -> DataFrame:
    """leaves: the levels and leaf_tokens, one row a leaf. Adds ``budget`` (long) to each leaf."""
    tree = leaves.withColumn("cap", (F.col("leaf_tokens") * epochs).cast(_BIG))
    nodes = tree.agg(budget.cast(_BIG).alias("parent_budget"))
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        kids = tree.groupBy(*path).agg(F.sum("cap").cast(_BIG).alias("cap"), F.sum("leaf_tokens").alias("leaf_tokens")).withColumn("weight", _weight(level, weights))
        if depth == 0:
            kids = kids.join(F.broadcast(nodes))  # one row
        else:
            above = nodes.select(*(F.col(c).alias(f"__{c}") for c in path[:-1]), F.col("budget").cast(_BIG).alias("parent_budget"))
            on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in path[:-1]]
            kids = kids.join(above, on).drop(*(f"__{c}" for c in path[:-1]))
        nodes = water_fill(kids, path[:-1], level)
    return nodes.select(*levels, "budget", "leaf_tokens")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), the levels and n_tokens of each row, read from the texts once and stored."""
    if "domain" not in docs.columns:
        docs = docs.withColumn("domain", domain_of(F.col("source")))
    return stored(docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), *LEVELS, tokens(F.col("text")).alias("n_tokens")), "mix-tokens")


def mix(slim: DataFrame, share: tuple[int, int] = (1, 2), weights: Mapping[str, Mapping[str, int]] | None = None, epochs: int = 2, seed: int = 1) -> DataFrame:
    """slim: doc_id, th, the levels, n_tokens. Adds leaf_budget and copies.

    The budget is ``share`` of all tokens. A leaf of budget b and n tokens gives b div n whole epochs,
    and of the next epoch, in the order of md5(seed:epoch:doc_id), the shortest prefix of documents
    that reaches b mod n tokens; so each leaf takes its budget and less than one document more.
    Documents without doc_id are ordered by their text's hash. Documents of a leaf without tokens are taken once. Nulls in a level are a child of their own.
    """
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"))
    total = F.expr(f"coalesce((sum(leaf_tokens) * {share[0]}) div {share[1]}, 0)")
    budgets = leaf_budgets(leaves, total, weights or {}, epochs)
    has = F.col("leaf_tokens") > 0
    plan = budgets.select(*(F.col(c).alias(f"k_{c}") for c in LEVELS), F.col("budget").alias("leaf_budget"), "leaf_tokens")
    plan = plan.withColumns({"whole": F.when(has, F.expr("leaf_budget div leaf_tokens")).otherwise(1).cast("long"), "rest": F.when(has, F.expr("leaf_budget % leaf_tokens")).otherwise(0).cast("long")})
    plan = stored(plan, "mix-leaves")
    if plan.limit(MAX_BROADCAST_LEAVES + 1).count() <= MAX_BROADCAST_LEAVES:
        plan = F.broadcast(plan)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.hex("th")))))
    return select_prefix(slim.join(plan, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in LEVELS]).withColumn("at", order))


def select_prefix(ranked: DataFrame) -> DataFrame:
    """Adds copies: whole epochs, and 1 for documents in the prefix of the next one.

    A leaf's order is cut into ``PARTS`` equal ranges of the hash; tokens are summed within a range and
    the ranges' totals are added before it, so a leaf of any size is never one task's.
    """
    keys = [f"k_{c}" for c in LEVELS]
    ranked = ranked.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("")) for k in keys} | {"part": F.conv(F.substring("at", 1, 3), 16, 10).cast("int")})
    sums = ranked.groupBy(*keys, "part").agg(F.sum("n_tokens").alias("part_tokens"))
    sums = sums.withColumn("start", F.sum("part_tokens").over(W.partitionBy(*keys).orderBy("part")) - F.col("part_tokens")).drop("part_tokens")
    inner = W.partitionBy(*keys, "part").orderBy("at", "doc_id", "th").rowsBetween(W.unboundedPreceding, 0)
    out = ranked.withColumn("upto", F.sum("n_tokens").over(inner)).join(sums, [*keys, "part"])
    first = F.col("start") + F.col("upto") - F.col("n_tokens")
    return out.select("doc_id", "th", *LEVELS, "n_tokens", "leaf_budget", (F.col("whole") + F.when(first < F.col("rest"), 1).otherwise(0)).cast("long").alias("copies"))


#: Weights of the registered query; what isn't named weighs 1.
WEIGHTS = {"domain": {"domain0": 3, "domain1": 2}, "lang": {"en": 4, "de": 2}}


def op1_mixing(docs: DataFrame, share: tuple[int, int] = (1, 2), weights=WEIGHTS, epochs: int = 2, seed: int = 1) -> DataFrame:
    """Every document with its leaf, the leaf's budget and how many copies of it are taken.

    Null texts have no tokens. Rows that share a doc_id are counted and taken one by one. An empty
    table gives no rows.
    """
    return mix(measured(docs), share, weights, epochs, seed).drop("th")


def taken(docs: DataFrame, share: tuple[int, int], weights=WEIGHTS, epochs: int = 1, seed: int = 1) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken; rows equal in doc_id and text all as often as the one taken most."""
    got = mix(measured(docs), share, weights, epochs, seed).where("copies > 0")
    one = got.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id0"), F.col("th").alias("__th")).agg(F.max("copies").alias("__copies"))
    kept = keyed(docs, "__").join(small(stored(one, "mix-taken"), MAX_BROADCAST_LEAVES), ["__id0", "__th"])
    return kept.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def op1_oracle(share=(1, 2), weights=WEIGHTS, epochs: int = 2, seed: int = 1) -> str:
    """The same in SQL; fixed three levels."""
    case = {lv: "CASE " + " ".join(f"WHEN {lv} = '{n}' THEN {w}" for n, w in weights.get(lv, {}).items()) + " ELSE 1 END" if weights.get(lv) else "1" for lv in LEVELS}
    sql = f"""
WITH d AS (SELECT doc_id, 'domain' || ((strpos('0123456789abcdef', md5(coalesce(source, ''))[2]) - 1) % 4) AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
           FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS n FROM d GROUP BY ALL),
n0 AS (SELECT coalesce(sum(n)::BIGINT * {share[0]} // {share[1]}, 0)::HUGEINT AS budget FROM leaf)"""
    for depth, lv in enumerate(LEVELS):
        path, up = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        part = f"PARTITION BY {', '.join(up)}" if up else ""
        join = f"JOIN n{depth} p USING ({', '.join(up)})" if up else f"CROSS JOIN n{depth} p"
        sql += f""",
k{depth} AS (SELECT k.*, p.budget AS pb FROM (SELECT {', '.join(path)}, sum(n * {epochs})::HUGEINT AS cap, {case[lv]}::HUGEINT AS w FROM leaf GROUP BY {', '.join(path)}) k {join}),
a{depth} AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS c, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS ws
  FROM k{depth} WINDOW o AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {lv} NULLS FIRST)),
b{depth} AS (SELECT *, min(CASE WHEN cap * ws <= (pb - c) * w THEN 1 ELSE 0 END) OVER ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {lv} NULLS FIRST ROWS UNBOUNDED PRECEDING) = 1 AS filled FROM a{depth}),
c{depth} AS (SELECT *, greatest(max(pb) OVER ({part}) - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({part}), 0), 0)::HUGEINT AS rest, sum(CASE WHEN NOT filled THEN w END) OVER ({part})::HUGEINT AS ow,
  sum(CASE WHEN NOT filled THEN 1 END) OVER ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {lv} NULLS FIRST ROWS UNBOUNDED PRECEDING) AS pos FROM b{depth}),
e{depth} AS (SELECT *, CASE WHEN NOT filled THEN rest * w // ow END AS share FROM c{depth}),
n{depth + 1} AS (SELECT {', '.join(path)}, (CASE WHEN filled THEN cap ELSE least(cap, share + CASE WHEN pos <= rest - sum(share) OVER ({part}) THEN 1 ELSE 0 END) END)::BIGINT AS budget FROM e{depth})"""
    return sql + f""",
q AS (SELECT d.*, b.budget, CASE WHEN l.n > 0 THEN b.budget // l.n ELSE 1 END AS whole, CASE WHEN l.n > 0 THEN b.budget % l.n ELSE 0 END AS part
      FROM d JOIN leaf l USING (domain, lang, source) JOIN n3 b USING (domain, lang, source)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS first FROM q)
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS leaf_budget, (whole + CASE WHEN first < part THEN 1 ELSE 0 END)::BIGINT AS copies FROM r"""
