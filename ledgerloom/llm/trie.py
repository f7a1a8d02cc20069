"""Prefix trie of conversations, rolled up in bands of depth.

A node is a sequence of first turns. Its key is 128 bits: the turns' own hashes, each with its place, joined by XOR, so that
keys of all prefixes are running XORs, which parts of a conversation get each for itself and shift by the parts
before: no task ever holds a whole conversation.

Subtree sums go up in bands of ``BAND`` levels. A node explodes to its ancestors within its band only; the roots of
bands, with the totals of their bands, are the nodes of a trie ``BAND`` times lower, which is rolled up in the same way;
a completed root then adds its total to the node above it and that one's ancestors in its band. For depth D that takes
2 log(D) / log(BAND) rounds, and a node makes at most ``BAND`` rows a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ships

ships(__name__)

#: Levels of a band.
BAND = 16
#: Conversations that share a leading part, and one more than the longest such part.
HUNDRED, SHARED = 100, 6
#: Ids of a chunk when the ids that end at a node are joined.
IDS = 4096
KEY = ["depth", "k1", "k2"]


def ordered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, part, i, c1, c2, n_chars, stored: the turns by turn (null first), then role and text. Parts are stretches of this
    order over the whole table, however long a conversation is; i is the place in the part; c1 and c2 are the content's hash."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    t = t.repartitionByRange(*by, F.substring("text", 1, 32)).sortWithinPartitions(*by, "text")
    t = t.withColumn("at", F.monotonically_increasing_id())
    hashes = [F.xxhash64(F.lit(seed), "role", "text").alias(c) for seed, c in enumerate(("c1", "c2"), 1)]
    return scratch.put("ordered", t.select("conv_id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("i"), *hashes, F.length("text").cast("long").alias("n_chars")))


def numbered(t: DataFrame) -> DataFrame:
    """t, with pos: each turn's number in its conversation, from 1. From the counts of parts, of which a conversation has few."""
    parts = t.groupBy("conv_id", "part").agg(F.min("i").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return t.join(parts.select("conv_id", "part", (before - F.col("low") + 1).alias("shift")), ["conv_id", "part"]).withColumn("pos", F.col("i") + F.col("shift")).drop("i", "shift")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv_id, part, pos, c1, c2, n_chars) of the rebuilt turns, and (conv_id, n_turns).

    own: ``numbered``. The leading turns of each hundred are five rows at most for each of its hundred conversations; they are part -1.
    """
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("leader"))
    led = F.least("h", F.coalesce("n0", F.lit(0)))
    convs = convs.join(sizes.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("leader"), F.col("n").alias("n0")), "leader", "left").withColumn("led", led)
    heads = own.where((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < SHARED)).select(F.col("conv_id").alias("leader"), "pos", "c1", "c2", "n_chars")
    shared = convs.join(heads, "leader").where("pos <= h").select("conv_id", F.lit(-1).cast("long").alias("part"), "pos", "c1", "c2", "n_chars")
    rest = own.join(convs.select("conv_id", "h", "led"), "conv_id").where("pos > h")
    rest = rest.select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("led")).alias("pos"), "c1", "c2", "n_chars")
    return shared.unionByName(rest), convs.select("conv_id", (F.col("led") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, p1, p2 (of the parent), n_chars and ends: a row for each prefix of each conversation, the empty one included."""
    own = turns.select("conv_id", "part", "pos", "n_chars", *(F.xxhash64("pos", F.lit(s), "c1", "c2").alias(f"f{s}") for s in (1, 2)))
    parts = own.groupBy("conv_id", "part").agg(F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"x{s}").over(earlier), F.lit(0)).alias(f"b{s}") for s in (1, 2)))
    here = W.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumns({f"r{s}": F.bit_xor(f"f{s}").over(here) for s in (1, 2)}).join(parts, ["conv_id", "part"]).join(convs, "conv_id")
    keys = [F.col(f"r{s}").bitwiseXOR(F.col(f"b{s}")) for s in (1, 2)]
    depth = F.col("pos").cast("long").alias("depth")
    out = own.select("conv_id", depth, *(k.alias(f"k{s}") for s, k in enumerate(keys, 1)), *(k.bitwiseXOR(F.col(f"f{s}")).alias(f"p{s}") for s, k in enumerate(keys, 1)), "n_chars", (F.col("pos") == F.col("n_turns")).alias("ends"))
    zero = F.lit(0).cast("long")
    top = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("n_chars"), (F.col("n_turns") == 0).alias("ends"))
    return top.unionByName(out)


def nodes_of(paths: DataFrame, level: int, *values: Column) -> DataFrame:
    """The nodes whose depth is a multiple of BAND ** level: key, ``values`` and up, the keys (k1, k2) from the band's root to the node itself."""
    unit = BAND**level
    band = W.partitionBy("conv_id", F.expr(f"depth div {unit * BAND}")).orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = paths.where(F.col("depth") % unit == 0) if level else paths
    return at.withColumn("up", F.collect_list(F.struct("k1", "k2")).over(band)).groupBy(*KEY).agg(*values, F.first("up").alias("up"))


def _raised(rows: DataFrame, unit: int, *sums: str) -> DataFrame:
    """Sums for each node over the rows at and below it in its band. rows: depth, up, and the summed columns."""
    root = F.col("depth") - F.col("depth") % (unit * BAND)
    each = rows.select("depth", *sums, F.posexplode("up").alias("j", "a")).select((root + F.col("j") * unit).alias("depth"), F.col("a.k1").alias("k1"), F.col("a.k2").alias("k2"), *sums)
    return each.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in sums))


def rollup(nodes: DataFrame, paths: DataFrame, scratch: Scratch, deepest: int, *sums: str, level: int = 0) -> DataFrame:
    """KEY and the sums of ``sums`` over each node's whole subtree. nodes: KEY, conv_id (a member), up and the values, stored; paths: ``prefixes``, stored."""
    unit = BAND**level
    inside = scratch.put(f"inside-{level}", _raised(nodes, unit, *sums))
    if deepest < unit * BAND:
        return inside
    roots = scratch.put(f"roots-{level}", nodes_of(paths, level + 1, F.min("conv_id").alias("conv_id")).join(inside, KEY))
    full = rollup(roots, paths, scratch, deepest, *sums, level=level + 1)
    # a completed root adds its total to the node of this level above it, and to that one's ancestors in its band
    hung = full.where("depth > 0").join(roots.select(*KEY, "conv_id"), KEY).select("conv_id", (F.col("depth") - unit).alias("depth"), *sums)
    hung = hung.join(paths.select("conv_id", *KEY), ["conv_id", "depth"]).join(nodes.select(*KEY, "up"), KEY)
    return inside.unionByName(_raised(hung, unit, *sums)).groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in sums))


def ends_of(paths: DataFrame, sep: str = ",") -> DataFrame:
    """KEY and ends_sha256 of the nodes at which conversations end: the hash of their ids in order, joined.

    Ids meet in chunks of ``IDS`` numbers; a node's chunks then stream through one hash, so a node that any share of
    all conversations ends at needs the memory of a chunk.
    """
    chunks = paths.where("ends").groupBy(*KEY, F.expr(f"conv_id div {IDS}").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), sep).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sha = None, None
        for pdf in batches:
            out = []
            for *key, ids in zip(pdf["depth"].tolist(), pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["ids"]):
                if key == last:
                    sha.update(f"{sep}{ids}".encode())
                    continue
                if last:
                    out.append((*last, sha.hexdigest()))
                last, sha = key, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if last:
            yield pd.DataFrame([(*last, sha.hexdigest())], columns=[*KEY, "ends_sha256"])

    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids").mapInPandas(run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each node: KEY, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. paths: ``prefixes``, stored."""
    own = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_chars").alias("n_chars"), F.first("p1").alias("p1"), F.first("p2").alias("p2")]
    nodes = scratch.put("nodes", nodes_of(paths, 0, *own))
    above = ((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = nodes.where("depth > 0").select(*above).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    valued = valued.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")})
    valued = scratch.put("valued", valued.select(*KEY, "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "p1", "p2", "up"))
    scratch.drop("nodes")
    deepest = valued.agg(F.max("depth")).first()[0] or 0
    sums = rollup(valued.select(*KEY, "conv_id", "up", "n_leaves", "saved_tokens"), paths, scratch, deepest, "n_leaves", "saved_tokens")
    named = valued.select("depth", "k1", "k2", F.col("conv_id").alias("parent_conv_id"))
    kids = valued.select(*KEY, "conv_id", "n_convs", "n_children", "p1", "p2")
    # the root's children may be a third of all nodes: their parent is known without a join
    root = valued.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))
    first = kids.where("depth = 1").crossJoin(F.broadcast(root)).drop("p1", "p2")
    deep = kids.where("depth > 1").withColumn("up_depth", F.col("depth") - 1)
    deep = deep.join(named.select(F.col("depth").alias("up_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv_id"), ["up_depth", "p1", "p2"]).drop("up_depth", "p1", "p2")
    tops = kids.where("depth = 0").drop("p1", "p2").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = first.unionByName(deep).unionByName(tops).join(sums, KEY).join(ends_of(paths), KEY, "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def op11_conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node.

    Null roles and texts are empty. Turns are ordered by turn (null first), then role and text in byte order; repeated rows are
    turns of their own. Rows without conv_id belong to no conversation and are left out. A negative id's hundred is the one towards
    zero. An empty table has no sequence and gives no rows; other columns are not read. Very long conversations and
    texts are dealt in parts; texts are hashed whole.
    """
    with Scratch(turns.sparkSession) as scratch:
        own = scratch.put("numbered", numbered(ordered(turns, scratch)))
        scratch.drop("ordered")
        paths = scratch.put("paths", prefixes(*rebuilt(own)))
        scratch.drop("numbered")
        out = scratch.put("trie", trie(paths, scratch))
        scratch.keep("trie")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 of the digits, by bits; h of each conversation, then the rebuilt turns, and each node by the list of its turns.
ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS leader, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 6 AS h FROM t GROUP BY conv_id),
cc AS (SELECT c.conv_id, c.n, c.leader, c.h, least(c.h, coalesce(l.n, 0)) AS led FROM c LEFT JOIN c l ON l.conv_id = c.leader),
r AS (SELECT cc.conv_id, t.pos, t.role, t.text FROM cc JOIN t ON t.conv_id = cc.leader AND t.pos <= cc.h UNION ALL SELECT cc.conv_id, t.pos - cc.h + cc.led, t.role, t.text FROM cc JOIN t USING (conv_id) WHERE t.pos > cc.h),
p AS (SELECT conv_id, pos AS depth, length(text) AS chars, list((role, text)) OVER (PARTITION BY conv_id ORDER BY pos) AS seq, pos = max(pos) OVER (PARTITION BY conv_id) AS ends FROM r
  UNION ALL SELECT conv_id, 0, 0, [], NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = cc.conv_id) FROM cc),
n AS (SELECT seq, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY seq),
k AS (SELECT a.conv_id, a.depth, count(b.depth) AS n_children FROM n a LEFT JOIN (SELECT n.depth - 1 AS depth, p.seq FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1) b ON a.seq = b.seq GROUP BY a.conv_id, a.depth, a.seq),
s AS (SELECT up.seq, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens FROM n JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth JOIN p up ON up.conv_id = n.conv_id AND up.depth <= n.depth GROUP BY up.seq)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth JOIN s ON s.seq = n.seq LEFT JOIN p up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1 LEFT JOIN n m ON m.seq = up.seq
"""
