"""Document fingerprints: invertible Bloom lookup sketches of paragraph hashes.

A sketch has ``TABLES`` x ``SIDE`` cells; a paragraph's digest falls in one cell of each table, which counts it and joins it and its
check by XOR. Subtracting the sketches of two versions cancels what they share. Peeling then takes digests from cells that hold
a single one until all cells are empty: what was taken is exactly what differs. Where that fails the sketch was too small, and the two
are compared again with sketches ``GROW`` times as large: the digests are dealt to as many sketches by further bits, of which again
only those that fail grow.

Cells are rows, so building, subtracting and peeling are sums and XORs by key. All keys start with the pair's own number, by which the
rows are dealt once: a level of all its rounds is one shuffle of the digests, and no task holds more of a pair than its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

#: Tables of a sketch, and the bits that choose a cell in one.
TABLES, BITS = 3, 3
SIDE = 1 << BITS
#: A retry has 2 ** GROW_BITS times the cells.
GROW_BITS = 5
GROW = 1 << GROW_BITS
#: A sketch is peeled if by its own counts at most this many digests differ; else it is too small.
MOST = 18
#: Rounds of peeling, each over one table; what isn't empty then is retried larger.
ROUNDS = 6
#: A paragraph ends at a line break or the end of a sentence, and after this many code points.
PIECE = 96
#: Parts of the order by doc_id for each shuffle partition.
PARTS = 4
#: What a sketch belongs to: the pair, which of its comparisons, and the part of the digests.
OF = ["row", "kind", "bucket"]


def paragraphs(text: Column) -> Column:
    """The text cut into stretches; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(rf"[^\n.!?]{{1,{PIECE}}}+[\n.!?]*+|[\n.!?]++"), F.lit(0))


def digests(text: Column) -> Column:
    """The distinct digests of the text's paragraphs."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _cell(key: Column, table: int) -> Column:
    """A digest's cell in a table: each table reads other bits of it."""
    return (F.shiftrightunsigned(key, table * BITS).bitwiseAND(F.lit(SIDE - 1).cast("long")) + table * SIDE).cast("int")


def _bucket(key: Column, level: int) -> Column:
    """Which of the GROW ** level sketches a digest falls in."""
    return F.shiftrightunsigned(key, 64 - GROW_BITS * level) if level else F.lit(0).cast("long")


def _joined() -> tuple[Column, ...]:
    return F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")


_FULL = "n <> 0 OR k <> 0 OR c <> 0"


def sketch(keys: DataFrame, *of: str) -> DataFrame:
    """of, cell, n, k and c: the cells that aren't empty. keys: of, k, and n, what a digest counts: -1 takes it away."""
    at = F.explode(F.array(*(_cell(F.col("k"), t) for t in range(TABLES)))).alias("cell")
    return keys.select(*of, "n", "k", F.xxhash64("k").alias("c"), at).groupBy(*of, "cell").agg(*_joined()).where(_FULL)


def peeled(cells: DataFrame, keep: bool = False) -> DataFrame:
    """OF, cell, n, k, c, found and digest after all rounds. Rows with cell >= 0 are what could not be peeled. The others say
    how many digests were found, or with ``keep`` which: k of such a row, of the first version if n is 1, else of the second.

    A digest is alone in at most one cell of a table, so a round, which looks at one table, takes it once."""
    zero = F.lit(0).cast("long")
    state = cells.select(*OF, "cell", "n", "k", "c", zero.alias("found"), zero.alias("digest"))
    n, k, c = (F.col(x) for x in "nkc")
    row = lambda cell, n, k, c, found, digest: F.struct(cell.alias("cell"), n.alias("n"), k.alias("k"), c.alias("c"), found.alias("found"), digest.alias("digest"))
    for r in range(ROUNDS):
        t = r % TABLES
        alone = F.col("cell").between(t * SIDE, t * SIDE + SIDE - 1) & ((n == 1) | (n == -1)) & (F.xxhash64("k") == c)
        taken = row(F.lit(-1), n if keep else zero, k if keep else zero, zero, F.lit(1).cast("long"), k if keep else zero)
        others = [row(_cell(k, u), -n, k, c, zero, zero) for u in range(TABLES) if u != t]
        same = F.array(row(F.col("cell"), n, k, c, F.col("found"), F.col("digest")))
        state = state.select(*OF, F.inline(F.when(alone, F.array(taken, *others)).otherwise(same)))
        state = state.groupBy(*OF, "cell", "digest").agg(*_joined(), F.sum("found").alias("found")).where(f"found > 0 OR {_FULL}")
    return state


def _keys(sets: DataFrame, level: int, pending: DataFrame | None = None) -> DataFrame:
    """OF, n and k of the digests that are to be sketched; rows lie by ``row``, whose arrays are what is shuffled. pending: row, kind, and above, the bucket of the last level."""
    if pending is None:
        dealt = sets.repartition("row").withColumn("todo", F.lit(None))
    else:
        dealt = sets.join(pending.groupBy("row").agg(F.collect_list(F.struct("kind", "above")).alias("todo")), "row")
    keys = dealt.select("row", "todo", F.inline("sides")).select("row", "todo", "kind", "n", F.explode("keys").alias("k")).withColumn("above", _bucket(F.col("k"), max(level - 1, 0)))
    if pending is not None:
        keys = keys.where(F.array_contains("todo", F.struct("kind", "above")))
    return keys.select("row", "kind", "n", "k", _bucket(F.col("k"), level).alias("bucket"))


def differing(sets: DataFrame, scratch: Scratch, keep: bool = False) -> DataFrame:
    """row, kind and found, how many digests differ; with ``keep`` a row for each such digest, with k and n as in ``peeled``.

    sets: row (unique), and sides, an array of kind, n and keys (digests); stored. Sketches grow until every pair is peeled. The squares
    of a table's counts add up to about the digests that differ, so most sketches that are too small are known before they are peeled."""
    least = sketch(_keys(sets, 0), *OF).groupBy(*OF).agg((F.sum(F.col("n") * F.col("n")) / TABLES).alias("about"))
    least = scratch.put("about", least.select("row", "kind", F.col("bucket").alias("above"), (F.col("about") <= MOST).alias("few")))
    pending, late, done = least.where("few"), least.where("NOT few"), None
    for level in range(60 // GROW_BITS + 1):
        after = peeled(sketch(_keys(sets, level, pending.select("row", "kind", "above")), *OF), keep)
        tried = after.select("*", (F.max("cell").over(W.partitionBy(*OF)) < 0).alias("ok")) if keep else after.groupBy(*OF).agg(F.sum("found").alias("found"), (F.max("cell") < 0).alias("ok"))
        tried = scratch.put(f"level-{level}", tried)
        good = tried.where("ok").select("row", "kind", *(("n", "k") if keep else ("found",)))
        done = good if done is None else done.unionByName(good)
        pending = tried.where("NOT ok").select("row", "kind", F.col("bucket").alias("above")).distinct()
        pending = pending.unionByName(late.select("row", "kind", "above")) if level == 0 else pending
        if not pending.limit(1).count():
            return done
    raise ValueError("digests that differ in no bit of 60")


def _side(kind: str, n: int, keys: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"), F.col(keys).alias("keys"))


def changes(pairs: DataFrame) -> DataFrame:
    """id, digest and side for each paragraph digest in which the versions ``old`` and ``new`` of a text differ; null is an empty text.

    pairs: id, old, new. Digests that both hold are not in the result, whatever their order or number."""
    with Scratch(pairs.sparkSession) as scratch:
        both = pairs.select(F.monotonically_increasing_id().alias("row"), "id", digests(text_or_empty("old")).alias("a"), digests(text_or_empty("new")).alias("b"))
        sets = scratch.put("sets", both.select("row", "id", F.array(_side("b", 1, "a"), _side("b", -1, "b")).alias("sides")))
        found = differing(sets, scratch, keep=True).join(sets.select("row", "id"), "row")
        out = scratch.put("changes", found.select("id", F.col("k").alias("digest"), F.when(F.col("n") > 0, "old").otherwise("new").alias("side")))
        scratch.keep("changes")
    return out


def dealt(docs: DataFrame) -> DataFrame:
    """part and th beside doc_id and text: parts are stretches of the order by doc_id (null first), then th, a hash of the text.

    The bounds are percentiles, PARTS for each shuffle partition. Ids that fill two or more of these, and null, are dealt by th."""
    spark = docs.sparkSession
    n = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or [0]
    at = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    key, most = F.col("doc_id"), len(bounds)
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(most.bit_length()))))
    place = F.aggregate(steps, F.lit(0), lambda lo, w: F.when((lo + w <= most) & (F.get(at, F.least(lo + w, F.lit(most)) - 1) <= key), lo + w).otherwise(lo))
    out = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text")).withColumn("lo", F.when(key.isNull(), -1).otherwise(place))
    hot = key.isNull() | (F.col("lo") > 1) & (F.get(at, F.col("lo") - 2) == key)
    return out.withColumn("part", F.col("lo").cast("long") * 1024 + F.when(hot, F.shiftright("th", 56) + 256).otherwise(1000)).drop("lo")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, of the document that follows in the order of ``dealt``; the first follows the last.

    One shuffle by part; the first document of each part also goes to the part before."""
    spark, own = docs.sparkSession, dealt(docs)
    firsts = sorted(own.groupBy("part").agg(F.min(F.struct("doc_id", "th")).alias("f")).select("part", "f.*").collect())  # PARTS a shuffle partition, and 256 for an id that fills two
    if not firsts:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    to = spark.createDataFrame([(p, d, h, firsts[i - 1][0]) for i, (p, d, h) in enumerate(firsts)], "part long, doc_id long, th long, before long")
    same = (own["part"] == to["part"]) & own["doc_id"].eqNullSafe(to["doc_id"]) & (own["th"] == to["th"])
    guests = own.join(F.broadcast(to), same).groupBy("before").agg(F.first("text").alias("text"))
    rows = own.withColumn("guest", F.lit(False)).unionByName(guests.select(F.col("before").alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("th"), F.lit(True).alias("guest")))
    follows = F.lead("text").over(W.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "th"))
    return rows.withColumn("next_text", follows).where("NOT guest").select("doc_id", "text", "next_text")


def _once(**columns: Column) -> Column:
    """A generator that gives the columns: they are evaluated once, however often they are used above."""
    return F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))


def likeness(n_a: str, n_b: str, differ: Column) -> Column:
    """Shared digests over all digests of the two; 1 if both have none."""
    total = F.col(n_a) + F.col(n_b)
    return F.when(total == 0, 1.0).otherwise((total - differ) / (total + differ))


def shown(cells: Column) -> Column:
    """A sketch as text: cell:n:k:c of each cell that isn't empty, k and c in hexadecimal digits. cells: an array of these."""
    return F.array_join(F.transform(F.array_sort(cells), lambda x: F.concat_ws(":", x["cell"].cast("string"), x["n"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["c"])))), ",")


def fingerprints(sets: DataFrame) -> DataFrame:
    """row, kind and fingerprint: the smallest sketch as text. sets: row and sides, as in ``differing``."""
    keys = sets.repartition("row").select("row", F.inline("sides")).select("row", "kind", "n", F.explode("keys").alias("k"))
    own = F.collect_list(F.struct("cell", "n", "k", "c")).alias("cells")
    return sketch(keys, "row", "kind").groupBy("row", "kind").agg(own).select("row", "kind", shown(F.col("cells")).alias("fingerprint"))


def op12_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of every document and of its edited text (the last half replaced by the next document's start).

    Null texts are empty; two empty texts are alike (1), an empty one and another are not (0). The next document is by doc_id, null
    first; rows that share an id follow each other by a hash of their text, and rows equal in both are edited alike. A single
    document is its own next. An empty table gives no rows; other columns are not read. Long texts have more digests, which the
    first sketch counts whole and larger ones tell apart.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    with Scratch(docs.sparkSession) as scratch:
        texts = with_next(docs).select("doc_id", "text", "next_text", _once(n_chars=n.cast("long"), edited=edited))
        sets = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _once(a=digests(F.col("text")), e=digests(F.col("edited")), x=digests(F.col("next_text"))))
        sets = scratch.put("sets", sets.select(F.monotonically_increasing_id().alias("row"), "*"))
        versus = F.array(_side("e", 1, "a"), _side("e", -1, "e"), _side("x", 1, "a"), _side("x", -1, "x"))
        found = differing(sets.select("row", versus.alias("sides")), scratch)
        found = found.groupBy("row").agg(*(F.sum(F.when(F.col("kind") == k, F.col("found")).otherwise(0)).alias(f"d_{k}") for k in ("e", "x")))
        own = fingerprints(sets.select("row", F.array(_side("a", 1, "a"), _side("e", 1, "e")).alias("sides")))
        own = own.groupBy("row").agg(*(F.max(F.when(F.col("kind") == k, F.col("fingerprint"))).alias(f"f_{k}") for k in ("a", "e")))
        heads = sets.select("row", "doc_id", "n_chars", "edited_sha256", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("a", "e", "x")))
        whole = heads.join(found, "row", "left").join(own, "row", "left")
        text = lambda k: F.coalesce(f"f_{k}", F.lit(""))
        near = lambda k: likeness("n_a", f"n_{k}", F.coalesce(f"d_{k}", F.lit(0)))
        out = scratch.put("fingerprints", whole.select("doc_id", "n_chars", "edited_sha256", text("a").alias("fingerprint"), text("e").alias("edited_fingerprint"), near("e").alias("near_edited"), near("x").alias("near_next")))
        scratch.keep("fingerprints")
    return out
