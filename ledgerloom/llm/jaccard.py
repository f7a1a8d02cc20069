"""Jaccard join on word shingles as a blocked sparse matrix product.

The distinct sets of shingles are rows, the shingles columns of a 0/1 matrix; overlaps are the entries of
its product with its transpose. Columns are ordered from rare to common, so a pair that is similar
enough must meet in the first columns of both rows (each row's prefix, from the size bound), and
the place of a meeting bounds the overlap that is still possible. Prefix columns are dealt to blocks by
hash and multiplied there: all rows of a column with one hub, so a group of near copies costs a product
each and not one for each pair. Pairs that the bounds leave have their remaining columns multiplied block
by block; the blocks' overlaps are added up and pairs below the size bound discarded. Rows that a link
already connects need no further product; products that may still link two components follow, column by
column.

Equal sets are one row. A row's number is 64 bits of its set's 128-bit hash; sets that differ in the other
64 bits are told apart (``_renamed``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, keyed, ships, small, summed, text_or_empty

ships(__name__)

#: Words in a shingle, and similarity in per cent.
SHINGLE, PERCENT = 5, 80
#: Counters that estimate how common a column is; the order of columns and the salting of hot ones depend on them, results don't.
COUNTERS = 1 << 20
#: Salts of a hot column, and columns of a block of a long row.
SALTS, BLOCK = 64, 4096
#: Keys of documents whose sets are made again are broadcast up to so many.
MAX_BROADCAST_ROWS = 1_000_000
_CHUNK = 1 << 12
_MULT = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 1 << 19


class _Hashes(dict):
    """8 bytes for each word, kept for the next time."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > _CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_digest(word)
        return got


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, k: int = SHINGLE):
        self.k, self.known = k, _Hashes()
        self.powers = [np.uint64(pow(int(_MULT), i, 1 << 64)) for i in range(k)]

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(words) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(words))], dtype=np.uint64)
        h = np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=">u8").astype(np.uint64)
        n = len(h) - self.k + 1
        mixed = h[:n].copy()
        for i in range(1, self.k):
            mixed += h[i : i + n] * self.powers[i]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed.sort()
        fresh = np.empty(n, dtype=bool)
        fresh[0] = True
        np.not_equal(mixed[1:], mixed[:-1], out=fresh[1:])
        return mixed[fresh]


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _halves(s: np.ndarray, bits: int) -> tuple[int, int]:
    """Two signed 64-bit halves of the set's hash; the first cut to ``bits`` (tests only)."""
    h = xxhash.xxh3_128_intdigest(s.tobytes(), seed=len(s))
    return (h & ((1 << bits) - 1)) - ((1 << 63) if bits == 64 else 0), (h >> 64) - (1 << 63)


def _texts(docs: DataFrame) -> DataFrame:
    return keyed(docs.select("doc_id", text_or_empty().alias("text")))


def rows_and_counts(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, counters: int = COUNTERS, bits: int = 64) -> tuple[DataFrame, np.ndarray]:
    """From one pass: doc_id, id0, th, n (set size), row and other (halves of the set's hash, null if empty) of each
    document, stored; and an upper estimate of how many rows hold a column, by the last bits of its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, total = Shingler(k), np.zeros(counters, dtype=np.uint32)
        for pdf in batches:
            sets = [make(t) for t in pdf["text"]]
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(counters - 1)).astype(np.int64), minlength=counters).astype(np.uint32)
            halves = [_halves(s, bits) if len(s) else (None, None) for s in sets]
            yield pd.DataFrame({
                "doc_id": pd.array(pdf["doc_id"], "Int64"), "id0": pdf["id0"], "th": pdf["th"], "n": [len(s) for s in sets],
                "row": pd.array([h[0] for h in halves], "Int64"), "other": pd.array([h[1] for h in halves], "Int64"), "i": pd.array([None] * len(pdf), "Int32"), "b": None,
            })
        for i in range(0, counters, _CHUNK):
            if (part := total[i : i + _CHUNK]).any():
                yield pd.DataFrame({c: pd.array([None], "Int64") for c in ("doc_id", "id0", "th", "n", "row", "other")} | {"i": [i // _CHUNK], "b": [part.astype(np.uint64).tobytes()]})

    both = scratch.put("rows", _texts(docs).mapInPandas(run, "doc_id long, id0 long, th long, n long, row long, other long, i int, b binary"))
    out = np.zeros(counters, dtype=np.uint64)
    for i, b in summed(both.where("i IS NOT NULL").select("i", "b"), "uint64").items():
        out[i * _CHUNK : i * _CHUNK + _CHUNK] = np.frombuffer(b, dtype=np.uint64)
    return both.where("i IS NULL").drop("i", "b"), out


def _renamed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """(row, other) of sets that share 64 bits with another set, with a number of their own.

    Of n sets, about n * n / 2**65 pairs are expected: none below a billion sets, some hundred at 1e11.
    """
    twice = rows.where("row IS NOT NULL").groupBy("row").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("row")
    pairs = rows.join(twice, "row").select("row", "other").distinct().collect()
    return {(r["row"], r["other"]): xxhash.xxh3_64_intdigest(f"{r['row']}/{r['other']}".encode()) - (1 << 63) for r in pairs}


def prefixes(docs: DataFrame, shared, k: int = SHINGLE, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """col, salt, row, n, pos: the columns of each row's prefix, once a task. shared: broadcast (classes, hot, renamed).

    Columns that may be held by more rows than a task should see are salted; salt is -1 for all others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, (classes, hot, renamed) = Shingler(k), shared.value
        last, seen = np.uint64(len(classes) - 1), set()
        for pdf in batches:
            cols, salts, rows, poss = [], [], [], []
            for text in pdf["text"]:
                s = make(text)
                if not len(s):
                    continue
                halves = _halves(s, bits)
                row = renamed.get(halves, halves[0])
                if row in seen:
                    continue
                if len(seen) > _CACHE:
                    seen.clear()
                seen.add(row)
                p = prefix_size(len(s), percent)
                at = (s & last).astype(np.int64)
                first = np.argsort(classes[at], kind="stable")[:p]  # s is in order of hash
                cols.append(s[first].view(np.int64))
                salts.append(np.where(hot[at[first]], xxhash.xxh3_64_intdigest(str(row)) % SALTS, -1))
                poss.append(np.arange(p))
                rows.append((row, len(s), p))
            if cols:
                sig, size, times = (np.array(x, dtype=np.int64) for x in zip(*rows))
                yield pd.DataFrame({"col": np.concatenate(cols), "salt": np.concatenate(salts), "row": np.repeat(sig, times), "n": np.repeat(size, times), "pos": np.concatenate(poss)})

    return _texts(docs).select("text").mapInPandas(run, "col long, salt int, row long, n int, pos int")


def multiplied(entries: DataFrame) -> DataFrame:
    """entries, dealt by (col, salt) and sorted by pos and row there: each with its column's hub, the row with the fewest rarer columns.

    Columns with one row are gone. A column's hub itself is given only where it is salted (hot), as its
    other salts haven't met it. A task holds a batch and the running column's hub, whatever its length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # col, salt, row of the last entry, and its column's hub: row, n, pos
        for pdf in batches:
            col, salt, row, n, pos = (pdf[c].to_numpy(dtype=np.int64) for c in ("col", "salt", "row", "n", "pos"))
            if not len(col):
                continue
            new = np.ones(len(col), dtype=bool)
            new[1:] = (col[1:] != col[:-1]) | (salt[1:] != salt[:-1])
            same = np.zeros(len(col), dtype=bool)
            same[1:] = ~new[1:] & (row[1:] == row[:-1])
            if last is not None and (col[0], salt[0]) == last[:2]:
                new[0], same[0] = False, row[0] == last[2]
            start = np.maximum.accumulate(np.where(new, np.arange(len(col)), -1))
            own = [np.where(start >= 0, x[start], y) for x, y in zip((row, n, pos), last[3:] if last else (0, 0, 0))]
            last = (col[-1], salt[-1], row[-1], *(int(x[-1]) for x in own))
            out = ~same & (~new | (salt >= 0))
            if out.any():
                yield pd.DataFrame({"col": col, "row": row, "n": n, "pos": pos, "hub": own[0], "hub_n": own[1], "hub_pos": own[2], "hot": salt >= 0})[out]

    return entries.repartition("col", "salt").sortWithinPartitions("col", "salt", "pos", "row").mapInPandas(run, "col long, row long, n int, pos int, hub long, hub_n int, hub_pos int, hot boolean")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether rows that meet at x's and y's places can still have the overlap that their sizes ask for. x, y: column prefixes."""
    need = f"ceil({percent} * ({x}n + {y}n) / {100 + percent})"
    return F.expr(f"{x}n - {x}pos >= {need} AND {y}n - {y}pos >= {need} AND 100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n)")


def _pieces(n: int) -> int:
    """Blocks of a row of n columns: a power of two, so that rows of like size have the same or twice as many."""
    return 1 << max(0, (-(-n // BLOCK) - 1).bit_length())


def sets_of(docs: DataFrame, wanted: DataFrame, shared, k: int = SHINGLE, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """row, n, pieces, piece, cols (array): the whole sets of the documents known by wanted (id0, th), in blocks of columns.

    A long row is given once more in the block count of rows up to 100 / ``percent`` times its size, if that differs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, renamed = Shingler(k), shared.value[2]
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                s = make(text)
                halves = _halves(s, bits)
                for pieces in sorted({_pieces(len(s)), _pieces(100 * len(s) // percent)}):
                    cuts = np.searchsorted(s, np.array([(i << 64) // pieces for i in range(1, pieces)], dtype=np.uint64))
                    out += [(renamed.get(halves, halves[0]), len(s), pieces, i, x.view(np.int64)) for i, x in enumerate(np.split(s, cuts))]
            if out:
                yield pd.DataFrame(out, columns=["row", "n", "pieces", "piece", "cols"])

    return _texts(docs).join(small(wanted, MAX_BROADCAST_ROWS), ["id0", "th"]).select("text").mapInPandas(run, "row long, n int, pieces int, piece int, cols array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs: a, b. Those that link: overlaps are counted block by block, added up, and held against the size bound.

    sets are dealt by row, once for both sides; a hub has no more members than a column's salt, so its sets meet them in one task.
    """
    side = lambda x: sets.select(F.col("row").alias(x), F.col("n").alias(f"{x}_n"), "pieces", "piece", F.col("cols").alias(f"{x}_cols"))
    met = pairs.join(side("b"), "b").join(side("a").withColumnsRenamed({"pieces": "a_pieces", "piece": "a_piece"}), "a").where("pieces = a_pieces AND piece = a_piece")
    blocks = met.select("a", "b", "a_n", "b_n", "pieces", F.size(F.array_intersect("a_cols", "b_cols")).alias("i"))
    total = blocks.groupBy("a", "b", "a_n", "b_n", "pieces").agg(F.sum("i").alias("i"))
    return total.where(100 * F.col("i") >= percent * (F.col("a_n") + F.col("b_n") - F.col("i"))).select("a", "b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: a, b. Returns row, label for every row that has a link: the smallest row reachable.

    Each round every row takes the smallest label among its neighbours', then the label of the row it
    names (pointer jumping). Labels only fall, so the rounds end.
    """
    both = scratch.put("both", links.select("a", "b").union(links.select("b", "a")).distinct())
    now = scratch.put("labels", both.groupBy(F.col("a").alias("row")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        name = now.select(F.col("row").alias("b"), F.col("label").alias("l"))
        near = both.join(name, "b").groupBy(F.col("a").alias("row")).agg(F.min("l").alias("l"))
        step = now.join(near, "row", "left").select("row", F.least("label", "l").alias("new"), F.col("label").alias("was"))
        jump = now.select(F.col("row").alias("new"), F.col("label").alias("jump"))
        now = scratch.put("labels", step.join(jump, "new", "left").select("row", F.least("new", "jump").alias("label"), "was"))
        if now.where("label <> was").limit(1).count() == 0:
            scratch.drop("both")
            return now.select("row", "label")
        now = now.select("row", "label")


def linked(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, counters: int = COUNTERS, bits: int = 64) -> DataFrame:
    """For each row of ``docs``: doc_id, id0, th, n_shingles, component_id, and first: of the component's documents
    the one that stays (the smallest doc_id, nulls last; then by the text's hash); copies of it are first too. A stored table."""
    with Scratch(docs.sparkSession) as scratch:
        out = _linked(docs, scratch, k, percent, counters, bits)
        scratch.keep("linked")
        return out


def _linked(docs: DataFrame, scratch: Scratch, k: int, percent: int, counters: int, bits: int) -> DataFrame:
    spark = docs.sparkSession
    rows, counts = rows_and_counts(docs, scratch, k, counters, bits)
    renamed = _renamed(rows)
    if renamed:
        table = spark.createDataFrame([(*key, new) for key, new in renamed.items()], "row long, other long, new long")
        rows = rows.join(F.broadcast(table), ["row", "other"], "left").withColumn("row", F.coalesce("new", "row")).drop("new")
    key = F.struct((F.col("id0") == NO_ID).alias("none"), "id0", "th")
    each = scratch.put("each", rows.where("row IS NOT NULL").groupBy("row").agg(F.min("doc_id").alias("least"), F.min(key).alias("key")))
    # A column that more rows may hold than a quarter of what a task gets is hot.
    task = (rows.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100 // int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((np.minimum(6 * np.log2(counts.astype(np.float64) + 1), 255).astype(np.uint8), counts > max(64, task // 4), renamed))
    entries = scratch.put("entries", multiplied(prefixes(docs, shared, k, percent, bits)))
    pairs = entries.where("row <> hub").where(_may_link("", "hub_", percent)).select(F.col("hub").alias("a"), F.col("row").alias("b"))
    hubs = entries.where("hot AND row = hub").groupBy("col").agg(F.min(F.struct("pos", "row", "n")).alias("top")).select("col", F.col("top.row").alias("top"), F.col("top.n").alias("top_n"), F.col("top.pos").alias("top_pos"))
    tops = entries.where("hot AND row = hub").join(hubs, "col").where("row <> top").where(_may_link("", "top_", percent)).select(F.col("top").alias("a"), F.col("row").alias("b"))
    # met: how many prefix columns a pair was multiplied in. Each row's own best hub comes first; hubs that these links reach need no product.
    one = pairs.union(tops).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("a").alias("a"), F.count("*").alias("met"))
    pairs = scratch.put("pairs", one.select("x", "y", "a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"), "met"))
    best = scratch.put("tried", pairs.groupBy("b").agg(F.max(F.struct("met", "a")).alias("best")).select("best.a", "b"))
    links = scratch.put("links", _verified(docs, each, best, shared, scratch, k, percent, bits))
    comp = components(links, scratch)
    of = lambda c, name: comp.select(F.col("row").alias(c), F.col("label").alias(name))
    more = pairs.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).join(best, ["a", "b"], "left_anti")
    more = scratch.put("more", more.select("a", "b"))
    if more.limit(1).count():
        links = scratch.put("links", links.union(_verified(docs, each, more, shared, scratch, k, percent, bits)))
        comp = components(links, scratch)
    scratch.drop("tried", "more")
    # What is left: rows that share a column but no component, of which at least one is outside the hub's. First each meets, of every
    # other component in the column, the one row with the fewest rarer columns; then, where that brought no link, all of its rows.
    top = hubs.select("col", "top")
    scratch.drop("links")
    entries = scratch.put("named", entries.join(top, "col", "left").select("col", "row", "n", "pos", F.coalesce("top", "hub").alias("hub")))
    scratch.drop("entries")
    links, tested = scratch.put("links", comp.select(F.col("row").alias("a"), F.col("label").alias("b")).where("a <> b")), pairs.select("x", "y")
    for last in (False, True):
        named = scratch.put("left", _outside(entries, comp))
        x, y = (named.select("col", *(F.col(c).alias(f"{p}_{c}") for c in ("row", "n", "pos", "comp", "out"))) for p in "xy")
        if not last:
            y = y.groupBy("col", "y_comp").agg(F.min(F.struct("y_pos", "y_row", "y_n")).alias("r")).select("col", "y_comp", "r.*")
        rest = x.where("x_out").join(y, "col").where("x_comp <> y_comp").where(_may_link("x_", "y_", percent))
        rest = rest.groupBy(F.least("x_row", "y_row").alias("x"), F.greatest("x_row", "y_row").alias("y")).agg(F.count("*").alias("met")).join(tested, ["x", "y"], "left_anti")
        rest = scratch.put("rest", rest.select("x", "y", F.col("x").alias("a"), F.col("y").alias("b")))
        if rest.limit(1).count():
            links = scratch.put("links", links.union(_verified(docs, each, rest, shared, scratch, k, percent, bits)))
            comp = components(links, scratch)
            tested = scratch.put("tested", tested.union(rest.select("x", "y")))
    scratch.drop("named", "left", "rest", "pairs", "tested")
    return _named(rows, each, comp, scratch)


def _outside(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """entries with comp (the row's component, else itself) and out (it isn't the hub's); only columns that hold a row outside."""
    of = lambda c, name: comp.select(F.col("row").alias(c), F.col("label").alias(name))
    named = entries.join(of("row", "comp"), "row", "left").join(of("hub", "hub_comp"), "hub", "left")
    named = named.select("col", "row", "n", "pos", F.coalesce("comp", "row").alias("comp"), (F.coalesce("comp", "row") != F.coalesce("hub_comp", "hub")).alias("out"))
    return named.join(named.where("out").select("col").distinct(), "col", "left_semi")


def _verified(docs: DataFrame, each: DataFrame, pairs: DataFrame, shared, scratch: Scratch, k: int, percent: int, bits: int) -> DataFrame:
    """The pairs that link. Only sets of rows in a pair are made again, each from one of its documents."""
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    wanted = scratch.put("wanted", each.join(wanted, "row").select("key.id0", "key.th"))
    sets = sets_of(docs, wanted, shared, k, percent, bits).repartition("row").dropDuplicates(["row", "pieces", "piece"])
    return overlaps(pairs.select("a", "b"), sets, percent)


def _named(rows: DataFrame, each: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """The result of ``linked``. Copies are one row before components are joined, so a large group is no task's."""
    labelled = each.join(comp, "row", "left").select("row", F.coalesce("label", "row").alias("label"), "least", "key")
    groups = scratch.put("groups", labelled.groupBy("label").agg(F.min("least").alias("least"), F.min("key").alias("key")))
    of_row = scratch.put("of_row", labelled.select("row", "label").join(groups, "label").select("row", "least", "key"))
    out = rows.join(of_row, "row", "left")
    first = F.col("row").isNull() | ((F.col("key.id0") == F.col("id0")) & (F.col("key.th") == F.col("th")))
    return scratch.put("linked", out.select("doc_id", "id0", "th", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), first.alias("first")))


def without_copies(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each group of linked documents the one that ``linked`` calls first; rows equal in doc_id and text stay once.

    Documents without shingles all stay. All columns of ``docs`` are kept.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = _linked(docs, scratch, k, percent, COUNTERS, 64)
        gone = scratch.put("gone", found.where("NOT first").select("id0", "th").distinct())
        twice = scratch.put("twice", found.where("first AND n_shingles > 0").groupBy("id0", "th").agg(F.count("*").alias("times")).where("times > 1").select("id0", "th"))
        scratch.keep("gone")
        scratch.keep("twice")
    on = lambda t: t.select(F.col("id0").alias("__id0"), F.col("th").alias("__th"))
    kept = keyed(docs, "__").join(small(on(gone), MAX_BROADCAST_ROWS), ["__id0", "__th"], "left_anti")
    if twice.limit(1).count():
        again = small(on(twice), MAX_BROADCAST_ROWS)
        kept = kept.join(again, ["__id0", "__th"], "left_anti").unionByName(kept.join(again, ["__id0", "__th"], "left_semi").dropDuplicates(["__id0", "__th"]))
    return kept.select(*docs.columns)


def op9_jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Null and empty texts have no shingles and stand alone. Texts of under five words are one shingle. Each
    row has the size of its own text's set, also where rows share a doc_id or have none. component_id is
    the smallest doc_id of the component, so null where none of its documents has one. An empty table gives
    no rows.
    """
    return linked(docs).select("doc_id", "n_shingles", "component_id")
