"""Benchmark decontamination with a positional inverted index.

The index holds postings (term, key, pos) of the terms that some window of the benchmark has among its two
rarest; key is a hash of a document's id and text. A window is looked up by its rarest term; that list is
intersected with the list of its second rarest term after shifting both to the place where the item would
start, and what is left is compared word by word with that stretch of the document. The same postings serve
proximity search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, ascii_lower, small

#: Words in a window.
WINDOW = 10
#: Benchmark-side tables of at most this many rows are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000
#: The same for places where an item may stand in a document.
MAX_BROADCAST_MEETS = 100_000
#: What separates words before A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words as they are written; ``ascii_lower`` makes them terms. None for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def with_key(docs: DataFrame) -> DataFrame:
    """key, id0 and text of each row. Rows equal in doc_id and text share a key, and their hits."""
    id0 = F.coalesce("doc_id", F.lit(NO_ID))
    return docs.select(F.xxhash64(id0, F.coalesce("text", F.lit(""))).alias("key"), id0.alias("id0"), "text")


def item_words(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """item (own key of each id and text), item_id and words (lower case), stored; items without a word are left out."""
    out = benchmark.select("item_id", F.transform(raw_words(F.col("text")), ascii_lower).alias("words"))
    return scratch.put("items", out.where("size(words) > 0").distinct().withColumn("item", F.monotonically_increasing_id()))


def _small(df: DataFrame) -> DataFrame:
    return small(df, MAX_BROADCAST_ROWS)


def term_counts(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """term, n: how often each term of the items stands in the documents (0 if never)."""
    terms = scratch.put("terms", items.select(F.explode("words").alias("term")).distinct())
    said = docs.select(F.explode(raw_words(F.col("text"))).alias("w")).select(ascii_lower(F.col("w")).alias("term"))
    found = said.join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, item_id, n_words (how many the item has), start, win (the words), and of each window the places and terms of its two rarest words.

    Places a and b count from the item's first word; b = a for one-word windows.
    """
    n = F.size("words")
    starts = items.select("item", "item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("start"))
    wins = starts.select("item", "item_id", F.size("words").alias("n_words"), "start", F.slice("words", F.col("start") + 1, window).alias("win"))
    placed = wins.select("item", "start", F.posexplode("win").alias("i", "term")).join(counts, "term")
    rare = placed.groupBy("item", "start").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "i", "term"))), 1, 2).alias("r"))  # at most ``window`` words
    last = F.element_at("r", -1)
    return wins.join(rare, ["item", "start"]).select(
        "item", "item_id", "n_words", "start", "win", F.size("win").alias("len"),
        F.col("r")[0]["term"].alias("term_a"), (F.col("start") + F.col("r")[0]["i"]).alias("a"),
        last["term"].alias("term_b"), (F.col("start") + last["i"]).alias("b"),
    )


def postings(docs: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored index: term, key, pos (from 0)."""
    tokens = with_key(docs).select("key", F.posexplode(raw_words(F.col("text"))).alias("pos", "w"))
    return scratch.put("postings", tokens.select(ascii_lower(F.col("w")).alias("term"), "key", "pos").join(_small(terms), "term").select("term", "key", "pos"))


def aligned(index: DataFrame, wins: DataFrame) -> DataFrame:
    """key, item, n_words, shift: where the item would start for its rarest terms' lists to meet."""

    def shifted(term: str, place: str) -> DataFrame:
        of = wins.select(F.col(term).alias("term"), "item", "n_words", F.col(place).alias("place")).distinct()
        return index.join(_small(of), "term").select("key", "item", "n_words", (F.col("pos") - F.col("place")).alias("shift"))

    return shifted("term_a", "a").distinct().join(shifted("term_b", "b"), ["key", "item", "n_words", "shift"], "left_semi")


def phrase_hits(docs: DataFrame, index: DataFrame, wins: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id0, item_id, start, at, len: window ``start`` of the item stands in the document from word ``at``.

    Of a document only the stretches where an item may stand are carried on, each no longer than the item.
    """
    meets = F.collect_list(F.struct("item", "shift", "n_words")).alias("meets")
    meet = scratch.put("aligned", aligned(index, wins).groupBy("key", F.expr("shift div 4096").alias("part")).agg(meets))  # 4096 places of a document a row
    few = (meet.agg(F.sum(F.size("meets"))).first()[0] or 0) <= MAX_BROADCAST_MEETS
    held = with_key(docs).join(F.broadcast(meet) if few else meet, "key").select("key", "id0", "meets", raw_words(F.col("text")).alias("ws"))
    from_ = lambda m: F.greatest(m["shift"], F.lit(0))
    cut = F.transform("meets", lambda m: F.struct(m["item"].alias("item"), m["shift"].alias("shift"), F.slice("ws", from_(m) + 1, m["n_words"]).alias("seg")))
    held = held.select("key", "id0", F.inline(cut))
    tried = held.join(_small(wins.select("item", "item_id", "start", "win", "len")), "item").withColumn("at", F.col("shift") + F.col("start"))
    said = F.transform(F.slice("seg", F.greatest(F.col("at") - F.greatest("shift", F.lit(0)), F.lit(0)) + 1, F.col("len")), ascii_lower)
    exact = tried.where((F.col("at") >= 0) & (said == F.col("win")))
    return exact.select("key", "id0", "item_id", "start", "at", "len").distinct()


def proximity_hits(index: DataFrame, wins: DataFrame, slop: int = 5, cell: int = 64) -> DataFrame:
    """key, item_id, n_near: places where a window's two rarest terms stand at most ``slop`` words off their distance in the item.

    Places are dealt to cells of ``cell`` words, so that a term repeated through a long text isn't paired with all its places.
    """
    pairs = wins.where("a <> b").select("item_id", F.col("term_a").alias("term"), "term_b", (F.col("b") - F.col("a")).alias("gap")).distinct()
    a = index.join(_small(pairs), "term").select("key", "item_id", "term_b", "gap", (F.col("pos") + F.col("gap")).alias("due"))
    a = a.withColumn("cell", F.explode(F.sequence(F.expr(f"floor((due - {slop}) / {cell})"), F.expr(f"floor((due + {slop}) / {cell})"))))
    b = index.select("key", F.col("term").alias("term_b"), "pos", F.expr(f"floor(pos / {cell})").alias("cell"))
    near = a.join(b, ["key", "term_b", "cell"]).where(F.abs(F.col("pos") - F.col("due")) <= slop)
    return near.select("key", "item_id", "term_b", "gap", "due").distinct().groupBy("key", "item_id").agg(F.count("*").alias("n_near"))


def search(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All exact windows of the benchmark in the documents (stored as ``hits``), and the index and windows to search on."""
    items = item_words(benchmark, scratch)
    wins = scratch.put("windows", anchors(items, term_counts(docs, items, scratch), window))
    terms = scratch.put("anchor-terms", wins.select(F.col("term_a").alias("term")).union(wins.select("term_b")).distinct())
    index = postings(docs, terms, scratch)
    return scratch.put("hits", phrase_hits(docs, index, wins, scratch)), index, wins


def summary(found: DataFrame) -> DataFrame:
    """Per document with hits (key, id0): n_hit, n_items, items_sha256. A null id counts as one item, without a place in the hash."""
    doc = ["key", "id0"]
    covered = found.select(*doc, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("p")).distinct().groupBy(*doc).agg(F.count("*").alias("n_hit"))
    items = found.select(*doc, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*doc).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("ids"))
    return covered.join(items, doc).select(*doc, "n_hit", "n_items", F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window, with all their columns; also those without doc_id are searched."""
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.put("gone", search(docs, benchmark, scratch, window)[0].select(F.col("key").alias("__key"), F.col("id0").alias("__id0")).distinct())
        scratch.keep("gone")
    id0 = F.coalesce("doc_id", F.lit(NO_ID))
    own = docs.withColumns({"__key": F.xxhash64(id0, F.coalesce("text", F.lit(""))), "__id0": id0})
    return own.join(small(gone, MAX_BROADCAST_ROWS), ["__key", "__id0"], "left_anti").select(*docs.columns)


def op7_decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near for every row of ``docs``.

    n_near: places where the two rarest terms of an item's window stand near their distance in it, exact ones
    included. Null texts have no words and no hits. Rows that share a doc_id, or have none, are searched each by
    its own text. Items without words match nothing; equal items both count, each text of an id that stands on
    several rows is looked for, and items without id count as one. With no items or no documents the result has
    no hits or no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        hits, index, wins = search(docs, benchmark, scratch, window)
        near = proximity_hits(index, wins).groupBy("key").agg(F.sum("n_near").alias("n_near"))
        # hits are the smaller side; a hot passage makes as many rows as there are documents holding it
        got = scratch.put("got", summary(hits).join(near, "key", "full_outer"))
        scratch.keep("got")
    none = F.sha2(F.lit(""), 256)
    counted = with_key(docs).select("key", F.col("id0").alias("doc0"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    both = counted.join(got, (counted["key"] == got["key"]) & (got["id0"].isNull() | (got["id0"] == counted["doc0"])), "left").drop(got["key"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    doc_id = F.when(F.col("doc0") != NO_ID, F.col("doc0")).alias("doc_id")
    return both.select(doc_id, "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS win, least(len(ws), 10) AS n FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, p, n, list_slice(ws, p, p + n - 1) AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT doc_id, p, bw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id),
tc AS (SELECT term, count(*) AS n FROM (SELECT unnest(ws) AS term FROM d) GROUP BY term),
st AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS s FROM (SELECT DISTINCT item_id, ws FROM b WHERE len(ws) > 0)),
pw AS (SELECT item_id, ws, s, p, ws[p] AS term FROM (SELECT item_id, ws, s, unnest(range(s, least(s + 10, len(ws) + 1))) AS p FROM st)),
rk AS (SELECT pw.*, row_number() OVER (PARTITION BY item_id, ws, s ORDER BY coalesce(n, 0), p) AS k FROM pw LEFT JOIN tc USING (term)),
pr AS (SELECT DISTINCT item_id, ta, tb, pb - pa AS gap FROM (SELECT item_id, max(term) FILTER (k = 1) AS ta, max(p) FILTER (k = 1) AS pa, max(term) FILTER (k = 2) AS tb, max(p) FILTER (k = 2) AS pb FROM rk GROUP BY item_id, ws, s) WHERE tb IS NOT NULL),
po AS (SELECT doc_id, p, ws[p] AS term FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
nr AS (SELECT x.doc_id, count(DISTINCT (item_id, tb, gap, x.p + gap)) AS n_near FROM po x JOIN pr ON x.term = ta JOIN po y ON y.doc_id = x.doc_id AND y.term = tb AND abs(y.p - x.p - gap) <= 5 GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
