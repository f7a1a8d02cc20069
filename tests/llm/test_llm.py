"""Small fixtures against plain second versions, and the cases that every operator must survive."""

import collections
import hashlib
import math
import re
import string
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import decontam, jaccard, linededup, lmscore, mixing, quality, queries, rangecoder, secrets, sharding, tokenids, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog and runs away from all the other animals of this wood today"
NEAR = LONG + " with " + " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, NEAR, "en", "a", 1), (2, NEAR, "en", "a", 1), (3, NEAR.replace("word59", "other"), "en", "b", 1), (4, None, None, None, None), (5, "", "de", "b", 0),
        (6, "one two", "en", "a", 7), (7, "ONE  two\n", "en", "a", 7), (8, LONG + "\npassword = abcdef0123456789abcd\n" + LONG, "en", None, 3), (8, LONG + "\npassword = abcdef0123456789abcd\n" + LONG, "en", None, 3),
        (10, "héllo wörld " * 4000, "fr", "c", 9), (11, "shared line of text\nown line eleven", "en", "c", 3), (12, "Shared line of text  \nown line twelve\nshort", "en", "c", 3), (None, "no id here at all", "en", "c", 3),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quality(docs, none):
    out = {r["doc_id"]: r for r in quality.op10_quality_rules(docs).collect()}
    assert out[4]["n_words"] == 0 and out[4]["base_failed"] and out[10]["n_repeat_words"] == 8000 and not out[10]["kept"] and out[1]["kept"]
    assert out[8]["n_dup_lines"] == 1
    assert quality.op10_quality_rules(none).count() == 0
    book = quality.ledger(docs.withColumn("n_words", F.lit(-1)))
    assert book.where("n_words < 0").count() == 0
    assert {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.quality_ablation(docs).collect()}["repeated_windows"] == (3, 3)
    ab = {r["rule"]: r for r in quality.ablation(book, "base-1").collect()}
    assert ab["few_words"]["n_failed"] == book.where("n_words < 20").count() and ab["few_words"]["n_only"] == ab["few_words"]["n_failed"]


def test_line_dedup(docs, none):
    out = {r["doc_id"]: r for r in linededup.op3_line_dedup(docs.where("doc_id <> 8")).collect()}
    assert (out[11]["n_dropped"], out[12]["n_dropped"], out[2]["n_dropped"]) == (0, 1, 1)
    assert out[12]["kept_sha256"] == hashlib.sha256(b"own line twelve\nshort").hexdigest()
    assert out[4]["n_lines"] == 1 and out[4]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert linededup.op3_line_dedup(none).count() == 0


def test_line_runs_compact(spark, docs):
    hashes = linededup.line_hashes(docs.where("doc_id in (11, 12)"))
    with linededup.LineRuns(spark, buckets=3) as runs:
        assert runs.add(hashes.where("doc_id = 11"), "a").count() == 0 and runs.add(hashes.where("doc_id = 12"), "b").count() == 1
        assert [len(x) for x in runs.levels] == [0, 1] and runs.tables()[0].count() == 3
        names = [t for level in runs.levels for t in level]
    assert not any(spark.catalog.tableExists(t) for t in names)


def test_line_runs_are_merged_without_shuffle_or_sort(spark, docs):
    """The plan of a batch against two runs: one exchange (of the batch's own keys), one sort (of the same)."""
    hashes = linededup.line_hashes(docs.where("doc_id IS NOT NULL"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    with linededup.LineRuns(spark, buckets=8, fanout=9) as runs:
        runs.add(hashes.where("doc_id < 8"), "a")
        runs.add(hashes.where("doc_id = 8"), "b")
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            with linededup._in_order(spark):
                plan = runs.marked(hashes.where("doc_id > 8"))._jdf.queryExecution().executedPlan().toString()
        finally:
            for k, v in was.items():
                spark.conf.set(k, v)
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and plan.count("Bucketed: true") == 2, plan


def test_urls(spark):
    urls = [None, "", "nothing", "http://Example.com/en/x?q", "https://www.example.com/en/1", "https://a.b.net/es/2#t", "http://c.org", "http://x.net/fr/", "http://d.com/?u"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    out = {r["page_id"]: r for r in urlfilter.op4_url_filters(pages).collect()}
    assert len(out) == len(urls)
    assert (out[3]["host"], out[3]["path"], out[3]["rule"], out[3]["verdict"]) == ("example.com", "/en/x", "example.com/en/", "block")
    assert [out[i]["rule"] for i in (0, 4, 5, 6, 7, 8)] == [None, "www.example.com/en/", "net/es/", None, "net/fr/", "com/"]
    assert out[0]["host"] == "" and out[6]["path"] == "" and {r["verdict"] for r in out.values()} == {"allow", "block"}
    assert urlfilter.op4_url_filters(pages.limit(0)).count() == 0


def test_url_model_learns(spark):
    good, bad = [f"http://news{i}.org/story/{i}" for i in range(200)], [f"http://pills{i}.org/buy/{i}" for i in range(200)]
    labelled = spark.createDataFrame([(u, 0.0) for u in good[:150]] + [(u, 1.0) for u in bad[:150]], "url string, label double")
    pages = spark.createDataFrame(list(enumerate(good[150:] + bad[150:])), "page_id long, url string")
    out = urlfilter.op4_url_filters(pages, labelled)
    assert out.where("(page_id >= 50) = (verdict = 'block')").count() >= 95


def plain_url(url, rules=urlfilter.RULES):
    """host, path and rule, by string search."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for rule, says in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, says
    return host, path, best


def test_urls_against_plain_version(spark):
    rng = np.random.default_rng(12)
    bits = ["http://", "https://", "://", "www.", "Example.com", "example.com", "net", ".net", "xnet", "com", "/", "/en/", "/es/", "/fr/x", "?", "#", "é", "a" * 3000, ""]
    urls = [None, *("".join(rng.choice(bits, int(rng.integers(1, 7)))) for _ in range(400))]
    got = {r["page_id"]: r for r in urlfilter.op4_url_filters(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, url in enumerate(urls):
        host, path, best = plain_url(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[0]), url
        assert got[i]["verdict"] == (best[1] if best else "block" if got[i]["block_score"] >= 0.5 else "allow")


def test_url_model_on_held_out_urls(spark):
    """A fifth of the labelled hosts is held out."""
    seeds = urlfilter.seed_urls(spark).withColumn("at", F.pmod(F.xxhash64("url"), F.lit(5))).cache()
    pages = seeds.where("at = 0").select(F.monotonically_increasing_id().alias("page_id"), "url", "label")
    out = urlfilter.op4_url_filters(pages, seeds.where("at > 0"), rules=())
    both = out.join(pages, "page_id").agg(F.avg(((F.col("verdict") == "block") == (F.col("label") == 1)).cast("double")), F.count("*")).first()
    assert both[0] >= 0.95 and both[1] >= 200, both
    named = spark.createDataFrame([(1, "http://m.casino-win.example.org/en/1"), (2, "https://www.cheap-pills.example.net/en/2"), (3, "http://ththre.example.org/en/3"), (4, "https://blog.tionsh.example.net/de/4")], "page_id long, url string")
    assert [r["verdict"] for r in urlfilter.op4_url_filters(named).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]


def test_sharding_against_plain_version(spark):
    rng = np.random.default_rng(14)
    data = [(int(i) if i % 9 else None, None if i % 11 == 0 else "é" * int(rng.integers(0, 50)) + "x" * int(rng.integers(0, 3000))) for i in range(600)] + [(5, "same")] * 3
    out = sharding.op5_sharding(spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, slot int").repartition(5)).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in data)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    by, of_slot = collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        by[r["shard"]].append(r)
        of_slot[r["virtual_slot"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(x) == 1 for x in of_slot.values()) and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r["size"] for r in by[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= max(sum(r["size"] for r in out if r["virtual_slot"] == s) for s in of_slot)


def test_sharding(docs, none, spark):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    out = sharding.op5_sharding(many).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert sorted(sizes.index) == list(range(16)) and sizes.max() - sizes.min() <= 2 * out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    small = {(r["doc_id"], r["slot"], r["shard"]): r for r in sharding.op5_sharding(docs).collect()}
    assert len(small) == 13 and {r["size"] for r in small.values() if r["doc_id"] in (4, 5)} == {1}
    assert sharding.op5_sharding(none).count() == 0
    same = spark.range(3000).select(F.when(F.col("id") >= 2000, F.col("id")).alias("doc_id"), F.lit("a text of equal size").alias("text")).repartition(6)
    sizes = [r[0] for r in sharding.op5_sharding(same).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 2 * 21, sizes  # 2,000 rows without id
    one = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.format_string("text %04d", "id").alias("text")).repartition(6)
    sizes = [r[0] for r in sharding.op5_sharding(one).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 2 * 10, sizes  # one id for all
    assert set(sharding.rebalance({0: 0, 1: 0, 2: 1}, {0: 5, 1: 5, 2: 0}, 3).values()) <= {0, 1, 2}


def test_mixing_budgets(docs, none):
    out = mixing.op1_mixing(docs)
    assert out.count() == docs.count() and mixing.op1_mixing(none).count() == 0
    leaves = out.select("domain", "lang", "source", "leaf_budget").distinct().agg(F.sum("leaf_budget")).first()[0]
    assert leaves == out.agg(F.sum("n_tokens")).first()[0] // 2


def test_water_fill(spark):
    caps, weights, budget = [5, 100, 7, 40, 0, 60], [1, 1, 3, 2, 5, 2], 120
    kids = spark.createDataFrame([(f"k{i}", c, w, budget) for i, (c, w) in enumerate(zip(caps, weights))], "name string, cap long, weight long, parent_budget long")
    kids = kids.select("name", *(F.col(c).cast(T.DecimalType(38, 0)) for c in ("cap", "weight", "parent_budget")))
    got = {r["name"]: r["budget"] for r in mixing.water_fill(kids, [], "name").collect()}
    left, share, full = budget, {}, set()
    while True:
        w = sum(x for i, x in enumerate(weights) if i not in full)
        new = {i for i in range(6) if i not in full and caps[i] * w <= left * weights[i]}
        if not new:
            break
        i = min(new, key=lambda j: caps[j] / weights[j])
        full.add(i)
        left -= caps[i]
        share[i] = caps[i]
    assert sum(got.values()) == budget and all(got[f"k{i}"] == share[i] for i in full)
    assert all(abs(got[f"k{i}"] - left * weights[i] / w) <= 1 for i in range(6) if i not in full)


def brute_decontam(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    out = {}
    for d, text in docs:
        ws, hit, found = word.findall((text or "").translate(low)), set(), set()
        for i, t in items:
            iw = word.findall((t or "").translate(low))
            n = min(10, len(iw))
            for a in range(len(iw) - n + 1) if n else ():
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[a : a + n]:
                        hit |= set(range(p, p + n))
                        found.add(i)
        out[d] = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, f"so {item.upper()}, yes. {item} " * 2), (2, item[:50]), (3, "short One here. short one"), (4, None), (5, "Épée ÉPÉE alpha"), (6, "x" * 9 + " " + item.replace("mu", "nu"))]
    items = [(10, item), (2, "short one"), (3, None), (4, "..."), (5, "ÉPÉE")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:6] for r in decontam.op7_decontamination(d, b).collect()}
    assert got == brute_decontam(docs, items)
    assert decontam.op7_decontamination(d.limit(0), b).count() == 0
    assert decontam.op7_decontamination(d, b.limit(0)).where("contaminated").count() == 0


def test_decontamination_null_and_shared_ids(spark):
    docs = [(None, "aa bb cc"), (None, "nothing here"), (5, "one two aa bb cc"), (5, "dd ee ff one two three four"), (5, "dd ee ff one two three four"), (6, None)]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(1, "aa bb cc"), (2, "dd ee ff")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.op7_decontamination(d, b).collect())
    assert got == [(0, 2, 0, 0), (0, 3, 3, 1), (5, 5, 3, 1), (5, 7, 3, 1), (5, 7, 3, 1), (6, 0, 0, 0)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in decontam.without_hits(d, b).collect()) == [(0, "nothing here"), (6, None)]


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red x x blue"), (2, "red blue"), (3, "blue " + "y " * 30 + "red"), (4, "red " * 2000 + "blue")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "red blue")], "item_id long, text string")
    near = {r["doc_id"]: r["n_near"] for r in decontam.op7_decontamination(d, b).collect()}
    assert near == {1: 1, 2: 1, 3: 0, 4: 1}


def brute_jaccard(docs):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {d: (len(s), root[d]) for d, s in sets.items()}


def test_jaccard(spark, docs, none):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    data = [(100 + i, " ".join(w if rng.random() > 0.01 * (i % 5) else f"z{rng.integers(99)}" for w in base)) for i in range(60)]
    data += [(i, " ".join(base[:40] + [f"q{i}_{j}" for j in range(30)])) for i in range(20)] + [(50, None), (51, ""), (52, "a b"), (53, "A  b"), (54, "a b c d e")]
    got = {r[0]: tuple(r)[1:] for r in jaccard.op9_jaccard_join(spark.createDataFrame(data, "doc_id long, text string").repartition(7)).collect()}
    assert got == brute_jaccard(data)
    assert jaccard.op9_jaccard_join(none).count() == 0 and jaccard.op9_jaccard_join(docs).count() == docs.count()


@pytest.mark.parametrize("counters, bits, block", [(1, 5, 16)])
def test_jaccard_hot_columns_colliding_rows_and_blocks(spark, monkeypatch, counters, bits, block):
    """One counter makes every column hot; five bits make most sets share a row number; small blocks cut every set into pieces."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(11)
    base = [[f"w{g}_{i}" for i in range(int(rng.integers(20, 90)))] for g in range(6)]
    data = []
    for i in range(150):
        own = list(base[int(rng.integers(6))])
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(len(own)))] = f"z{rng.integers(40)}"
        data.append((i, " ".join(own[: int(rng.integers(max(5, len(own) - 8), len(own) + 1))])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(data, "doc_id long, text string").repartition(5), counters=counters, bits=bits).collect()}
    assert got == brute_jaccard(data)


def test_jaccard_null_and_shared_ids(spark):
    text = lambda i: " ".join(f"w{i}_{j}" for j in range(30))
    data = [(None, text(1)), (None, text(1)), (7, text(1)), (7, text(2)), (7, text(2)), (3, text(2) + " x"), (None, text(4)), (None, None), (5, ""), (5, "")]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "doc_id long, text string, n_shingles int")
    got = sorted(map(tuple, jaccard.op9_jaccard_join(d).collect()), key=str)
    assert got == sorted([(None, 26, 7), (None, 26, 7), (7, 26, 7), (7, 26, 3), (7, 26, 3), (3, 27, 3), (None, 26, None), (None, 0, None), (5, 0, 5), (5, 0, 5)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.without_copies(d).collect()), key=str)
    assert kept == sorted([(7, text(1)), (3, text(2) + " x"), (None, text(4)), (None, None), (5, ""), (5, "")], key=str)


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 700, 4096, 9001):
        for x in (rng.integers(0, 65536, n), np.full(n, 65535), rng.zipf(1.3, n) % 3000):
            ids = x.astype(np.uint16)
            data = rangecoder.encode(ids)
            assert (rangecoder.decode(data) == ids).all()
    assert len(data) < 1.6 * n
    broken = bytearray(data)
    broken[40] ^= 255
    with pytest.raises(ValueError):
        rangecoder.decode(bytes(broken))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300))
def test_range_coder_any_ids(ids):
    ids = np.array(ids, dtype=np.uint16)
    assert (rangecoder.decode(rangecoder.encode(ids, block=64)) == ids).all()


def test_token_ids(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted(rows(tokenids.op6_token_ids(docs, queries.tokenizer_path())), key=lambda r: r[1])
    data = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    at = 0
    for (doc, text), row in zip(data, got, strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert row == (doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert tokenids.op6_token_ids(none, queries.tokenizer_path()).count() == 0


def test_tokenizer_words_match_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(queries.tokenizer_path()), tokenids.Encoder(queries.tokenizer_path())
    for text in ("It's a test, isn't it? I'LL go.", "a<|endoftext|>b <|x", "ﬁ é é ́x   y\tz\x0bq", "123 4a5 ...!!! x.,", "", "  ", "İstanbul ΣΑΣ"):
        assert np.frombuffer(own([text])[0], dtype="<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_range_coder_memory():
    """A segment's coder has to fit beside the executor's heap (pipeline, last stage)."""
    ids = (np.random.default_rng(2).zipf(1.2, 1 << 19) % 40000).astype(np.uint16)
    for step in (rangecoder.encode, rangecoder.decode):
        tracemalloc.start()
        data = step(ids if step is rangecoder.encode else data)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24 * len(ids)
    assert (data == ids).all()


def test_words_of_latin_letters_skip_the_splitter():
    from tokenizers import Tokenizer

    class Counting:
        """The tokenizer, and the texts it was given whole."""

        def __init__(self, inner):
            self.inner, self.texts = inner, []

        def encode(self, text, **kw):
            self.texts.append(text)
            return self.inner.encode(text, **kw)

    path = queries.tokenizer_path()
    plain, own = Tokenizer.from_file(path), tokenids.Encoder(path)
    own.tokenizer = Counting(own.tokenizer)
    signs = ["", *string.punctuation, "$$$", "...", "<|", "|>"]
    latin = [a + w + b for a in signs for b in signs for w in ("s", "Endoftext", "Ère", "straße", "ŒUVRE") if not set(a) & set("'<")]
    texts = [" ".join(latin), "".join(map(chr, range(0x250))), *(f"{a}{w}{b}" for a in ("'", "<|") for b in ("|>", "'s") for w in ("s", "endoftext")), *map(chr, range(0x250))]
    got = [np.frombuffer(x, dtype="<u2").tolist() for x in own(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {w for t in own.tokenizer.texts for w in t.split("<|endoftext|>")} & (set(latin) - set(signs))


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokenids.Encoder(path)
    assert not own.by_word and tokenids.Encoder(queries.tokenizer_path()).by_word
    for text in ("It's A test,  Isn't it?\n\nYes", "", "x y"):
        assert np.frombuffer(own([text])[0], dtype="<u2").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_lm_score(docs, none, spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(words[min(int(rng.zipf(1.4)), 299)] for _ in range(80)) + (" new%d" % i if i % 3 == 0 else "")) for i in range(300)] + [(300, None), (301, "")]
    got = {r["doc_id"]: r for r in lmscore.op2_lm_score(spark.createDataFrame(data, "doc_id long, text string"), slots=1 << 16).collect()}
    train = [t for d, t in data if zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in (t or "").split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    for d, t in data:
        ws = (t or "").split()
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        assert abs(base - got[d]["base_score"]) < 1e-6 and got[d]["n_tokens"] == len(ws) + 1 and got[d]["train_tokens"] == n
        assert got[d]["n_known"] == sum(w in c for w in ws) + 1
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lmscore.op2_lm_score(none, slots=1 << 16).count() == 0
    assert lmscore.op2_lm_score(docs, slots=1 << 16).count() == docs.count()


def test_lm_score_is_the_same_however_it_is_partitioned(spark):
    rng = np.random.default_rng(8)
    data = [(i, " ".join(f"w{int(rng.zipf(1.3)) % 400}" for _ in range(int(rng.integers(0, 300))))) for i in range(120)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    one, seven = ({r["doc_id"]: r["score"] for r in lmscore.op2_lm_score(x, n_words=50).collect()} for x in (d.coalesce(1), d.repartition(7)))
    assert all(abs(one[i] - seven[i]) <= 1e-5 * max(1, abs(one[i])) for i in one) and len(one) == 120


def toy_model():
    rng = np.random.default_rng(6)
    code = lmscore.make_code([b"a", b"b", b"c"], [50, 9, 2], 7, 25, rng.integers(1, 30, 16))
    logit, seen = lmscore.predictors(rng.integers(0, 40, (2, 1 << 10, 2)))
    return code, logit, seen, rng.normal(0.3, 0.2, (64, 3)).astype(np.float32), 1 << 10


def test_lm_probabilities_add_to_one():
    """After any symbols, with any tables and weights, the shares of words, end and escape add to one, and so do those of the buckets."""
    model = toy_model()
    for before in ([], [16], [3, 17], [17, 18, 19]):
        bits, deep = lmscore.score_group([np.array([*before, s], dtype=np.uint32) for s in range(20)], *model)
        start = lmscore.score_group([np.array(before, dtype=np.uint32)], *model)[0][0] if before else 0.0
        assert abs((2.0 ** (bits[15:] - start)).sum() - 1) < 1e-4 and np.allclose(bits[:16], bits[15])
        assert abs(sum(2.0 ** x[-1] for x in deep[:16]) - 1) < 1e-4 and all(x[-1] == 0 for x in deep[16:])


def test_lm_score_is_the_plain_one():
    """Symbol by symbol and decision by decision."""
    code, logit, seen, first, slots = model = toy_model()
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 20, int(k)).astype(np.uint32) for k in (1, 5, 40, 40, 3)]
    for text, bits, deep in zip(texts, *lmscore.score_group(texts, *model)):
        w, total, below, before = first.astype(float).copy(), 0.0, [], [16, 16]
        for sym in text.tolist():
            one = lambda x: np.array([x], dtype=np.int64)
            _, place, (s1, s2) = lmscore._decisions(one(sym), one(before[-1]), one(before[-2]), code, slots)
            steps, below = [], [*below, 0.0]
            for i, at in enumerate(place):
                x = np.array([code["logit"][at], logit[0][s1[i]], logit[1][s2[i]]], dtype=float)
                gate = int(seen[1][s2[i]]) * 8 + int(seen[0][s1[i]])
                p = min(max(1 / (1 + math.exp(-float(x @ w[gate]))), 1e-5), 1 - 1e-5)
                bit = int(code["bit"][at])
                cost = math.log2(p if bit else 1 - p)
                total, below[-1] = total + (not code["deep"][at]) * cost, below[-1] + code["deep"][at] * cost
                steps.append((gate, 0.002 * (bit - p) * x))
            for gate, move in steps:  # decisions of one symbol with one gate all count
                w[gate] += move
            before.append(sym)
        assert abs(total - bits) < 1e-2 and np.allclose(below, deep, atol=1e-2)


def plain_base(text):
    """A second version of the base, character by character."""
    out = []
    for kind, pattern in enumerate((r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", r"(AKIA[A-Z0-9]+)()", r"([0-9a-f]+)()")):
        at, one = 0, re.compile(pattern)
        while at <= len(text):
            m = one.match(text, at)
            if m is None or m.end() == at:
                at += 1
                continue
            if len(m[2]) >= 12 if kind == 0 else len(m[0]) >= (18, 16)[kind - 1]:
                out.append((m.start(), kind, m.end()))
            at = m.end()
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "secret", "token", "api_key", "apikey", "AKIA", "\"", "'", " ", ":", "=", "\n", "abcdef012345", "0" * 15, "f", "ABCDEFGHIJKLMN", "Z9", "é", "ſecret", "x" * 12, "-", "K"]), max_size=14).map("".join))
def test_secret_base_is_the_plain_one(text):
    assert secrets.base_spans(text) == plain_base(text)


def planted(rng, kind):
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    alnum = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    return {"bearer": f"Authorization: Bearer {draw(alnum, 40)}", "pwd": f"pwd = {draw(alnum, 20)}", "credential": f"credential: {draw(alnum + '+/', 32)}", "client_id": f"client_id = \"{draw(alnum, 28)}\""}[kind]


@pytest.mark.parametrize("kind", ["bearer", "pwd", "credential", "client_id"])
def test_field_finds_kinds_that_no_pattern_knows(spark, kind):
    rng = np.random.default_rng(2)
    words = ["the", "of", "a", "river", "stone", "Anna", "walked", "2024", "again,", "house.", "in", "to", "it's", "(see", "page", "12)"]
    line = lambda: " ".join(rng.choice(words, 12))
    hexed = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    data = [(i, line() + f'\n{line()} {"token = " if i % 2 else ""}"{hexed()}" {line()}\n' + line()) for i in range(200)] + [(i, "\n".join(line() for _ in range(6))) for i in range(200, 300)]
    found = {True: 0, False: 0}
    tests = [(1000 + i, f"{line()}\n{line()} {planted(rng, kind) if i % 2 else line()} {line()}") for i in range(200)]
    model = secrets.train(spark.createDataFrame(data, "doc_id long, text string"))
    for r in secrets.scan(spark.createDataFrame(tests, "doc_id long, text string"), model).collect():
        found[r["doc_id"] % 2 == 1] += r["n_crf"] > 0
    assert found[True] >= 80 and found[False] <= 5, found


def test_viterbi_is_best():
    rng = np.random.default_rng(4)
    trans = rng.normal(size=(3, 3)).astype(np.float32)
    trans[0, 2] = -1e9
    e = rng.normal(size=(6, 3)).astype(np.float32)
    got = secrets.viterbi(e, np.array([0]), np.array([6]), trans)
    value = lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) - (1e9 if p[0] == 2 else 0)
    import itertools

    assert value(tuple(got)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=6))), abs=1e-4)


def test_pipeline_stages_keep_columns(docs, spark, tmp_path):
    import corpus_pipeline as cp

    own = docs.withColumns({"n_words": F.lit(-5), "fail_bits": F.lit("x"), "copies": F.lit(0), "key": F.lit(1)})
    own.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = own
    for name, stage in cp.STAGES[:-1]:
        if stage is not cp.near_duplicate_stage:  # run below, and by itself
            at = stage(spark, at, str(tmp_path))
        assert at.columns == own.columns, name
        assert {tuple(r)[-4:] for r in at.collect()} <= {(-5, "x", 0, 1)}, name
    assert cp.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_stages_lose_no_row(spark, tmp_path):
    """Rows without doc_id, and rows that share one, are judged each by its text."""
    import corpus_pipeline as cp

    text = lambda i: " ".join(f"word{i * 1000 + j}" for j in range(60))
    rows = [(None, text(1)), (None, text(2) + " aa bb cc"), (7, text(3)), (7, text(4)), (8, text(3)), (9, "too short")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    spark.createDataFrame([(1, "aa bb cc")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))
    d = cp.quality_stage(spark, d, str(tmp_path))
    assert seen(d) == sorted((i or 0, t) for i, t in rows[:5])
    d = cp.near_duplicate_stage(spark, d, str(tmp_path))
    assert seen(d) == sorted((i or 0, t) for i, t in rows[:4])
    d = cp.decontamination_stage(spark, d, str(tmp_path))
    assert seen(d) == sorted((i or 0, t) for i, t in (rows[0], rows[2], rows[3]))
    taken = seen(cp.mixing_stage(spark, d, str(tmp_path)))
    assert len(taken) == 3 and taken == seen(d)  # the document that passes the budget is taken whole
    for stage in (cp.quality_stage, cp.decontamination_stage, cp.mixing_stage, cp.token_stage):
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
