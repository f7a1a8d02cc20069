"""Conversation tries, fingerprints and periodic runs against plain second versions, with nulls, ties, repeats, empty tables and other columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import periodic, sketch, trie

TURNS = "conv_id long, turn long, role string, text string, depth long, k1 string"
DOCS = "doc_id long, text string, row string, kind long, part string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1]) if n else 0
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, ())), leaves[n], saved[n], sha(",".join(map(str, sorted(ends.get(n, ())))))) for n, m in members.items())


def some_turns(seed, n_convs, deepest):
    rng, rows = random.Random(seed), []
    for c in range(n_convs):
        conv = rng.choice([c, 100 * (c % 3), 200 + c, -c])
        for t in range(rng.randint(1, deepest)):
            rows.append((conv, rng.choice([None, t, t, t]), rng.choice(["user", None, ""]), rng.choice([None, "", "a", "a", "bb", "ñ" * 3]), 7, "x"))
    return rows + [(None, 1, "user", "no conversation", 7, "x")] + rows[:5]


@pytest.mark.parametrize(("seed", "n", "deepest", "band", "parts"), [(1, 60, 7, 16, 8), (2, 25, 40, 3, 3), (3, 4, 90, 2, 5)])
def test_trie_against_plain_version(spark, monkeypatch, seed, n, deepest, band, parts):
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "IDS", 7)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = some_turns(seed, n, deepest)
        got = trie.op11_conversation_trie(spark.createDataFrame(rows, TURNS).repartition(4))
        assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1])) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_trie_of_nothing_and_of_turnless(spark):
    assert trie.op11_conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its only turn is replaced by those of 100, which isn't there
    assert [tuple(r) for r in trie.op11_conversation_trie(spark.createDataFrame([(lone, 0, "user", "gone", 1, "x")], TURNS)).collect()] == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]


def plain_digests(text):
    return set(re.findall(r"[^\n.!?]{1,96}[\n.!?]*|[\n.!?]+", text))


def likeness(a, b):
    a, b = plain_digests(a), plain_digests(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_plain_version(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice("one two three four five sechs señor".split()) for _ in range(rng.randint(1, 9))) + rng.choice(".!\n ")
    texts = ["".join(sentence() for _ in range(rng.choice([1, 3, 10, 60, 400]))) for _ in range(60)] + [None, "", "x", "no end " * 3000, "a\n" * 5000]
    texts[7] = texts[8] = texts[30]
    rows = [(3 * i - 20, t, "r", 1, "p") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    out = {r["doc_id"]: r for r in sketch.op12_fingerprints(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    order = sorted((i, t or "") for i, t, *_ in rows)
    assert len(out) == len(rows)
    for k, (doc, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half, r = len(text) // 2, out[doc]
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        assert r["near_edited"] == pytest.approx(likeness(text, edited)) and r["near_next"] == pytest.approx(likeness(text, after))
    prints = defaultdict(set)
    for doc, text in order:
        prints[text].add(out[doc]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len({frozenset(plain_digests(t)) for t in prints})


def test_fingerprints_of_null_and_shared_ids_and_nothing(spark):
    rows = [(None, f"null {i}. and more", "r", 1, "p") for i in range(40)] + [(5, f"five {i}.", "r", 1, "p") for i in range(40)] + [(5, "five 1.", "r", 1, "p"), (9, "last.", "r", 1, "p")]
    out = sketch.op12_fingerprints(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert len(out) == len(rows) and sum(r["doc_id"] is None for r in out) == 40 and all(0 <= r["near_next"] <= 1 for r in out)
    assert sum(r["near_next"] == 1 for r in out) == 1  # of the two equal rows the first is followed by the second
    assert [r["near_next"] for r in sketch.op12_fingerprints(spark.createDataFrame([(1, "alone. here", "r", 1, "p")], DOCS)).collect()] == [1.0]
    assert sketch.op12_fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_changes_recover_the_digests_that_differ(spark):
    old = "".join(f"line {i}\n" for i in range(500))
    new = old.replace("line 77\n", "another\n").replace("line 400\n", "")
    rows = [(1, old, new), (2, old, old), (3, None, "fresh text"), (4, "".join(f"x{i}\n" for i in range(900)), old)]
    got = defaultdict(set)
    for r in sketch.changes(spark.createDataFrame(rows, "id long, old string, new string")).collect():
        got[r["id"], r["side"]].add(r["digest"])
    assert {k: len(v) for k, v in got.items()} == {(1, "old"): 2, (1, "new"): 1, (3, "new"): 1, (4, "old"): 900, (4, "new"): 500}


def plain_runs(ids, least=12):
    out = set()
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i < len(ids) - q:
            j = i
            while j < len(ids) - q and ids[j] == ids[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                w = ids[i : j + q]
                if all(any(w[k] != w[k + r] for k in range(len(w) - r)) for r in range(1, q)):
                    out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_plain_version(monkeypatch):
    rng = random.Random(9)
    for _ in range(3000):
        monkeypatch.setattr(periodic, "CHUNK", rng.choice([4, 1024]))
        n, k, least = rng.randint(0, 50), rng.choice([1, 2, 2, 3, 5]), rng.choice([2, 4, 12])
        ids = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 6)
            ids = [ids[i] if i < a else ids[a + (i - a) % p] for i in range(n)]
        assert periodic.runs(np.array(ids, dtype=np.int64), least) == plain_runs(ids, least), (ids, least)


def test_runs_of_documents(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab c dé".split()) for _ in range(rng.choice([0, 5, 40, 120]))) for _ in range(150)]
    texts += [None, "", " \t\n", "same " * 20_000, "two words\n" * 9, "no break   wide"]
    rows = [(i, t, "r", 1, "p") for i, t in enumerate(texts)] + [(None, "x y " * 9, "r", 1, "p")] * 2
    got = sorted(map(tuple, periodic.op13_periodic_runs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()), key=repr)
    want = []
    for doc, text, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        n = len(words)
        if doc is not None and n and (h := zlib.crc32(str(doc).encode())) % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = [(0, n, 1)] if n > 1000 else plain_runs(words)
        gone = {i for s, l, q in found for i in range(s + q, s + l)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        want.append((doc, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{l},{q}\n" for s, l, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert got == sorted(want, key=repr)
    assert periodic.op13_periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    some = spark.createDataFrame([(1, "a b " * 10 + "c"), (2, "plain")], "doc_id long, text string")
    assert [tuple(r) for r in periodic.text_runs(some).collect()] == [(1, 0, 20, 2)]
    assert sorted(map(tuple, periodic.collapsed(some).collect())) == [(1, "a b c"), (2, "plain")]
