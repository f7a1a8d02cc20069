"""Whole texts and all rows: cases that operators once left out, held against plain second versions."""

import duckdb
import numpy as np

from ledgerloom.llm import decontam, lmscore, secrets


def test_lm_weights_come_from_all_training_texts_and_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c a b word{i % 7}") for i in range(60)], "doc_id long, text string")
    seen, learn = {}, lmscore.learn_weights

    def spy(docs, code, table, slots):
        seen.update(texts=docs.count(), counts=table.value)
        return learn(docs, code, table, slots)

    monkeypatch.setattr(lmscore, "train_counts", lambda *_: np.full((2, 1 << 12, 2), 100_000, dtype=np.float32))
    monkeypatch.setattr(lmscore, "learn_weights", spy)
    n_train = lmscore.op2_lm_score(docs, slots=1 << 12).where("NOT held_out").count()
    assert seen["texts"] == n_train and seen["counts"].min() == 100_000


def test_lm_weights_are_carried_through_a_text():
    rng, slots = np.random.default_rng(3), 1 << 12
    c = lmscore.make_code([b"a", b"b", b"c", b"d"], [50, 30, 10, 5], 20, 7, np.array([5, 2, 1, 1]))
    texts = [np.append(rng.integers(0, 9, n), 4).astype(np.uint32) for n in (3, 300, 0, 70)]
    logit, seen = rng.normal(size=(2, slots)).astype(np.float32), rng.integers(0, 8, (2, slots)).astype(np.uint8)
    first = rng.normal(size=(64, 3)).astype(np.float32)
    want = []
    for t in texts:
        w, bits = first.astype(float), 0.0
        sym = t.astype(np.int64)
        prev1, prev2 = lmscore._before(sym, np.array([0]), 4)
        for i in range(len(t)):
            at = slice(i, i + 1)
            _, place, (one, two) = lmscore._decisions(sym[at], prev1[at], prev2[at], c, slots)
            before = w.copy()  # weights change after each symbol
            for p, a, b in zip(place, one, two):
                x, g = np.array([c["logit"][p], logit[0][a], logit[1][b]], dtype=float), int(seen[1][b]) * 8 + int(seen[0][a])
                q = np.clip(1 / (1 + np.exp(-x @ before[g])), 1e-5, 1 - 1e-5)
                bits += np.log2(q if c["bit"][p] else 1 - q)
                w[g] += (float(c["bit"][p]) - q) * 0.002 * x
        want.append(bits)
    bits, deep = lmscore.score_group(texts, c, logit, seen, first, slots)
    assert np.allclose(bits + np.array([x.sum() for x in deep]), want, rtol=1e-4)


def test_lm_passes_read_stored_symbols(spark):
    """Symbols are made once; counts and what is left out of them are those of a plain version."""
    rng, slots, sc = np.random.default_rng(12), 1 << 12, spark.sparkContext
    words = [b"a", b"b", "ö".encode(), b"d"]
    c = lmscore.make_code(words, [50, 30, 10, 5], 20, 7, np.array([5, 2, 1, 1]))
    texts = [" ".join(rng.choice(["A", "b", "ö", "d", "new", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")], n)) for n in (3, 300, 0, 70)]
    docs = spark.createDataFrame([(i, i == 1, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    found = {r["doc_id"]: r for r in lmscore.symbols(docs, sc.broadcast(c)).collect()}
    want = np.zeros((2, slots, 2))
    for i, text in enumerate(texts):
        said = [w.encode().lower() for w in text.split()]
        sym = np.array([5 + words.index(w) if w in words else lmscore.bucket_of(w, 4) for w in said] + [4])
        r = found[i]
        assert (lmscore._unpack(bytes(r["sym"])) == sym).all() and [bytes(w) for w in r["escaped"]] == [w for w in said if w not in words]
        assert r["n_bytes"] == len(text.encode()) + 1 and r["held_out"] == (i == 1)
        _, place, where = lmscore._decisions(sym, *lmscore._before(sym, np.array([0]), 4), c, slots)
        for o in (0, 1):
            np.add.at(want[o], (where[o], c["bit"][place]), 1)
    counts = lmscore.train_counts(lmscore.symbols(docs, sc.broadcast(c)).repartition(3), sc.broadcast(c), slots)
    assert (counts == want).all() and counts.sum() > 2000
    left = lmscore._left_out(counts)
    for o, slot, bit in zip(*np.nonzero(counts)):
        logit, seen = lmscore.predictors(counts[o, slot] - np.array([bit == 0, bit == 1]))
        at = left[o, 2 * slot + bit : 2 * slot + bit + 1]
        assert np.isclose(at.view(np.float32)[0], logit, atol=1e-5) and at[0] & 7 == seen
    big = np.array([0, 1, 65535, 65536, (1 << 17) + (1 << 16)], dtype=np.uint32)
    assert (lmscore._unpack(lmscore._pack(big)) == big).all()


def plain_shape(word):
    hint = any(x in word.lower() for x in (b"pass", b"secret", b"token", b"key", b"akia", b"auth", b"bearer", b"pwd", b"credential"))
    end = 1 if word[-1:] in (b":", b"=") else 2 if b"=" in word or b":" in word else 0
    core = word.strip(b"\"'.,;:!?()[]{}<>=")
    kinds = [any(a <= c <= b for c in core) for a, b in (b"az", b"AZ", b"09")]
    other = any(not chr(c).isalnum() or c > 127 for c in core)
    if kinds[2] and all(c in b"0123456789abcdef" for c in core):
        kind = 8
    else:
        kind = 9 if other and kinds[2] else kinds[0] + 2 * kinds[1] + 4 * kinds[2]
    return 1 + ((hint * 3 + end) * 10 + kind) * 7 + sum(len(word) >= n for n in (4, 8, 12, 16, 20, 32))


def test_shapes_look_at_whole_words():
    rng, known = np.random.default_rng(8), secrets._known_shapes()
    words = [b"x" * 300 + tail for tail in (b"", b"=", b"Password", b"9", b"-9", b":v", b"Q", "é".encode())] + [b"a" * 256 + b"0" * 50, b"," * 400, b"", b"\xfe"]
    words += [bytes(rng.choice(list(b"abfgzAFZ019=:.-_'\xc3"), rng.integers(1, 600))) for _ in range(300)]
    for w in words * 2:
        assert secrets.shape(w) == plain_shape(w) == known[w], w
    assert max(map(len, known)) <= 256
    assert secrets._file_class(secrets._classes("x" * 400 + "_secret=" + "Ab1" * 20, known)) == 3


def test_decontamination_of_shared_and_null_item_ids(spark):
    a, b, c = ("one two three four five six seven eight nine ten", "uno dos tres cuatro cinco seis siete ocho nueve one diez", "un deux trois quatre")
    docs = [(1, f"x {a} y"), (2, f"{b} z"), (3, f"one diez {c}"), (4, f"{a} {b} {c}"), (5, "one two uno dos"), (6, None)]
    docs += [(100 + i, "one two three six seven eight nine dos tres cuatro cinco seis siete nueve") for i in range(5)]
    items = [(7, a), (7, b), (7, None), (None, c), (None, "no hit"), (8, b)]
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    got = sorted(tuple(r) for r in decontam.op7_decontamination(d, m).collect())
    assert got == sorted(con.sql(decontam.ORACLE).fetchall())
    assert [r[3] for r in got[:5]] == [1, 2, 1, 3, 0]
