"""Periodic runs of words: stretches that repeat themselves with a smallest period.

Suffixes of a text are classed by their first words. Classes are united by decreasing length of the common
prefix (LCP), as Kruskal unites components: a union-find over the suffixes, with the ordered positions of each
class. Two positions that become neighbours in a class at a distance of at most the LCP overlap themselves, so
they seed a run, which is then extended to both sides. Every run is seeded so: when its first two periods meet
in a class, no position stands between them, or the period would not be the smallest.

A run of ``least`` words with two periods has an LCP of half of ``least`` or more, so only stretches of that many words
found twice in a text enter; texts without one, most of a corpus, end after one sort.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import ships, text_or_empty

ships(__name__)

#: Least length of a run in words; two periods are always needed.
LEAST = 12
#: Positions in a chunk of an ordered set before it is cut in two.
CHUNK = 1024


class Positions:
    """Ordered positions in chunks, so that an insertion moves at most ``CHUNK`` of them."""

    def __init__(self, first: int):
        self.chunks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        return (x for chunk in self.chunks for x in chunk)

    def add(self, x: int) -> tuple[int, int]:
        """Inserts x; its neighbours below and above, or -1."""
        c = min(bisect_left(self.tops, x), len(self.chunks) - 1)
        chunk = self.chunks[c]
        at = bisect_left(chunk, x)
        chunk.insert(at, x)
        self.size += 1
        below = chunk[at - 1] if at else self.chunks[c - 1][-1] if c else -1
        above = chunk[at + 1] if at + 1 < len(chunk) else self.chunks[c + 1][0] if c + 1 < len(self.chunks) else -1
        self.tops[c] = chunk[-1]
        if len(chunk) > CHUNK:
            self.chunks[c : c + 1] = [chunk[: CHUNK // 2], chunk[CHUNK // 2 :]]
            self.tops[c : c + 1] = [chunk[CHUNK // 2 - 1], chunk[-1]]
        return below, above


def gram_keys(ids: np.ndarray, gram: int) -> np.ndarray:
    """A number for the ``gram`` words from each position on, in the order of their ids; the end of the text comes before every word."""
    n, base = len(ids), int(ids.max()) + 2
    key, top = ids + 1, base
    for j in range(1, gram):
        if top > (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
            top = n
        key = key * base
        key[: n - j] += ids[j:] + 1
        top *= base
    return key


def suffix_levels(ids: np.ndarray, gram: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions whose ``gram`` words stand twice or more, in the order of their suffixes, and for each width gram, 2 gram,
    4 gram, ... a rank by position: equal where that many words are."""
    n, key = len(ids), gram_keys(ids, gram)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return np.zeros(0, dtype=np.int64), []
    k = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.append(True, ~same), k, 0))
    active = cands = order[np.append(False, same) | np.append(same, False)]
    levels, width = [(gram, rank)], gram
    while len(active):
        nxt = active + width
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        first, k = rank[active], np.arange(len(active))
        outer = np.append(True, first[1:] != first[:-1])
        inner = outer | np.append(True, second[1:] != second[:-1])
        rank = rank.copy()
        rank[active] = first + np.maximum.accumulate(np.where(inner, k, 0)) - np.maximum.accumulate(np.where(outer, k, 0))
        width *= 2
        active = active[~(inner & np.append(inner[1:], True))]
        levels.append((width, rank))
    return cands[np.argsort(rank[cands], kind="stable")], levels


def common_prefix(ids: np.ndarray, a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many words the suffixes at a and b share."""
    n, l = len(ids), np.zeros(len(a), dtype=np.int64)

    def step(by: int, values: np.ndarray) -> None:
        i, j = a + l, b + l
        inside = np.maximum(i, j) < n
        l[inside] += by * (values[i[inside]] == values[j[inside]])

    for width, rank in reversed(levels):
        step(width, rank)
    for _ in range(levels[0][0] - 1):
        step(1, ids)
    return l


def seeds(cands: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int]]:
    """(position, distance) of neighbours in a class at a distance within the LCP, by decreasing LCP. lcp[k]: of cands[k] and the next."""
    pos = cands.tolist()
    parent = list(range(len(pos)))
    sets: list[Positions | None] = [Positions(p) for p in pos]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = np.argsort(-lcp, kind="stable")
    for k, l in zip(edges.tolist(), lcp[edges].tolist()):
        if l == 0:
            return
        big, few = root(k), root(k + 1)
        if sets[big].size < sets[few].size:
            big, few = few, big
        parent[few], ordered = big, sets[big]
        for x in sets[few]:
            below, above = ordered.add(x)
            if below >= 0 and x - below <= l:
                yield below, x - below
            if 0 <= above <= x + l:
                yield x, above - x
        sets[few] = None


def _equal_from(ids: np.ndarray, i: int, j: int, way: int) -> int:
    """How many words are equal going from i and j (i < j) to the right (way 1) or to the left (-1), in blocks that grow."""
    got, block = 0, 64
    while True:
        most = min(block, len(ids) - j - got if way > 0 else i + 1 - got)
        if most <= 0:
            return got
        a, b = (ids[i + got : i + got + most], ids[j + got : j + got + most]) if way > 0 else (ids[i - got - most + 1 : i - got + 1][::-1], ids[j - got - most + 1 : j - got + 1][::-1])
        off = np.flatnonzero(a != b)
        if len(off):
            return got + int(off[0])
        got, block = got + most, block * 2


def _is_power(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether the period's words repeat a shorter stretch, so that it isn't the smallest."""
    rest, f, word = period, 2, ids[start : start + period]
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            if (word[period // f :] == word[: period - period // f]).all():
                return True
            while rest % f == 0:
                rest //= f
        f += 1
    return False


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, 2 * period) words, by start, then period."""
    gram = max(least // 2, 1)
    if len(ids) < least:
        return []
    cands, levels = suffix_levels(ids, gram)
    if not levels:
        return []
    lcp = common_prefix(ids, cands[:-1], cands[1:], levels)
    lcp[lcp < gram] = 0
    out, known = [], {}
    for at, period in seeds(cands, lcp):
        spans = known.setdefault(period, [])
        k = bisect_left(spans, (at + 1,)) - 1
        if k >= 0 and at + period < spans[k][1]:
            continue
        start = at - _equal_from(ids, at - 1, at + period - 1, -1) if at else 0
        end = at + period + _equal_from(ids, at, at + period, 1)
        insort(spans, (start, end))
        if end - start >= max(least, 2 * period) and not _is_power(ids, start, period):
            out.append((start, end - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The places that stay when each run keeps its first period only."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def each_text(docs: DataFrame, schema: str, row: Callable[[int | None, list[bytes]], list[tuple]]) -> DataFrame:
    """One pass without a shuffle: ``row`` gives the rows of a document from its id and the words of its whole text."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [None if x is None or x != x else int(x) for x in pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None)]
            rows = [r for doc, text in zip(ids, pdf["text"]) for r in row(doc, text.encode("utf-8", "surrogatepass").split())]
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="string" if kind.endswith("string") else "Int64") for i, (c, kind) in enumerate(zip(names, schema.split(", ")))})

    # the id goes as text: pandas would make floats of a column with nulls
    return docs.select(docs["doc_id"].cast("string").alias("doc_id"), text_or_empty(docs["text"]).alias("text")).mapInPandas(run, schema)


def text_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, length, period: a row for each run of each document's words."""
    return each_text(docs, "doc_id long, start long, length long, period long", lambda doc, words: [(doc, *r) for r in runs(word_ids(words), least)])


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and text: the words, joined by blanks, with each run cut to its first period."""

    def row(doc: int | None, words: list[bytes]) -> list[tuple]:
        keep = kept_words(len(words), runs(word_ids(words), least))
        return [(doc, b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "surrogatepass"))]

    return each_text(docs, "doc_id long, text string", row)


def rebuilt(doc: int | None, n: int) -> np.ndarray | None:
    """The places of the words that the query's contract sets for every tenth document: from a on, the first p words repeat. None: as they stand."""
    if doc is None or n == 0:
        return None
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _summary(doc: int | None, words: list[bytes]) -> list[tuple]:
    ids, at = word_ids(words), rebuilt(doc, len(words))
    if at is not None:
        ids, words = ids[at], [words[i] for i in at.tolist()]
    found = runs(ids)
    best = (None,) * 4
    if found:
        start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]))
        best = (start, length, period, 1000 * length // period)
        words = [w for w, k in zip(words, kept_words(len(words), found).tolist()) if k]
    listed = "".join(f"{s},{l},{p}\n" for s, l, p in found)
    return [(doc, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())]


def op13_periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of every document after the rebuilding that the contract sets (``rebuilt``).

    Null and empty texts have no words: no runs, four nulls, and the hash of the empty string twice. Documents
    without id are not rebuilt. Repeated rows are judged one by one, an empty table gives no rows, and other columns
    are not read. A very long text is searched whole, in the memory of its words times about the logarithm of their number.
    """
    return each_text(docs, SCHEMA, _summary)
