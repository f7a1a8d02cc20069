"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

Each line is a chain of words tagged outside, begin or inside. A word's score comes from its own
shape, its neighbours' shapes and features of the whole document; a tag's from the tag before. A shape
has parts (hint word, end mark, characters, length) that are weighed alone and together, so a mix never seen
in training still has a score. The weights are trained on lines that the patterns label, and on copies of
these with the patterns' own giveaways masked (``masked``), so that the field also finds what the patterns
don't know. Viterbi decoding runs over all lines of a batch side by side.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ships, text_or_empty

ships(__name__)

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The most stretches of each sort, with and without a labelled secret, that the field is trained on; a line of more
#: than MAX_WORDS words makes several stretches.
MAX_LINES, MAX_WORDS = 2000, 128
#: Shapes of words of at most so many bytes are kept; those of longer ones are worked out anew.
_KEPT = 256
_HINT = re.compile(rb"pass|secret|token|key|akia|auth|bearer|pwd|credential", re.I)
_LOWER, _UPPER, _DIGIT, _OTHER, _NOT_HEX = (re.compile(x) for x in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^0-9A-Za-z]", rb"[^0-9a-f]"))
_LENGTHS = (4, 8, 12, 16, 20, 32)
_EDGE, _CLASSES = 0, 1 + 2 * 3 * 10 * (len(_LENGTHS) + 1)
_FILES, O, B, I = 4, 0, 1, 2
_CACHE = 1 << 19


_AS_HEX = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_STEMS = (b"passw", b"secret", b"token", b"api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in code points, in order.

    Each pattern runs only where a plain search finds what all its matches hold.
    """
    raw, out = text.encode("utf-8", "surrogatepass"), []
    if (b":" in raw or b"=" in raw) and any(x in low for low in (raw.lower(),) for x in _STEMS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"h" * 16 in raw.translate(_AS_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def shape(word: bytes) -> int:
    """A word's class: hint word or not, end mark, characters, length."""
    hint = 1 if _HINT.search(word) else 0
    end = 1 if word[-1:] in (b":", b"=") else 2 if b"=" in word or b":" in word else 0
    core = word.strip(b"\"'.,;:!?()[]{}<>=")
    lower, upper, digit, other = (x.search(core) is not None for x in (_LOWER, _UPPER, _DIGIT, _OTHER))
    if digit and not _NOT_HEX.search(core):
        kind = 8
    elif other and digit:
        kind = 9
    else:
        kind = lower + 2 * upper + 4 * digit if core else 0
    size = sum(len(word) >= n for n in _LENGTHS)
    return 1 + ((hint * 3 + end) * 10 + kind) * (len(_LENGTHS) + 1) + size


class _Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(word) > _KEPT:
            return shape(word)
        if len(self) > _CACHE:
            self.clear()
            self[b"\xff"] = _EDGE
        got = self[word] = shape(word)
        return got


def _classes(text: str, known: _Shapes) -> np.ndarray:
    """Classes of a text's words, with _EDGE for each line end."""
    words = text.encode("utf-8", "surrogatepass").replace(b"\n", b" \xff ").split()
    return np.fromiter(map(known.__getitem__, words), dtype=np.int16, count=len(words))


def _file_class(c: np.ndarray) -> int:
    """Whether a document has a hint word, and a long word that mixes letters and digits."""
    cell = (c.astype(np.int64) - 1) // (len(_LENGTHS) + 1)
    own = c != _EDGE
    hint = bool((own & (cell >= 30)).any())
    kind, size = cell % 10, (c.astype(np.int64) - 1) % (len(_LENGTHS) + 1)
    return hint + 2 * bool((own & (kind >= 5) & (size >= 4)).any())


def _known_shapes() -> _Shapes:
    out = _Shapes()
    out[b"\xff"] = _EDGE
    return out


def scores(c: np.ndarray, files: np.ndarray, model: dict) -> np.ndarray:
    """(words, 3): what each word's own, previous and next class and its document add to each tag."""
    before, after = np.concatenate([[_EDGE], c[:-1]]), np.concatenate([c[1:], [_EDGE]])
    return model["own"][c] + model["before"][before] + model["after"][after] + model["file"][files]


def viterbi(e: np.ndarray, start: np.ndarray, size: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags of chains at e[start : start + size], side by side. Inside never follows outside or a start."""
    out = np.zeros(len(e), dtype=np.int8)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    n, longest = len(start), int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")
    best = np.full((n, 3), -1e9, dtype=np.float32)
    back = np.zeros((len(e), 3), dtype=np.int8)
    for t in range(longest):
        k = int(live[t])
        at = start[:k] + t
        if t == 0:
            best[:k] = e[at]
            best[:k, I] = -1e9
            continue
        prev = best[:k]
        new = np.empty((k, 3), dtype=np.float32)
        for tag in (O, B, I):
            cand = prev + trans[:, tag]
            frm = cand.argmax(axis=1)
            back[at, tag] = frm
            new[:, tag] = cand[np.arange(k), frm]
        best[:k] = new + e[at]
    tag = best.argmax(axis=1).astype(np.int8) if n else np.zeros(0, dtype=np.int8)
    for t in range(longest - 1, -1, -1):
        k = int(live[t])
        at = start[:k] + t
        out[at] = tag[:k]
        if t:
            tag[:k] = back[at, tag[:k]]
    return out


def _parts() -> list[np.ndarray]:
    """For each class its number in every partition of the classes: itself, hint, end mark, characters, length. The edge is 0."""
    c = np.arange(_CLASSES - 1)
    size, cell = c % (len(_LENGTHS) + 1), c // (len(_LENGTHS) + 1)
    each = [c, cell // 30, cell // 10 % 3, cell % 10, size]
    return [np.concatenate([[0], x + 1]) for x in each]


_SIDES = ("own", "before", "after")


def _weights() -> dict:
    out = {f"{side}{i}": np.zeros((int(part.max()) + 1, 3)) for side in _SIDES for i, part in enumerate(_parts())}
    out |= {"file": np.zeros((_FILES, 3)), "trans": np.zeros((3, 3))}
    out["file"][:, O] = 1.0
    out["trans"][O, I] = -1e9
    return out


def _tables(w: dict) -> dict:
    """The weights as one table a side, by class."""
    parts = _parts()
    return {side: sum(w[f"{side}{i}"][part] for i, part in enumerate(parts)) for side in _SIDES} | {"file": w["file"], "trans": w["trans"]}


def plain_model() -> dict:
    """Everything is outside."""
    return {k: v.astype(np.float32) for k, v in _tables(_weights()).items()}


def masked(lines: list[tuple[list[int], list[int], int]]) -> list[tuple[list[int], list[int], int]]:
    """The lines; and those with a secret once more without hints, and once more with other characters in the secret's words."""
    n, out, deal = len(_LENGTHS) + 1, list(lines), np.random.default_rng(13)
    for classes, tags, file in lines:
        if not any(tags):
            continue
        out.append(([c if c == _EDGE else (c - 1) % (30 * n) + 1 for c in classes], tags, file & 2))
        kind = int(deal.choice((5, 6, 7, 9)))
        swap = lambda c: c if (c - 1) // n % 10 != 8 else c + (kind - 8) * n  # noqa: B023, E731  hex becomes another mix with digits
        out.append(([swap(c) if c != _EDGE and t else c for c, t in zip(classes, tags)], tags, file))
    return out


def fit(lines: list[tuple[list[int], list[int], int]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-4) -> dict:
    """lines: classes, tags, file class. Maximum likelihood by stochastic gradient (forward-backward, Adagrad)."""
    w, parts = _weights(), _parts()
    if not any(B in tags for _, tags, _ in lines):
        return plain_model()
    square = {k: np.full(v.shape, 1e-3) for k, v in w.items()}
    lines = sorted(lines, key=lambda x: (len(x[0]), x))
    groups = [lines[i : i + 64] for i in range(0, len(lines), 64)]
    deal = np.random.default_rng(7)
    for _ in range(epochs):
        for g in deal.permutation(len(groups)):
            part, m = groups[g], _tables(w)
            longest = max(len(x[0]) for x in part)
            c, y, live = (np.zeros((len(part), longest), dtype=np.int64) for _ in range(3))
            for i, (classes, tags, _) in enumerate(part):
                c[i, : len(classes)], y[i, : len(tags)], live[i, : len(classes)] = classes, tags, 1
            file = np.array([x[2] for x in part])
            before = np.pad(c, ((0, 0), (1, 0)))[:, :-1]
            after = np.pad(c, ((0, 0), (0, 1)))[:, 1:]
            e = m["own"][c] + m["before"][before] + m["after"][after] + m["file"][file][:, None]
            e[:, 0, I] = -1e9
            n, rows = longest, np.arange(len(part))
            fwd, bwd = np.zeros((len(part), n, 3)), np.zeros((len(part), n, 3))
            fwd[:, 0] = e[:, 0]
            add = np.logaddexp.reduce
            for t in range(1, n):
                fwd[:, t] = np.where(live[:, t, None] > 0, add(fwd[:, t - 1, :, None] + m["trans"], axis=1) + e[:, t], fwd[:, t - 1])
            for t in range(n - 2, -1, -1):
                bwd[:, t] = np.where(live[:, t + 1, None] > 0, add(m["trans"] + (e[:, t + 1] + bwd[:, t + 1])[:, None], axis=2), 0.0)
            z = add(fwd[:, -1], axis=1)
            p = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0)) * live[..., None]
            diff = np.zeros_like(p)
            diff[rows[:, None], np.arange(n), y] = 1.0
            diff = diff * live[..., None] - p
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            for side, key in zip(_SIDES, (c, before, after)):
                by_class = np.zeros((_CLASSES, 3))
                np.add.at(by_class, key.ravel(), diff.reshape(-1, 3))
                for i, of in enumerate(parts):
                    np.add.at(grad[f"{side}{i}"], of, by_class)
            np.add.at(grad["file"], file, diff.sum(axis=1))
            if n > 1:
                pair = np.exp(np.minimum(fwd[:, :-1, :, None] + m["trans"] + (e[:, 1:] + bwd[:, 1:])[:, :, None] - z[:, None, None, None], 0)) * live[:, 1:, None, None]
                grad["trans"] -= pair.sum(axis=(0, 1))
                np.add.at(grad["trans"], (y[:, :-1][live[:, 1:] > 0], y[:, 1:][live[:, 1:] > 0]), 1.0)
            for k in w:
                step = grad[k] / len(part) - l2 * np.where(w[k] < -1e8, 0, w[k])
                square[k] += step * step
                w[k] += rate * step / np.sqrt(square[k])
            w["trans"][O, I] = -1e9
    return {k: v.astype(np.float32) for k, v in _tables(w).items()}


def labelled_lines(docs: DataFrame) -> DataFrame:
    """h, positive, classes, tags, file: every line with a pattern's match, and a line of one document in eight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _known_shapes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                spans = base_spans(text)
                c, file = None, 0
                seed = zlib.crc32(str(doc).encode())
                parts = text.split("\n")
                chosen, found = {seed // 8 % len(parts)} if seed % 8 == 0 else set(), {}
                starts = np.cumsum([0] + [len(x) + 1 for x in parts[:-1]]) if spans else None
                for start, _, end in spans:
                    i = int(np.searchsorted(starts, start, "right")) - 1
                    found.setdefault(i, []).append((start - int(starts[i]), end - int(starts[i])))
                for i in chosen | set(found):
                    words = list(_WORD.finditer(parts[i]))
                    tags = [O] * len(words)
                    for a, b in found.get(i, []):
                        inside = [j for j, w in enumerate(words) if w.start() < b and w.end() > a]
                        for j in inside:
                            tags[j] = B if j == inside[0] and tags[j] == O else I if tags[j] == O else tags[j]
                    if words and c is None:
                        c = _classes(text, known)
                        file = _file_class(c)
                    for first in range(0, len(words), MAX_WORDS):
                        some, own = words[first : first + MAX_WORDS], tags[first : first + MAX_WORDS]
                        if own[0] == I:
                            own[0] = B
                        rows.append((zlib.crc32(f"{doc}:{i}:{first}".encode()), any(own), [int(known[w[0].encode("utf-8", "surrogatepass")]) for w in some], own, file))
            yield pd.DataFrame(rows, columns=["h", "positive", "classes", "tags", "file"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, "h long, positive boolean, classes array<int>, tags array<int>, file int")


def train(docs: DataFrame, max_lines: int = MAX_LINES) -> dict:
    """Fitted on at most ``max_lines`` stretches of lines with and as many without a match, those of least hash."""
    with Scratch(docs.sparkSession) as scratch:
        lines, few = scratch.put("labelled-lines", labelled_lines(docs)), []
        for which in ("positive", "NOT positive"):
            own = lines.where(which)
            # Hashes are even over 32 bits: of n lines, about twice as many as are needed lie below this.
            least = min(1.0, (2 * max_lines + 200) / max(own.count(), 1))
            few += own.where(F.col("h") < int(least * 2**32)).orderBy("h", "classes", "tags").limit(max_lines).collect()  # a bounded sample
    return fit(masked([(r["classes"], r["tags"], r["file"]) for r in few]))


def _spans_of(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """tags of the words and line ends; the spans of begin-inside runs."""
    out, words, at = [], list(_WORD.finditer(text)), 0
    for tag in tags:
        if tag < 0:
            continue
        w = words[at]
        at += 1
        if tag == B:
            out.append((w.start(), 3, w.end()))
        elif tag == I and out:
            out[-1] = (out[-1][0], 3, w.end())
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, the base counts, base_sha256, all spans and n_crf (how many the field added) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, m = _known_shapes(), shared.value
        for whole in batches:
            for s in range(0, len(whole), 1000):
                pdf = whole.iloc[s : s + 1000]
                per_doc = [_classes(t, known) for t in pdf["text"]]
                lens = np.array([len(c) + 1 for c in per_doc])  # an edge ends each document
                c = np.concatenate([x for own in per_doc for x in (own, np.zeros(1, dtype=np.int16))]).astype(np.int64)
                files = np.repeat([_file_class(own) for own in per_doc], lens)
                edge = c == _EDGE
                ends = np.flatnonzero(edge)
                start = np.concatenate([[0], ends[:-1] + 1])
                size = ends - start
                tags = viterbi(scores(c, files, m), start[size > 0], size[size > 0], m["trans"])
                tags[edge] = -1
                bounds = np.cumsum(lens)
                rows = []
                for text, a, b in zip(pdf["text"], bounds - lens, bounds):
                    base = base_spans(text)
                    own = tags[a:b]
                    added = []
                    if (own > 0).any():
                        added = [x for x in _spans_of(text, own) if not any(x[0] < q[2] and q[0] < x[2] for q in base)]
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added), len(added)))
                out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])
                yield out.assign(doc_id=pd.array(pdf["doc_id"], "Int64"))

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def op8_secret_scans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_crf for every row.

    Null and empty texts have no spans. Repeated rows are scanned one by one. Without a match to learn
    from, the field adds nothing. An empty table gives no rows.
    """
    return scan(docs, train(docs))
