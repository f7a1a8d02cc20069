"""Token ids of whole texts as binary files of range-coded blocks.

Texts are sorted by doc_id over range partitions and encoded; each partition writes segments of whole
documents. A segment is a row of a Parquet data set (so Spark's committer keeps one copy of each,
whatever executors are lost): its documents' ids, their lengths, and the blocks of ``rangecoder``.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rangecoder
from .common import scratch, ships, text_or_empty

ships(__name__)

#: The id that ends each document, and ids after which a segment is closed.
END, SEGMENT = 1, 1 << 22
SCHEMA = "part int, seg int, doc_ids array<long>, lens array<long>, data binary"
_KNOWN, _MARK = 1 << 19, "<|endoftext|>"
#: A word of Latin letters, whose lower case is one to one and which NFC leaves as they are, with ASCII signs around it that start no token of their own.
_LATIN = re.compile(r"""([!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)([A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@\[-`{-~]*)""")
#: Texts that are encoded together.
_TEXTS = 64
#: Offsets of at most this many segments are broadcast.
MAX_BROADCAST_SEGMENTS = 500_000


def splits_at_blanks(tokenizer) -> bool:
    """Whether the tokenizer's ids of a text are those of its words between blanks, one after the other, in either case.

    That holds for what is checked here: NFC, blanks squeezed and lower case before, then a cut at blanks and
    between letters, digits and other signs, and nothing added after.
    """
    j = json.loads(tokenizer.to_str())
    norm, pre = j["normalizer"] or {}, j["pre_tokenizer"] or {}
    norms = [(x["type"], x.get("pattern"), x.get("content")) for x in norm.get("normalizers", [])]
    splits = [(x["type"], x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in pre.get("pretokenizers", [])]
    return (
        norms == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and splits == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]
        and pre["pretokenizers"][0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and not j["post_processor"] and not j["truncation"] and not j["padding"] and not j["model"].get("dropout")
    )


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes from 128 on in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others) if b > 127}


class Encoder:
    """Ids as uint16 bytes. If words between blanks never merge, each distinct one is encoded once and kept; else whole texts are encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.by_word = splits_at_blanks(self.tokenizer)
        self.mark = self.tokenizer.token_to_id(_MARK)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("the file format holds ids below 65536")

    def _encode(self, words: list[str]) -> None:
        """Many words in one call, with the end-of-text string between them; words that hold a part of it go alone."""
        alone = [w for w in words if "<|" in w or self.mark is None]
        for w in alone:
            self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u2").tobytes()
        words = [w for w in words if w not in self.known]
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            ids = np.array(self.tokenizer.encode(_MARK.join(part), add_special_tokens=False).ids, dtype="<u2")
            ends = (2 * np.append(np.flatnonzero(ids == self.mark), len(ids))).tolist()
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, ends):
                self.known[w], start = raw[start:end], end + 2

    def _piece(self, piece: str) -> bytes:
        """Ids of what the tokenizer does not cut further: lower-case Latin letters, or ASCII signs."""
        ids = self.known.get(piece) or self.older.get(piece)
        if ids is None:
            asked = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = self.known[piece] = b"".join([t.id.to_bytes(2, "little") for t in self.model.tokenize(asked)])
        return ids

    def learn(self, words: list[str]) -> None:
        """A word of Latin letters has the ids of its lower-cased letters, and signs around it add their own."""
        known, older, piece, rest = self.known, self.older, self._piece, []
        for w in words:
            if (ids := older.get(w)) is None:
                if not (latin := _LATIN.fullmatch(w)):
                    rest.append(w)
                    continue
                before, stem, after = latin.groups()
                ids = piece(stem.lower())
                if after:
                    ids += piece(after)
                if before:
                    ids = piece(before) + ids
            known[w] = ids
        self._encode(rest)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > _KNOWN // 2:  # words that aren't met again go when the next half is full
            self.known, self.older = {}, self.known
        words = [text.replace("\n", " ").split(" ") for text in texts]
        if new := set().union(*words).difference(self.known):
            self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, w)) for w in words]


def write_ids(docs: DataFrame, tokenizer: str, path: str, partitions: int | None = None) -> None:
    """docs: doc_id, text. Writes the ids of all texts in ascending doc_id order (nulls first)."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, seg = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        docs_, lens, ids, held = [], [], [], 0
        end = np.array([END], dtype="<u2").tobytes()

        def row() -> pd.DataFrame:
            data = rangecoder.encode(np.frombuffer(b"".join(ids), dtype="<u2"))
            return pd.DataFrame({"part": [part], "seg": [seg], "doc_ids": [docs_], "lens": [lens], "data": [data]})

        for pdf in batches:
            all_docs, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for i in range(0, len(texts), _TEXTS):
                for doc, got in zip(all_docs[i : i + _TEXTS], encode(texts[i : i + _TEXTS])):
                    got += end
                    docs_.append(None if pd.isna(doc) else int(doc))
                    lens.append(len(got) // 2)
                    ids.append(got)
                    held += len(got) // 2
                    if held >= SEGMENT:
                        yield row()
                        docs_, lens, ids, held, seg = [], [], [], 0, seg + 1
        if docs_:
            yield row()

    slim = docs.select("doc_id", text_or_empty().alias("text"))
    slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(run, SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, seg, start (ids before the segment), doc_ids, lens, data of each segment."""
    files = spark.read.schema(SCHEMA).parquet(path)
    size = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    segs = files.select("part", "seg", size.alias("n"))
    parts = segs.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))  # a row per partition
    inner = F.sum("n").over(W.partitionBy("part").orderBy("seg")) - F.col("n")
    starts = segs.withColumn("inner", inner).join(parts.select("part", "before"), "part").select("part", "seg", (F.col("before") + F.col("inner")).alias("start"))
    if segs.limit(MAX_BROADCAST_SEGMENTS + 1).count() <= MAX_BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    return files.join(starts, ["part", "seg"])


def documents_of(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the decoded ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for docs, lens, data, start in zip(pdf["doc_ids"], pdf["lens"], pdf["data"], pdf["start"]):
                ids, lens = rangecoder.decode(bytes(data)).astype("<u4"), np.asarray(lens, dtype=np.int64)
                ends = np.cumsum(lens)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lens, ends)]
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs], "Int64"), "start": start + ends - lens, "n_tokens": lens, "ids_crc32": crcs})

    return segments.select("doc_ids", "lens", "data", "start").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files.

    Null and empty texts hold the end id alone. Rows that share a doc_id follow each other by text; null
    doc_ids come first. An empty table gives no rows.
    """
    path = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path)
    return documents_of(read_ids(docs.sparkSession, path))
