"""Token ids in compressed shard files that answer questions without decoding.

A shard is a wavelet matrix: one bit plane for each bit of an id, highest
first, each plane sorted stably by the bits above it. Counts of ones before
every block make rank and select cheap, so a file answers which id stands at a
place, how often an id occurs, and where.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeloom.scale import scratch_path

MAGIC = b"WVM1"
BLOCK = 4096  # bits a rank entry covers
SHARD_TOKENS = 1 << 22
CACHED_WORDS = 1_000_000
GROUP_CHARS = 1 << 20  # characters whose new words are learned together
END = 1  # appended to each document
STEM = re.compile(r"([^\W\d_]+)([.,;:!?#*%$&()|-]*)")
MARKS = re.compile("[^\x00-\u02ff]")  # no mark that joins a letter is below
SHARD_SCHEMA = "shard long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, matrix binary"


class WaveletMatrix:
    """A sequence of ids below 2**32, read from one file image."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.size, self.bits = struct.unpack_from("<QI", image, 4)
        self._planes, self._ones, self._zeros = [], [], []
        at, unpack = 16, zstandard.ZstdDecompressor()
        for _ in range(self.bits):
            zeros, n_plane, n_rank = struct.unpack_from("<QQQ", image, at)
            at += 24
            self._zeros.append(zeros)
            self._planes.append(np.frombuffer(unpack.decompress(image[at : at + n_plane]), np.uint8))
            self._ones.append(np.frombuffer(unpack.decompress(image[at + n_plane : at + n_plane + n_rank]), np.uint64))
            at += n_plane + n_rank

    @staticmethod
    def image(ids: np.ndarray) -> bytes:
        """The file image of a sequence."""
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        level = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        out, pack = [MAGIC, struct.pack("<QI", len(ids), bits)], zstandard.ZstdCompressor(level=1)
        for bit in range(bits - 1, -1, -1):
            ones = (level & level.dtype.type(1 << bit)) != 0
            plane = np.packbits(ones)
            starts = np.arange(0, len(plane), BLOCK // 8)
            sums = np.add.reduceat(np.bitwise_count(plane), starts, dtype=np.uint64) if len(plane) else np.zeros(0, np.uint64)
            ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sums, dtype=np.uint64)])
            a, b = pack.compress(plane.tobytes()), pack.compress(ranks.tobytes())
            out += [struct.pack("<QQQ", len(ids) - int(ranks[-1]), len(a), len(b)), a, b]
            level = np.concatenate([np.compress(~ones, level), np.compress(ones, level)])
        return b"".join(out)

    def _rank1(self, k: int, i: int) -> int:
        """Ones before place i of plane k."""
        block = i // BLOCK
        first, last = block * (BLOCK // 8), i // 8
        n = int(self._ones[k][block]) + int(np.bitwise_count(self._planes[k][first:last]).sum())
        return n + (int(self._planes[k][last]) >> (8 - i % 8)).bit_count() if i % 8 else n

    def _select(self, k: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) one or zero of plane k."""
        ranks = self._ones[k].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.size) - ranks
        block = int(np.searchsorted(ranks, j, "right")) - 1
        bits = np.unpackbits(self._planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.size - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - ranks[block]])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        found = 0
        for k in range(self.bits):
            bit = int(self._planes[k][i // 8]) >> (7 - i % 8) & 1
            found = found << 1 | bit
            ones = self._rank1(k, i)
            i = self._zeros[k] + ones if bit else i - ones
        return found

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        """Where the token's places in [first, last) end up below the last plane."""
        if token < 0 or token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._rank1(k, first), self._rank1(k, last)
            if token >> (self.bits - 1 - k) & 1:
                first, last = self._zeros[k] + a, self._zeros[k] + b
            else:
                first, last = first - a, last - b
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """How often the token occurs at places [first, last)."""
        a, b = self._range(token, first, self.size if last is None else last)
        return b - a

    def select(self, token: int, j: int) -> int:
        """The place of the j-th (from 0) occurrence of the token."""
        first, last = self._range(token, 0, self.size)
        if not 0 <= j < last - first:
            raise IndexError(j)
        place = first + j
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            place = self._select(k, bit, place - self._zeros[k] if bit else place)
        return place

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each step undoes one stable sort."""
        ids = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self._planes[k], count=self.size).astype(bool)
            above = np.empty_like(ids)
            above[np.flatnonzero(~ones)] = ids[: self._zeros[k]]
            above[np.flatnonzero(ones)] = ids[self._zeros[k] :] | ids.dtype.type(1 << (self.bits - 1 - k))
            ids = above
        return ids


def _stem(word: str) -> tuple[str, str]:
    """Letters and the marks after them; all of another word, and no marks."""
    if word.isascii() and word.isalpha():
        return word.lower(), ""
    m = STEM.fullmatch(word)
    if not m or not m[1].isalpha() or not m[1].lower().isalpha():
        return word, ""
    return (m[1].lower() if m[1].isascii() else m[1]), m[2]


def split_words(text: str) -> list[str]:
    """The words between blanks, tabs and breaks, and empty ones where these meet.

    Other white space separates no words here, so `str.split` alone will not do.
    """
    return text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


class Words:
    """Ids of white-space-separated words, as the library gives them.

    The tokenizer drops white space and never joins words across it, so a text
    is the ids of its words in order; punctuation after letters is cut off as the
    tokenizer does, and ASCII capitals count as small. What was met lately is
    remembered by the Python worker.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._known: dict[str, bytes] = {"": b""}
        self._stems: dict[str, bytes] = {}
        self._end = np.array([END], self.dtype).tobytes()
        vocabulary = self._tokenizer.get_vocab()
        self._special = [t.content.lower() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self._closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ask(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words of letters are asked as one text: each has a
        closing id or more, so if there are as many of these, each has one."""
        letters = [w for w in words if w.isalpha()]
        parts = self._split(letters) if letters else []
        if len(parts) < len(letters):
            return self._ask_each(words)
        others = iter(self._ask_each([w for w in words if not w.isalpha()]))
        mine = iter(parts)
        return [next(mine) if w.isalpha() else next(others) for w in words]

    def _split(self, letters: list[str]) -> list[bytes]:
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, self.dtype)
        ends = (np.flatnonzero(self._closes[ids]) + 1) * self.dtype.itemsize
        if len(ends) != len(letters) or ends[-1] != ids.nbytes:
            return []
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _ask_each(self, words: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember new words, by their stems and marks where they have some."""
        parts = [_stem(w) for w in words]
        new = list({p for pair in parts for p in pair if p and p not in self._stems})
        self._stems.update(zip(new, self._ask(new), strict=True))
        stems = self._stems
        self._known.update((w, stems[a] + stems[b] if b else stems[a]) for w, (a, b) in zip(words, parts, strict=True))

    def _small(self, text: str) -> str:
        """The text with A-Z as a-z. The tokenizer does that as well, but after
        it has found special tokens and joined letters and marks; texts that may
        hold these stay as they are."""
        small = text.encode().lower().decode()
        return text if MARKS.search(text) or any(t in small for t in self._special) else small

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, new words of about GROUP_CHARS characters at a time."""
        group, held = [], 0
        for text in texts:
            group.append(split_words(self._small(text or "")))
            held += len(text or "")
            if held >= GROUP_CHARS:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, texts: list[list[str]]) -> Iterator[bytes]:
        known = self._known
        if len(known) > CACHED_WORDS:
            known.clear()
            known[""] = b""
        if len(self._stems) > CACHED_WORDS:
            self._stems.clear()
        new = set().union(*texts).difference(known)
        if new:
            self._learn(list(new))
        for words in texts:
            yield b"".join(map(known.__getitem__, words)) + self._end


@lru_cache(maxsize=4)
def words_of(path: str) -> Words:
    """One for each Python worker and tokenizer."""
    return Words(path)


def write(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all documents and write shard files in ascending doc_id order.

    A row of the table at `path` is one shard file: the image of its wavelet
    matrix with the documents it holds. Spark commits the files, so a lost task
    leaves nothing behind. A shard closes at the end of the document that takes
    it to `shard_tokens` ids; a document is never split. A null or empty text
    is its end id alone; repeated ids stand side by side, in order of text.
    """

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, n = words_of(tokenizer), TaskContext.get().partitionId(), 0
        ids, sizes, held, total = [], [], [], 0

        def close() -> pd.DataFrame:
            tokens = np.frombuffer(b"".join(held), words.dtype)
            row = [(part << 32) + n, len(tokens), ids, sizes, WaveletMatrix.image(tokens)]
            return pd.DataFrame([row], columns=["shard", "n_tokens", "doc_ids", "doc_tokens", "matrix"])

        for batch in batches:
            for doc_id, found in zip(batch["doc_id"], words.encode_all(batch["text"]), strict=True):
                held.append(found)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                sizes.append(len(held[-1]) // words.dtype.itemsize)
                total += sizes[-1]
                if total >= shard_tokens:
                    yield close()
                    n, ids, sizes, held, total = n + 1, [], [], [], 0
        if ids:
            yield close()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    order = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    order.mapInPandas(shards, SHARD_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The shards at `path`: one row each, in the order of `shard`."""
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def digests(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from the shard files: doc_id, start,
    n_tokens, ids_crc32. The start counts the ids of all documents before it."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, doc_ids, sizes, image in batch[["shard", "doc_ids", "doc_tokens", "matrix"]].itertuples(index=False):
                ids = WaveletMatrix(image).decode().astype("<u4")
                ends = np.cumsum(np.asarray(sizes, np.int64))
                starts = ends - np.asarray(sizes, np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pd.DataFrame({
                    "shard": shard, "doc_id": pd.array([None if pd.isna(d) else int(d) for d in doc_ids], "Int64"),
                    "place": starts, "n_tokens": sizes, "ids_crc32": crc,
                })

    found = shards.mapInPandas(documents, "shard long, doc_id long, place long, n_tokens long, ids_crc32 long")
    # One row a shard of millions of ids: the only rows that meet in one task.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    first = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    return found.join(first, "shard").select(
        "doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of one id in every shard, from rank alone: shard, n."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"shard": batch["shard"], "n": [WaveletMatrix(m).count(token) for m in batch["matrix"]]})

    return shards.select("shard", "matrix").mapInPandas(counted, "shard long, n long")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """Every occurrence of one id, from select alone: shard, place."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, image in zip(batch["shard"], batch["matrix"], strict=True):
                matrix = WaveletMatrix(image)
                found = [matrix.select(token, j) for j in range(matrix.count(token))]
                yield pd.DataFrame({"shard": np.full(len(found), shard, np.int64), "place": np.array(found, np.int64)})

    return shards.select("shard", "matrix").mapInPandas(places, "shard long, place long")


def op4(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, path, tokenizer)
    return digests(read(spark, path))
