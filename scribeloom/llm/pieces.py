"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut into units, runs of space marks with the characters up to the
next mark. No piece of the vocabulary holds a mark after another character, so
no merge ever crosses units and each is encoded alone: its characters are
symbols, and an agenda of adjacent pairs, ordered by score and then by place,
says which pair is merged next. Short units have one agenda each in a matrix, and
all of them take a step at once. Units met lately are remembered. All units that
are new in a stretch of an Arrow batch are encoded and decoded by the
sentencepiece library as well, and a difference ends the task.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHED_UNITS = 800_000
SHORT = 48
CACHED_CHARS = 64  # longer units are not remembered
GROUP_CHARS = 1 << 20  # characters whose new units are learned together
ROWS = 1 << 13  # units whose agendas make a matrix
POINTS = 0x110000  # code points
NEVER = float("inf")


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self._byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._bytes = {i: b for b, i in enumerate(self._byte_ids)}
        self._ids: dict[str, int] = {}
        self._rank: dict[str, float] = {}
        self._surface: list[bytes] = []
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            plain = not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))
            if plain:
                self._ids[piece], self._rank[piece] = i, -lib.get_score(i)
            elif lib.is_unknown(i):
                piece = " ⁇ "
            self._surface.append(
                bytes([self._bytes[i]]) if lib.is_byte(i) else b"" if lib.is_control(i) else piece.replace(MARK, " ").encode()
            )
        if any(MARK in piece.lstrip(MARK) for piece in self._ids):
            raise ValueError("a piece holds a space mark after another character")
        self._known: dict[str, bytes] = {}
        self._tables()

    def _tables(self) -> None:
        """Pairs of symbols that make a piece, with the piece's place by score.

        A symbol is the id of its piece, or behind all ids a character's code
        point; the last number stands for the end of a unit. Of different pieces
        with equal scores the leftmost goes first, which a place by score does not
        tell: units that hold such a piece are merged one by one.
        """
        pieces = self.library.get_piece_size()
        self._span = pieces + POINTS + 1
        self._points = np.arange(POINTS, dtype=np.int64) + pieces
        for piece, i in self._ids.items():
            if len(piece) == 1:
                self._points[ord(piece)] = i
        symbol = lambda x: self._ids.get(x, int(self._points[ord(x)]) if len(x) == 1 else None)
        order = sorted((p for p in self._ids if len(p) > 1), key=self._rank.__getitem__)
        shared = Counter(self._rank[p] for p in order)
        tied = [p for p in order if shared[self._rank[p]] > 1]
        self._tied = re.compile("|".join(map(re.escape, tied)) or r"(?!)")
        pairs = {}
        for place, piece in enumerate(order):
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self._span + b] = place
        keys = sorted(pairs)
        self._pairs = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self._places = np.array([*(pairs[k] for k in keys), len(order)], np.int32)
        self._merged = np.array([self._ids[p] for p in order], np.int64)

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place by score of the piece that a and b make, behind all if none."""
        keys = a * self._span + b
        at = np.searchsorted(self._pairs, keys)
        return np.where(self._pairs[at] == keys, self._places[at], np.int32(len(self._merged)))

    def _merge_all(self, units: list[str]) -> list[list[int]]:
        """Ids of short units: a row of symbols and an agenda for each, and in
        every step each row merges its best pair, the leftmost of equal ones."""
        sizes = np.array([len(u) for u in units])
        width, never = int(sizes.max()), len(self._merged)
        symbols = np.full((len(units), width + 1), self._span - 1, np.int64)
        symbols[np.arange(width + 1) < sizes[:, None]] = self._points[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        agenda = self._place(symbols[:, :-1], symbols[:, 1:])
        done, left, columns = symbols.copy(), np.arange(len(units)), np.arange(width + 1)
        while len(left):
            best = agenda.argmin(axis=1)
            place = agenda[np.arange(len(left)), best]
            more = place < never
            if not more.all():
                done[left[~more]] = symbols[~more]
                left, symbols, agenda, best, place = left[more], symbols[more], agenda[more], best[more], place[more]
            rows = np.arange(len(left))
            symbols[rows, best] = self._merged[place]
            after = np.minimum(columns + (columns > best[:, None]), width)
            symbols = np.take_along_axis(symbols, after, 1)
            agenda = np.take_along_axis(agenda, np.minimum(after[:, :-1], width - 1), 1)
            agenda[:, -1] = never
            agenda[rows, best] = self._place(symbols[rows, best], symbols[rows, np.minimum(best + 1, width)])
            inner = np.flatnonzero(best)
            before = best[inner] - 1
            agenda[inner, before] = self._place(symbols[inner, before], symbols[inner, best[inner]])
        ends = (done < self._span - 1).sum(axis=1)
        plain = np.where(done < self._span - 1, done, 0).max(axis=1) < self._span - 1 - POINTS
        return [
            row[:n] if whole else self._spelled([chr(x - self._span + 1 + POINTS) if x >= self._span - 1 - POINTS else x for x in row[:n]])
            for row, n, whole in zip(done.tolist(), ends.tolist(), plain.tolist(), strict=True)
        ]

    def _spelled(self, symbols: list[int | str]) -> list[int]:
        """Ids, and those of the bytes of characters that are no pieces."""
        return [i for x in symbols for i in ([self._byte_ids[b] for b in x.encode()] if isinstance(x, str) else [x])]

    def encode_unit(self, unit: str) -> list[int]:
        """Merge symbols in the order of the agenda until no pair is a piece."""
        symbols = self._merge_short(unit) if len(unit) <= SHORT else self._merge_long(unit)
        return self._spelled([self._ids.get(symbol, symbol) for symbol in symbols])

    def _merge_short(self, unit: str) -> list[str]:
        """The agenda as a list beside the symbols: the least rank is the best
        score, and its first place the leftmost pair."""
        rank, symbols = self._rank.get, list(unit)
        agenda = [rank(a + b, NEVER) for a, b in zip(unit, unit[1:])]  # noqa: B905
        agenda.append(NEVER)  # after the last symbol
        while (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            merged = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i + 1 < len(symbols):
                agenda[i] = rank(merged + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + merged, NEVER)
        return symbols

    def _merge_long(self, unit: str) -> list[str]:
        """The agenda as a heap of (rank, place): near linear in the unit."""
        rank, text = self._rank, list(unit)
        n = len(text)
        right = list(range(1, n + 1))  # the next symbol; n is the end
        left = list(range(-1, n - 1))
        agenda = [(rank[pair], i, i + 1, 2) for i in range(n - 1) if (pair := text[i] + text[i + 1]) in rank]
        heapify(agenda)
        while agenda:
            _, a, b, size = heappop(agenda)
            if not text[a] or not text[b] or right[a] != b or len(text[a]) + len(text[b]) != size:
                continue  # one of the two has been merged since
            merged = text[a] = text[a] + text[b]
            text[b] = ""
            after = right[a] = right[b]
            if after < n:
                left[after] = a
                if (pair := merged + text[after]) in rank:
                    heappush(agenda, (rank[pair], a, after, len(pair)))
            before = left[a]
            if before >= 0 and (pair := text[before] + merged) in rank:
                heappush(agenda, (rank[pair], before, a, len(pair)))
        return [symbol for symbol in text if symbol]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of units not met lately, as little-endian 32-bit integers, all
        checked against the library."""
        size = lambda u: SHORT + 1 if len(u) > SHORT or self._tied.search(u) else len(u)
        new = sorted(new, key=size)
        short = bisect_right(new, SHORT, key=size)
        ids = [x for k in range(0, short, ROWS) for x in self._merge_all(new[k : min(k + ROWS, short)])]
        ids += [self.encode_unit(u) for u in new[short:]]
        # The library puts a mark before a text, and cannot be given an empty one.
        checked = [k for k, u in enumerate(new) if u[0] == MARK and len(u) > 1]
        # Units that end without a mark stand side by side in one text, since no merge crosses them.
        whole = [k for k in checked if new[k][-1] != MARK]
        for group in (whole, *([k] for k in checked if new[k][-1] == MARK)):
            if not self._agrees([new[k] for k in group], [ids[k] for k in group]):
                wrong = next((new[k] for k in group if not self._agrees([new[k]], [ids[k]])), "units side by side")
                raise RuntimeError(f"the library encodes or decodes {wrong!r} in another way")
        return {u: array("i", x).tobytes() for u, x in zip(new, ids, strict=True)}

    def _agrees(self, units: list[str], ids: list[list[int]]) -> bool:
        """Whether the library encodes the units to these ids, and decodes these
        ids to what their pieces spell."""
        flat = list(chain.from_iterable(ids))
        if not flat:
            return not units
        if self.library.encode("".join(units)[1:]) != flat:
            return False
        return b"".join(map(self._surface.__getitem__, flat)) == b" " + self.library.decode(flat).encode()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, without begin or end ids; a null counts as empty."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text, new units of about GROUP_CHARS characters at a time."""
        out, group, held = [], [], 0
        for text in texts:
            group.append(UNIT.findall((MARK + text).replace(" ", MARK)) if text else [])
            held += len(text or "")
            if held >= GROUP_CHARS:
                out += self._group(group)
                group, held = [], 0
        return out + self._group(group)

    def _group(self, texts: list[list[str]]) -> list[bytes]:
        known = self._known
        if len(known) > CACHED_UNITS:
            known.clear()
        new = {u for units in texts for u in units if u not in known}
        if new:
            known.update(self.learn(list(new)))
        out = [b"".join(map(known.__getitem__, units)) for units in texts]
        for u in new:
            if len(u) > CACHED_CHARS:
                del known[u]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one space that stands for the mark put before a
        text goes; bytes that are no valid character become U+FFFD each."""
        raw = b"".join(map(self._surface.__getitem__, ids))
        first = next((i for i in ids if self._surface[i]), None)
        if raw[:1] == b" " and first not in self._bytes and not self.library.is_unknown(first):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _repaired(raw)


def _repaired(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}  # one for each Python worker and model


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of every whole text and the text that decoding them gives.

    A null or empty text has no ids and decodes to an empty text. Other columns
    stay; rows are read one by one, so repeated rows and empty tables need
    nothing special. There is no shuffle, and a lost task is run again.
    """

    @F.arrow_udf(f"struct<{ids}:array<int>,{decoded}:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model)
        for batch in batches:
            found = own.encode_all(text.as_py() for text in batch)
            spoken = [own.decode(np.frombuffer(x, "<i4").tolist()) for x in found]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.StructArray.from_arrays([lists, pa.array(spoken, pa.string())], names=[ids, decoded])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (ids, decoded)]
    return docs.select(*kept, run(F.col(f"`{text}`")).alias("_pieces")).select(*kept, "_pieces.*")


def op9(docs: DataFrame, model: str) -> DataFrame:
    found = encode(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
