"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary is a certain
cut: no token can reach across it, so what stands on either side is encoded by itself and
the ids are put one after the other. Nearly every word end is such a cut (a space never
follows a letter inside a token), so a text falls into short fragments that repeat, and a
task encodes each distinct fragment once. Inside a fragment the pattern of the vocabulary
and further forced cuts make smaller pieces, and only those run through the merges.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pitwall.llm.common import columns_of, giving_back, text_rows

#: Bytes of distinct fragments, and of words of them, that a task remembers if they are short, until it ends;
#: characters it takes at a time.
REMEMBERED = 64 << 20
SHORT = 40
BATCH_CHARS = 1 << 20
#: Words of more bytes are cut further and merged through a heap.
LONG = 48

_FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: The split of byte-level vocabularies of this kind; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where it can be printed, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Remembered(dict):
    """Packed ids of short texts, emptied before they take more than REMEMBERED bytes."""

    used = 0

    def keep(self, new: dict[str, bytes]) -> None:
        for key, value in new.items():
            if len(key) > SHORT:
                continue
            size = sys.getsizeof(key) + sys.getsizeof(value) + 100  # its share of the table
            if self.used + size > REMEMBERED:
                self.clear()
            self[key] = value
            self.used += size

    def clear(self) -> None:
        super().clear()
        self.used = 0


class Vocabulary:
    """A byte-level BPE vocabulary file: tokens, merges, special tokens and forced cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        ids = content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        plain = {name: id_ for name, id_ in ids.items() if name not in self.special}
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for name, id_ in plain.items():
            self.bytes_of[id_] = bytes(letters[c] for c in name)
        for name, id_ in self.special.items():
            self.bytes_of[id_] = name.encode()
        self.byte_ids = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.rank_of, new_ids = {}, []
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank_of[ids[left] << 20 | ids[right]] = rank
            new_ids.append(ids[left + right])
        self.new_ids = np.array(new_ids, np.int64)
        self.table = self._hashed()
        #: inside[a, b]: bytes a and b stand together in some token.
        self.inside = np.zeros((256, 256), bool)
        for id_ in plain.values():
            token = np.frombuffer(self.bytes_of[id_], np.uint8)
            self.inside[token[:-1], token[1:]] = True
        self.pattern = regex.compile(PATTERN)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # A text is cut before every space but those that follow one of these bytes, which some token joins to a space.
        self.uncut = [bytes([b]) + b" " for b in np.flatnonzero(self.inside[:, 32])]
        after = "".join(re.escape(chr(x[0])) for x in self.uncut if x[0] < 128)
        after += "\u0080-\U0010ffff" if any(x[0] >= 128 for x in self.uncut) else ""
        self.cut = re.compile(f"(?<![{after}])(?= )" if after else "(?= )")
        self.known = _Remembered()
        self.words = _Remembered()

    def _hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The merges in a hash table, and the places that more than one wants."""
        codes = np.fromiter(self.rank_of, np.int64, len(self.rank_of))
        at = (codes.view(np.uint64) * _FACTOR) >> np.uint64(44)
        names, ranks = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, np.int32)
        names[at], ranks[at] = codes, np.fromiter(self.rank_of.values(), np.int32, len(codes))
        crowded = np.zeros(1 << 20, bool)
        crowded[at[names[at] != codes]] = True
        return names, ranks, crowded

    def fragments(self, text: str) -> list[str]:
        """The text in parts that are encoded apart, cut before spaces where the cut is forced."""
        data = text.encode("utf-8", "replace") if self.uncut else b""
        if not any(pair in data for pair in self.uncut):
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        return [x for x in self.cut.split(text) if x]

    def _pieces(self, data: bytes) -> list[bytes]:
        if len(data) < 2:
            return [data] if data else []
        codes = np.frombuffer(data, np.uint8)
        cuts = (np.flatnonzero(~self.inside[codes[:-1], codes[1:]]) + 1).tolist()
        return [data[a:b] for a, b in pairwise([0, *cuts, len(data)])]

    def _ranks(self, codes: np.ndarray) -> np.ndarray:
        """Rank of each pair code, len(new_ids) where there is no such merge."""
        names, ranks, crowded = self.table
        at = (codes.view(np.uint64) * _FACTOR) >> np.uint64(44)
        out = np.where(names[at] == codes, ranks[at], np.int32(len(self.new_ids)))
        second = np.flatnonzero(crowded[at])
        if len(second):
            get, none = self.rank_of.get, len(self.new_ids)
            out[second] = [get(c, none) for c in codes[second].tolist()]
        return out

    def _merge_equal(self, data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words of one length, laid end to end, all at once.

        Each step merges in every word its pair of lowest rank, the leftmost of equal ones.
        """
        ids = self.byte_ids[np.frombuffer(data, np.uint8)].reshape(-1, length)
        done, counts, none = np.zeros(ids.shape, np.int32), np.full(len(ids), length), len(self.new_ids)
        rows = np.arange(len(ids))
        ranks = self._ranks(((ids[:, :-1] << 20) | ids[:, 1:]).ravel()).reshape(len(ids), -1)
        while len(rows) and ids.shape[1] > 1:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), best]
            stop = rank == none
            if stop.any():
                done[rows[stop], : ids.shape[1]] = ids[stop]
                go = ~stop
                ids, ranks, rows, best, rank = ids[go], ranks[go], rows[go], best[go], rank[go]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            ids[at, best] = new = self.new_ids[rank]
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= best[:, None]), axis=1)
            counts[rows] -= 1
            after, before = best < ids.shape[1] - 1, best > 0
            ranks[at[after], best[after]] = self._ranks((new[after] << 20) | ids[at[after], best[after] + 1])
            ranks[at[before], best[before] - 1] = self._ranks((ids[at[before], best[before] - 1] << 20) | new[before])
        done[rows, : ids.shape[1]] = ids
        return done, counts

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps, for long pieces."""
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(self.rank_of[p], i, p) for i, (a, b) in enumerate(pairwise(ids)) if (p := a << 20 | b) in self.rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or ids[i] << 20 | ids[j] != pair:
                continue
            ids[i], ids[j] = self.new_ids[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := ids[a] << 20 | ids[b]) in self.rank_of:
                    heapq.heappush(heap, (self.rank_of[p], a, p))
        return [x for x in ids if x >= 0]

    def _learn_words(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of words, long ones cut at every forced cut and merged alone."""
        out: dict[str, bytes] = {}
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            data = word.encode("utf-8", "replace")
            if len(data) > LONG:
                ids = [x for p in self._pieces(data) for x in self._merge_long(self.byte_ids[np.frombuffer(p, np.uint8)].tolist())]
                out[word] = np.array(ids, np.int32).tobytes()
            else:
                names, contents = by_length.setdefault(len(data), ([], []))
                names.append(word)
                contents.append(data)
        for length, (names, contents) in by_length.items():
            ids, counts = self._merge_equal(b"".join(contents), length)
            flat, step = ids.tobytes(), 4 * length
            for i, (name, n) in enumerate(zip(names, counts.tolist(), strict=True)):
                out[name] = flat[i * step : i * step + 4 * n]
        return out

    def _learn(self, fragments: set[str]) -> dict[str, bytes]:
        """Packed ids of fragments not met before; short ones and their words are remembered."""
        parts = {f: self.pattern.findall(f) for f in fragments}
        fresh = self._learn_words({w for ws in parts.values() for w in ws if w not in self.words})
        known = self.words
        out = {f: b"".join([known[w] if w in known else fresh[w] for w in ws]) for f, ws in parts.items()}
        self.known.keep(out)
        self.words.keep({w: ids for w, ids in fresh.items() if w not in out})
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers. Special tokens in a text become their id."""
        plain: list[list] = []
        for text in texts:
            if self.split_special and any(s in text for s in self.special):
                parts = self.split_special.split(text)
                plain.append([x for p in parts if p for x in ([self.special[p]] if p in self.special else self.fragments(p))])
            else:
                plain.append(self.fragments(text))
        found = [list(map(self.known.get, fs)) for fs in plain]
        new = {f for fs, ps in zip(plain, found, strict=True) for f, p in zip(fs, ps, strict=True) if p is None}
        fresh = {id_: np.int32(id_).tobytes() for id_ in self.special.values() if id_ in new}
        fresh |= self._learn(new - fresh.keys())
        return [
            b"".join([p if p is not None else fresh[f] for f, p in zip(fs, ps, strict=True)] if None in ps else ps)
            for fs, ps in zip(plain, found, strict=True)
        ]

    def forget(self) -> None:
        """Give back what is remembered."""
        self.known.clear()
        self.words.clear()

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Loaded once for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, ids array<int>, decoded string.

    `path` is the vocabulary file, readable on every executor. A null text is an empty
    one; it has no ids and decodes to the empty text. Repeated rows are repeated, an
    empty table gives no rows, other columns are ignored. No text is cut short.
    """

    @giving_back()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            packed = own.encode_batch([text or "" for _, text in held])
            offsets = np.cumsum([0, *[len(x) // 4 for x in packed]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            texts = [own.decode(np.frombuffer(x, np.int32)) for x in packed]
            return pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in held], pa.int64()), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
            )

        for row in text_rows(batches, "doc_id", "text"):
            held.append(row)
            size += len(row[1] or "")
            if size >= BATCH_CHARS or len(held) >= 4096:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        own.forget()

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
