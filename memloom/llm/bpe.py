"""Byte-level BPE encoding and decoding with numpy matrices.

A text is split by the tokenizer's pattern; each match is a piece of its own. Pieces that are whole tokens take their
id at once. The others are bytes in padded matrices, one for each length bucket, a piece a row. In each round every row
merges its leftmost pair of minimum rank; pair ranks come from a hash table over (left id, right id), and after each
round finished rows and emptied columns leave the matrix (compaction). Further places of the same pair in a row merge
in the same round where that is sure to give the same ids: where no pair that the merged token forms could rank below
it (`BytePairs.settled`). A piece longer than LONG is one row whose places are kept by rank, so that a round costs no
more than what it merges.

Each task holds the vocabulary, a bounded memory of words and one block of texts (about BLOCK bytes, or one text).
Nothing is shuffled. Ids are carried as little-endian unsigned 32-bit integers in one binary value a row.

Edge cases: null text is the empty text, which has no ids; whole texts are read, also very long words; special tokens'
strings are ordinary text; rows that repeat a doc_id, or have none, each give a row; extra columns are ignored; an empty
table gives no rows; ids that the vocabulary lacks, or bytes that are not whole ids, are an error when decoded; null ids
decode to null.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 2048
#: Elements of a matrix, bytes of the texts handled together, bytes of words that a task remembers, words looked at together.
CELLS, BLOCK, REMEMBERED, SOME = 1 << 18, 1 << 22, 1 << 27, 1 << 20
NONE = np.int32(2**31 - 1)
#: A text is cut where white space (as Unicode defines it) follows something else; no match of the pattern reaches across.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_words = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
_ODD = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PairTable:
    """Ranks by (left id, right id): open addressing in numpy arrays, looked up for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(left) + 1))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        key, slot = self._at(left, right)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.ranks[slot[placed]] = rank[placed]
            key, slot, rank = key[~placed], (slot[~placed] + 1) & self.mask, rank[~placed]

    def _at(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        return key, ((key.view(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key, slot = self._at(left, right)
        found = self.keys[slot]
        ranks = np.where(found == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            ranks[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return ranks


def _every_other(hit: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring hits along the last axis, the first, third and so on: those that a merge from the left takes."""
    again = hit[..., 1:] & hit[..., :-1]
    if not again.any():
        return hit
    place = np.arange(hit.shape[-1])
    starts = hit.copy()
    starts[..., 1:] &= ~hit[..., :-1]
    return hit & ((place - np.maximum.accumulate(np.where(starts, place, 0), axis=-1)) % 2 == 0)


class BytePairs:
    """One vocabulary: its ranks, the pairs that merge into each token, and the pattern that splits texts."""

    _shared: dict[str, BytePairs] = {}

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN

        self.split = regex.compile(PATTERN).findall
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(left, right, r) for token, r in self.rank.items() for k in range(1, len(token)) if (left := self.rank.get(token[:k])) is not None and (right := self.rank.get(token[k:])) is not None]
        left, right, rank = np.array(pairs, np.int32).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)
        #: Tokens that no pair of lower rank contains: after a merge into one, every new pair ranks above it.
        self.settled = np.ones(size, bool)
        self.settled[left[rank < left]] = False
        self.settled[right[rank < right]] = False
        self.token = [b""] * size
        for token, r in self.rank.items():
            self.token[r] = token
        self.sizes = np.array([len(t) for t in self.token], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.known: dict[str, bytes] = {}
        self.remembered = 0

    @classmethod
    def of(cls, path: str) -> BytePairs:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def merge_rows(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids of the rows of a padded matrix, one row after the other, and how many each has; sizes: used columns of each row."""
        done, used = np.zeros_like(ids), sizes.copy()
        row = np.arange(len(ids))
        ranks = np.full(ids.shape, NONE, np.int32)
        at, col = np.nonzero(np.arange(1, ids.shape[1] + 1) < sizes[:, None])
        ranks[at, col] = self.pairs.find(ids[at, col], ids[at, col + 1])
        while len(row):
            least = ranks.min(1)
            ended = least == NONE
            if ended.any():
                done[row[ended], : ids.shape[1]], used[row[ended]] = ids[ended], sizes[ended]
                row, ids, ranks, sizes, least = row[~ended], ids[~ended], ranks[~ended], sizes[~ended], least[~ended]
                if not len(row):
                    break
            hit = ranks == least[:, None]
            single = np.flatnonzero(~self.settled[least])
            if len(single):
                first = hit[single].argmax(1)
                hit[single] = False
                hit[single, first] = True
            hit = _every_other(hit)
            ids = np.where(hit, least[:, None], ids)
            keep = np.arange(ids.shape[1]) < sizes[:, None]
            keep[:, 1:] &= ~hit[:, :-1]
            sizes = sizes - hit.sum(1)
            place = np.arange(sizes.max()) < sizes[:, None]
            packed = [np.zeros(place.shape, np.int32), np.full(place.shape, NONE, np.int32), np.zeros(place.shape, bool)]
            for new, old in zip(packed, (ids, ranks, hit)):
                new[place] = old[keep]
            ids, ranks, merged = packed
            merged[:, :-1] |= merged[:, 1:]
            at, col = np.nonzero(merged)
            last = col + 1 == sizes[at]
            ranks[at[last], col[last]] = NONE
            at, col = at[~last], col[~last]
            ranks[at, col] = self.pairs.find(ids[at, col], ids[at, col + 1])
        return done[np.arange(done.shape[1]) < used[:, None]], used

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Final ids of one long row. Places are kept by rank, so a round costs what it merges; empty places are skipped by links."""
        n = len(ids)
        ids, live = np.append(ids, 0), np.ones(n, bool)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # n: beyond the end
        ranks = np.full(n + 1, NONE, np.int32)
        places: dict[int, list[int]] = {}
        queue: list[int] = []

        def rank_pairs(left: np.ndarray) -> None:
            ranks[left] = found = self.pairs.find(ids[left], ids[after[left]])
            for r, i in zip(found.tolist(), left.tolist()):
                if r != NONE:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(queue, r)
                    places[r].append(i)

        rank_pairs(np.arange(n - 1))
        while queue:
            least = heapq.heappop(queue)
            hit = np.unique(np.array(places.pop(least)))
            hit = hit[ranks[hit] == least]
            if not len(hit):
                continue
            all_ = hit
            if (touching := after[hit[:-1]] == hit[1:]).any():
                place = np.arange(len(hit))
                starts = np.append(True, ~touching)
                hit = hit[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
            gone = after[hit]
            if not self.settled[least]:  # merge from the left until a new pair ranks lower
                merged, left, right = np.full(len(hit), least), before[hit], after[gone]
                left_id = np.where(np.append(False, left[1:] == gone[:-1]), least, ids[left])
                lower = ((left >= 0) & (self.pairs.find(left_id, merged) < least)) | ((right < n) & (self.pairs.find(merged, ids[right]) < least))
                if lower.any():
                    hit, gone = hit[: lower.argmax() + 1], gone[: lower.argmax() + 1]
            ids[hit] = least
            after[hit] = after[gone]
            live[gone], ranks[gone] = False, NONE
            before[after[hit]] = hit
            spots = np.unique(np.append(hit, before[hit]))
            spots = spots[spots >= 0]
            ranks[spots] = NONE
            rank_pairs(spots[after[spots] < n])
            rest = all_[(ranks[all_] == least) & (all_ > hit[-1])]
            if len(rest):
                if least not in places:
                    places[least] = []
                    heapq.heappush(queue, least)
                places[least] += rest.tolist()
        return ids[:n][live]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Little-endian ids of each piece."""
        raw = [p.encode() for p in pieces]
        found: list[bytes] = [b""] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            r = self.rank.get(p)
            if r is not None:
                found[i] = r.to_bytes(4, "little")
            elif len(p) > LONG:
                found[i] = self.merge_long(self.single[np.frombuffer(p, np.uint8)]).astype("<u4").tobytes()
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for bits, all_ in sorted(buckets.items()):
            width = 1 << bits
            for lo in range(0, len(all_), max(1, CELLS // width)):
                some = all_[lo : lo + max(1, CELLS // width)]
                sizes = np.array([len(raw[i]) for i in some])
                ids = np.zeros((len(some), width), np.int32)
                ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join([raw[i] for i in some]), np.uint8)]
                flat, sizes = self.merge_rows(ids, sizes)
                packed, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
                for i, start, end in zip(some, [0, *ends], ends):
                    found[i] = packed[start:end]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i, text in enumerate(texts):
            words = _words(text)
            for lo in range(0, len(words), SOME):
                held.append((i, words[lo : lo + SOME]))
                n += len(held[-1][1])
                if n >= SOME:
                    self._look_up(held, out)
                    held, n = [], 0
        self._look_up(held, out)
        return [b"".join(x) for x in out]

    def _look_up(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if self.remembered > REMEMBERED:
            self.known, self.remembered = {}, 0
        found = [list(map(self.known.get, words)) for _, words in held]
        new = list({w for (_, words), ids in zip(held, found) if None in ids for w, x in zip(words, ids) if x is None})
        if new:
            split = [self.split(w) for w in new]
            pieces = list(set().union(*split))
            ids_of = dict(zip(pieces, self.encode_pieces(pieces)))
            self.known.update(zip(new, [b"".join(map(ids_of.__getitem__, x)) for x in split]))
            self.remembered += sum(map(len, new)) + 150 * len(new)
        for (i, words), ids in zip(held, found):
            out[i].append(b"".join(map(self.known.__getitem__, words) if None in ids else ids))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        parts = []
        for lo in range(0, len(ids), SOME):
            some = ids[lo : lo + SOME].astype(np.int64)
            n = self.sizes[some]
            shift = self.starts[some] - (np.cumsum(n) - n)
            parts.append(self.bytes[np.repeat(shift, n) + np.arange(n.sum())].tobytes())
        return b"".join(parts)


def _blocks(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK bytes, or of one row."""
    lo = held = 0
    for i, v in enumerate(values):
        n = v.as_buffer().size if v.is_valid else 0
        if held and held + n > BLOCK:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(values):
        yield lo, len(values)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row of docs(doc_id, text)."""
    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs.of(path or vocabulary_path())
        for b in batches:
            for lo, hi in _blocks(b.column("text")):
                part = b.slice(lo, hi - lo)
                ids = pairs.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(doc_id, n_tokens, ids) with the bytes that the ids stand for, in a column decoded."""
    encoded = only(encoded, "doc_id", "n_tokens", "ids")
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs.of(path or vocabulary_path())
        for b in batches:
            for lo, hi in _blocks(b.column("ids")):
                part = b.slice(lo, hi - lo)
                texts = [None if not v.is_valid else pairs.decode(np.frombuffer(v.as_buffer() or b"", "<u4")) for v in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
