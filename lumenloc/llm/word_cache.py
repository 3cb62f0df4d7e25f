"""Encoding by the tokenizers library with a cache of chunks.

Both vocabularies never form a token across a space that stands between two characters that aren't white space, so a
text's ids are its space-separated chunks' ids in a row. Chunks repeat: Arrow's dictionary encoding finds a batch's
distinct ones, and only those that the worker has not met go to the library. Known chunks are found by a hash in sorted
arrays, and a chunk counts as known only if its stored bytes are the same, so a hash can't give another chunk's ids. No
Python object is kept or made for known chunks.

The cache is bounded in bytes (KEPT_BYTES); chunks of more than LONGEST bytes are never kept.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import eights, hash_eights

#: Bytes that a worker's cache takes at most; once there, chunks seen once go, and more until three quarters are left.
KEPT_BYTES = 96 << 20
#: Bytes of the longest chunk that is kept.
LONGEST = 64
#: Bytes of an entry besides its text and ids: hash, places and counts.
ENTRY = 36
#: Chunks that may share a call: they start with a letter, end with no white space and hold no 0.
PLAIN = re.compile(r"[ \n]?[^\W\d_](?:[^0]*[^0\s])?")
#: A chunk whose last sign is a piece of its own, as a letter stands before it.
SIGNS = ".,;:!?"
TAIL = re.compile(r".*[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?]", re.DOTALL)
#: Bytes of text at once: the more, the fewer distinct chunks a byte.
TOGETHER_BYTES = 4 << 20
#: Chunks in one call.
TOGETHER = 500
SEED = 11


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans' elements in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Packed:
    """Strings as 64-bit numbers: sizes in bytes, the numbers in a row with each string's bounds, and hashes."""

    def __init__(self, strings: pa.Array) -> None:
        n = len(strings)
        _, offsets, data = strings.buffers()
        kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
        at = np.frombuffer(offsets, kind)[strings.offset : strings.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
        self.sizes = np.diff(at)
        self.words, place, self.bounds = eights(buf, at[:-1] - at[0], self.sizes)
        self.hashes = hash_eights(self.words, place, self.bounds, self.sizes, SEED)
        self.counts = np.diff(self.bounds)


class ChunkEncoder:
    """Ids of chunks, each as if it were a text of its own; between: what parts chunks in one call, a token of its own."""

    def __init__(self, tokenizer, between: str) -> None:  # noqa: ANN001
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizer
        self.between = between
        (self.sign,) = tokenizer.encode(between, add_special_tokens=False).ids
        self.hashes, self.hits = np.empty(0, np.uint64), np.empty(0, np.int32)  # by hash, ascending
        self.sizes, self.texts = np.empty(0, np.int32), np.empty(0, np.int64)  # bytes of text, and where it stands
        self.lengths, self.starts = np.empty(0, np.int32), np.empty(0, np.int64)  # how many ids, and where they stand
        self.words, self.n_words = np.empty(1 << 12, np.uint64), 0
        self.ids, self.n_ids = np.empty(1 << 12, np.uint32), 0

    @property
    def kept_bytes(self) -> int:
        return 8 * self.n_words + 4 * self.n_ids + ENTRY * len(self.hashes)

    def places(self, x: Packed) -> np.ndarray:
        """Where the strings stand, or -1."""
        if not len(self.hashes):
            return np.full(len(x.sizes), -1, np.int64)
        order = np.argsort(x.hashes)  # ascending keys keep the search in the cache
        found = np.empty(len(order), np.int64)
        found[order] = np.searchsorted(self.hashes, x.hashes[order])
        found[found == len(self.hashes)] = 0
        alike = (self.hashes[found] == x.hashes) & (self.sizes[found] == x.sizes)
        counts = np.where(alike, x.counts, 0)
        same = self.words[spans(self.texts[found], counts)] == x.words[spans(x.bounds[:-1], counts)]
        wrong = np.concatenate([[0], np.cumsum(~same)])
        ends = np.cumsum(counts)
        found[~alike | (wrong[ends] != wrong[ends - counts])] = -1
        return found

    def gathered(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids at these places, in a row."""
        return self.ids[spans(starts, sizes.astype(np.int64))]

    @staticmethod
    def put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        """array, grown if need be, with the values from at on."""
        if len(array) < at + len(values):
            array = np.concatenate([array[:at], np.empty(max(at + len(values), len(array) * 3 // 2) - at, array.dtype)])
        array[at : at + len(values)] = values
        return array

    def resolved(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each of the distinct strings or -1, where its ids stand and how many there are.

        Ids of strings that aren't kept stand behind the kept ones until the next call.
        """
        x = Packed(strings)
        at = self.places(x)
        new = np.flatnonzero(at < 0)
        starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if len(new):
            flat, sizes = self.encoded(strings.take(pa.array(new)).to_pylist())
            first = np.cumsum(sizes) - sizes
            keys = x.hashes[new]
            # one of each hash, of short strings only, and none whose hash is there: what stands there is another string
            keep = np.zeros(len(new), bool)
            keep[np.unique(keys, return_index=True)[1]] = True
            keep &= x.sizes[new] <= LONGEST
            if len(self.hashes):
                keep &= self.hashes[np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)] != keys
            self.keep(x, new[keep], flat[spans(first[keep], sizes[keep])], sizes[keep])
            at = self.places(x)
            rest = flat[spans(first[~keep], sizes[~keep])]
            self.ids = self.put(self.ids, self.n_ids, rest)
            lengths[new[~keep]] = sizes[~keep]
            starts[new[~keep]] = self.n_ids + np.cumsum(sizes[~keep]) - sizes[~keep]
        known = at >= 0
        starts[known], lengths[known] = self.starts[at[known]], self.lengths[at[known]]
        return at, starts, lengths

    def keep(self, x: Packed, which: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Adds these of x's strings with their ids."""
        counts = x.counts[which]
        words = x.words[spans(x.bounds[which], counts)]
        self.words, self.ids = self.put(self.words, self.n_words, words), self.put(self.ids, self.n_ids, flat)
        order = np.argsort(x.hashes[which])
        at = np.searchsorted(self.hashes, x.hashes[which][order])
        self.hashes = np.insert(self.hashes, at, x.hashes[which][order])
        self.sizes = np.insert(self.sizes, at, x.sizes[which][order])
        self.texts = np.insert(self.texts, at, (self.n_words + np.cumsum(counts) - counts)[order])
        self.lengths = np.insert(self.lengths, at, sizes[order])
        self.starts = np.insert(self.starts, at, (self.n_ids + np.cumsum(sizes) - sizes)[order])
        self.hits = np.insert(self.hits, at, 0)
        self.n_words, self.n_ids = self.n_words + len(words), self.n_ids + len(flat)

    def shrink(self) -> None:
        """Keeps the chunks met most often, three quarters of the bytes at most."""
        counts = (self.sizes.astype(np.int64) + 7) >> 3
        order = np.argsort(-self.hits, kind="stable")
        size = np.cumsum((8 * counts + 4 * self.lengths + ENTRY)[order])
        kept = np.sort(order[(size <= KEPT_BYTES * 3 // 4) & (self.hits[order] > 1)])
        ids, words = self.gathered(self.starts[kept], self.lengths[kept]), self.words[spans(self.texts[kept], counts[kept])]
        self.ids, self.words, self.n_ids, self.n_words = ids, words, len(ids), len(words)
        self.hashes, self.sizes, self.lengths = self.hashes[kept], self.sizes[kept], self.lengths[kept]
        self.hits = np.zeros(len(kept), np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.texts = np.cumsum(counts[kept]) - counts[kept]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks in a row, and how many each has."""
        tail = np.fromiter((x[-1:] in SIGNS and TAIL.fullmatch(x) is not None for x in chunks), bool, len(chunks))
        plain = np.fromiter((not t and PLAIN.fullmatch(x) is not None for x, t in zip(chunks, tail.tolist(), strict=True)), bool, len(chunks))
        parts = [[x for x, k in zip(chunks, m.tolist(), strict=True) if k] for m in (plain, ~plain & ~tail, tail)]
        # a call for each chunk would cost more than its merges do: plain ones go together, with a token between
        lists = self.encode([self.between.join([*parts[0][i : i + TOGETHER], ""]) for i in range(0, len(parts[0]), TOGETHER)])
        flat = np.concatenate([np.empty(0, np.uint32), *[np.array(x, np.uint32) for x in lists]])
        sizes = [np.diff(np.flatnonzero(flat == self.sign), prepend=-1) - 1]
        flats = [flat[flat != self.sign]]
        lists = self.encode(parts[1])
        flats.append(np.concatenate([np.empty(0, np.uint32), *[np.array(x, np.uint32) for x in lists]]))
        sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        if parts[2]:
            pieces = pc.dictionary_encode(pa.array([y for x in parts[2] for y in (x[:-1], x[-1])], pa.string()))
            _, starts, lengths = self.resolved(pieces.dictionary)
            at = np.asarray(pieces.indices)
            flats.append(self.gathered(starts[at], lengths[at]))
            sizes.append(lengths[at].reshape(-1, 2).sum(axis=1))
        flat, size = np.concatenate(flats), np.concatenate(sizes)
        # from the order of the kinds to that of the chunks
        order = np.empty(len(chunks), np.int64)
        order[np.concatenate([np.flatnonzero(m) for m in (plain, ~plain & ~tail, tail)])] = np.arange(len(chunks))
        first = np.cumsum(size) - size
        return flat[spans(first[order], size[order])], size[order]

    def __call__(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """lists: each text's chunks. All ids in a row, and how many each text has."""
        coded = pc.dictionary_encode(lists.flatten())
        if self.kept_bytes > KEPT_BYTES:
            self.shrink()
        places, starts, lengths = self.resolved(coded.dictionary)
        at = np.asarray(coded.indices)
        often = np.bincount(at, minlength=len(places))
        np.add.at(self.hits, places[places >= 0], often[places >= 0].astype(np.int32))
        ids = self.gathered(starts[at], lengths[at])
        per = np.diff(np.asarray(lists.offsets)) if len(lists) else np.empty(0, np.int64)
        last = np.cumsum(per)
        bounds = np.concatenate([[0], np.cumsum(lengths[at], dtype=np.int64)])
        return ids, bounds[last] - bounds[last - per]
