"""Whole texts to token ids with the `tokenizers` library, one chunk at a time.

The byte-level pre-tokenizer never joins characters across a single space or line break that has a non-space on both
sides, so a text may be cut before each of these without changing any id. Chunks repeat a lot; the library encodes
each distinct one once, and the ids of a text are gathered, by numpy, from its chunks' ids. `brute_ids` is the
plain call that the tests hold this against.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .shared import release_memory

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Longer chunks are encoded each time; shorter ones are known by two 64-bit multilinear hashes.
LONGEST = 256
#: Texts are cut and looked up in slices of about so many bytes.
SLICE = 1 << 20
_encoders: dict = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _starts(raw: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, and at each space or line break between two characters that are no spaces."""
    at = np.flatnonzero((raw == 32) | (raw == 10))
    at = at[(at > 2) & (at < len(raw) - 1)]
    a, b, c, d = raw[at - 1], raw[at - 2], raw[at - 3], raw[at + 1]
    # ASCII white space and controls; U+0085 and U+00A0 (C2 85, C2 A0); U+1680 and U+2000 to U+3000 (E1 to E3 with two more).
    # What only may be a space is taken for one: not to cut is always right.
    odd = (a <= 32) | (b == 0xC2) | ((c >= 0xE1) & (c <= 0xE3)) | (d <= 32) | (d == 0xC2) | ((d >= 0xE1) & (d <= 0xE3))
    marks = np.zeros(len(raw), bool)
    marks[at[~odd]] = marks[firsts] = True
    return np.flatnonzero(marks)


class ChunkEncoder:
    """ids of texts; remembers up to `keep` distinct chunks in flat arrays (some 60 bytes each)."""

    def __init__(self, path: str, keep: int = 1_600_000):
        from tokenizers import Tokenizer

        self.keep = keep
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # The byte-level alphabet writes one character for each byte, so a token's length in characters is its length in bytes.
        self.width = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(added[i].encode()) if i in added else len(token)
        parts = json.loads(self.tokenizer.to_str())
        pre = parts.get("pre_tokenizer") or {}
        self.splits = parts.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(" " in t or "\n" in t for t in added.values())
        rng = np.random.default_rng(20250)
        self.weights = rng.integers(0, 1 << 64, (2, LONGEST + 1), np.uint64) | np.uint64(1)
        self._clear()

    def _clear(self) -> None:
        self.n, self.bits = 0, 16
        self.a, self.b, self.begin, self.count = (np.zeros(1 << 15, t) for t in (np.uint64, np.uint64, np.int64, np.int32))
        self.pool, self.pooled = np.zeros(1 << 16, np.uint32), 0
        self.table = np.full(1 << self.bits, -1, np.int32)

    def forget(self) -> None:
        """Drops all chunks; a task that ends a job's use of the encoder calls it."""
        self._clear()
        release_memory()

    def _place(self, a: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry of each chunk, -1 if it is new: open addressing, all chunks at once."""
        out, left, at = np.full(len(a), -1, np.int64), np.arange(len(a)), self._place(a)
        while len(left):
            e = self.table[at]
            hit = (e >= 0) & (self.a[e] == a[left]) & (self.b[e] == b[left])
            out[left[hit]] = e[hit]
            go = (e >= 0) & ~hit
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _enter(self, entries: np.ndarray) -> None:
        left, at = entries, self._place(self.a[entries])
        while len(left):
            free = np.flatnonzero(self.table[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            self.table[slot] = left[free[first]]
            stay = np.ones(len(left), bool)
            stay[free[first]] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _add(self, a: np.ndarray, b: np.ndarray, ids: list[np.ndarray], known: bool) -> np.ndarray:
        """New entries with these ids; only known ones can be found again."""
        new = np.arange(self.n, self.n + len(ids))
        flat, sizes = np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        for name, need in (("a", new[-1] + 1), ("b", new[-1] + 1), ("begin", new[-1] + 1), ("count", new[-1] + 1), ("pool", self.pooled + len(flat))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        self.a[new], self.b[new], self.count[new] = a, b, sizes
        self.begin[new] = self.pooled + np.cumsum(sizes) - sizes
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        self.pooled, self.n = self.pooled + len(flat), self.n + len(ids)
        if known:
            if 2 * self.n > 1 << self.bits:
                self.bits = max(self.bits + 1, int(2 * self.n).bit_length())
                self.table = np.full(1 << self.bits, -1, np.int32)
                self._enter(np.arange(self.n))
            else:
                self._enter(new)
        return new

    def _encode(self, chunks: list[bytes], leading: np.ndarray) -> list[np.ndarray]:
        """Ids of chunks by the library. Those that start at a safe space or line break may stand side by side, many to a text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(chunks)
        alone = np.flatnonzero(~leading).tolist()
        for i, one in zip(alone, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in alone], add_special_tokens=False)):
            out[i] = np.array(one.ids, np.uint32)
        # A chunk that ends in white space ends its text, and so its run.
        last = [not c[-4:].decode(errors="ignore")[-1:].strip() for c in chunks]
        rest = [i for i in np.flatnonzero(leading).tolist() if not last[i]]
        runs = [rest[k : k + 64] for k in range(0, len(rest), 64)] + [[i] for i in np.flatnonzero(leading).tolist() if last[i]]
        texts = [b"".join([b"x", *[chunks[i] for i in r]]).decode() for r in runs]
        for run, one in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(one.ids, np.uint32)
            ends = np.cumsum([len(chunks[i]) for i in run]) + 1
            cuts = (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1).tolist()
            for i, low, high in zip(run, [1, *cuts], cuts):
                out[i] = ids[low:high]
        return out

    def _entries(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each chunk, chunks before each text and in all)."""
        data = b"".join(texts)
        raw = np.frombuffer(data, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        firsts = np.cumsum(sizes) - sizes
        start = _starts(raw, firsts[sizes > 0]) if self.splits else firsts[sizes > 0]
        size = np.diff(start, append=len(raw))
        off = np.arange(len(raw)) - np.repeat(start, size)
        np.minimum(off, LONGEST, out=off)
        value = raw.astype(np.uint64) + np.uint64(1)
        a, b = (np.add.reduceat(value * w[off], start) for w in self.weights)
        long = size > LONGEST
        found = self._find(a, b)
        found[long] = -1
        new = np.flatnonzero((found < 0) & ~long)
        leading = np.ones(len(start), bool)
        leading[np.searchsorted(start, firsts[sizes > 0])] = False
        if len(new):
            _, first, same = np.unique(a[new], return_index=True, return_inverse=True)
            pick = new[first]
            ids = self._encode([data[s : s + n] for s, n in zip(start[pick].tolist(), size[pick].tolist())], leading[pick])
            found[new] = self._add(a[pick], b[pick], ids, True)[same]
        if long.any():
            at = np.flatnonzero(long)
            ids = self._encode([data[s : s + n] for s, n in zip(start[at].tolist(), size[at].tolist())], leading[at])
            found[at] = self._add(a[at], b[at], ids, False)
        return found, np.append(np.searchsorted(start, firsts), len(start))

    def _slices(self, texts: list[str | None]):
        """The texts' bytes in lots of about SLICE; a longer text is a lot of its own."""
        lot, held = [], 0
        for t in texts:
            raw = t.encode() if t else b""
            if lot and held + len(raw) > SLICE:
                yield lot, held
                lot, held = [], 0
            lot.append(raw)
            held += len(raw)
        if lot:
            yield lot, held

    def ids_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has); null is an empty text."""
        flats, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lot, held in self._slices(texts):
            if not held:
                sizes.append(np.zeros(len(lot), np.int64))
                continue
            if self.n > self.keep:
                self._clear()
            found, cut = self._entries(lot)
            count = self.count[found]
            ends = np.cumsum(count, dtype=np.int64)
            flats.append(self.pool[np.repeat(self.begin[found] - (ends - count), count) + np.arange(ends[-1])])
            sizes.append(np.diff(np.concatenate([[0], ends])[cut]))
        return np.concatenate(flats), np.concatenate(sizes)

    def count_ids(self, batches, total: np.ndarray) -> None:
        """Adds to total[id] how often each id occurs in the batches' texts; chunks are counted first, then their ids."""
        seen = np.zeros(0, np.int64)

        def settle() -> None:
            hit = np.flatnonzero(seen)
            for k in range(0, len(hit), 1 << 18):
                e = hit[k : k + (1 << 18)]
                count = self.count[e].astype(np.int64)
                ends = np.cumsum(count)
                ids = self.pool[np.repeat(self.begin[e] - (ends - count), count) + np.arange(ends[-1])]
                total[:] += np.bincount(ids, np.repeat(seen[e], count), len(total)).astype(np.int64)  # sums below 2**53 are exact

        for texts in batches:
            for lot, held in self._slices(texts):
                if not held:
                    continue
                if self.n > self.keep:
                    settle()
                    self._clear()
                    seen = np.zeros(0, np.int64)
                found, _ = self._entries(lot)
                if self.n > len(seen):
                    seen = np.concatenate([seen, np.zeros(max(self.n, 2 * len(seen)) - len(seen), np.int64)])
                order = np.sort(found)
                first = np.flatnonzero(np.diff(order, prepend=-1))
                seen[order[first]] += np.diff(first, append=len(order))
        settle()


def encoder(path: str) -> ChunkEncoder:
    """One for each worker process; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def brute_ids(texts: list[str | None], path: str) -> list[bytes]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [np.asarray(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
