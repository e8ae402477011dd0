"""Token ids from the tokenizers library, with a memory for words.

The byte-level pre-tokenizer splits a text into pieces that are encoded one by
one, so a text may be cut wherever a piece is sure to begin, and each part encoded
alone with the same ids. Parts repeat much more than texts do; each distinct one
is encoded once per worker and kept, up to ``KEPT`` parts.
Parts are cut, hashed (64 bits) and put together as arrays over the UTF-8 bytes.

A piece always begins at a space before a visible character. In texts of ASCII
and Latin-1 letters, without apostrophes (contractions), special tokens and runs of
white space that end in a line feed, one also begins wherever a run of letters
begins, with the space before it, or ends.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from strandline.llm.shingles import poly_hashes, text_blocks

#: Distinct parts, and ids of these, that one worker keeps; then it starts over.
KEPT, KEPT_IDS = 1_000_000, 16_000_000
LEAD = 0xC3  # first byte of the Latin-1 letters


def _lut(*codes) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in codes:
        out[c] = True
    return out


_LETTER = _lut(slice(ord("A"), ord("Z") + 1), slice(ord("a"), ord("z") + 1), LEAD)
_FOREIGN = ~_lut(ord("\n"), slice(0x20, 0x7F)) | _lut(ord("'"))
_BREAK = _lut(ord("\n"), ord(" "))
# what may follow a space that begins a piece; leads of characters that some count as white space do not
_SOLID = _lut(slice(0x21, 0x7F), slice(0xC3, 0xE1), slice(0xE4, 0xF8))


def parts_at(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First byte of each part and the end: places where texts can be cut and their parts encoded alone."""
    n = len(data)
    follows = np.zeros(n, bool)  # second byte of a Latin-1 letter
    follows[1:] = data[:-1] == LEAD
    follows[ends[:-1][ends[:-1] < n]] = False
    letter = _LETTER[data] | follows
    foreign = _FOREIGN[data] & (data != LEAD) & ~follows
    foreign |= follows & ((data == 0x97) | (data == 0xB7))  # multiplication and division signs
    foreign[:-1] |= _BREAK[data[:-1]] & (data[1:] == ord("\n")) | (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    plain = np.ones(len(ends), bool)
    plain[np.searchsorted(ends, np.flatnonzero(foreign), side="right") - 1] = False

    begins = np.zeros(n + 1, bool)
    begins[ends] = True
    at = np.zeros(n + 1, bool)
    before = np.concatenate([[False], letter[:-1]]) & ~begins[:-1]
    run = np.flatnonzero(letter & ~before)
    at[run - ((run > 0) & (data[run - 1] == 0x20) & ~begins[run])] = True
    at[:-1] |= ~letter & before
    at[:-1] &= np.repeat(plain[:-1], np.diff(ends))
    space = np.flatnonzero(data[:-1] == 0x20)
    at[space[_SOLID[data[space + 1]]]] = True
    at[ends] = True
    return np.flatnonzero(at)


_made: dict[str, WordTokens] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Places:
    """Numbers 64-bit keys in the order they come: an open-addressing table of two arrays."""

    def __init__(self, size: int):
        self._keys, self._at, self._n = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0

    def __len__(self) -> int:
        return self._n

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        mask = np.uint64(len(self._keys) - 1)
        out, rest, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys & mask
        while len(rest):
            at = self._at[slot]
            hit = (at >= 0) & (self._keys[slot] == keys[rest])
            out[rest[hit]] = at[hit]
            on = (at >= 0) & ~hit
            rest, slot = rest[on], (slot[on] + np.uint64(1)) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not in yet."""
        if 2 * (self._n + len(keys)) > len(self._keys):
            old = np.flatnonzero(self._at >= 0)
            old = self._keys[old][np.argsort(self._at[old])]
            size = len(self._keys)
            while size < 3 * (self._n + len(keys)):
                size *= 2
            self._keys, self._at, self._n = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0
            self.add(old)
        mask, number = np.uint64(len(self._keys) - 1), np.arange(self._n, self._n + len(keys), dtype=np.int32)
        self._n += len(keys)
        rest, slot = np.arange(len(keys)), keys & mask
        while len(rest):
            free = np.flatnonzero(self._at[slot] < 0)
            put = free[np.unique(slot[free], return_index=True)[1]]  # one for each free slot
            self._keys[slot[put]], self._at[slot[put]] = keys[rest[put]], number[rest[put]]
            on = np.ones(len(rest), bool)
            on[put] = False
            rest, slot = rest[on], (slot[on] + np.uint64(1)) & mask


class WordTokens:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._forget()

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def _forget(self) -> None:
        self._entry = _Places(1 << 16)
        self._first, self._size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self._ids, self._used = np.zeros(4096, np.uint32), 0

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        got = [np.array(e.ids, np.uint32) for lo in range(0, len(parts), 20_000) for e in self._tok.encode_batch_fast(parts[lo : lo + 20_000], add_special_tokens=False)]
        size = np.array([len(g) for g in got], np.int32)
        n, m = len(self._entry), int(size.sum())
        while len(self._first) < n + len(got):
            self._first, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._first, self._size))
        while len(self._ids) < self._used + m:
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + m] = np.concatenate(got)
        self._size[n : n + len(got)] = size
        self._first[n : n + len(got)] = self._used + np.cumsum(size, dtype=np.int64) - size
        self._entry.add(hashes)
        self._used += m

    def _block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        if len(self._entry) > KEPT or self._used > KEPT_IDS:
            self._forget()
        cuts = parts_at(data, ends)
        h = poly_hashes(data, cuts[:-1], cuts[1:])
        distinct, sample, which = np.unique(h, return_index=True, return_inverse=True)
        entry = self._entry.of(distinct)
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(distinct[new], [raw[cuts[k] : cuts[k + 1]].decode() for k in sample[new].tolist()])
            entry[new] = np.arange(len(self._entry) - len(new), len(self._entry))
        entry = entry[which]
        size = self._size[entry]
        last = np.cumsum(size, dtype=np.int64)
        ids = self._ids[np.repeat(self._first[entry] - (last - size), size) + np.arange(last[-1])]
        return ids, np.concatenate([[0], last])[np.searchsorted(cuts, ends)]

    def encode_all(self, texts: pa.Array):
        """Raw ids of each text of a string column, in order."""
        for _, _, data, ends in text_blocks(texts):
            ids, at = self._block(data, ends)
            raw, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
            for a, z in zip(at, at[1:], strict=False):
                yield raw[a:z]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))
