"""Encoding with a byte-level BPE of the tokenizers library, once per distinct pre-token.

The library merges inside pre-tokens only, so a text's ids are those of its pre-tokens in order.  Pre-tokens are found by
numpy over the texts' code points (runs of letters, numbers, other signs and blanks, by the rules of the byte-level
pattern); each distinct one is encoded by the library once a chunk at most, and kept for later chunks.  Texts with
code points outside the ranges whose classes are listed here are encoded by the library as they are.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from tokenizers import Tokenizer

from foldlight.llm import textkernel as tk

LETTER, NUMBER, OTHER, BLANK, UNLISTED = range(5)


def _classes() -> np.ndarray:
    """The class of each code point below 0x2028; Latin text and general punctuation are listed."""
    table = np.full(0x2029, UNLISTED, np.uint8)
    for point in [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028)]:
        major = unicodedata.category(chr(point))[0]
        table[point] = LETTER if major == "L" else NUMBER if major == "N" else BLANK if major == "Z" else OTHER if major in "PSM" else UNLISTED
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
    return table  # the last one, 0x2028, stands for all above


_CLASSES = _classes()
_CONTRACTIONS = {"s": 1, "t": 1, "d": 1, "m": 1, "re": 2, "ve": 2, "ll": 2}


def pretoken_starts(points: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions (in code points) at which pre-tokens start, in texts whose code points are all listed."""
    n = len(points)
    begins = np.zeros(n + 1, bool)
    begins[bounds] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= begins
    run = np.flatnonzero(change[:n])  # starts of runs of one class
    run_end = np.append(run[1:], n)
    is_blank = kind[run] == BLANK
    # Before a run of signs, its text's last space joins the run; a longer blank run ends one before its last blank.
    follows = ~is_blank & ~begins[run]
    after_blank = run[follows & (kind[np.maximum(run - 1, 0)] == BLANK)]
    joined = points[after_blank - 1] == 0x20
    out = np.zeros(n + 1, bool)
    out[run] = True
    out[after_blank[joined]] = False
    out[after_blank - 1] = True
    # Contractions: an apostrophe that starts a run of its own, without a space before it.
    quote = run[(points[run] == 0x27) & (kind[run] == OTHER) & (run_end - run >= 1)] if n else run
    for at in quote.tolist():
        if not out[at]:
            continue  # the space before it is part of this pre-token
        stop = n if at >= bounds[-1] else int(bounds[np.searchsorted(bounds, at, "right")])
        tail = "".join(chr(p) for p in points[at + 1 : min(at + 3, stop)])
        size = _CONTRACTIONS.get(tail[:1]) or _CONTRACTIONS.get(tail)
        if size:
            out[at + 1] = False
            if at + 1 + size < stop:
                out[at + 1 + size] = True
    out[n] = False
    return np.flatnonzero(out)


_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The process's encoder for a vocabulary file: later tasks of a worker find its pre-tokens known."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids of whole texts; keeps at most `keep` distinct pre-tokens, then starts over.

    A pre-token is known by its hash: an entry says where its ids are in the pool.  Most are found in a direct-mapped
    table; the others, once each, by search among the sorted hashes.
    """

    def __init__(self, path: str, keep: int = 1_500_000, table_bits: int = 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.mask = keep, np.uint64((1 << table_bits) - 1)
        self.break_id = self._plain(["\n"])[0]
        assert len(self.break_id) == 1 and self._plain(["ab\n cd\n12"])[0].count(self.break_id[0]) == 2
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and their entries
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.near_key, self.near_entry = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, -1, np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[bytes], blank: np.ndarray) -> None:
        """Adds the ids of distinct pre-tokens, ordered by key; blank: those that consist of blanks, encoded one by one."""
        sizes, pools = [np.zeros(0, np.int64)], [self.pool]
        alone, rest = np.flatnonzero(blank), np.flatnonzero(~blank)
        for ids in self._plain([texts[k].decode() for k in alone]):
            sizes.append(np.array([len(ids)])), pools.append(np.array(ids, np.uint32))
        # The others many at once, with line breaks between, which no other pre-token's ids hold.
        for i in range(0, len(rest), 1024):
            some = rest[i : i + 1024].tolist()
            ids = np.array(self._plain([b"\n".join([texts[k] for k in some]).decode()])[0], np.uint32)
            breaks = np.flatnonzero(ids == self.break_id[0])
            assert len(breaks) == len(some) - 1, "pre-tokens were not kept apart"
            edges = np.concatenate([[-1], breaks, [len(ids)]])
            sizes.append(np.diff(edges) - 1), pools.append(np.delete(ids, breaks))
        which, size = np.concatenate([alone, rest]), np.concatenate(sizes)
        entry = np.empty(len(texts), np.int64)
        entry[which] = len(self.at) + np.arange(len(texts))
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
        self.size, self.pool = np.concatenate([self.size, size]), np.concatenate(pools)
        places = np.searchsorted(self.keys, keys)
        self.keys, self.entry = np.insert(self.keys, places, keys), np.insert(self.entry, places, entry)

    def _entries(self, hashes: np.ndarray, raw: bytes, first: np.ndarray, last: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """The entry of each pre-token; new ones are learnt."""
        slot = (hashes & self.mask).astype(np.intp)
        out = self.near_entry[slot]
        far = np.flatnonzero((self.near_key[slot] != hashes) | (out < 0))
        if not len(far):
            return out
        keys, example, where = np.unique(hashes[far], return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            example = far[example[new]]
            self._learn(keys[new], [raw[a:b] for a, b in zip(first[example].tolist(), last[example].tolist(), strict=True)], blank[example])
            place = np.searchsorted(self.keys, keys)
        entry = self.entry[place]
        slot = (keys & self.mask).astype(np.intp)
        self.near_key[slot], self.near_entry[slot] = keys, entry
        out[far] = entry[where]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        bounds = np.searchsorted(byte_at, offsets)
        kind = _CLASSES[np.minimum(points, len(_CLASSES) - 1)]
        unlisted = np.zeros(len(offsets) - 1, bool)
        unlisted[np.searchsorted(bounds, np.flatnonzero(kind == UNLISTED), "right") - 1] = True
        # The library takes the strings of its special tokens out of a text before all else.
        marked = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        unlisted[np.searchsorted(offsets, marked, "right") - 1] = True
        starts = pretoken_starts(points, kind, bounds)
        stops = np.append(starts[1:], len(points)) if len(starts) else starts
        first, last, blank = byte_at[starts], byte_at[stops], kind[stops - 1] == BLANK
        text_of = np.searchsorted(bounds, starts, "right") - 1
        if unlisted.any():
            listed = ~unlisted[text_of]
            first, last, text_of, blank = first[listed], last[listed], text_of[listed], blank[listed]
        if len(self.keys) > self.keep:
            self._forget()
        entry = self._entries(tk.span_hashes(data, first, last), raw, first, last, blank)
        size, at = self.size[entry], self.at[entry]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(at - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        counts = np.diff(np.concatenate([[0], upto])[np.searchsorted(text_of, np.arange(len(offsets)))])
        if not unlisted.any():
            return ids, np.concatenate([[0], np.cumsum(counts)])
        whole = np.flatnonzero(unlisted)
        plain = self._plain([raw[offsets[k] : offsets[k + 1]].decode() for k in whole])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k, x in zip(whole.tolist(), plain, strict=True):
            parts[k] = np.array(x, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
