"""Re-Pair grammar compression of id sequences, in rounds.

A round counts all pairs of neighbouring symbols exactly (never across documents; in a run of one symbol every second
place), gives the most frequent ones a nonterminal each, and replaces their occurrences; where two overlap, the more
frequent pair wins.  Rounds end when no pair is frequent enough: the most frequent pair of a round is always replaced at
all its places.  A shard stores the rules, each rule's expansion length, and each document's number of symbols; lengths
lead to any document or position without expanding what stands before.
"""

from __future__ import annotations

import itertools

import numpy as np

#: Pairs replaced in a round at most, and the least count of a pair.
BATCH, MIN_COUNT = 2048, 24
_BUCKET_BITS = 18


def _buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right) * np.uint32(0x85EBCA6B) >> np.uint32(32 - _BUCKET_BITS)


def compress(ids: np.ndarray, counts: np.ndarray, base: int, rounds: int | None = None, batch: int = BATCH, least: int = MIN_COUNT):
    """(rules, lengths, symbols, symbol counts) of documents with `counts` ids each; symbols from `base` on are rules."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    ends = np.cumsum(counts)
    last[ends[counts > 0] - 1] = True
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    # Places whose pair can be frequent.  A pair of old symbols never becomes more frequent, so that later rounds look at
    # pairs with a new symbol and at those that were frequent before; a pair is no more frequent than its bucket.
    live = ~last
    if len(symbols) > 1:
        bucket = _buckets(symbols[:-1], symbols[1:])
        live[:-1] &= (np.bincount(bucket[live[:-1]], minlength=1 << _BUCKET_BITS) >= least)[bucket]
    for _ in itertools.count() if rounds is None else range(rounds):
        at = np.flatnonzero(live)
        left, right = symbols[at], symbols[np.minimum(at + 1, len(symbols) - 1)]
        pair = left.astype(np.uint64) << np.uint64(32) | right
        apart = np.ones(len(at), bool)
        run = np.flatnonzero(left == right)
        if len(run):  # occurrences of a pair of equal symbols must not overlap
            first = np.flatnonzero(np.concatenate([[True], at[run[1:]] != at[run[:-1]] + 1]))
            apart[run] = (np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))) % 2 == 0
        ordered = np.sort(pair[apart])
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, np.intp)
        found = np.diff(edge)
        frequent = found >= least
        pairs, found = ordered[edge[:-1][frequent]], found[frequent]
        if not len(pairs):
            break
        # The places of frequent pairs: by bucket (the others in it do no harm), then those of the chosen pairs themselves.
        hot = np.zeros(1 << _BUCKET_BITS, np.uint8)
        hot[_buckets((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))] = 1
        pairs = pairs[np.argsort(-found, kind="stable")[:batch]]
        hot[_buckets((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))] = 2
        heat = hot[_buckets(left, right)]
        live[at[heat == 0]] = False
        near = apart & (heat == 2)
        at, pair = at[near], pair[near]
        far = len(pairs)
        by_value = np.argsort(pairs)
        slot = by_value[np.minimum(np.searchsorted(pairs[by_value], pair), far - 1)]
        same = pairs[slot] == pair
        at, rank = at[same], slot[same]
        # Only pairs at neighbouring places overlap.
        beside = at[1:] == at[:-1] + 1
        before, behind = np.full(len(at), far), np.full(len(at), far)
        before[1:][beside], behind[:-1][beside] = rank[:-1][beside], rank[1:][beside]
        picked = (rank < before) & (rank < behind)
        used = np.bincount(rank[picked], minlength=far)
        good = used >= least // 2
        picked &= good[rank]
        chosen, chosen_rank = at[picked], rank[picked]
        number = np.cumsum(good) - 1 + len(rules)
        new = pairs[good]
        new = np.stack([(new >> np.uint64(32)).astype(np.uint32), new.astype(np.uint32)], axis=1)
        length = np.append(lengths, np.uint32(1))[np.where(new < base, len(lengths), new.astype(np.int64) - base)].sum(axis=1)
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, length.astype(np.uint32)])
        symbols[chosen] = base + number[chosen_rank]
        last[chosen] = last[chosen + 1]
        live[chosen] = ~last[chosen]
        behind_one = chosen[chosen > 0] - 1
        live[behind_one] = ~last[behind_one]
        stay = np.ones(len(symbols), bool)
        stay[chosen + 1] = False
        symbols, last, live = symbols[stay], last[stay], live[stay]
    # Each document with ids ends at one `last` symbol.
    n = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    symbol_counts = np.zeros(len(counts), np.int64)
    symbol_counts[counts > 0] = n
    return rules, lengths, symbols, symbol_counts


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rules one after the other, and n + 1 offsets."""
    out = np.arange(base, base + len(rules), dtype=np.int64)
    while len(at := np.flatnonzero(out >= base)):
        times = np.ones(len(out), np.int64)
        times[at] = 2
        first = np.cumsum(times)[at] - 2
        rule = out[at] - base
        out = np.repeat(out, times)
        out[first], out[first + 1] = rules[rule, 0], rules[rule, 1]
    return out.astype(np.uint32), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    pool, offsets = expansions(rules, lengths, base)
    pool = np.concatenate([np.arange(base, dtype=np.uint32), pool])
    is_rule = symbols >= base
    at = symbols.astype(np.int64)
    size = np.ones(len(symbols), np.int64)
    rule = at[is_rule] - base
    at[is_rule], size[is_rule] = base + offsets[rule], lengths[rule]
    upto = np.cumsum(size)
    return pool[np.repeat(at - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]


def expand_document(k: int, symbols: np.ndarray, symbol_counts: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start..stop of the k-th document; only the symbols that cover them are expanded."""
    first = int(symbol_counts[:k].sum())
    mine = symbols[first : first + int(symbol_counts[k])]
    upto = np.cumsum(np.where(mine < base, 1, lengths[np.maximum(mine.astype(np.int64) - base, 0)] if len(lengths) else 1))
    total = int(upto[-1]) if len(upto) else 0
    stop = total if stop is None else min(stop, total)
    a, b = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, stop, "left")) + 1
    before = int(upto[a - 1]) if a else 0
    return expand(mine[a:b], rules, lengths, base)[start - before : stop - before]
