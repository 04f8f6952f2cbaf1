"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in lower case (code point by code point) with each run of blanks made one space.  A benchmark item is cut into
overlapping windows of WINDOW characters, so that a passage quoted from it is found wherever it begins and ends; an item
of up to SEGMENT characters is a segment as a whole as well.  A place in a document within k edits of a segment of m
characters shares at least m + 1 - q - k q of its q-grams, all on at most k + 1 neighbouring diagonals; so shared q-grams
are counted in bands of 2 (k + 1) diagonals that overlap by half, and bands that reach the bound are kept.  The kept places of
all texts and segments of a chunk are verified together: equal regions once, in one banded alignment over arrays, from
which places drop out as soon as they exceed their edits.  Each segment's best place in a document is a hit; hits of an item
that continue each other are joined into one span.

Where the items share a phrase (a question template), a text with that phrase has as many shared q-grams as there are such
items.  Such texts are worked through in overlapping tiles of bounded size, and tiles of equal contents once.

Documents are read once per block of the benchmark and never shuffled; a block's index has a stated size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm import textkernel as tk
from foldlight.llm.common import in_arrow, record

Q = 8
EDIT_SHARE = 0.10
#: Shared q-grams that a band must have at least: segments too short for the edit share get fewer edits.
MIN_SHARED = 4
#: Items of up to SEGMENT characters are searched as a whole; longer than WINDOW, in windows as well.  Any quoted passage of
#: WINDOW + WINDOW_STEP - 1 characters holds a whole window.
SEGMENT, WINDOW, WINDOW_STEP = 400, 80, 40
#: Items with fewer characters must stand in a text exactly, on word bounds; those with fewer than Q must be the whole text.
MIN_ITEM_CHARS = 24
#: Shared q-grams that are looked at at once; a text with more is cut into tiles of TILE places, each with the next LAP ones (no band
#: of a segment is longer).
POSTINGS, TILE, LAP = 1 << 21, 512, 640
#: Places aligned at once.
BATCH = 1024
#: Characters of benchmark text in one broadcast index (about 80 to 120 bytes of index each); a larger benchmark takes more passes.
BLOCK_CHARS = 1 << 19

_BLANK = 0x20
#: Lower case of each code point below 0x10000, where that is one code point.
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 and not 0xD800 <= i < 0xE000 else i for i in range(0x10000)], np.uint32)
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts after normalisation, n + 1 offsets, and each one's position in its original text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    bounds = before[offsets]
    points = np.where(points < 0x10000, _LOWER[points & np.uint32(0xFFFF)], points)
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    points[blank] = _BLANK
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[bounds[:-1][bounds[:-1] < len(points)]] = True
    where = np.flatnonzero(keep)
    ends = np.searchsorted(where, bounds)
    return points[where], ends, where - np.repeat(bounds[:-1], np.diff(ends))


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """32-bit hashes of all Q = 8 consecutive code points, by three doublings."""
    h = points * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    for length in (1, 2, 4):
        h = (h[:-length] ^ (h[:-length] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + h[length:] * np.uint32(0xC2B2AE35) if len(h) > length else h[:0]
    return h ^ (h >> np.uint32(16))


class Index:
    """Q-grams of the segments of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        segments, owners, starts, wholes, exact, short = [], [], [], {}, [], {}
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            points = trimmed(normalised(raw, np.array([0, len(raw)]))[0])
            if len(points) < Q:
                if len(points):
                    short.setdefault(points.tobytes(), []).append(k)
                continue
            cuts = [(0, len(points))] if len(points) <= SEGMENT else []
            if len(points) > WINDOW:
                last = len(points) - WINDOW
                # The last windows are counted from the end, so that the last SEGMENT characters are tiled without a rest.
                ats = {*range(0, last, WINDOW_STEP), *range(last, max(last - SEGMENT, -1), -WINDOW_STEP)}
                cuts += [(at, at + WINDOW) for at in sorted(ats)]
            for at, end in cuts:
                segments.append(points[at:end]), owners.append(k), starts.append(at), exact.append(len(points) < MIN_ITEM_CHARS)
            wholes[k] = points
        self.ids = [i for i, _ in items]
        self.wholes, self.short = wholes, short
        self.segments, self.owners, self.starts = segments, np.array(owners, np.int64), np.array(starts, np.int64)
        self.exact = np.array(exact, bool)
        self.sizes = m = np.array([len(s) for s in segments], np.int64)
        self.entire = m == np.array([len(wholes[k]) for k in owners], np.int64)
        self.edits = np.where(self.exact, 0, np.minimum((m * EDIT_SHARE).astype(np.int64), np.maximum((m + 1 - Q - MIN_SHARED) // Q, 0)))
        self.bound = np.maximum(m + 1 - Q - self.edits * Q, 1)
        self.points = np.concatenate([*segments, np.zeros(0, np.uint32)])
        self.offsets = np.concatenate([[0], np.cumsum(m)])
        hashes = [gram_hashes(s) for s in segments]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        segment = np.repeat(np.arange(len(segments)), [len(h) for h in hashes])
        position = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.segment, self.position = segment[order], position[order]
        # A table over leading hash bits tells most positions of a document at once that they match nothing.
        self.shift = np.uint32(32 - min(26, max(16, int(len(every)).bit_length() + 5)))
        self.table = np.zeros(1 << int(32 - self.shift), bool)
        self.table[self.grams >> self.shift] = True


def trimmed(points: np.ndarray) -> np.ndarray:
    """Without the blanks at both ends."""
    inside = np.flatnonzero(points != _BLANK)
    return points[inside[0] : inside[-1] + 1] if len(inside) else points[:0]


def align(segments: np.ndarray, sizes: np.ndarray, regions: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best place of each whole segment in its region, or any edits above `most` where no place has
    that few.

    A column of `segments` and `regions` is one place to verify, the longest segment first; a segment ends after its size.  The
    alignment starts in one of the region's first lanes (rows of `regions` less those of `segments`, plus 1) and ends in one.
    """
    width = len(regions) - len(segments) + 1
    kind, shift = (np.int32, 16) if len(regions) < 1 << 14 else (np.int64, 32)
    lanes = np.arange(width, dtype=kind)[:, None]
    one = kind(1 << shift)  # a cost of edits << shift | first lane, so that a minimum carries its start along
    lift = lanes * one
    n = len(sizes)
    out = np.full((3, n), 1 << 30, np.int64)
    cost = np.repeat(lanes, n, axis=1)
    mine = np.arange(n)
    for i in range(len(segments)):
        step = cost + np.where(regions[i : i + width] == segments[i], kind(0), one)
        np.minimum(step[:-1], cost[1:] + one, out=step[:-1])
        step -= lift
        reach = 1
        while reach < width:  # the running minimum over lanes, by doublings
            np.minimum(step[reach:], step[:-reach], out=step[reach:])
            reach *= 2
        step += lift
        cost = step
        done = len(mine) - int(np.searchsorted(-sizes, -(i + 1), "left")) if sizes[-1] <= i + 1 else 0
        if done or i % 8 == 7:
            least = cost.min(axis=0) >> shift
            if done:
                ended = np.arange(len(mine) - done, len(mine))
                best = np.argmin(cost[:, ended] >> shift, axis=0)
                found = cost[best, ended]
                out[0, mine[ended]], out[1, mine[ended]], out[2, mine[ended]] = found >> shift, found & (one - 1), best + i + 1
            stay = least <= most
            stay[len(mine) - done :] = False
            if not stay.any():
                break
            if not stay.all():
                mine, cost, sizes, most, segments, regions = mine[stay], cost[:, stay], sizes[stay], most[stay], segments[:, stay], regions[:, stay]
    return out[0], out[1], out[2]


def _places(points: np.ndarray, ends: np.ndarray, at: np.ndarray, gram: np.ndarray, text: np.ndarray, index: Index, before: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, segment, low, high): bands that reach their segment's bound; low and high: the outer diagonals of their shared q-grams,
    as places in `points` where the segment would start.  before: only bands whose first shared q-gram stands before it."""
    n = index.first[gram + 1] - index.first[gram]
    post = np.repeat(index.first[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    segment, diagonal, text = index.segment[post], np.repeat(at, n) - index.position[post] + SEGMENT, np.repeat(text, n)  # none is negative
    width = index.edits[segment] + 1
    bands = (len(points) + 2 * SEGMENT) // 2 + 2
    found = []
    for half in (0, 1):
        key = (text * len(index.owners) + segment) * bands + (diagonal + half * width) // (2 * width)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        # The bound is on distinct places of the segment; bands with too few hits go before these are counted.
        enough = np.diff(edge) >= index.bound[segment[order[edge[:-1]]]]
        mine = order[np.repeat(enough, np.diff(edge))]
        if not len(mine):
            continue
        number = np.repeat(np.arange(enough.sum()), np.diff(edge)[enough])
        shared = np.sort(number * (SEGMENT + 1) + index.position[post[mine]])
        distinct = np.bincount(shared[np.concatenate([[True], shared[1:] != shared[:-1]])] // (SEGMENT + 1))
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        low, high = np.minimum.reduceat(diagonal[mine], first), np.maximum.reduceat(diagonal[mine], first)
        good = distinct >= index.bound[segment[mine[first]]]
        if before is not None:
            good &= np.minimum.reduceat(diagonal[mine] - SEGMENT + index.position[post[mine]], first) < before
        found.append(np.stack([text[mine[first]], segment[mine[first]], low - SEGMENT, high - SEGMENT])[:, good])
    every = np.concatenate([*found, np.zeros((4, 0), np.int64)], axis=1)
    return tuple(every[:, np.unique(_row_hashes(every), return_index=True)[1]])


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each column of `rows`."""
    out = np.zeros(rows.shape[1], np.uint64)
    for row in rows:
        out = tk.mix(out * np.uint64(0x9FB21C651E98DF25) + row.astype(np.uint64))
    return out


def _verified(points: np.ndarray, ends: np.ndarray, places: tuple[np.ndarray, ...], index: Index) -> np.ndarray:
    """Rows text, segment, edits, start, end (in `points`) of the places that hold their segment within its edits."""
    text, segment, low, high = places
    k, m = index.edits[segment], index.sizes[segment]
    a, b = low - k, high + k + m
    inside_a = np.minimum(np.maximum(a, ends[text]), ends[text + 1])
    inside_b = np.maximum(np.minimum(b, ends[text + 1]), inside_a)
    one = which = np.arange(len(text))
    if len(text) > 4 * BATCH:  # regions of equal contents once: a polynomial hash over what lies inside the text
        base = np.full(len(points), 0x9E3779B97F4A7C15, np.uint64)
        power = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(base)])
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(points.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        hashes = (upto[inside_b] - upto[inside_a]) * power[len(points) - inside_a]
        same = _row_hashes(np.stack([segment, b - a, inside_a - a, inside_b - inside_a, hashes.view(np.int64)]))
        _, one, which = np.unique(same, return_index=True, return_inverse=True)
    edits, start, end = (np.full(len(one), 1 << 30, np.int64) for _ in range(3))
    # Batches of places of like sizes; the longest segment of a batch first.
    lanes = (high - low + 2 * k + 1)[one]
    order = np.lexsort((-m[one], lanes, m[one] // 32))
    for cut in range(0, len(order), BATCH):
        mine = order[cut : cut + BATCH]
        mine = mine[np.argsort(-m[one[mine]], kind="stable")]
        rows, width = int(m[one[mine[0]]]), int(lanes[mine].max())
        i = np.arange(rows)[:, None]
        segments = index.points[np.minimum(index.offsets[segment[one[mine]]] + i, len(index.points) - 1)]
        j = a[one[mine]] + np.arange(rows + width - 1)[:, None]
        out = (j < inside_a[one[mine]]) | (j >= inside_b[one[mine]])
        regions = np.where(out, np.uint32(0xFFFFFFFF), points[np.clip(j, 0, len(points) - 1)])
        edits[mine], start[mine], end[mine] = align(segments, m[one[mine]], regions, k[one[mine]])
    good = edits[which] <= k
    found = np.stack([text, segment, edits[which], a + start[which], a + end[which]])[:, good]
    if index.exact.any():  # no letter or digit before or behind
        word = (points >= 0x80) | ((points >= 0x30) & (points < 0x3A)) | ((points >= 0x61) & (points < 0x7B))
        edge = np.concatenate([[False], word, [False]])
        t, s, _, first, last = found
        joined = (edge[first] & (first > ends[t])) | (edge[np.minimum(last, len(points)) + 1] & (last < ends[t + 1]))
        found = found[:, ~(index.exact[s] & joined)]
    return found


def _best(found: np.ndarray) -> np.ndarray:
    """Of each text and segment the hit with the fewest edits, the first of these."""
    found = found[:, np.lexsort((found[4], found[3], found[2], found[1], found[0]))]
    return found[:, np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(axis=0)])] if found.shape[1] else found


def _hits(points: np.ndarray, ends: np.ndarray, index: Index) -> np.ndarray:
    """The best hit of each text and segment: rows text, segment, edits, start, end (in `points`)."""
    none = np.zeros((5, 0), np.int64)
    if not len(index.owners):
        return none
    hashes = gram_hashes(points)
    at = np.flatnonzero(index.table[hashes >> index.shift])
    gram = np.minimum(np.searchsorted(index.grams, hashes[at]), len(index.grams) - 1)
    good = index.grams[gram] == hashes[at]
    at, gram = at[good], gram[good]
    text = np.searchsorted(ends, at, "right") - 1
    good = at + Q <= ends[text + 1]
    at, gram, text = at[good], gram[good], text[good]
    if not len(at):
        return none
    cost = np.concatenate([[0], np.cumsum(index.first[gram + 1] - index.first[gram])])
    bounds = np.searchsorted(at, ends)  # the places of each text
    upto = cost[bounds]
    out, t, texts = [none], 0, len(ends) - 1
    while t < texts:
        # As many whole texts as POSTINGS allow, or one text in tiles.
        to = int(np.searchsorted(upto, upto[t] + POSTINGS, "right")) - 1
        if to > t:
            some = slice(bounds[t], bounds[to])
            out.append(_best(_verified(points, ends, _places(points, ends, at[some], gram[some], text[some], index), index)))
            t = to
            continue
        known: set[bytes] = set()
        tile, first, last = int(ends[t]), int(ends[t]), int(ends[t + 1])
        while tile < last:
            # Bands belong to the tile with their first shared q-gram; LAP places before and behind are what they may touch.
            shift, end = max(tile - LAP, first), min(tile + TILE + 2 * LAP, last)
            mine = points[shift:end]
            name = bytes([shift == first, end == last]) + mine.tobytes()
            if name not in known:  # else its hits stand further behind, with as many edits
                known.add(name)
                inside = slice(*np.searchsorted(at, (tile, min(tile + TILE + LAP, last))))
                bare = np.array([0, len(mine)])
                places = _places(mine, bare, at[inside] - shift, gram[inside], np.zeros(inside.stop - inside.start, np.int64), index, before=tile + TILE - shift)
                hits = _best(_verified(mine, bare, places, index))
                hits[0], hits[3:] = t, hits[3:] + shift
                out.append(hits)
            # Repeated text is met in step: the next tile starts, if it can, with the q-gram that this one starts with.
            again = np.flatnonzero(hashes[tile + 1 : tile + TILE + 1] == hashes[tile]) if tile < len(hashes) else ()
            tile += int(again[-1]) + 1 if len(again) and again[-1] >= TILE // 2 else TILE
            if len(out) > 64:
                out = [_best(np.concatenate(out, axis=1))]
        t += 1
    return _best(np.concatenate(out, axis=1))


def find(data: np.ndarray, offsets: np.ndarray, index: Index, any_place: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of each item in each text (with any_place: text and item only); positions in the original text."""
    points, ends, origin = normalised(data, offsets)
    text, segment, edits, start, end = _hits(points, ends, index)
    owner = index.owners[segment] if len(segment) else segment
    out = []
    if index.short:
        for t in np.flatnonzero(np.diff(ends) < Q + 2):
            mine = trimmed(points[ends[t] : ends[t + 1]])
            lead = int(np.argmax(points[ends[t] : ends[t + 1]] != _BLANK)) if len(mine) else 0
            for k in index.short.get(mine.tobytes(), ()):
                place = origin[ends[t] + lead : ends[t] + lead + len(mine)]
                out.append((int(t), index.ids[k], 0, int(place[0]), int(place[-1]) + 1))
    order = np.lexsort((owner, text))
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(text[order]) != 0) | (np.diff(owner[order]) != 0), [True]])) if len(order) else [0]
    for a, b in itertools.pairwise(edge):
        mine = order[a:b]
        t, item = int(text[mine[0]]), int(owner[mine[0]])
        if any_place:
            out.append((t, index.ids[item], 0, 0, 0))
            continue
        s = segment[mine]
        hits = np.stack([index.starts[s], index.starts[s] + index.sizes[s], edits[mine], start[mine] - ends[t], end[mine] - ends[t]], axis=1).tolist()
        e, first, last = best_span(hits, index.wholes[item], points[ends[t] : ends[t + 1]])
        place = origin[ends[t] : ends[t + 1]]
        out.append((t, index.ids[item], e, int(place[max(first, 0)]), int(place[min(last, len(place)) - 1]) + 1))
    return sorted(out)


def align_one(segment: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int]:
    """The best place of one segment that starts on diagonals low..high of a text, drifting by up to k."""
    a, b = low - k, high + k + len(segment)
    region = np.full(b - a, 0xFFFFFFFF, np.uint32)
    i, j = max(a, 0), min(b, len(text))
    if j > i:
        region[i - a : j - a] = text[i:j]
    edits, start, end = align(segment[:, None], np.array([len(segment)]), region[:, None], np.array([len(segment)]))
    return int(edits[0]), a + int(start[0]), a + int(end[0])


def best_span(hits: list[list[int]], item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of one item in one text: the whole item's place if it is a hit, else the longest span of hits
    on neighbouring diagonals that continue each other.  Hits: [start in the item, end in the item, edits, start, end]."""
    if wholes := [h[2:] for h in hits if h[1] - h[0] == len(item)]:
        return tuple(wholes[0])
    near = 2 * int(WINDOW * EDIT_SHARE)  # two hits that overlap may lie so many diagonals apart
    ordered = sorted(hits, key=lambda h: h[3] - h[0])
    group = np.cumsum([0, *(b[3] - b[0] - a[3] + a[0] > near for a, b in itertools.pairwise(ordered))]).tolist()
    spans: list[list[int]] = []  # first and last place in the item, edits, first and last place in the text, group, hits
    for g, (a, b, e, start, end) in sorted(zip(group, ordered, strict=True)):
        if spans and spans[-1][5] == g and a <= spans[-1][1] and start <= spans[-1][4]:
            c = spans[-1]
            c[1], c[2], c[3], c[4], c[6] = max(c[1], b), c[2] + e, min(c[3], start), max(c[4], end), c[6] + 1
        else:
            spans.append([a, b, e, start, end, g, 1])
    first, last, edits, start, end, _, n = min(spans, key=lambda c: (c[0] - c[1], c[2], c[3]))
    if edits and n > 1:  # edits where hits overlap count once
        edits, start, end = align_one(item[first:last], text, start - near, start + near, edits + near)
    return edits, start, end


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """Broadcast indexes of blocks of the benchmark of about `block_chars` characters each; one block is held at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        index = Index(sorted((r["item"] if r["item"] is not None else -1, r["text"]) for r in rows))
        if len(index.owners) or index.short:
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each item found in each row of `docs`: the whole item at its best place, or the
    longest quoted part of it that holds a window (each window at its best place: fewest edits, then the first).

    Null and empty texts hold nothing; null and empty items are not searched; items under MIN_ITEM_CHARS characters must
    stand there exactly, with no letter or digit beside them, and those under Q be the whole text; an item without an id has
    item_id -1.  Rows are judged one by one, so repeated rows give repeated results, and a null doc_id stays null.
    """

    def kernel(bc):
        def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
            found = find(*tk.text_bytes(part.column(1)), bc.value)
            if not found:
                return None
            t, item, edits, start, end = zip(*found, strict=True)
            return record(_OUT, doc_id=part.column(0).take(pa.array(t)), item_id=list(item), edits=list(edits), start=list(start), end=list(end))

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = "doc_id long, item_id long, edits long, start long, `end` long"
    out = docs.sparkSession.createDataFrame([], ddl)
    for bc in indexes(benchmark, text_col="text", block_chars=block_chars):
        out = out.unionByName(in_arrow(rows, tk.over_chunks(kernel(bc)), ddl))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, columns kept, that hold no benchmark item; nothing is shuffled."""

    def kernel(bc):
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            clean = np.ones(part.num_rows, bool)
            clean[[t for t, *_ in find(*tk.text_bytes(part.column(part.schema.get_field_index(text_col))), bc.value, any_place=True)]] = False
            return part.filter(pa.array(clean))

        return run

    for bc in indexes(benchmark, block_chars=block_chars):
        docs = in_arrow(docs, tk.over_chunks(kernel(bc), text_col), docs.schema)
    return docs
