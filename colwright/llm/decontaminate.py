"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Every window of a document that is as long as some benchmark item may hold that item. A shingle votes
on a window's 64-bit SimHash with the root of its weight, so the angle between two windows is that of
their weighted shingle bags: at a similarity of 0.8 about 10 bits differ, in RADIUS = 17 lie 99 %. Six
blocks of 11 or 10 bits list the items whose block differs in at most two bits; two fingerprints within
the radius differ in at most two bits in one of six blocks, so none is missed. Only listed pairs of a
window and an item are compared, and those within the radius verified by the exact weighted Jaccard
similarity of their five-word shingles.

Shingles weigh 1 / (number of distinct item texts that hold them), all others 1. A window of n
shingles can only reach similarity t if t n of them occur in some item, since each shingle outside
weighs 1; windows below that bound get no fingerprint.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import chunks, mix, shingles

WORDS_PER_SHINGLE, PERCENT = 5, 80
RADIUS = 17
ITEMS_PER_BLOCK = 20_000  # items that a task is sent at once; larger benchmarks take several scans
FILTER_BITS = 22
_BITS = np.arange(64, dtype=np.uint64)
_WIDTHS = (11, 11, 11, 11, 10, 10)  # bits of the blocks
_SHIFTS = np.cumsum((0,) + _WIDTHS[:-1]).astype(np.uint64)
_MASKS = np.array([(1 << w) - 1 for w in _WIDTHS], np.uint64)
_FLIPS = [np.array([x for x in range(1 << w) if x.bit_count() <= RADIUS // len(_WIDTHS)]) for w in _WIDTHS]
UNIT = 1024  # the vote of a shingle of weight 1
STRETCH, PAIRS = 4096, 1 << 20  # words whose windows, and listed pairs that, are worked on at once


class Group(NamedTuple):
    """Items with the same number of shingles."""

    size: int
    items: list[int]
    prints: np.ndarray
    keys: np.ndarray  # the multi-index: block values near to some item's, ascending,
    listed: np.ndarray  # and the items that they belong to


class Index(NamedTuple):
    ids: list
    known: np.ndarray  # all items' shingles, ascending
    weights: np.ndarray
    votes: np.ndarray
    maybe: np.ndarray  # bit table over the shingles
    bags: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]  # shingles, counts, weights, total
    groups: list[Group]


def fingerprints(run: np.ndarray, starts: np.ndarray, size: int, votes: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the windows run[s:s+size]: a bit is set if most of the shingles' votes have it set."""
    lo, hi = int(starts.min()), int(starts.max()) + size
    sides = ((mix(run[lo:hi], 9)[:, None] >> _BITS) & np.uint64(1)).astype(np.int64) * 2 - 1
    sums = np.zeros((hi - lo + 1, 64), np.int64)
    np.cumsum(sides if votes is None else sides * votes[lo:hi, None], axis=0, out=sums[1:])
    win = sums[starts - lo + size] - sums[starts - lo]
    return np.bitwise_or.reduce((win > 0).astype(np.uint64) << _BITS, axis=1)


def _blocks(prints: np.ndarray) -> np.ndarray:
    """[print, block]: the block's value, with its number above."""
    return ((prints[:, None] >> _SHIFTS) & _MASKS).astype(np.int64) + (np.arange(len(_WIDTHS)) << max(_WIDTHS))


def _listed(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block value within the distance of an item's block, ascending, and the item's place."""
    at = _blocks(prints)
    keys = np.concatenate([(at[:, k, None] ^ flips).ravel() for k, flips in enumerate(_FLIPS)])
    places = np.concatenate([np.repeat(np.arange(len(prints), dtype=np.int32), len(flips)) for flips in _FLIPS])
    order = np.argsort(keys, kind="stable")
    return keys[order].astype(np.int32), places[order]


def within(group: Group, prints: np.ndarray) -> list[tuple[int, int]]:
    """(print, item of the group) for all fingerprints within the radius; only listed pairs are compared."""
    at = _blocks(prints).ravel().astype(np.int32)
    first = np.searchsorted(group.keys, at, "left")
    count = np.searchsorted(group.keys, at, "right") - first
    ends = np.cumsum(count.reshape(len(prints), -1).sum(axis=1))
    found, start = [], 0
    while start < len(prints):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        cells = slice(start * len(_WIDTHS), stop * len(_WIDTHS))
        n = count[cells]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        items = group.listed[np.repeat(first[cells], n) + inside]
        windows = start + np.repeat(np.arange(len(n)) // len(_WIDTHS), n)
        near = np.bitwise_count(prints[windows] ^ group.prints[items]) <= RADIUS
        found.append(np.unique(windows[near] * len(group.items) + items[near]))
        start = stop
    return [divmod(int(x), len(group.items)) for part in found for x in part]


def build_index(items: list[tuple[object, np.ndarray]], frequency: dict[int, int]) -> Index:
    """items: (id, shingles in order); frequency: distinct item texts that hold a shingle."""
    items = [(i, s) for i, s in items if len(s)]
    known = np.unique(np.concatenate([s for _, s in items])) if items else np.zeros(0, np.uint64)
    weights = np.array([1.0 / frequency.get(int(k), 1) for k in known])
    votes = np.rint(np.sqrt(weights) * UNIT).astype(np.int64)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    bags, sizes = [], {}
    for place, (_, s) in enumerate(items):
        values, counts = np.unique(s, return_counts=True)
        w = weights[np.searchsorted(known, values)]
        bags.append((values, counts, w, float((counts * w).sum())))
        sizes.setdefault(len(s), []).append(place)
    groups = []
    for size, places in sorted(sizes.items()):
        prints = np.concatenate([
            fingerprints(items[p][1], np.zeros(1, np.int64), size, votes[np.searchsorted(known, items[p][1])]) for p in places])
        groups.append(Group(size, places, prints, *_listed(prints)))
    return Index([i for i, _ in items], known, weights, votes, maybe, bags, groups)


def similarity(index: Index, item: int, window: np.ndarray) -> float:
    """Weighted Jaccard similarity of a window's and an item's shingle bags."""
    values, counts, weights, total = index.bags[item]
    own, times = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(index.known, own), len(index.known) - 1)
    own_weight = np.where(index.known[at] == own, index.weights[at], 1.0)
    here = np.minimum(np.searchsorted(own, values), len(own) - 1)
    shared = float((np.where(own[here] == values, np.minimum(times[here], counts), 0) * weights).sum())
    return shared / (total + float((times * own_weight).sum()) - shared)


def matches(index: Index, run: np.ndarray, hit: np.ndarray, percent: int = PERCENT) -> list[tuple[int, float, int]]:
    """(item, similarity, first word) of the best window of each item in one document; run: its
    shingles in order, hit: whether some item holds the shingle."""
    n, total = len(run), np.concatenate([[0], np.cumsum(hit)])
    best: dict[int, tuple[float, int]] = {}
    votes = np.full(n, UNIT, np.int32)
    votes[hit] = index.votes[np.searchsorted(index.known, run[hit])]
    for group in index.groups:
        size = min(group.size, n)
        starts = np.flatnonzero(100 * (total[size:] - total[:-size]) >= percent * size)
        if not len(starts):
            continue
        # A stretch of the text at a time: windows that lie far apart share no sums.
        for part in np.split(starts, np.flatnonzero(np.diff(starts // STRETCH)) + 1):
            for p, i in within(group, fingerprints(run, part, size, votes)):
                item, start = group.items[i], int(part[p])
                value = similarity(index, item, run[start:start + size])
                if 100 * value >= percent - 1e-9 and value > best.get(item, (0.0, 0))[0]:
                    best[item] = (value, start)
    return [(item, value, start) for item, (value, start) in sorted(best.items())]


def _hits(index: Index, run: np.ndarray) -> np.ndarray:
    hit = index.maybe[(run >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    at = np.flatnonzero(hit)
    hit[at] = index.known[np.minimum(np.searchsorted(index.known, run[at]), len(index.known) - 1)] == run[at]
    return hit


def _found(index: Index, texts: pa.Array):
    """(row, matches) of the batch's texts that hold an item."""
    if not len(index.known):
        return
    least = min(g.size for g in index.groups)
    for chunk in chunks(texts):
        run, bounds = shingles(chunk, WORDS_PER_SHINGLE)
        hit = _hits(index, run)
        if not hit.any():
            continue
        held = np.concatenate([[0], np.cumsum(hit)])[bounds]
        size = np.diff(bounds)
        for i in np.flatnonzero((np.diff(held) > 0) & (100 * np.diff(held) >= PERCENT * np.minimum(size, least))):
            got = matches(index, run[bounds[i]:bounds[i + 1]], hit[bounds[i]:bounds[i + 1]])
            if got:
                yield chunk.first + int(i), got


def indexes(benchmark: DataFrame) -> list[Index]:
    """Indexes over blocks of items (item_id, text); shingle weights are those of the whole benchmark."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                values, bounds = shingles(chunk, WORDS_PER_SHINGLE)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(chunk.first, chunk.last - chunk.first),
                     pa.array([values[a:b].view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int64()))],
                    names=["item_id", "shingles"])

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(run, "item_id bigint, shingles array<bigint>").where("size(shingles) > 0").distinct()
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    counts = (items.select("shingles").distinct().select(F.explode(F.array_distinct("shingles")).alias("s"))
              .groupBy("s").count().where("count > 1"))
    out = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == block)
        rows = mine.orderBy("item_id", "shingles").collect()
        shared = counts.join(mine.select(F.explode("shingles").alias("s")).distinct(), "s").collect()
        out.append(build_index([(r.item_id, np.array(r.shingles, np.int64).view(np.uint64)) for r in rows],
                               {r.s & 0xFFFFFFFFFFFFFFFF: r["count"] for r in shared}))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): each item that a row of docs (doc_id, text) holds,
    with its best window (the first of equal ones).

    Null and empty texts hold nothing; an item without words matches nothing, one of fewer than five
    words only a text of just these words. A text shorter than an item is one window. Repeated items
    count once, items with equal texts are all reported, repeated rows of docs each on their own. Null
    ids stay null. Empty tables give an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                rows = [(at, item, value, start) for at, got in _found(sent.value, batch.column("text"))
                        for item, value, start in got]
                if rows:
                    at, item, value, start = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(at)), pa.array([sent.value.ids[i] for i in item], pa.int64()),
                         pa.array(value, pa.float64()), pa.array(start, pa.int64())],
                        names=["doc_id", "item_id", "similarity", "first_word"])

        found = docs.mapInArrow(run, "doc_id bigint, item_id bigint, similarity double, first_word bigint")
        out = found if out is None else out.unionByName(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, with all their columns."""
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[at for at, _ in _found(sent.value, batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
