"""LM scoring with Brown class-based n-grams.

P(word | previous) = P(class | previous class) * P(word | class). Classes come from exchange
clustering: a unit moves to the class that raises the likelihood of the class bigrams most, given
the classes of all others; moves are made in batches that raise the likelihood, until it has
settled. Units are all words of at least the count that SHARE of the tokens reach, so their number
grows with the text, and one unit holds all rarer words meanwhile. After that each rarer word
chooses its class by the classes of its own neighbours. Words that the training text lacks get the
class that most of the words seen once have.

All counts cover the whole training text. Bigrams, and counts and classes of words, stay tables;
tasks are sent the digests of the units while bigrams are counted and one class number a unit in the
exchange. In scoring they are sent the FREQUENT most frequent units only; all other words get their
counts and classes by a join.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, new_path, release, small_batches, written
from .words import END_WORD, chunks, mix

FREQUENT = 1 << 18  # words whose counts and classes are sent to the tasks that score
SHARE = 0.95  # of the tokens, held at least by the words that are units
CLASSES = 64
SHARES = 4  # hashed shares of the units, which move in turn
SETTLED = 1e-3  # nats a token; exchange ends when a turn of all shares gains no more
PRIOR = 5.0  # weight of the class frequencies in the class transitions
FIRST, STEP = 4096, 16  # most frequent units that exchange first, among themselves; steps to all units
EARLIER = 1e-2  # nats a token, at which the exchange among these gives way to the next step
SMALL = 16  # counts whose rises are tabulated
PACK = 1 << 18  # about so many pairs begin, and end, with the units of a packed row
PACKED = ("ru", "rv", "rn", "lv", "lu", "ln")
PAIRS = "share int, " + ", ".join(f"{c} binary" for c in PACKED)
DEALT = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
NUMBERS = (np.int32, np.int32, np.int64)  # of packed units, units and counts
END = np.array([END_WORD], np.uint64)
FLUSH = 1 << 22
HELD = 1 << 20  # tokens whose pairs a task packs at once
SLICE = 512  # class bigram counts that are summed together


class Model(NamedTuple):
    tokens: int  # in the training text, ends included
    types: int
    words: np.ndarray  # frequent words, ascending, their counts and their classes
    counts: np.ndarray
    classes: np.ndarray
    unseen: int  # class of the words that are not in the training text
    transitions: np.ndarray  # log10 P(class | previous class)
    class_tokens: np.ndarray
    class_types: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Fifth of the documents that the model doesn't learn from; null ids are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _sequence(chunk) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds) of a chunk with an end token after each text."""
    texts = len(chunk.bounds) - 1
    bounds = chunk.bounds + np.arange(texts + 1)
    words = np.full(int(bounds[-1]), END_WORD, np.uint64)
    place = np.ones(len(words), bool)
    place[bounds[1:] - 1] = False
    words[place] = chunk.words
    return words, bounds


def _found(words: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the ascending table, whether it is there) of each word."""
    if not len(table):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return at, table[at] == words


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts, ends included."""

    def run(batches):
        held, size = [], 0

        def packed():
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                held.append(_sequence(chunk)[0])
                size += len(held[-1])
                if size > FLUSH:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(vocabulary: DataFrame) -> int:
    """The greatest count such that words of at least that count hold SHARE of the tokens."""
    rows = vocabulary.groupBy("n").agg((F.count("*") * F.col("n")).alias("tokens")).orderBy(F.desc("n")).toArrow()
    n, tokens = rows.column("n").to_numpy(), np.cumsum(rows.column("tokens").to_numpy())
    return int(n[np.searchsorted(tokens, SHARE * tokens[-1])]) if len(n) else 1


def unit_bigrams(docs: DataFrame, top: np.ndarray, units: np.ndarray, blocks: int) -> DataFrame:
    """What stands side by side, as two kinds of rows, counted in parts that are yet to be summed.

    Rows with a block are packed pairs of units for packed_pairs; all words without a unit of their own
    have the last one. Rows without are (u, v, uw, vw, count) for pairs with such words: uw and vw are
    these, else null."""
    sent = docs.sparkSession.sparkContext.broadcast((top, units))
    total = len(top) + 1

    def run(batches):
        held, size = [], 0

        def packed():
            every = np.concatenate([END, *held])  # all parts end with an end, so each word's predecessor stands before it
            before, words = every[:-1], every[1:]
            top, units = sent.value
            at, hit = _found(every, top)
            unit = np.full(len(every), total - 1)
            unit[hit] = units[at[hit]]
            u, v, hit_before, hit = unit[:-1], unit[1:], hit[:-1], hit[1:]
            keys, counts = np.unique(u * total + v, return_counts=True)
            rows = _dealt(keys // total, keys % total, counts, blocks)
            yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(rows[0]), t) for t in kinds)], names=names)
            one = np.flatnonzero(~(hit & hit_before))
            rows = [pa.array(u[one], pa.int32()), pa.array(v[one], pa.int32()), pa.array(before[one].view(np.int64), mask=hit_before[one]),
                    pa.array(words[one].view(np.int64), mask=hit[one]), pa.array(np.ones(len(one), np.int64))]
            for first in range(0, len(one), FLUSH >> 4):
                part = [x.slice(first, FLUSH >> 4) for x in rows]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part[0]), t) for t in DEALT), *part], names=names)

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                held.append(_sequence(chunk)[0])
                size += len(held[-1])
                if size > HELD:
                    yield from packed()
                    held, size = [], 0
        if size:
            yield from packed()

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["block", "side", "x", "y", "n", "u", "v", "uw", "vw", "count"]
    return docs.select("text").mapInArrow(
        run, "block bigint, side int, x binary, y binary, n binary, u int, v int, uw bigint, vw bigint, count bigint")


def _dealt(u: np.ndarray, v: np.ndarray, n: np.ndarray, blocks: int) -> list:
    """Packed rows (block, side, x, y, n) of pairs: side 0 by the block of u, side 1 (v, u) by that of v."""
    rows = []
    for side, (x, y) in enumerate(((u, v), (v, u))):
        block = (mix(x.astype(np.uint64), 9) % np.uint64(SHARES * blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.diff(block[order], prepend=-1))
        for at in np.split(order, starts[1:]) if len(order) else []:
            rows.append((block[at[0]], side, *(z[at].astype(t).tobytes() for z, t in zip((x, y, n), NUMBERS))))
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(DEALT)]


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_moves(joint: np.ndarray, sides: np.ndarray, selves: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, gain) of each unit: where it raises the likelihood of class bigrams most, and by how much.

    joint: class bigram counts; sides: (units, 2, classes), how often a unit stands before and after
    each class; selves: how often it follows itself; old: its class. The likelihood is the sum of
    g(joint) less g of both margins, g(x) = x log x; ties go to the old class, then to the smallest.
    Rises of g by small counts come from a table.
    """
    joint = joint.astype(float)
    few = np.arange(1, SMALL + 1, dtype=float)[None, :, None]
    tables = [(t, _g(t), _g(t[:, None] + few) - _g(t)[:, None]) for t in (np.ascontiguousarray(joint.T), joint)]
    found, gains = np.zeros(len(old), np.int64), np.zeros(len(old))
    for first in range(0, len(old), 4096):
        part = slice(first, first + 4096)
        near, o, own = sides[part].astype(float), old[part], selves[part].astype(float)
        every = np.arange(len(o))
        gain = np.zeros((len(o), len(joint)))
        for side, (table, g, rises) in enumerate(tables):
            units, classes = np.nonzero(near[:, side])
            for k in range(0, len(units), 1 << 15):
                i, c = units[k:k + (1 << 15)], classes[k:k + (1 << 15)]
                n = near[i, side, c]
                rise = rises[c, np.minimum(n, SMALL).astype(np.int64) - 1]
                many = np.flatnonzero(n > SMALL)
                rise[many] = _g(table[c[many]] + n[many, None]) - g[c[many]]
                here = table[c, o[i]]  # the unit itself is no longer in its old class
                rise[np.arange(len(i)), o[i]] = _g(here) - _g(here - n)
                same = np.flatnonzero(c == o[i])
                rest, m = table[c[same]] - near[i[same], 1 - side], n[same] - own[i[same]]
                rest[np.arange(len(same)), o[i[same]]] += own[i[same]] - n[same]
                rise[same] = _g(rest + m[:, None]) - _g(rest)
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                length = np.diff(starts, append=len(i))
                while len(starts):  # the next class of all units that have one
                    gain[i[starts]] += rise[starts]
                    starts, length = starts[length > 1] + 1, length[length > 1] - 1
        r, l = near[:, 0].copy(), near[:, 1].copy()
        r[every, o] -= own
        l[every, o] -= own
        i, c = np.nonzero((r != 0) & (l != 0) | (own != 0)[:, None])  # elsewhere these terms cancel
        d = np.diag(joint)[c] - np.where(c == o[i], near[i, 0, c] + near[i, 1, c] - own[i], 0)
        x, y = r[i, c], l[i, c]
        gain[i, c] += _g(d + x + y + own[i]) + _g(d) - _g(d + x) - _g(d + y)
        # The margins of the others' tokens don't depend on where the unit goes.
        for side in (0, 1):
            margin = joint.sum(axis=1 - side)
            n, at = np.unique(near[:, side].sum(axis=1), return_inverse=True)
            rise = (_g(margin + n[:, None]) - _g(margin))[at]
            rise[every, o] = _g(margin[o]) - _g(margin[o] - n[at])
            gain -= rise
        here = gain[every, o].copy()
        gain[every, o] += 1e-9 * np.maximum(1.0, abs(here))
        found[part] = gain.argmax(axis=1)
        gains[part] = np.where(found[part] == o, 0, gain[every, found[part]] - here)
    return found, gains


def best_class(joint: np.ndarray, right: np.ndarray, left: np.ndarray, own: int, old: int) -> int:
    """The class to which a unit of class `old` moves; see best_moves."""
    return int(best_moves(joint, np.stack([right, left])[None], np.array([own]), np.array([old]))[0][0])


def likelihood(joint: np.ndarray) -> float:
    """Log likelihood of the class bigrams, without what no class changes."""
    return float(_g(joint).sum() - _g(joint.sum(axis=0)).sum() - _g(joint.sum(axis=1)).sum())


def _square(found: DataFrame, first: int, classes: int) -> np.ndarray:
    rows = found.toArrow()
    out = np.zeros(first * classes * classes, np.int64)
    out[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(first, classes, classes)


def packed_pairs(dealt: DataFrame, total: int) -> DataFrame:
    """The summed pairs of what _dealt made, a row for each block, written by share of the units: a row has
    all pairs that begin with its units (ru, rv, rn) and all that end with them (lv, lu, ln)."""

    def merge(group):
        out = {"share": pa.array([group.column("block")[0].as_py() % SHARES], pa.int32())}
        for side, names in enumerate((("ru", "rv", "rn"), ("lv", "lu", "ln"))):
            own = group.filter(pa.compute.equal(group.column("side"), side))
            x, y, n = (np.frombuffer(b"".join(own.column(c).to_pylist()), t) for c, t in zip(("x", "y", "n"), NUMBERS))
            keys, at = np.unique(x.astype(np.int64) * total + y, return_inverse=True)
            for name, z, t in zip(names, (keys // total, keys % total, np.bincount(at, n, len(keys))), NUMBERS):
                out[name] = pa.array([z.astype(t).tobytes()], pa.binary())
        return pa.table(out)

    rows = dealt.select("block", "side", "x", "y", "n").groupBy("block").applyInArrow(merge, PAIRS)
    return _by_share(rows)


def _by_share(rows: DataFrame) -> DataFrame:
    path = new_path(rows.sparkSession, "pairs")
    rows.write.partitionBy("share").parquet(path)
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    table.written_to = path
    return table


def pairs_among(pairs: DataFrame, top: int) -> DataFrame:
    """The packed pairs of which both units are below top."""

    def run(batches):
        for batch in batches:
            for share, row in zip(batch.column("share").to_pylist(), _arrays(batch, PACKED)):
                columns = [pa.array([share], pa.int32())]
                for side in (row[:3], row[3:]):
                    own = np.flatnonzero(np.maximum(side[0], side[1]) < top)
                    columns += [pa.array([x[own].tobytes()], pa.binary()) for x in side]
                yield pa.RecordBatch.from_arrays(columns, names=["share", *PACKED])

    return _by_share(pairs.select("share", *PACKED).mapInArrow(run, PAIRS))


def pairs_of(bigrams: DataFrame, total: int) -> DataFrame:
    """Packed pairs of a table (u, v, n)."""
    blocks = max(1, -(-bigrams.count() // (SHARES * PACK)))

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "n"))
            yield pa.RecordBatch.from_arrays(_dealt(*columns, blocks), names=["block", "side", "x", "y", "n"])

    return packed_pairs(bigrams.select("u", "v", "n").mapInArrow(run, "block bigint, side int, x binary, y binary, n binary"), total)


def _arrays(batch, names):
    """The numbers of each row of a batch of packed_pairs."""
    for row in range(batch.num_rows):
        yield [np.frombuffer(batch.column(c)[row].as_buffer(), np.int64 if c.endswith("n") else np.int32) for c in names]


def _own_pairs(batches):
    """(u, n) of the units that follow themselves."""
    for batch in batches:
        for u, v, n in _arrays(batch, PACKED[:3]):
            same = np.flatnonzero(u == v)
            yield pa.RecordBatch.from_arrays([pa.array(u[same]), pa.array(n[same])], names=["u", "n"])


def _summing(begin, pairs: DataFrame, shape: tuple) -> np.ndarray:
    """The sums over all rows of pairs of what run = begin() makes of their six arrays, an array of this
    shape. Tasks send some numbers to a row, as a frame of one row for each number would be large."""

    def parts(batches):
        run, sums = begin(), np.zeros(shape)
        for batch in batches:
            for row in _arrays(batch, PACKED):
                sums += run(*row)
        flat = sums.ravel().astype(np.int64)
        keys = [k for k in range(0, len(flat), SLICE) if flat[k:k + SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([flat[k:k + SLICE].tobytes() for k in keys], pa.binary())],
                                         names=["key", "sums"])

    def add(group):
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in group.column("sums"))
        return pa.table({"key": pa.array([group.column("key")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    kinds = "key int, sums binary"
    rows = pairs.select(*PACKED).mapInArrow(parts, kinds).groupBy("key").applyInArrow(add, kinds).toArrow()
    out = np.zeros(int(np.prod(shape)), np.int64)
    for key, sums in zip(rows.column("key").to_pylist(), rows.column("sums").to_pylist()):
        part = np.frombuffer(sums, np.int64)
        out[key:key + len(part)] = part
    return out.reshape(shape)


def _proposals(pairs: DataFrame, joint: np.ndarray, kind: np.ndarray, selves, turn: int) -> tuple:
    """(units, classes, gains) of the share of units whose turn it is and that gain by a move, most first;
    selves is a broadcast."""
    classes = len(joint)
    sent = pairs.sparkSession.sparkContext.broadcast((joint, kind.astype(np.int32)))

    def choose(batches):
        joint, kind = sent.value
        for batch in batches:
            for ru, rv, rn, lv, lu, ln in _arrays(batch, PACKED):
                units, at = np.unique(np.concatenate([ru, lv]), return_inverse=True)
                side = np.repeat([0, classes], [len(ru), len(lv)])
                sides = np.bincount(2 * classes * at + side + kind[np.concatenate([rv, lu])], np.concatenate([rn, ln]),
                                    2 * classes * len(units)).reshape(-1, 2, classes)
                new, gains = best_moves(joint, sides, selves.value[units], kind[units])
                up = gains > 0
                yield pa.RecordBatch.from_arrays([pa.array(units[up], pa.int32()), pa.array(new[up], pa.int32()), pa.array(gains[up])],
                                                 names=["unit", "cls", "gain"])

    rows = pairs.where(F.col("share") == turn % SHARES).select(*PACKED).mapInArrow(choose, "unit int, cls int, gain double").toArrow()
    units, new, gains = (rows.column(c).to_numpy() for c in ("unit", "cls", "gain"))
    order = np.lexsort((units, -gains))
    sent.destroy()  # its file too, which unpersist() leaves
    return units[order], new[order], gains[order]


def _trials(pairs: DataFrame, joint: np.ndarray, kind: np.ndarray, units: np.ndarray, new: np.ndarray, sizes: list[int],
            turn: int) -> np.ndarray:
    """Class bigram counts after the first moves, for each of the sizes (the greatest first). The units
    are of the share whose turn it is, whose rows hold all pairs that change."""
    classes = len(joint)
    sent = pairs.sparkSession.sparkContext.broadcast((kind.astype(np.int32), units, new))

    def begin():
        kind, units, new = sent.value
        rank = np.full(len(kind), len(units), np.int32)  # place among the moves
        rank[units] = np.arange(len(units))
        goes = kind.copy()
        goes[units] = new

        def change(ru, rv, rn, lv, lu, ln):
            sums = np.zeros((len(sizes), classes ** 2))
            right = np.flatnonzero(rank[ru] < len(units))
            left = np.flatnonzero((rank[lv] < len(units)) & (rank[lu] == len(units)))  # both moved: among the first
            u, v, n = (np.concatenate(x) for x in ((ru[right], lu[left]), (rv[right], lv[left]), (rn[right], ln[left])))
            u_rank, v_rank, ku, kv, gu, gv = rank[u], rank[v], kind[u], kind[v], goes[u], goes[v]
            for i, size in enumerate(sizes):
                if i:
                    own = np.flatnonzero(np.minimum(u_rank, v_rank) < size)
                    n, u_rank, v_rank, ku, kv, gu, gv = (x[own] for x in (n, u_rank, v_rank, ku, kv, gu, gv))
                after = np.where(u_rank < size, gu, ku) * classes + np.where(v_rank < size, gv, kv)
                sums[i] = np.bincount(after, n, classes ** 2) - np.bincount(ku * classes + kv, n, classes ** 2)
            return sums

        return change

    mine = pairs.where(F.col("share") == turn % SHARES)
    out = joint + _summing(begin, mine, (len(sizes), classes ** 2)).reshape(-1, classes, classes)
    sent.destroy()
    return out


def exchange(bigrams: DataFrame, kind: np.ndarray, classes: int = CLASSES, settled: float = SETTLED,
             watch=None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts), from the classes in kind on.

    The pairs of units are summed and packed once, all pairs of a unit in one row, so that no round
    shuffles them. Each round is two Spark jobs. A hashed share of the units choose their best class, given
    those of all others; then the class bigrams are counted anew for the whole batch and for ever fewer of its
    moves of the greatest gain, down to one move, whose gain is exact. The best batch is applied, so the
    likelihood rises in every round that moves a unit. Rounds end when all shares together gained
    no more than `settled` nats a token (0: when no move gains). watch is called with each likelihood.
    """
    pairs = pairs_of(bigrams, len(kind))
    try:
        return exchange_packed(pairs, kind, classes, settled, watch)
    finally:
        discard(pairs)


def exchange_packed(pairs: DataFrame, kind: np.ndarray, classes: int = CLASSES, settled: float = SETTLED,
                    watch=None) -> tuple[np.ndarray, np.ndarray]:
    """exchange over packed pairs."""
    kind = kind.astype(np.int64)
    selves = np.zeros(len(kind), np.int64)
    with small_batches(pairs.sparkSession, 1):
        own = pairs.select(*PACKED[:3]).mapInArrow(_own_pairs, "u int, n bigint").toArrow()
        selves[own.column("u").to_numpy()] = own.column("n").to_numpy()
        sent = pairs.sparkSession.sparkContext.broadcast(kind.copy())
        joint = _summing(lambda: lambda u, v, n, *_: np.bincount(sent.value[u] * classes + sent.value[v], n, classes ** 2),
                         pairs, (classes ** 2,)).reshape(classes, classes)
        sent.destroy()
        sent = pairs.sparkSession.sparkContext.broadcast(selves)
        values = [likelihood(joint)]
        while joint.any():
            units, new, _ = _proposals(pairs, joint, kind, sent, len(values) - 1)
            best = values[-1]
            if len(units):
                sizes = sorted({max(1, len(units) >> k) for k in (0, 1, 3, 6, 9, 12, 15, 18, 99)}, reverse=True)
                tried = _trials(pairs, joint, kind, units, new, sizes, len(values) - 1)
                scores = [likelihood(t) for t in tried]
                k = int(np.argmax(scores))
                if scores[k] > best:
                    best, joint = scores[k], tried[k]
                    kind[units[:sizes[k]]] = new[:sizes[k]]
            values.append(best)
            if watch:
                watch(best)
            if len(values) > SHARES and values[-1] - values[-1 - SHARES] <= settled * joint.sum():
                break
        sent.destroy()
    release(pairs.sparkSession)
    return kind, joint


def place_rare(bigrams: DataFrame, kind: np.ndarray, joint: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """((word, cls) of the words in the last unit, class bigram counts after that).

    Each word chooses the class that the counts of its own neighbours' classes favour. Of all the
    moves, and those of ever greater gain, the set of the greatest likelihood is made; a word that
    doesn't move stays in the class of the last unit."""
    spark, classes, rest = bigrams.sparkSession, len(joint), int(kind[-1])
    sent = spark.sparkContext.broadcast((joint, kind))

    def classed(batches):
        for batch in batches:
            cu, cv = (pa.array(sent.value[1][batch.column(c).to_numpy()], pa.int32()) for c in ("u", "v"))
            yield pa.RecordBatch.from_arrays([batch.column("uw"), cu, batch.column("vw"), cv, batch.column("n")],
                                             names=["uw", "cu", "vw", "cv", "n"])

    edges = written(bigrams.where("uw IS NOT NULL OR vw IS NOT NULL").mapInArrow(
        classed, "uw bigint, cu int, vw bigint, cv int, n bigint"), "edges")
    near = (edges.where("uw IS NOT NULL").selectExpr("uw AS word", "0 AS side", "cv AS cls", "n", "if(uw <=> vw, n, 0) AS own")
            .unionByName(edges.where("vw IS NOT NULL").selectExpr("vw AS word", "1 AS side", "cu AS cls", "n", "0L AS own"))
            .groupBy("word", "side", "cls").agg(F.sum("n").alias("n"), F.sum("own").alias("own")))

    def choose(group):
        word, side, cls, n, own = (group.column(c).to_numpy() for c in ("word", "side", "cls", "n", "own"))
        words, at = np.unique(word, return_inverse=True)
        sides = np.zeros((len(words), 2, classes), np.int64)
        sides[at, side, cls] = n
        selves = np.bincount(at, own, len(words))
        new, gains = best_moves(sent.value[0], sides, selves, np.full(len(words), rest))
        return pa.table({"word": pa.array(words), "cls": pa.array(new, pa.int32()), "gain": pa.array(gains)})

    blocks = max(32, edges.count() // 8192)
    moves = written(near.groupBy(F.pmod(F.xxhash64("word"), F.lit(blocks))).applyInArrow(
        choose, "word bigint, cls int, gain double"), "rare").where("gain > 0")
    limits = moves.approxQuantile("gain", [0.0, 0.5, 0.75, 0.9, 0.99, 1.0], 0.005)
    if not limits:
        discard(edges)
        return moves.select("word", "cls"), joint

    def side(rows, word, old):
        """rows with the moves of one of their words; rows without such a word as they are."""
        of = moves.select(F.col("word").alias(word), F.col("cls").alias(f"new_{old}"), F.col("gain").alias(f"gain_{old}"))
        return rows.where(f"{word} IS NOT NULL").join(of, word, "left").unionByName(
            rows.where(f"{word} IS NULL"), allowMissingColumns=True)

    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("least")) for i, x in enumerate(limits)])
    after = lambda old: F.when(F.col(f"gain_{old}") >= F.col("try.least"), F.col(f"new_{old}")).otherwise(F.col(old))
    square = lambda cu, cv: (cu * classes + cv).cast("bigint").alias("key")
    ahead = side(side(edges, "uw", "cu"), "vw", "cv").withColumn("try", F.explode(tries))
    tried = _square(ahead.groupBy((F.col("try.i") * classes ** 2 + square(after("cu"), after("cv"))).alias("key"))
                    .agg(F.sum("n").alias("n")), len(limits), classes)
    tried = tried + joint - _square(edges.groupBy(square(F.col("cu"), F.col("cv"))).agg(F.sum("n").alias("n")), 1, classes)
    discard(edges)
    scores = [likelihood(t) for t in tried]
    k = int(np.argmax(scores))
    if scores[k] <= likelihood(joint):
        return moves.where("false").select("word", "cls"), joint
    return moves.where(F.col("gain") >= limits[k]).select("word", "cls"), tried[k]


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the (word, n, cls) table of all its words."""
    spark = docs.sparkSession
    counted = written(word_counts(docs), "words")
    size = counted.agg(F.sum("n"), F.count("*")).first()
    least = least_count(counted)
    often = counted.where(F.col("n") >= least).toArrow()
    words, counts = often.column("word").to_numpy(), often.column("n").to_numpy()
    order = np.lexsort((words, -counts))
    words, counts = words[order].view(np.uint64), counts[order]
    units = np.argsort(words)
    with small_batches(spark, FLUSH >> 2):
        with small_batches(spark, 2000):
            blocks = max(1, -(-(size[0] or 0) // (2 * SHARES * PACK)))  # a pair stands about twice in the text
            found = written(unit_bigrams(docs, words[units], units, blocks), "bigrams")
        with small_batches(spark, 16):
            pairs = packed_pairs(found.where("block IS NOT NULL"), len(words) + 1)
        release(spark)
        kind, top = np.arange(len(words) + 1) % CLASSES, FIRST
        while top < len(kind):
            with small_batches(spark, 1):
                among = pairs_among(pairs, top)
            kind[:top] = exchange_packed(among, kind[:top], settled=EARLIER)[0]
            discard(among)
            top *= STEP
        kind, joint = exchange_packed(pairs, kind)
        discard(pairs)
        bigrams = found.where("block IS NULL").select("u", "v", "uw", "vw", F.col("count").alias("n"))
        moved, joint = place_rare(bigrams, kind, joint)
        discard(found)
    release(spark)
    known = spark.createDataFrame(pa.table({"word": words.view(np.int64), "n": counts, "cls": pa.array(kind[:-1], pa.int32())}))
    rare = counted.where(F.col("n") < least).join(moved, "word", "left")
    vocabulary = written(known.unionByName(rare.select("word", "n", F.coalesce("cls", F.lit(int(kind[-1]))).alias("cls"))), "classes")
    discard(counted)
    types, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in vocabulary.groupBy("cls").agg(F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once")).collect():
        types[row.cls], once[row.cls] = row.types, row.once
    unseen = int(np.argmax(once if once.any() else types))
    tokens = joint.sum(axis=0).astype(float)
    share = (tokens + 1) / (tokens.sum() + CLASSES)
    moves = (joint + PRIOR * share[None, :]) / (joint.sum(axis=1) + PRIOR)[:, None]
    order = np.argsort(words[:FREQUENT])
    return Model(size[0] or 0, size[1], words[order], counts[order], kind[order], unseen, np.log10(moves), tokens, types), vocabulary


def score_texts(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """All of docs with n_tokens, n_known, base_score and score; see class_lm_scores."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    floor = model.tokens + 0.5 * (model.types + 1)
    room = model.class_tokens + model.class_types + 1
    kinds = {"kind": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(),
             "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "before": pa.int64(),
             "before_cls": pa.int32(), "word": pa.int64(), "cls": pa.int32()}

    def run(batches):
        m = sent.value
        part, count = TaskContext.get().partitionId() << 33, 0

        def packed(n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c]).cast(t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()],
                                              names=list(kinds))

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                words, bounds = _sequence(chunk)
                every = np.concatenate([END, words])
                at, hit = _found(every, m.words)
                before, at_before, hit_before, at, hit = every[:-1], at[:-1], hit[:-1], at[1:], hit[1:]
                n, cls, cls_before = np.zeros(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                n[hit], cls[hit], cls_before[hit_before] = m.counts[at[hit]], m.classes[at[hit]], m.classes[at_before[hit_before]]
                both = hit & hit_before
                base = np.log10((n + 0.5) / floor)  # words not found are counted as unseen so far
                score = np.where(hit, np.log10(np.maximum(n, 1) / room[cls]), 0) + np.where(both, m.transitions[cls_before, cls], 0)
                sums = lambda x: np.add.reduceat(x, bounds[:-1])
                size = len(bounds) - 1
                rows = part + count + np.arange(size)
                count += size
                yield packed(size, kind=np.zeros(size, np.int32), row=rows, doc_id=batch.column("doc_id").slice(chunk.first, size),
                             held_out=batch.column("held_out").slice(chunk.first, size), n_tokens=np.diff(bounds),
                             n_known=sums(hit.astype(np.int64)), base_score=sums(base), score=sums(score))
                left = np.flatnonzero(~both)
                if len(left):
                    unless = lambda x, null: pa.array(x[left], mask=null[left])
                    yield packed(len(left), kind=np.ones(len(left), np.int32), row=rows[np.searchsorted(bounds, left, "right") - 1],
                                 before=unless(before.view(np.int64), hit_before), before_cls=unless(cls_before, ~hit_before),
                                 word=unless(words.view(np.int64), hit), cls=unless(cls, ~hit))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        held_out(F.col("doc_id")).alias("held_out"))
    found = written(texts.mapInArrow(
        run, "kind int, row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
             "score double, before bigint, before_cls int, word bigint, cls int"), "scores")

    def looked_up(rows, word):
        of = vocabulary.select(F.col("word").alias(word), F.col("n").alias(f"{word}_n"), F.col("cls").alias(f"{word}_found"))
        return rows.where(f"{word} IS NOT NULL").join(of.hint("shuffle_hash"), word, "left").unionByName(
            rows.where(f"{word} IS NULL"), allowMissingColumns=True)

    left = looked_up(looked_up(found.where("kind = 1").select("row", "before", "before_cls", "word", "cls"), "word"), "before")
    left = left.select("row", "word", F.col("word_n").alias("n"), F.coalesce("before_cls", "before_found", F.lit(model.unseen)).alias("p"),
                       F.coalesce("cls", "word_found", F.lit(model.unseen)).alias("c"))
    steps = F.broadcast(spark.createDataFrame([(p, c, float(x), float(np.log10(room[c]))) for (p, c), x in np.ndenumerate(model.transitions)],
                                              "p int, c int, move double, room double"))
    more = left.join(steps, ["p", "c"]).groupBy("row").agg(
        F.count("n").alias("more_known"), F.sum(F.log10((F.col("n") + 0.5) / 0.5)).alias("more_base"),
        F.sum(F.col("move") + F.when(F.col("word").isNotNull(), F.log10(F.coalesce("n", F.lit(1))) - F.col("room"))
              .otherwise(0.0)).alias("more_score"))
    return found.where("kind = 0").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


def class_lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), a row for
    each row of docs (doc_id, text; other columns are ignored).

    Tokens are the words (white space apart, A-Z lower-cased) and an end. The model learns from the
    texts that are not held out. base_score is the log10 probability under add-half unigrams, score
    that of the class model: transitions smoothed by class frequencies; within a class of N tokens and
    T types a word seen n times has n / (N + T + 1), an unseen one 1 / (N + T + 1), which leaves room for
    as many unseen types as there are seen ones, and one more. Null and empty
    texts are one end. Repeated rows are learned and scored one by one; without training texts every
    word is unseen; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    with small_batches(docs.sparkSession, 2000):
        model, vocabulary = train(docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text")))
        scored = score_texts(docs, model, vocabulary)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
