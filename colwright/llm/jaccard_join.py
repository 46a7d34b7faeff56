"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets with Jaccard similarity of at least t, of sizes n <= m, share a token among the first
n - ceil(t n) + 1 tokens of each set, whatever total order sorts the tokens; of prefixes longer by e tokens
they share e + 1. So a pair that shares too few prefix tokens under any one of the orders is no link.
The first order puts frequent tokens last and makes the candidates by one shuffle of the prefixes; a
set that shares fewer of its tokens with all others together than a link takes has no link and leaves.
The other orders (plain mixed digests) test candidates before sets are intersected in full: one by
longer prefixes in 32-bit digests, which travel in place of the sets, the last one where two whole
sets meet.

No group is written out as pairs. Texts with equal sets are one class. The list of a prefix token is
named by its least set, its hub, and lists with one hub are joined. A set needs its hubs, in one order
of all hubs, only as long as those from there on hold as many of its tokens as a link shares: the first
hub that two linked sets have in common is among them for both. The sets of a hub are cut into groups of
neighbouring size bands, so two sets that can link share a group. A first
turn compares every set with the centres of its groups, and the links found merge classes into
components. A second turn compares, in groups that still span several
components, only sets of different components: the group is cut into blocks of bounded size, each
pair of blocks meets in one task, and only links leave it. Every link between different sets thus
has either been tested or lies within one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, release, small_batches, written
from .graph import components
from .words import chunks, distinct_sets, mix, shingles

HEAVY_TOKENS = 1 << 18  # bound of the table of frequent tokens that tasks are sent
ID_BITS = 1 << 23  # bits of the table that keeps texts without candidates from being read again
BLOCK_SETS, BLOCK_ITEMS = 128, 1 << 19  # sets and tokens of one group that make a block
LIGHT_ORDER, LAST_ORDER = 5, 6  # salts of the orders that test candidates
FLUSH = 1 << 22


def _prefix_size(n, percent: int):
    """n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def _extra(n, percent: int):
    """Tokens by which the prefixes of the first order are longer than those that share one token."""
    return percent * n // 2000


def _least_shared(n: str, percent: int):
    """Prefix tokens that a set of size n shares with each set that it links with: one more than the
    extra tokens of the smallest set that may link."""
    return F.expr(f"1 + {percent}L * (({percent}L * {n} + 99) div 100) div 2000")


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct digests, bounds) chunk by chunk."""
    for chunk in chunks(batch.column("text")):
        yield chunk.first, *distinct_sets(*shingles(chunk, k))


def _signature(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal for equal sets."""
    out = []
    for salt in (2, 3):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values, salt))])
            out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """One pass over the texts: a row per document (kind 0) with set size and signature, and rows
    (kind 1) of tokens that part of a task's texts repeat, with their counts there."""

    def run(batches):
        held, size = [], 0

        def frequent():
            tokens = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            count = np.diff(np.append(first, len(tokens)))
            keep = count >= 3
            n, zeros = int(keep.sum()), np.zeros(int(keep.sum()), np.int64)
            return _batch({"kind": np.ones(n, np.int32), "doc_id": pa.nulls(n, pa.int64()),
                           "n": count[keep].astype(np.int64),
                           "h1": tokens[first][keep].view(np.int64), "h2": zeros})

        for batch in batches:
            ids = batch.column("doc_id")
            for first, values, bounds in _sets(batch, k):
                h1, h2 = _signature(values, bounds)
                n = len(bounds) - 1
                yield _batch({"kind": np.zeros(n, np.int32), "doc_id": ids.slice(first, n),
                              "n": np.diff(bounds).astype(np.int64), "h1": h1, "h2": h2})
                held.append(values)
                size += len(values)
                if size > FLUSH:
                    yield frequent()
                    held, size = [], 0
        if size:
            yield frequent()

    return docs.mapInArrow(run, "kind int, doc_id bigint, n bigint, h1 bigint, h2 bigint")


def frequent_tokens(counts: DataFrame, most: int) -> np.ndarray:
    """The most frequent tokens of (token, n), most first, equal counts by token; about `most` at most.

    A histogram of the counts tells which to take, so the driver is sent no others; of the tokens of
    the last count, the share that there is room for goes by the digest."""
    rows = counts.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).toArrow()
    n, tokens = (rows.column(c).to_numpy() for c in ("n", "tokens"))
    whole = int(np.searchsorted(np.cumsum(tokens), most, "right"))
    taken = F.col("n") > int(n[whole]) if whole < len(n) else F.lit(True)
    if whole < len(n):
        room = most - int(tokens[:whole].sum())
        taken |= (F.col("n") == int(n[whole])) & (F.col("token") < (room << 64) // int(tokens[whole]) - (1 << 63))
    found = counts.where(taken).toArrow()
    token, n = (found.column(c).to_numpy() for c in ("token", "n"))
    return token[np.lexsort((token, -n))].view(np.uint64)


def _prefixes(docs: DataFrame, k: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """(token, doc_id, n) of each set's prefix under the order: rare before frequent, then digest.
    Equal sets in one task send one prefix."""
    order = np.argsort(heavy, kind="stable")
    tokens, ranks = heavy[order], order.astype(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast((tokens, ranks))

    def run(batches):
        tokens, ranks = sent.value
        seen = set()
        top = np.uint64(1 << 63)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, values, bounds in _sets(batch, k):
                known = ids.slice(first, len(bounds) - 1)
                valid = np.asarray(known.is_valid())
                known = np.asarray(known.fill_null(0))
                key = mix(values, 4) >> np.uint64(1)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
                    hit = tokens[at] == values
                    key[hit] = top + (np.uint64(len(tokens)) - ranks[at[hit]])
                h1, h2 = _signature(values, bounds)
                out, owner, sizes = [], [], []
                for i in np.flatnonzero(valid & (np.diff(bounds) > 0)):
                    mark = (int(h1[i]), int(h2[i]))
                    if mark in seen:
                        continue
                    seen.add(mark)
                    a, b = bounds[i], bounds[i + 1]
                    n = int(b - a)
                    p = _prefix_size(n, percent) + _extra(n, percent)
                    part = values[a:b] if p >= n else values[a:b][np.argpartition(key[a:b], p - 1)[:p]]
                    out.append(part)
                    owner.append(known[i])
                    sizes.append(n)
                if out:
                    lengths = [len(x) for x in out]
                    yield _batch({"token": np.concatenate(out).view(np.int64),
                                  "doc_id": np.repeat(np.array(owner, np.int64), lengths),
                                  "n": np.repeat(np.array(sizes, np.int32), lengths)})

    return docs.mapInArrow(run, "token bigint, doc_id bigint, n int")


def _lists(prefixes: DataFrame) -> DataFrame:
    """Tokens with several sets: (hub, doc_id, n, tokens), hub being the list's least set; to be summed.
    A stream over sorted rows: only the current list's hub is held between batches."""

    def run(batches):
        last = None  # the open list: its first row, and whether that row has been sent
        for batch in batches:
            token, doc, n = (np.asarray(batch.column(c)) for c in ("token", "doc_id", "n"))
            if not len(token):
                continue
            sent = bool(last and last[0] == token[0] and last[3])
            if last and last[0] == token[0]:
                token, doc, n = (np.concatenate([[x], y]) for x, y in zip(last[:3], (token, doc, n)))
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(begin, len(token)))
            hub = np.repeat(begin, length)
            keep = np.repeat(length > 1, length)
            if sent:
                keep[0] = False
            last = (token[hub[-1]], doc[hub[-1]], n[hub[-1]], bool(length[-1] > 1))
            if keep.any():
                rows, tokens = np.unique(np.stack([doc[hub[keep]], doc[keep], n[keep]]), axis=1, return_counts=True)
                yield _batch({"hub": rows[0], "doc_id": rows[1], "n": rows[2].astype(np.int32), "tokens": tokens})

    by_token = prefixes.repartition("token").sortWithinPartitions("token", "n", "doc_id")
    return by_token.mapInArrow(run, "hub bigint, doc_id bigint, n int, tokens bigint").groupBy("hub", "doc_id", "n").agg(
        F.sum("tokens").alias("tokens"))


def _id_bits(ids: DataFrame) -> np.ndarray:
    """A bit per digest of an id: a bounded table that may let other ids through, never loses one."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    found = (ids.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("part"))
             .agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits")).collect())
    out = np.zeros(ID_BITS // 8, np.uint8)
    for row in found:
        out[row.part * 4096:(row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _light_size(n, percent: int):
    """Tokens of a longer prefix, of which two linked sets must share many."""
    return np.minimum(n, _prefix_size(n, percent) + n // 10)


def _sets_of(docs: DataFrame, ids: DataFrame, k: int, light: int = 0) -> DataFrame:
    """(doc_id, items): the sets of the documents named by ids, as packed ascending digests; with
    light, a percentage, only their longer prefixes under the light order, in 32 bits."""
    sent = docs.sparkSession.sparkContext.broadcast(_id_bits(ids))

    def run(batches):  # sets of other documents may pass too; the join that follows drops them
        bits = sent.value
        for batch in batches:
            at = np.asarray(batch.column("bit"))
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for first, values, bounds in _sets(batch, k):
                if light:
                    values, bounds = _longer_prefixes(values, bounds, light)
                raw, size = values.tobytes(), values.itemsize
                known = batch.column("doc_id").slice(first, len(bounds) - 1)
                items = pa.array([raw[size * a:size * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([known, items], names=["doc_id", "items"])

    found = (docs.where("doc_id IS NOT NULL")
             .select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)).alias("bit")))
    return found.mapInArrow(run, "doc_id bigint, items binary")


def _longer_prefixes(values: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    parts, mixed = [], mix(values, LIGHT_ORDER)
    for a, b in zip(bounds[:-1], bounds[1:]):
        size = int(_light_size(b - a, percent))
        part = np.partition(mixed[a:b], size - 1)[:size] if 0 < size < b - a else mixed[a:b]
        parts.append(np.sort(part.astype(np.uint32)))
    return (np.concatenate(parts) if parts else values.astype(np.uint32)), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _numbered(values: np.ndarray) -> np.ndarray:
    """Ascending 32-bit digests made distinct by numbering equal ones: two sets then share at least as
    many as before they were cut to 32 bits."""
    first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    return (values.astype(np.uint64) << np.uint64(32)) + (np.arange(len(values)) - begin[np.cumsum(first) - 1]).astype(np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]))
    return int((both[1:] == both[:-1]).sum())


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share, by products of the incidence matrix, some columns at a time."""
    out = np.zeros((len(sets), len(sets)), np.float64)
    if len(sets) == 2:
        out[0, 1] = out[1, 0] = _common(*sets)
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(first) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1]
    for begin in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        out += part @ part.T
    return out


def _fitting(n: np.ndarray, allowed: np.ndarray, percent: int) -> np.ndarray:
    fits = 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    return np.triu(allowed & fits & np.outer(n > 0, n > 0), 1)


def light_pairs(prefixes: list[np.ndarray], n: np.ndarray, allowed: np.ndarray, percent: int) -> np.ndarray:
    """The allowed pairs (matrix, i < j) that may link by their longer prefixes under the light order.

    Linked sets of sizes x and y share at least o = ceil(t (x + y) / (1 + t)) tokens, hence of the
    first p tokens of one and q of the other at least min(p - x, q - y) + o.
    """
    allowed = _fitting(n, allowed, percent)
    if allowed.any():
        slack = np.array([len(x) for x in prefixes]) - n
        least = -(-percent * np.add.outer(n, n) // (100 + percent)) + np.minimum.outer(slack, slack)
        allowed &= _shared(prefixes) >= np.maximum(least, 1)
    return allowed


def linked(sets: list[np.ndarray], allowed: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The allowed pairs (i < j) of ascending digest sets that link: sizes, then the prefix filter of
    the last order, then the exact similarity."""
    n = np.array([len(x) for x in sets])
    allowed = _fitting(n, allowed, percent)
    for exact in (False, True):
        used = np.flatnonzero(allowed.any(axis=0) | allowed.any(axis=1))
        if not len(used):
            return []
        parts = [sets[i] for i in used]
        if not exact:
            parts = [np.partition(mix(x, LAST_ORDER), p - 1)[:p] for x, p in zip(parts, _prefix_size(n[used], percent))]
        shared, at = _shared(parts), np.ix_(used, used)
        allowed[at] &= (100 * shared >= percent * (n[used][:, None] + n[used][None, :] - shared)) if exact else shared > 0
    return [tuple(map(int, x)) for x in np.argwhere(allowed)]


def _meeting(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among rows (hub, band, i, j, side, doc_id, n, colour): sets meet by the first four;
    those of different sides are compared, or all where j is i, unless their colours are equal. Longer
    prefixes meet first; only sets with a possible partner are sent whole."""

    def seen(group, kind=np.uint64):
        colour, side = (np.asarray(group.column(c)) for c in ("colour", "side"))
        inside = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        items = [np.frombuffer(x.as_buffer(), kind) for x in group.column("items")]
        return items, (colour[:, None] != colour[None, :]) & (inside | (side[:, None] != side[None, :]))

    def light(group):
        items, allowed = seen(group, np.uint32)
        left = light_pairs([_numbered(x) for x in items], np.asarray(group.column("n")).astype(np.int64), allowed, percent)
        return group.select(["hub", "band", "doc_id"]).filter(pa.array(left.any(axis=0) | left.any(axis=1)))

    def exact(group):
        doc = np.asarray(group.column("doc_id"))
        found = linked(*seen(group), percent)
        return pa.table({"a": pa.array([int(doc[x]) for x, _ in found], pa.int64()),
                         "b": pa.array([int(doc[y]) for _, y in found], pa.int64())})

    cell = ("hub", "band", "i", "j")
    rows = written(rows, "cells")
    near = rows.join(_sets_of(docs, rows.select("doc_id"), k, percent), "doc_id").groupBy(*cell).applyInArrow(
        light, "hub bigint, band bigint, doc_id bigint").distinct()
    near = written(near, "near")
    release(docs.sparkSession)  # of the longer prefixes
    rows = rows.join(near, ["hub", "band", "doc_id"], "left_semi")
    return rows.join(_sets_of(docs, near.select("doc_id"), k), "doc_id").groupBy(*cell).applyInArrow(
        exact, "a bigint, b bigint").distinct()


def _blocks(sets: str, items: str):
    return F.expr(f"cast(greatest(ceil({sets} / {BLOCK_SETS}), ceil({items} / {BLOCK_ITEMS})) AS int)")


def _with_centres(groups: DataFrame, percent: int) -> DataFrame:
    """First turn: rows that bring every set of a group to a copy of the group's centre."""
    fit = groups.where(f"100L * least(n, centre.n) >= {percent}L * greatest(n, centre.n)")
    sizes = fit.groupBy("hub", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("items")).where("sets > 1")
    rows = fit.join(sizes, ["hub", "band"]).withColumn("blocks", _blocks("sets", "items"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    is_centre = F.col("doc_id") == F.col("centre.doc_id")
    return rows.withColumn("i", F.explode(F.when(is_centre, every).otherwise(own))).select(
        "hub", "band", "i", F.lit(-1).alias("j"), is_centre.cast("int").alias("side"), "doc_id", "n",
        F.col("doc_id").alias("colour"))


def _across(groups: DataFrame, colours: DataFrame) -> DataFrame:
    """Second turn: rows that bring together the blocks of each group that spans several components.
    Sets of the centre's component are never compared with each other."""
    coloured = (groups.join(colours.withColumnsRenamed({"node": "doc_id", "component": "colour"}), "doc_id", "left")
                .withColumn("colour", F.coalesce("colour", "doc_id")))
    main = coloured.where("doc_id = centre.doc_id").groupBy("hub", "band").agg(F.min("colour").alias("centre_colour"))
    rows = coloured.join(main, ["hub", "band"]).withColumn("main", F.expr("colour = centre_colour"))
    sizes = rows.groupBy("hub", "band").agg(
        F.count_if("main").alias("s0"), F.sum(F.expr("if(main, n, 0)")).alias("n0"),
        F.count_if(F.expr("NOT main")).alias("s1"), F.sum(F.expr("if(main, 0, n)")).alias("n1")).where("s1 > 0")
    # Two sets alone in a group have met in the first turn.
    rows = (rows.join(sizes.where("s0 + s1 > 2"), ["hub", "band"])
            .withColumn("b0", _blocks("s0", "n0")).withColumn("b1", _blocks("s1", "n1"))
            .withColumn("own", F.expr("cast(pmod(xxhash64(doc_id), if(main, b0, b1)) AS int)")))
    # Cells: (i, j) of two blocks outside the centre's component, (i, -1 - m) of such a block and one inside.
    cells = F.expr("""if(main,
        transform(sequence(0, b1 - 1), x -> struct(x AS i, -1 - own AS j, 1 AS side)),
        concat(transform(sequence(0, b1 - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j, if(x < own, 1, 0) AS side)),
               transform(sequence(0, b0 - 1), m -> struct(own AS i, -1 - m AS j, 0 AS side))))""")
    return rows.withColumn("cell", F.explode(cells)).select("hub", "band", "cell.*", "doc_id", "n", "colour")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs (doc_id, text; other columns
    are ignored).

    A document's set holds its distinct runs of k words (white space apart, A-Z lower-cased); a
    shorter text is one run; a null, empty or blank text has an empty set and links with nothing.
    Two documents link when 100 * shared >= percent * united. component_id is the least doc_id that
    links reach. Rows that repeat a doc_id are one document: what any of them links with, it links
    with. A null doc_id gets a null component_id. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    with small_batches(spark, 2000):
        described = written(_describe(docs, k), "sets")
    rows = described.where("kind = 0").select("doc_id", "n", "h1", "h2")
    counts = written(described.where("kind = 1").groupBy(F.col("h1").alias("token")).agg(F.sum("n").alias("n")).where("n >= 8"), "counts")
    heavy = frequent_tokens(counts, HEAVY_TOKENS)
    discard(counts)

    sets = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    member = written(sets.join(classes, ["n", "h1", "h2"]).select("doc_id", "rep").distinct(), "members")
    same = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    with small_batches(spark, 2000):
        found = _prefixes(docs, k, percent, heavy)
    with small_batches(spark, 50_000):
        lists = written(_lists(found), "lists")
    release(spark)  # of the prefixes
    groups = written(_groups(_needed(lists, member, percent), percent), "groups")
    with small_batches(spark):
        links = written(_meeting(docs, _with_centres(groups, percent), k, percent), "links")
    release(spark)  # of the sets
    first = written(components(links.unionByName(same)), "components")
    with small_batches(spark):
        more = written(_meeting(docs, _across(groups, first), k, percent), "links")
    release(spark)
    final = first if more.isEmpty() else written(
        components(links.unionByName(more).unionByName(same)), "components")
    release(spark)
    return rows.join(final, rows.doc_id == final.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text and any others) without those near duplicates that have a
    smaller doc_id in their group.

    Rows are told apart by doc_id and text: different texts under one doc_id stay unless they have near
    duplicates themselves, and of rows that repeat both, one stays. A text without words and a row with
    a null doc_id are near duplicates of nothing; an empty table stays empty.
    """
    repeated = written(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    # Own names, since docs may have columns of any name.
    row, ids = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), repeated.withColumnRenamed("doc_id", "shared")
    rows = docs.select(row.alias("row")).join(ids, F.col("row.doc_id") == F.col("shared"), "left").select(
        "row", F.col("shared").isNotNull().alias("again"),
        F.when(F.col("shared").isNull(), F.col("row.doc_id").cast("bigint")).otherwise(F.xxhash64("row.doc_id", "row.text")).alias("own"))
    found = near_duplicates(rows.select(F.col("own").alias("doc_id"), F.col("row.text").alias("text")), k, percent)
    moved = written(found.where("doc_id <> component_id").select("doc_id", "component_id").distinct(), "moved")
    members = moved.unionByName(moved.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
    named = members.join(rows.select(F.col("own").alias("doc_id"), F.col("row.doc_id").alias("id")).distinct(), "doc_id")
    first = named.groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("first"))
    gone = written(named.join(first, "component_id").where("doc_id <> first.doc_id").select(F.col("doc_id").alias("own")), "gone")
    kept = rows.join(gone, "own", "left_anti")
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    least = F.to_json(F.struct(*rest)) if rest else F.lit("")
    single = kept.where("again").groupBy("own").agg(F.min_by("row", least).alias("row"))
    return kept.where("NOT again").select("row.*").unionByName(single.select("row.*"))


def _needed(lists: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """(hub, doc_id, n): the rows of lists, by the classes' least ids, that a link may need.

    First sets go whose hubs hold fewer of their tokens than a link shares, twice, since hubs with one
    set left go with them. Then a set keeps its hubs, small ones first, up to the last one from which on
    they hold enough of its tokens.
    """
    hubs = member.select(F.col("doc_id").alias("hub"), F.col("rep").alias("hub_rep"))
    # Equal sets have the same tokens in a hub, so they count once.
    rows = (lists.join(member, "doc_id").join(hubs, "hub").groupBy("hub_rep", "hub", "rep", "n").agg(F.max("tokens").alias("tokens"))
            .groupBy(F.col("hub_rep").alias("hub"), F.col("rep").alias("doc_id"), "n").agg(F.sum("tokens").alias("tokens")))
    rows = written(rows, "shared")
    for _ in range(2):
        several = rows.groupBy("hub").agg(F.count("*").alias("sets"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        rows = rows.drop("sets").join(several.where("least <> most").select("hub", "sets"), "hub")
        enough = rows.groupBy("doc_id", "n").agg(F.sum("tokens").alias("all")).where(F.col("all") >= _least_shared("n", percent))
        rows = written(rows.join(enough.select("doc_id", "n"), ["doc_id", "n"]), "shared")
    onwards = Window.partitionBy("doc_id", "n").orderBy(F.desc("sets"), F.desc("hub"))
    return rows.withColumn("onwards", F.sum("tokens").over(onwards)).where(
        F.col("onwards") >= _least_shared("n", percent)).select("hub", "doc_id", "n")


def _groups(rows: DataFrame, percent: int) -> DataFrame:
    """(hub, band, doc_id, n, centre) from rows (hub, doc_id, n); groups of a single class are left out.

    Sets whose sizes allow a link lie in the same size band or in neighbouring ones. A set goes to its
    own band and to the next one, as far as the hub has sets there; centre is the least set's
    struct (doc_id, n).
    """
    width = 1.0001 * math.log(100 / percent) if percent < 100 else 1e-9
    rows = rows.withColumn("own", F.floor(F.log(F.col("n")) / width))
    bands = rows.groupBy("hub").agg(F.collect_set("own").alias("bands"))
    up, down = (F.array_contains("bands", F.col("own") + d) for d in (1, -1))
    placed = rows.join(bands, "hub").withColumn("band", F.explode(F.filter(F.array(
        F.when(up, F.col("own") + 1), F.when(down | ~up, F.col("own"))), lambda x: x.isNotNull())))
    several = (placed.groupBy("hub", "band").agg(F.min(F.struct("doc_id", F.col("n").cast("bigint").alias("n"))).alias("centre"),
                                                 F.max("doc_id").alias("most")).where("centre.doc_id <> most"))
    return placed.join(several.drop("most"), ["hub", "band"]).select("hub", "band", "doc_id", "n", "centre")
