"""MinHash near duplicates by an inverted join over signature coordinates.

A document's signature has COORDINATES minima of its shingle set. It is posted under every
(coordinate, value) pair, and each pair's list length is counted over the whole corpus. Documents
whose signatures agree in at least MATCHES coordinates share a pair among the first
COORDINATES - MATCHES + 1 of each under any common order of the pairs, so only those of the shortest
lists are kept; a pair that one document alone holds takes a place in that prefix and makes no list.
Agreements are then counted coordinate by coordinate: pairs of documents without one in a prefix
of the coordinates are skipped, as are those that can no longer reach MATCHES. Retained documents are
compared on their full shingle sets.

No list is written out as pairs. Documents with equal sets are one class. A list is named by its
least document, its hub. Each document first meets its hubs, and the best agreement is confirmed on
full sets; confirmed links merge documents into components. Then the members of each hub are cut
into blocks of bounded size, blocks meet, and only documents of different components are compared, so
every link lies within one component. A cell of blocks emits a spanning forest of its links.

Two sets with a similarity of 0.8 agree in fewer than 36 of 64 coordinates with a probability of
4e-6, more similar ones still less often; that is the only way to miss a link.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, small_batches, written
from .graph import components
from .words import chunks, distinct_sets, mix, shingles

COORDINATES, MATCHES = 64, 36
PREFIX = COORDINATES - MATCHES + 1
BLOCK_SETS, BLOCK_ITEMS = 256, 1 << 18  # documents and shingles that make a block
ID_BITS = 1 << 23  # bits of the table that keeps texts without candidates from being shuffled


@lru_cache(maxsize=2)
def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64), 31) | np.uint64(1)


def signatures(values: np.ndarray, bounds: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """[set, coordinate]: digests of the minima; the sets must not be empty."""
    out = np.empty((len(bounds) - 1, n), np.uint64)
    with np.errstate(over="ignore"):
        for c, factor in enumerate(_multipliers(n)):
            out[:, c] = mix(np.minimum.reduceat(values * factor, bounds[:-1]), c) if len(out) else 0
    return out


def set_digests(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set: equal for equal sets."""
    out = []
    for salt in (2, 3):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values, salt))])
            out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()],
                                      names=list(columns))


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.ravel()))


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, h1, h2, posts, codes) of every row: set size and digests, the (coordinate, value)
    pairs as numbers and a byte of each; the last two are null for empty sets."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in chunks(batch.column("text")):
                values, bounds = distinct_sets(*shingles(chunk, k))
                n = np.diff(bounds)
                full = np.flatnonzero(n > 0)
                h1, h2 = set_digests(values, bounds)
                made = signatures(values, np.append(bounds[:-1][full], len(values)))
                place = pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, 0), pa.int64(), mask=n == 0)
                codes = made.astype(np.uint8).tobytes()
                codes = pa.array([codes[i:i + COORDINATES] for i in range(0, len(codes), COORDINATES)], pa.binary())
                yield _table({"doc_id": ids.slice(chunk.first, len(n)), "n": n.astype(np.int64), "h1": h1, "h2": h2,
                              "posts": _lists(made.view(np.int64)).take(place), "codes": codes.take(place)})

    return docs.mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, posts array<bigint>, codes binary")


def _hubs(classes: DataFrame) -> DataFrame:
    """(hub, doc_id, n): the members of every prefix list of several documents, named by the least.

    Lengths are counted with partial sums; a list that a third of the corpus shares is joined to its
    length by a join that adaptive execution splits. An id with several texts keeps all its lists.
    """
    posts = classes.select("doc_id", F.explode("posts").alias("post"))
    length = posts.groupBy("post").agg(F.count("*").alias("length")).where("length > 1")
    several = posts.join(length, "post").groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("length", "post"))).alias("posts"))
    sizes = classes.groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("texts"))
    # Pairs that are alone in their lists come first in the order and fill the prefix.
    kept = F.expr(f"slice(posts, 1, if(texts > 1, size(posts), greatest(0, {PREFIX} - ({COORDINATES} - size(posts)))))")
    prefix = written(several.join(sizes, "doc_id").select("doc_id", "n", F.explode(kept.getField("post")).alias("post")), "posts")
    lists = prefix.groupBy("post").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    return prefix.join(lists.drop("last"), "post").select("hub", "doc_id", "n").distinct()


def agreements(codes: np.ndarray, left: np.ndarray, right: np.ndarray, matches: int = MATCHES) -> np.ndarray:
    """How many bytes the codes of each pair of rows share, 0 where they are fewer than matches.
    Pairs are skipped once the coordinates left cannot bring them there."""
    count = np.zeros(len(left), np.int16)
    alive = np.arange(len(left))
    width = codes.shape[1]
    for begin in range(0, width, 8):
        part = codes[:, begin:begin + 8]
        count[alive] += (part[left[alive]] == part[right[alive]]).sum(axis=1).astype(np.int16)
        alive = alive[count[alive] + (width - min(begin + 8, width)) >= matches]
    out = np.zeros(len(left), np.int16)
    out[alive] = count[alive]
    return out


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _rays(members: DataFrame, signed: DataFrame) -> DataFrame:
    """(hub, doc_id, n, found): the documents whose signatures agree with that of their hub."""
    own = signed.select("doc_id", F.col("codes").alias("a"))
    of_hub = signed.select(F.col("doc_id").alias("hub"), F.col("codes").alias("b"))
    pairs = members.where("hub <> doc_id").join(own, "doc_id").join(of_hub, "hub")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _codes(batch.column("a")), _codes(batch.column("b"))
            rows = np.arange(len(a))
            found = agreements(np.concatenate([a, b]), rows, rows + len(a))
            batch = batch.select(["hub", "doc_id", "n"]).append_column("found", pa.array(found, pa.int16()))
            yield batch.filter(pa.array(found > 0))

    return pairs.select("hub", "doc_id", "n", "a", "b").mapInArrow(run, "hub bigint, doc_id bigint, n bigint, found short")


def _best(rays: DataFrame) -> DataFrame:
    """(hub, doc_id, n): for each document the hub that it agrees with best."""
    return rays.groupBy("doc_id").agg(F.max_by(F.struct("hub", "n"), F.struct("found", -F.col("hub"))).alias("best")).select(
        "best.hub", "doc_id", "best.n")


def _id_bits(ids: DataFrame) -> np.ndarray:
    """A bit per digest of an id, of bounded size: it may let other ids through, never loses one."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    parts = ids.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("part")).agg(
        F.expr("bitmap_construct_agg(bit % 32768)").alias("bits")).collect()
    out = np.zeros(ID_BITS // 8, np.uint8)
    for row in parts:
        out[row.part * 4096:(row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ids and some others, which the join that follows drops."""
    sent = docs.sparkSession.sparkContext.broadcast(_id_bits(ids))

    def run(batches):
        bits = sent.value
        for batch in batches:
            at = np.asarray(batch.column("bit"))
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep))

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)).alias("bit"))
    return rows.mapInArrow(run, "doc_id bigint, text string")


def _forest(doc: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the links that join two parts not yet joined."""
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kept = []
    for i, j in pairs:
        a, b = find(int(doc[i])), find(int(doc[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((int(doc[i]), int(doc[j])))
    return kept


def linked_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of ascending sets link."""
    out = np.zeros(len(left), bool)
    for x, (i, j) in enumerate(zip(left, right)):
        a, b = sets[i], sets[j]
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            continue
        if len(a) > len(b):
            a, b = b, a
        at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
        shared = int((b[at] == a).sum()) if len(b) else 0
        out[x] = shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)
    return out


def _met(group) -> tuple[np.ndarray, np.ndarray]:
    """(documents, matrix of the pairs to compare) of a cell: other side, or one block with itself;
    other colour; sizes that allow a link are tested with the sets."""
    doc, colour, side = (np.asarray(group.column(c)) for c in ("doc_id", "colour", "side"))
    inside = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    return doc, (colour[:, None] != colour[None, :]) & (inside | (side[:, None] != side[None, :]))


CELL = ("hub", "i", "j")


def _confirmed(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among rows (hub, i, j, side, doc_id, colour), compared by cell on full sets."""

    def run(group):
        doc, allowed = _met(group)
        sets: list = [None] * len(doc)
        for chunk in chunks(group.column("text").combine_chunks()):
            values, bounds = distinct_sets(*shingles(chunk, k))
            sets[chunk.first:chunk.last] = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        left, right = np.nonzero(np.triu(allowed, 1))
        if len(left) > 8 * len(doc) and min(map(len, sets)):  # many pairs: those without agreement go first
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            near = agreements(signatures(np.concatenate(sets), bounds).astype(np.uint8), left, right) > 0
            left, right = left[near], right[near]
        keep = linked_sets(sets, left, right, percent)
        found = _forest(doc, list(zip(left[keep], right[keep])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    with small_batches(docs.sparkSession):
        return written(rows.join(_texts(docs, rows.select("doc_id")), "doc_id").groupBy(*CELL).applyInArrow(
            run, "a bigint, b bigint"), "links")


def _blocks(sets: str, items: str):
    return F.expr(f"cast(greatest(1, ceil({sets} / {BLOCK_SETS}), ceil({items} / {BLOCK_ITEMS})) AS int)")


def _stars(best: DataFrame) -> DataFrame:
    """Cells of a hub and a block of the documents that agree with it best."""
    sizes = best.groupBy("hub").agg(F.count("*").alias("sets"), F.sum("n").alias("items")).withColumn(
        "blocks", _blocks("sets", "items")).select("hub", "blocks")
    rays = best.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("i"),
                                          F.lit(0).alias("side"), "doc_id")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"),
                        F.lit(1).alias("side"), F.col("hub").alias("doc_id"))
    return rays.unionByName(hubs).withColumn("j", F.lit(-1)).withColumn("colour", F.col("doc_id"))


def _across(members: DataFrame, colours: DataFrame) -> DataFrame:
    """Cells that bring together members of a hub that lie in different components. Members of the
    component that holds most of them, the main one, are never compared with each other."""
    coloured = members.join(colours.select(F.col("node").alias("doc_id"), F.col("component").alias("colour")),
                            "doc_id", "left").withColumn("colour", F.coalesce("colour", "doc_id"))
    sizes = coloured.groupBy("hub", "colour").agg(F.count("*").alias("sets"), F.sum("n").alias("items"))
    main = sizes.groupBy("hub").agg(
        F.max_by("colour", F.struct("sets", -F.col("colour"))).alias("main"), F.max("sets").alias("s0"),
        F.max_by("items", F.struct("sets", -F.col("colour"))).alias("n0"),
        F.sum("sets").alias("s"), F.sum("items").alias("n")).where("s > s0")
    main = main.withColumn("b0", _blocks("s0", "n0")).withColumn("b1", _blocks("(s - s0)", "(n - n0)"))
    rows = coloured.join(main.select("hub", "main", "b0", "b1"), "hub").withColumn("inside", F.expr("colour = main")).withColumn(
        "own", F.expr("cast(pmod(xxhash64(doc_id), if(inside, b0, b1)) AS int)"))
    # Cells: (i, j) of two blocks outside the main component, (i, -1 - m) of one outside and one inside.
    cells = F.expr("""if(inside,
        transform(sequence(0, b1 - 1), x -> struct(x AS i, -1 - own AS j, 1 AS side)),
        concat(transform(sequence(0, b1 - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j, if(x < own, 1, 0) AS side)),
               transform(sequence(0, b0 - 1), m -> struct(own AS i, -1 - m AS j, 0 AS side))))""")
    return rows.withColumn("cell", F.explode(cells)).select("hub", "cell.*", "doc_id", "colour")


def _partners(group: np.ndarray, side: np.ndarray, inside: np.ndarray, colour: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which rows agree with a row of their cell that they are to be compared with; group is ascending.
    Rows meet at growing distances, so all cells of a batch are compared at once."""
    keep = np.zeros(len(group), bool)
    left, step = np.arange(len(group)), 1
    while True:
        left = left[left + step < len(group)]
        left = left[group[left] == group[left + step]]
        if not len(left):
            return keep
        right = left + step
        meet = (colour[left] != colour[right]) & (inside[left] | (side[left] != side[right]))
        a, b = left[meet], right[meet]
        near = agreements(codes, a, b) > 0
        keep[a[near]] = keep[b[near]] = True
        step += 1


def _agreeing_rows(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """The rows of each cell that agree with a row they are to be compared with. A stream over sorted
    rows: the open cell, of two blocks at most, is held between batches."""

    def compare(table):
        table = table.combine_chunks()
        hub, i, j, side, colour = (np.asarray(table.column(c)) for c in (*CELL, "side", "colour"))
        new = np.concatenate([[True], (hub[1:] != hub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        keep = _partners(np.cumsum(new), side, i == j, colour, _codes(table.column("codes").combine_chunks()))
        yield from table.drop_columns(["codes"]).filter(pa.array(keep)).to_batches()

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            hub, i, j = (np.asarray(table.column(c)) for c in CELL)
            open_ = np.flatnonzero((hub != hub[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(open_[-1]) + 1 if len(open_) else 0
            if cut:
                yield from compare(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from compare(held)

    wide = rows.join(signed, "doc_id").select(*CELL, "side", "doc_id", "colour", "codes")
    wide = wide.repartition(*CELL).sortWithinPartitions(*CELL, "doc_id")
    return wide.mapInArrow(run, "hub bigint, i int, j int, side int, doc_id bigint, colour bigint").distinct()


def minhash_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs (doc_id, text; other
    columns are ignored).

    A document's set holds its distinct runs of k words (white space apart, A-Z lower-cased); a
    shorter text is one run; a null, empty or blank text has an empty set and links with nothing.
    Two documents link when 100 * shared >= percent * united, confirmed on the full sets; percent is
    at least 80 (below it, agreements in the fixed number of coordinates become likely to be missed).
    component_id is the least doc_id that links reach, kept says that it is the document itself. Rows
    that repeat a doc_id are one document: what any of them links with, it links with. A null doc_id
    gets a null component_id and is kept. An empty table gives an empty result.
    """
    if percent < 80:
        raise ValueError("percent must be at least 80")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    with small_batches(spark, 2000):
        wide = written(_signed(docs, k), "signatures")
    rows = written(wide.select("doc_id", "n", "h1", "h2"), "sizes")
    sets = rows.where("n > 0 AND doc_id IS NOT NULL")
    first = sets.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    member = written(sets.join(first.withColumnRenamed("doc_id", "rep"), ["n", "h1", "h2"]).select("doc_id", "rep").distinct(), "members")
    same = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    classes = written(wide.join(first, ["doc_id", "n", "h1", "h2"], "left_semi").select("doc_id", "n", "posts", "codes"), "classes")
    discard(wide)
    signed = classes.select("doc_id", "codes").distinct()
    hubs = written(_hubs(classes), "hubs")
    with small_batches(spark, 10_000):
        rays = written(_rays(hubs, signed), "rays")
    links = _confirmed(docs, _stars(_best(rays)), k, percent)
    found = written(components(links.unionByName(same)), "components")
    # A hub with one other member has met it: nothing is left to compare unless they agree.
    alone = hubs.groupBy("hub").agg(F.count("*").alias("members")).where("members = 2").join(rays, "hub", "left_anti")
    with small_batches(spark, 10_000):
        cells = written(_agreeing_rows(_across(hubs.join(alone, "hub", "left_anti"), found), signed), "cells")
    if not cells.isEmpty():
        more = _confirmed(docs, cells, k, percent)
        if not more.isEmpty():
            found = written(components(links.unionByName(more).unionByName(same)), "components")
    return rows.select("doc_id", "n").join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))
