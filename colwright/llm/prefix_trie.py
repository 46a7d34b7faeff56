"""Conversation prefix trie: a z-fast trie built by batched insertion in Spark.

A turn is a letter (role and text), a conversation a string. The trie is a table of compacted nodes,
a row for the edge that leads to each: depths p and e of the edge's ends (e is where the node's
extent ends), ref, a conversation that runs through it, and digests of four prefixes of ref: parent
(p turns), name (p + 1), handle and extent (e). The handle's depth is the two-fattest number of
(p, e], the one that the highest power of two divides.

A round inserts a batch. Each pending conversation finds its exit node by fat binary search: it
halves the depths (a, b] that may hold its deepest node at their two-fattest number f, and asks for
a handle equal to its own prefix of f turns, so a conversation of n turns makes log2(n) lookups, each
a join of all pending ones with the handles. It then leaves the trie at some depth of its exit edge,
where the edge is split. Of the conversations that leave at one place with the same next turn, one
drawn by a hash becomes a new leaf; the others pass through it in the next round. The draw leaves
half of such a group or fewer on average to any later one, so the rounds grow with the logarithm of the
largest group.

Digests of a prefix are two polynomial sums of the digests of its turns, so those of a conversation
are sums over the sorted table of turns; sorted ranges are summed apart and joined by an offset per
range, and no task needs all turns of a long conversation. The texts are not shuffled.
While the trie is built, a conversation travels as one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, settings, written

BASE = (0x9E6C63D0876A9A4B, 0xC2B2AE3D27D4EB4F)  # odd: they have inverses modulo 2**64
PIECE = 4096  # ids that are joined to one string before they are hashed in order
ROOT = b""
_U = np.uint64


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2**64; exponents may be negative."""
    out = np.ones(len(exponent), _U)
    e = np.abs(exponent).astype(np.int64)
    for sign in (1, -1):
        factor = base if sign > 0 else pow(base, -1, 1 << 64)
        mine, left = np.sign(exponent) == sign, e.copy()
        while (left * mine).any():
            hit = mine & (left & 1 == 1)
            out[hit] = out[hit] * _U(factor)
            factor = factor * factor % (1 << 64)
            left >>= 1
    return out


def _u(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(_U)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()],
                                      names=list(columns))


def _digest(a: np.ndarray, b: np.ndarray) -> pa.Array:
    raw = np.stack([a, b], axis=1).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(raw)]).cast(pa.binary())


SUMS = "part int, conv_id bigint, j bigint, s1 bigint, s2 bigint, words bigint"


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, d1, d2, words): digests of role and text and the words of the text. tie
    orders rows of one turn that differ, by role and text; only their texts are shuffled."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.where("`conv_id` IS NOT NULL").select(
        F.col("`conv_id`").cast("bigint").alias("conv_id"), F.col("`turn`").alias("turn"), text("role").alias("role"),
        text("text").alias("text"))
    rows = rows.withColumn("d1", F.xxhash64(F.lit(1), "role", "text")).withColumn("d2", F.xxhash64("text", "role", F.lit(2)))
    thin = written(rows.select("conv_id", "turn", "d1", "d2", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")), "rows")
    tied = thin.groupBy("conv_id", "turn").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high")
    tied = written(tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t")), "tied")
    if tied.isEmpty():
        return thin.withColumn("tie", F.lit(0))
    there = rows.join(tied, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left_semi")
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    ranks = there.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("d1").alias("x1"), F.col("d2").alias("x2"),
                         F.dense_rank().over(order).alias("tie")).distinct()
    return thin.join(ranks, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("d1") == F.col("x1"))
                     & (F.col("d2") == F.col("x2")), "left").select(
        "conv_id", "turn", "d1", "d2", "words", F.coalesce("tie", F.lit(0)).alias("tie"))


def _running(turns: DataFrame) -> DataFrame:
    """(conv_id, j, s1, s2, words): the j-th turn's place and sums over the first j turns."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("d1"), F.col("d2")]

    def sums(batches):
        part, open_ = TaskContext.get().partitionId(), (None, 0, [0, 0], 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = np.asarray(batch.column("conv_id"))
            begin = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(conv))))
            before = np.zeros(len(begin), np.int64)
            carried = open_[0] == conv[0]
            before[0] = open_[1] if carried else 0
            j = np.arange(len(conv)) - begin[run] + 1 + before[run]
            out = {"part": np.full(len(conv), part, np.int32), "conv_id": conv, "j": j}
            last = []
            for x, (name, base) in enumerate(zip(("d1", "d2"), BASE)):
                total = np.concatenate([np.zeros(1, _U), np.cumsum(_u(batch.column(name)) * _power(base, j))])
                total = total[1:] - total[begin][run]
                if carried:
                    total += np.where(run == 0, _U(open_[2][x]), _U(0))
                out[f"s{x + 1}"] = total.view(np.int64)
                last.append(int(total[-1]))
            words = np.cumsum(np.asarray(batch.column("words")))
            start = np.concatenate([[0], words])[begin]
            start[0] -= open_[3] if carried else 0
            out["words"] = words - start[run]
            open_ = (int(conv[-1]), int(j[-1]), last, int(out["words"][-1]))
            yield _batch(out)

    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(ranged.mapInArrow(sums, SUMS), "turns")
    # A conversation that runs on over several ranges: what its earlier ranges hold, one row a range.
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct(
        "conv_id", "j", "s1", "s2", "words")).alias("last")).orderBy("part").collect()
    offsets, held = {}, (None, 0, 0, 0, 0)
    for r in ends:
        if r.first == held[0]:
            offsets[r.part] = held
        same = held if r.last.conv_id == held[0] and r.first == r.last.conv_id else (None, 0, 0, 0, 0)
        shift = np.array([same[1]])
        s = [(t + (int(v) % (1 << 64)) * int(_power(b, shift)[0])) % (1 << 64)
             for t, v, b in zip(same[2:4], (r.last.s1, r.last.s2), BASE)]
        held = (r.last.conv_id, same[1] + r.last.j, *s, same[4] + r.last.words)

    def join(batches):
        for batch in batches:
            part, conv = np.asarray(batch.column("part")), np.asarray(batch.column("conv_id"))
            j, words = np.asarray(batch.column("j")).copy(), np.asarray(batch.column("words")).copy()
            s = [_u(batch.column("s1")).copy(), _u(batch.column("s2")).copy()]
            for p in np.unique(part):
                if int(p) in offsets:
                    name, count, *before, more = offsets[int(p)]
                    at = np.flatnonzero((part == p) & (conv == name))
                    for x, base in enumerate(BASE):
                        s[x][at] = _U(before[x]) + s[x][at] * _power(base, np.full(len(at), count))
                    j[at] += count
                    words[at] += more
            yield _batch({"conv_id": conv, "j": j, "s1": s[0].view(np.int64), "s2": s[1].view(np.int64), "words": words})

    return written(local.mapInArrow(join, "conv_id bigint, j bigint, s1 bigint, s2 bigint, words bigint"), "sums")


def _rebuilt(running: DataFrame, heads: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, h, words) of every prefix of every rebuilt conversation, and (conv_id) of all.

    The first h turns come from conversation conv_id - conv_id % group, h = crc32(conv_id) % heads."""
    convs = running.select("conv_id").distinct()
    head = running.where(F.col("j") < heads).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("j", "s1", "s2", "words"))).alias("head"))
    plan = (convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
            .withColumn("base", F.col("conv_id") - F.col("conv_id") % group))
    of_base = head.select(F.col("conv_id").alias("base"), F.col("head").alias("lent"))
    plan = plan.join(of_base, "base", "left").join(head.withColumnRenamed("head", "mine"), "conv_id").select(
        "conv_id", "h", F.slice(F.coalesce("lent", F.expr("slice(mine, 1, 0)")), F.lit(1), F.col("h")).alias("lent"),
        F.get("mine", F.col("h") - 1).alias("cut"))
    plan = written(plan, "heads")
    lent = plan.select("conv_id", F.explode("lent").alias("t")).select("conv_id", "t.*")
    # Own turns beyond the head: their sums start after the cut and continue those of the lent head.
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    shifted = plan.select("conv_id", "h", F.size("lent").cast("bigint").alias("n"),
                          *[zero(f"cut.{c}").alias(f"c_{c}") for c in ("s1", "s2", "words")],
                          *[F.coalesce(F.expr(f"get(lent, size(lent) - 1).{c}"), F.lit(0).cast("bigint")).alias(f"l_{c}")
                            for c in ("s1", "s2", "words")])
    own = running.join(shifted, "conv_id").where("j > h")

    def move(batches):
        for batch in batches:
            get = lambda c: np.asarray(batch.column(c))
            shift = get("n") - get("h")
            out = {"conv_id": get("conv_id"), "j": get("j") + shift}
            for x, base in enumerate(BASE):
                s, cut, head_ = (_u(batch.column(f"{c}s{x + 1}")) for c in ("", "c_", "l_"))
                out[f"s{x + 1}"] = (head_ + (s - cut) * _power(base, shift)).view(np.int64)
            yield _batch(out | {"words": get("l_words") + get("words") - get("c_words")})

    rows = lent.unionByName(own.mapInArrow(move, "conv_id bigint, j bigint, s1 bigint, s2 bigint, words bigint"))

    def name(batches):
        for batch in batches:
            yield _batch({"conv_id": batch.column("conv_id"), "d": batch.column("j"),
                          "h": _digest(_u(batch.column("s1")), _u(batch.column("s2"))), "words": batch.column("words")})

    return written(rows.mapInArrow(name, "conv_id bigint, d bigint, h binary, words bigint"), "prefixes"), convs


def _fattest(a: str, b: str) -> str:
    """SQL of the two-fattest number of (a, b]."""
    return f"({b} & shiftleft(-1L, length(bin({a} ^ {b})) - 1))"


def _edges(new: DataFrame, strings: DataFrame) -> DataFrame:
    """Edges (ref, p, e) with the digests of their prefixes."""
    at = lambda d: F.expr(f"if({d} = 0, X'', get(hs, cast({d} AS int) - 1))")
    return (new.join(strings.select(F.col("rep").alias("ref"), "hs"), "ref").withColumn("f", F.expr(_fattest("p", "e")))
            .select("ref", "p", "e", "f", at("p").alias("parent"), at("p + 1").alias("name"), at("f").alias("handle"),
                    at("e").alias("extent")))


EDGE = "ref bigint, p bigint, e bigint, f bigint, parent binary, name binary, handle binary, extent binary"


def _located(pending: DataFrame, trie: DataFrame, steps: int) -> DataFrame:
    """Each pending row with its exit: depth a of its deepest node, exit (an edge, null where it
    leaves at the node itself)."""
    state = (pending.withColumn("b", F.col("n")).withColumn("known", F.col("a"))
             .withColumn("last", F.lit(None).cast("struct<ref:bigint,p:bigint,e:bigint,extent:binary>")))
    handles = trie.select(F.col("f").alias("key_f"), F.col("handle").alias("key"), F.struct("ref", "p", "e", "extent").alias("hit"))
    for _ in range(steps):
        state = (state.withColumn("f", F.expr(f"if(a < b, {_fattest('a', 'b')}, 0L)"))
                 .withColumn("probe", F.expr("get(hs, cast(if(f > 0, f, n) AS int) - 1)"))
                 .join(handles, (F.col("f") == F.col("key_f")) & (F.col("probe") == F.col("key")), "left")
                 .withColumn("a", F.expr("coalesce(hit.e, a)"))
                 .withColumn("b", F.expr("if(f > 0 AND hit IS NULL, f - 1, b)"))
                 .withColumn("last", F.coalesce("hit", "last")).drop("f", "probe", "key_f", "key", "hit"))
    # The last node found is the exit node itself if its extent is no prefix of the conversation.
    within = F.expr("last IS NOT NULL AND (last.e > n OR get(hs, cast(least(last.e, n) AS int) - 1) <> last.extent)")
    state = state.withColumn("inside", within).withColumn("a", F.expr("if(inside, last.p, a)"))
    names = trie.select(F.col("name").alias("key"), F.struct("ref", "p", "e", "extent").alias("child"))
    state = state.withColumn("probe", F.expr("get(hs, cast(least(a + 1, n) AS int) - 1)")).join(
        names, (F.col("probe") == F.col("key")) & (F.col("a") < F.col("n")), "left")
    return state.select("rep", "n", "hs", "a", F.expr("if(inside, last, child)").alias("exit"))


def build_trie(strings: DataFrame, longest: int, log: list | None = None) -> DataFrame:
    """The compacted nodes but the root (EDGE) of the strings (rep, n, hs, ws), distinct and not empty."""
    spark = strings.sparkSession
    trie = spark.createDataFrame([], EDGE)
    draw = F.struct(F.xxhash64("rep"), "rep")
    pending, steps = strings.select("rep", "n", "hs", F.lit(0).cast("bigint").alias("a")), longest.bit_length()
    first = True
    while True:
        if first:
            moves = pending.select("rep", "n", "a", F.col("a").alias("l"), F.lit(None).cast("bigint").alias("ref"),
                                   F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("e"),
                                   F.element_at("hs", 1).alias("name"))
        else:
            found = _located(pending, trie, steps)
            other = strings.select(F.col("rep").alias("other"), F.col("hs").alias("path"))
            same = F.expr("""if(exit IS NULL, a, a + size(filter(sequence(a + 1, least(n, exit.e)),
                             d -> get(hs, cast(d AS int) - 1) = get(path, cast(d AS int) - 1))))""")
            moves = (found.join(other, F.col("exit.ref") == F.col("other"), "left")
                     .withColumn("exit", F.when(F.col("a") < F.col("n"), F.col("exit"))).withColumn("l", same).select(
                         "rep", "n", "a", "l", "exit.ref", "exit.p", "exit.e",
                         F.expr("if(l < n, get(hs, cast(l AS int)), NULL)").alias("name")))
        moves = written(moves, "moves")
        leaving = moves.where("l < n")
        leaves = leaving.groupBy("name").agg(F.min_by(F.struct("rep", "l", "n"), draw).alias("x")).select("x.*")
        # An edge and the depths at which it is split make consecutive edges.
        cuts = moves.where("ref IS NOT NULL AND l < e").select("ref", "p", "e", "l").distinct()
        stops = cuts.unionByName(cuts.select("ref", "p", "e", F.col("e").alias("l"))).distinct()
        order = Window.partitionBy("ref", "p", "e").orderBy("l")
        pieces = stops.select("ref", F.coalesce(F.lag("l").over(order), "p").alias("p"), F.col("l").alias("e"))
        new = pieces.unionByName(leaves.select(F.col("rep").alias("ref"), F.col("l").alias("p"), F.col("n").alias("e")))
        split = cuts.select("ref", "p").distinct()
        trie = written(trie.join(split, ["ref", "p"], "left_anti").unionByName(_edges(new, strings)), "trie")
        if log is not None:
            log.append(moves.count())
        left = leaving.join(leaves.select("rep"), "rep", "left_anti").select("rep", "l")
        # The place where a conversation left is a node now; the search goes on below it.
        pending = written(left.withColumnRenamed("l", "a").join(strings.select("rep", "n", "hs"), "rep"), "pending")
        if pending.isEmpty():
            return trie
        first = False


def _end_digests(ends: DataFrame) -> DataFrame:
    """(h, ends_sha256) of (h, conv_id): ids in ascending order, joined by commas. Sorted ranges make
    strings of bounded length, which are then hashed one after the other."""

    def pieces(batches):
        key, ids = None, []
        for batch in batches:
            out = []
            for h, i in zip(batch.column("h").to_pylist(), batch.column("conv_id").to_pylist()):
                if h != key or len(ids) == PIECE:
                    if ids:
                        out.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = h, []
                ids.append(i)
            yield from packed(out)
        if ids:
            yield from packed([(key, ids[0], ",".join(map(str, ids)))])

    def packed(rows):
        if rows:
            h, i, s = zip(*rows)
            yield _batch({"h": pa.array(h, pa.binary()), "first": pa.array(i, pa.int64()), "ids": pa.array(s)})

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for h, s in zip(batch.column("h").to_pylist(), batch.column("ids").to_pylist()):
                if h != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = h, hashlib.sha256(s.encode())
                else:
                    state.update(f",{s}".encode())
            if out:
                yield _batch({"h": pa.array([x for x, _ in out], pa.binary()), "ends_sha256": pa.array([x for _, x in out])})
        if state is not None:
            yield _batch({"h": pa.array([key], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

    ranged = ends.repartitionByRange("h", "conv_id").sortWithinPartitions("h", "conv_id")
    parts = ranged.mapInArrow(pieces, "h binary, first bigint, ids string")
    return parts.repartition("h").sortWithinPartitions("h", "first").mapInArrow(hashed, "h binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, heads: int = 4, group: int = 20, log: list | None = None) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, edges expanded.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn,
    null first, then by role and text; rows that repeat count each. A null role or text is empty. Rows with a null conv_id belong to no conversation and
    are left out. Conversation c is rebuilt from the first h turns of conversation c - c % group and its
    own turns after its first h, h = crc32(c) % heads. Columns of a node: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty table has no
    conversation and no node; otherwise the root is among the rows. log receives the conversations that
    each round located.
    """
    spark = conversations.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="10000"):
        running = _running(_turns(conversations))
        prefixes, convs = _rebuilt(running, heads, group)
        last = prefixes.groupBy("conv_id").agg(F.max(F.struct("d", "h", "words")).alias("t"))
        ends = written(convs.join(last, "conv_id", "left").select(
            "conv_id", F.coalesce("t.d", F.lit(0).cast("bigint")).alias("n"), F.coalesce("t.h", F.expr("X''")).alias("h"),
            F.coalesce("t.words", F.lit(0).cast("bigint")).alias("words")), "ends")
        whole = ends.agg(F.count("*").alias("convs"), F.max("n").alias("n"), F.min("conv_id").alias("least")).first()
        out = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, " \
              "saved_tokens bigint, ends_sha256 string"
        if not whole.convs:
            return spark.createDataFrame([], out)
        # Conversations that are equal as a whole are one string; rep is the least of them.
        alike = ends.groupBy("n", "h", "words").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"))
        strings = alike.where("n > 0").join(prefixes.withColumnRenamed("conv_id", "rep").select(
            "rep", F.struct("d", F.col("h").alias("x"), F.col("words").alias("w")).alias("t")), "rep").groupBy("rep").agg(
            F.first("n").alias("n"), F.first("weight").alias("weight"), F.first("words").alias("words"),
            F.sort_array(F.collect_list("t")).alias("t")).select(
            "rep", "n", "weight", "words", F.col("t.x").alias("hs"), F.col("t.w").alias("ws"))
        strings = written(strings, "strings")
        trie = build_trie(strings, whole.n, log) if whole.n else spark.createDataFrame([], EDGE)
        nodes = _expanded(strings, trie)
        sha = written(_end_digests(ends.select("h", "conv_id")), "ended")
    empty = hashlib.sha256(b"").hexdigest()
    top = trie.where("p = 0").count()
    totals = nodes.agg(F.sum("own").alias("saved"), F.count_if(F.expr("n_children = 0")).alias("leaves")).first()
    root = spark.createDataFrame([(whole.least, 0, None, whole.convs, top, totals.leaves or 1, totals.saved or 0, ROOT)],
                                 "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
                                 "n_leaves bigint, saved_tokens bigint, h binary")
    under_root = F.when(F.length("parent") == 0, F.lit(whole.least))
    rows = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", under_root)).select(*root.columns)
    return rows.unionByName(root).join(sha, "h", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def _expanded(strings: DataFrame, trie: DataFrame) -> DataFrame:
    """A row for each node below the root: its edge is expanded along the ref's turns."""
    children = trie.groupBy(F.col("parent").alias("extent")).agg(F.count("*").alias("children"))
    compact = written(trie.join(children, "extent", "left").select(
        "extent", "ref", "p", "e", "parent", F.coalesce("children", F.lit(0).cast("bigint")).alias("children")), "compact")
    path = strings.select("rep", "n", "weight", F.col("words").alias("all_words"), F.posexplode("hs").alias("i", "h"), "ws").select(
        "rep", "n", "weight", "all_words", (F.col("i") + 1).cast("bigint").alias("d"), "h", F.col("ws")[F.col("i")].alias("words"),
        F.expr("ws[i] - if(i > 0, ws[greatest(i, 1) - 1], 0)").alias("w"))
    met = path.join(compact.select(F.col("extent").alias("h"), F.struct("ref", "p", "e", "extent", "parent", "children").alias("node")), "h", "left")
    # The edge of a place is that of the next node down the conversation; only ref's places are counted as nodes.
    down = Window.partitionBy("rep").orderBy(F.desc("d"))
    deeper = down.rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("edge", F.last("node", ignorenulls=True).over(down)).withColumn(
        "mine", F.when(F.col("edge.ref") == F.col("rep"), F.col("w")).otherwise(0)).withColumn(
        "below", F.coalesce(F.sum("mine").over(deeper), F.lit(0))).withColumn("leaf", F.first("edge.children").over(down) == 0)
    met = written(met.select("rep", "weight", "all_words", "d", "h", "words", "w", "edge", "below", "leaf"), "places")
    at_node = met.where("d = edge.e").groupBy("h").agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("to_here"),
        F.count_if("leaf").alias("n_leaves"), F.sum(F.expr("weight * all_words")).alias("reach"),
        F.sum("below").alias("below"))
    # Words saved strictly below: all members' words beyond this depth, less those of the nodes there.
    stats = written(at_node.select(F.col("h").alias("extent"), "conv_id", "n_convs", "n_leaves", "to_here",
                                   F.expr("reach - n_convs * to_here - below").alias("saved")), "nodes")
    up = stats.select(F.col("extent").alias("parent"), F.col("conv_id").alias("up"))
    places = met.where("edge.ref = rep").select("h", "d", "words", "w", "edge.*").join(stats, "extent").join(up, "parent", "left")
    return written(places.select(
        "h", "conv_id", F.col("d").alias("depth"), "parent",
        F.expr("if(d > p + 1, conv_id, up)").alias("parent_conv_id"), "n_convs",
        F.expr("if(d < e, 1L, children)").alias("n_children"), "n_leaves",
        F.expr("saved + (n_convs - 1) * (to_here - words + w)").alias("saved_tokens"),
        F.expr("(n_convs - 1) * w").alias("own")), "expanded")
