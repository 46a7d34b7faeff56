"""Conversation trie, coordinate join and pivot clustering against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from colwright.llm import coordinates, pivots, prefix_trie
from .test_operators import DOCS, WORD, brute_components, varied

# -- op11 ------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string"


def rebuilt(rows, heads, group):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
    return {c: tuple(own.get(c - c % group, [])[:h[c]] + own[c][h[c]:]) for c in own}


def brute_trie(rows, heads=4, group=20):
    convs = rebuilt(rows, heads, group)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = Counter()
    for node, inside in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in inside if len(convs[c]) == len(node))))
        out[min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children), len(leaves), saved,
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for c in range(120):
        base = [("user", f"hello {draw.randrange(3)} {draw.randrange(2)}")] * draw.randrange(2)
        turns = base + [(draw.choice(["user", "assistant", None]), draw.choice(["a", "b b", "a a c", "", None, "d " * 40]))
                        for _ in range(draw.choice([0, 1, 2, 3, 5, 9]))]
        rows += [(c, i if draw.random() < .9 else None, r, t, "x") for i, (r, t) in enumerate(turns)]
    long = [("user", f"turn {i % 7}") for i in range(300)]
    for c, cut in ((200, 300), (201, 300), (221, 299), (242, 150), (263, 151), (284, 37), (305, 2)):
        rows += [(c, i, r, t, "x") for i, (r, t) in enumerate(long[:cut])]
        rows += [(c, 1000, "user", "other end", "x")] * (cut % 2)
    rows += [(c, 0, "user", "the same", None) for c in range(400, 440)]  # turnless after the head, or one turn
    rows += [(500, 1, "user", "tie b", None), (500, 1, "user", "tie a", None), (500, 1, "assistant", "tie a", None)] * 2
    return rows + [(None, 0, "user", "no id", None), (7, 3, "user", "again", None), (7, 3, "user", "again", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed):
    rows, log = conversations(seed), []
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), log=log)
    assert Counter(tuple(r) for r in found.collect()) == brute_trie(rows)
    assert 2 <= len(log) <= 12 and log == sorted(log, reverse=True)


def test_prefix_trie_other_heads(spark):
    rows = conversations(3)
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), heads=6, group=7)
    assert Counter(tuple(r) for r in found.collect()) == brute_trie(rows, 6, 7)


def test_prefix_trie_small_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x", None)], TURNS)).count() == 0
    rows = [(1, 0, "user", None, None), (2, 0, None, "x y", None)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))
    assert Counter(tuple(r) for r in found.collect()) == brute_trie(rows)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint").selectExpr("a", "b", f"{prefix_trie._fattest('a', 'b')} AS f")
    for a, b, f in frame.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    frame = spark.createDataFrame([(b"x", i) for i in range(100)] + [(b"y", 5), (b"", -3), (b"", 2)], "h binary, conv_id bigint")
    found = {bytes(r.h): r.ends_sha256 for r in prefix_trie._end_digests(frame.repartition(9)).collect()}
    want = {b"x": range(100), b"y": [5], b"": [-3, 2]}
    assert found == {h: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for h, ids in want.items()}


# -- op12 ------------------------------------------------------------------------

def near_copies(seed, groups=10):
    draw = random.Random(seed)
    rows = [(1, varied(300), "en", "s", "x"), (2, None, None, None, None), (3, "", "en", "s", "x"), (4, " \n\t", "en", "s", "x"),
            (5, "one", "en", "s", "x"), (6, "ONE", "en", "s", "x"), (7, "two words", "en", "s", "x"), (7, "two words", "en", "s", "x"),
            (7, varied(300), "en", "s", "x"), (None, varied(300), "en", "s", "x"), (9, varied(20_000, 5), "en", "s", "x"),
            (10, "a b " * 50, "en", "s", "x"), (11, "b a " * 70, "en", "s", "x")]
    for g in range(groups):
        text = [f"g{g}w{draw.randrange(300)}" for _ in range(draw.choice([12, 60, 200]))]
        for c in range(12):
            copy = list(text)
            for _ in range(draw.randrange(1 + len(text) // 10)):
                copy[draw.randrange(len(copy))] = f"r{draw.random()}"
            rows.append((100 + 20 * g + c, " ".join(copy), "en", "s", ""))
    return rows


def test_minhash_duplicates(spark):
    rows = near_copies(4)
    for k, percent in ((2, 80), (5, 90)):
        found = coordinates.minhash_duplicates(spark.createDataFrame(rows, DOCS), k, percent).collect()
        assert Counter(tuple(r)[:3] for r in found) == brute_components(rows, k, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert coordinates.minhash_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        coordinates.minhash_duplicates(spark.createDataFrame([], DOCS), percent=70)


def test_minhash_chain_in_blocks(spark, monkeypatch):
    """Neighbours of a chain link, its ends do not: found across many small blocks."""
    monkeypatch.setattr(coordinates, "BLOCK_SETS", 3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(24):
        words = list(base)
        words[:6 * i] = [f"n{j}" for j in range(6 * i)]
        rows.append((i, " ".join(words), "en", "s", ""))
    draw = random.Random(2)
    draw.shuffle(rows)
    found = coordinates.minhash_duplicates(spark.createDataFrame(rows, DOCS), 2, 80).collect()
    assert Counter(tuple(r)[:3] for r in found) == brute_components(rows, 2, 80) and {r.component_id for r in found} == {0}


def test_agreements_are_exact_from_the_threshold_on():
    draw = np.random.default_rng(1)
    codes = draw.integers(0, 2, (60, coordinates.COORDINATES)).astype(np.uint8)
    left, right = np.triu_indices(60, 1)
    count = (codes[left] == codes[right]).sum(axis=1)
    found = coordinates.agreements(codes, left, right)
    assert ((found > 0) == (count >= coordinates.MATCHES)).all() and (found[found > 0] == count[found > 0]).all()
    group, side = np.sort(draw.integers(0, 6, 60)), draw.integers(0, 2, 60)
    colour, inside = draw.integers(0, 3, 60), np.isin(group, (1, 3))
    want = np.zeros(60, bool)
    for a, b, n in zip(left, right, count):
        if group[a] == group[b] and colour[a] != colour[b] and (inside[a] or side[a] != side[b]) and n >= coordinates.MATCHES:
            want[[a, b]] = True
    assert (coordinates._partners(group, side, inside, colour, codes) == want).all()


# -- op13 ------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, cluster string"


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(64 * x) < 2 ** 62 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in first[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    label = lambda v: min(range(len(centres)), key=lambda c: (gap(v, centres[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[label(v)].append(v)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else centres[c] for c in range(len(centres))]
    rows = [(i, label(v), gap(v, centres[label(v)])) for i, v in kept]
    long = lambda x: x if x is not None and x < 2 ** 63 else None
    fits = {c: all(d < 2 ** 63 for _, c2, d in rows if c2 == c) for c in range(len(centres))}
    sums = {c: sum(d for _, c2, d in rows if c2 == c) if fits[c] else None for c in range(len(centres))}
    total = sum(d for _, _, d in rows) if all(fits.values()) else None
    return Counter((i, c, long(d), long(sums[c]), long(total),
                    hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in rows)


def vectors(seed, n=300, dim=8, large=()):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [x + draw.gauss(0, .1) for x in centres[i % 6]], "x") for i in range(n)]
    rows += [(900, [0.0] * dim, "x")] * 4 + [(None, [1.0] * dim, None), (901, None, "x"), (902, [1.0] * (dim - 1), "x"), (903, [], "x"),
             (904, [None] + [1.0] * (dim - 1), "x"), (905, [float("nan")] * dim, "x"), (906, [float("inf")] * dim, "x"),
             (907, [1e300] * dim, "x"), (908, [0.25] * dim, "x"), (908, [-0.25] * dim, "x")]
    return rows + [(950 + i, [x] * dim, "x") for i, x in enumerate(large)]


@pytest.mark.parametrize("large", [(), (3e6, -4e6), (2e15, -1e15, 6e16)])
def test_pivot_clusters(spark, large):
    rows, log = vectors(5, large=large), []
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    found = pivots.cluster_vectors(frame, k=7, rounds=3, dim=8, log=log)
    assert Counter(tuple(r) for r in pivots.cluster_digests(found).collect()) == brute_clusters(rows, 7, 3, 8)
    assert len(log) == 3 and sum(found.counts) == found.rows.count()
    assert max(log) < 0.6 * 7 * found.rows.count()  # bounds spare most distances


def test_pivot_clusters_of_few_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    rows = vectors(6, n=2)[:5]
    found = pivots.cluster_vectors(frame(rows), k=16, dim=8)
    assert Counter(tuple(r) for r in pivots.cluster_digests(found).collect()) == brute_clusters(rows, 16, 3, 8)
    for nothing in ([], [(1, None, "x"), (2, [1.0], "x")]):
        assert pivots.cluster_digests(pivots.cluster_vectors(frame(nothing), dim=8)).count() == 0


def test_bounds_never_drop_the_nearest():
    draw = np.random.default_rng(3)
    v, centres = draw.integers(-40, 40, (400, 16)), draw.integers(-40, 40, (9, 16))
    centres[4] = centres[2]  # a tie goes to the smaller number
    pivot = draw.integers(-40, 40, (5, 16))
    label, best, _ = pivots.nearest(v, pivots.pivot_distances(v, pivot), centres, pivots.pivot_distances(centres, pivot))
    every = ((v[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (label == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
