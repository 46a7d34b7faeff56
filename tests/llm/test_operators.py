"""Each operator against a brute-force version on small tables with nulls, empty and repeated rows."""

import hashlib
import math
import pathlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import pytest

from checks.compare import check, connect
from colwright.llm import (chat, class_lm, decontaminate, graph, jaccard_join, licenses, mixing, quality, token_counts,
                           url_filters, warc)
from colwright.llm.common import settings, small_batches
from colwright.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def varied(n, seed=0):
    return " ".join(f"w{seed}x{i * 7919 % 9973}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    base = varied(300)
    near = base.split()
    near[10], near[200] = "changed", "again"
    return [(1, base, "en", "src0", "x"), (2, " ".join(near), "en", "src0", None), (3, base.upper(), "de", None, "x"),
            (4, None, None, "src1", "x"), (5, "", "en", "src1", "x"), (6, " \n\t ", "en", "src2", "x"),
            (7, "two words", "en", "src2", "x"), (7, "two words", "en", "src2", "x"), (None, varied(60, 3), "en", "src2", "x"),
            (9, varied(20_000, 5), "en", "src3", "x"), (10, "a b c " * 40, "en", "src3", "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    assert check(spark, connect(SF), SF, name, QUERIES[name], SQL[name]) is None


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 8), (None, 3), (7, None), (3, 1), (9, 8)]
    found = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}


# -- op1 -------------------------------------------------------------------------

def test_warc_round_trip(spark):
    long = "x" * 5000 + "\r\n\r\nWARC/1.1\r\n" + "é" * 9000
    pages = [(1, "http://a/\r\n", long, 0), (2, None, long, 0), (3, "u", "", 0), (4, "u", None, 0), (None, "u", "y" * 3000, 0),
             (6, "u", "short", 0), (7, "u", "short", 0), (8, "u", "WARC/1.1\r\n" * 3, 0), (6, "u", "short", 0),
             (1, "other", long, 0), (2, "other", long, 0), (None, "v", "y" * 3000, 0), (None, "u", "", 0), (None, "u", None, 0)]
    found = warc.round_trip(spark.createDataFrame(pages, "page_id bigint, url string, html string, payload int"))
    want = Counter()
    for i, _, html, _ in pages:
        data = (html or "").encode()
        again = len(data) >= 1000 and i == 1
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
    assert Counter(tuple(r) for r in found.collect()) == want
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_broken_segments(spark):
    part = lambda i, n, size, total, block: (f"o/{n}" if n > 1 else "o", "response", None, None, "o" if n > 1 else None, n,
                                             total, block, True)
    good = [part(0, 1, 2, None, b"ab"), part(0, 2, 1, 3, b"c"), part(0, 2, 1, 3, b"c")]
    frame = lambda rows: spark.createDataFrame(rows, warc.RECORD)
    assert [(bytes(r.block), r.complete) for r in warc.assembled(frame(good)).collect()] == [(b"abc", True)]
    for bad in (good[:1], good[1:], [good[0], part(0, 2, 1, 9, b"c")], [good[0], part(0, 3, 1, 3, b"c")],
                [*good, part(0, 2, 1, 3, b"d")]):
        assert [r.complete for r in warc.assembled(frame(bad)).collect()] == [False]


def test_chunked_framing():
    data = bytes(range(256)) * 50
    assert warc.unchunked(warc.chunked(data, 1000)) == data and warc.unchunked(warc.chunked(b"")) == b""
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None


# -- op2 -------------------------------------------------------------------------

def test_license_scan(spark, none):
    texts = ["Released under the MIT License. x under the mit license", "cc-by-nc cc by nc", "CC BY-NC 4.0", None, "",
             "Licensed under the Apache License, Version 2.0", "permit license", "Distributed under the GNU General Public License v3"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1), (0, texts[0], 1)],
                                  "doc_id bigint, text string, n_words int")
    found = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    assert licenses.scan_licenses(frame).count() == 10
    assert (found[0].n_base, found[0].first_word, found[0].last_word, found[0].base_labels) == (2, 1, 6, "mit")
    assert (found[1].n_base, found[1].first_word, found[1].last_word) == (2, 0, 3)
    assert found[2].base_labels == "cc-by-nc" and found[3].labels == found[4].labels == "" and found[3].n_words == 0
    assert found[5].labels == "apache-2" and found[5].n_base == 1
    assert found[6].n_base == 0 and found[7].labels == "gpl-3" and found[None].n_base == 2
    assert len(licenses.default_rules()) > 200 and licenses.scan_licenses(none).count() == 0


# -- op3 -------------------------------------------------------------------------

def brute_components(rows, k, percent):
    sets = []
    for i, text, *_ in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    least = {i: i for i, *_ in rows if i is not None}
    while True:
        before = dict(least)
        for a, sa in enumerate(sets):
            for b, sb in enumerate(sets):
                x, y = rows[a][0], rows[b][0]
                if None not in (x, y) and sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                    least[x] = least[y] = min(least[x], least[y])
        if before == least:
            return Counter((r[0], len(s), least.get(r[0])) for r, s in zip(rows, sets))


def test_jaccard_join(spark, rows, docs, none):
    import random
    rng = random.Random(1)
    many = list(rows)
    for g in range(12):
        text = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([30, 80, 200]))]
        for c in range(9):
            copy = list(text)
            for _ in range(rng.randrange(len(text) // 12)):
                copy[rng.randrange(len(copy))] = f"r{rng.random()}"
            many.append((100 + 20 * g + c, " ".join(copy), "en", "s", ""))
    for k, percent in ((4, 85), (5, 80)):
        found = jaccard_join.near_duplicates(spark.createDataFrame(many, DOCS), k, percent)
        assert Counter(tuple(r) for r in found.collect()) == brute_components(many, k, percent)
    assert jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_bounds_lose_no_link(spark):
    """Linked sets share the least number of prefix tokens, and equal 32-bit digests hide none."""
    import numpy as np
    rng = np.random.default_rng(3)
    for percent in (50, 80, 85, 100):
        for n in (1, 2, 19, 25, 60, 300):
            for m in range(n, 100 * n // percent + 1):
                least = -(-percent * (n + m) // (100 + percent))  # tokens that a link shares
                for shared in {least, n}:
                    x, y = np.arange(n), np.concatenate([np.arange(shared), n + np.arange(m - shared)])
                    order = rng.permutation(n + m)
                    size = lambda z: jaccard_join._prefix_size(z, percent) + jaccard_join._extra(z, percent)
                    first = [set(z[np.argsort(order[z])][:size(len(z))].tolist()) for z in (x, y)]
                    fewest = max(1 + percent * ((percent * z + 99) // 100) // 2000 for z in (n, m))
                    assert len(first[0] & first[1]) >= fewest
    sizes = spark.range(1, 400).select("id", jaccard_join._least_shared("id", 85).alias("least")).collect()
    assert all(r.least == 1 + 85 * ((85 * r.id + 99) // 100) // 2000 for r in sizes)
    a, b = np.array([3, 3, 3, 7, 9], np.uint32), np.array([3, 3, 7, 7], np.uint32)
    assert jaccard_join._common(jaccard_join._numbered(a), jaccard_join._numbered(b)) == 3
    assert len(jaccard_join._numbered(a[:0])) == 0


def test_jaccard_blocks(spark, monkeypatch):
    """A group of many blocks gives the links of one."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for c in range(30):
        copy = list(base)
        for j in range(c % 6):
            copy[(c * 17 + j * 29) % 120] = f"x{c}y{j}"
        rows.append((c, " ".join(copy), "", "", ""))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 85)
    assert Counter(tuple(r) for r in found.collect()) == brute_components(rows, 4, 85)


# -- op4 -------------------------------------------------------------------------

def test_token_counts(docs, rows, none):
    encoding, _ = token_counts._encoding(token_counts.VOCABULARY, token_counts.PATTERN)
    for rule in token_counts.RULES:
        total, parts = Counter(), Counter()
        for r in token_counts.count_tokens(docs, rule).collect():
            total[r.doc_id] += r.n_tokens
            parts[r.doc_id] += r.char_end - r.char_start
        for i in {r[0] for r in rows}:
            own = [r[1] or "" for r in rows if r[0] == i]
            assert total[i] == sum(len(encoding.encode_ordinary(t)) for t in own)
            assert parts[i] == sum(map(len, own))
    assert token_counts.count_tokens(none).count() == 0


def test_crossing_tokens():
    import numpy as np
    spans = np.array([0, 3, 5]), np.array([3, 5, 9])
    sections = np.array([0, 4, 6])
    assert [list(token_counts.attribute(*spans, sections, r)[0]) for r in token_counts.RULES] == [[2, 1, 0], [1, 1, 1], [2, 0, 1]]


def test_one_of_each_keeps_texts_that_share_an_id(spark):
    """Rows count by id and text: only near duplicates and repeated rows go, extra columns are not ordered."""
    a, b = varied(80), varied(80, 5)
    near = a.replace("w0x0 ", "w0y ")
    rows = [(1, a, {"m": 1}), (1, b, {"m": 2}), (1, None, {"m": 3}), (2, near, {"m": 4}), (3, b, None), (4, varied(80, 9), {}),
            (4, varied(80, 9), {}), (5, None, {}), (None, a, {}), (None, a, {}), (7, "", {}), (6, near, {}), (6, varied(80, 11), {})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key map<string,int>")
    kept = sorted((r.doc_id or 0, r.text or "", (r.key or {}).get("m", 0)) for r in jaccard_join.one_of_each(docs).collect())
    assert kept == sorted([(1, a, 1), (1, b, 2), (1, "", 3), (4, varied(80, 9), 0), (5, "", 0), (0, a, 0), (0, a, 0), (7, "", 0),
                           (6, varied(80, 11), 0)])
    assert jaccard_join.one_of_each(docs.limit(0)).columns == docs.columns
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


# -- op5 -------------------------------------------------------------------------

def base_measures(text):
    w = WORD.findall(text or "")
    runs, covered = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if runs[tuple(w[k:k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules(spark, rows, docs, none, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (9, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    for direct in (quality.DIRECT, 2):
        monkeypatch.setattr(quality, "DIRECT", direct)
        found = quality.quality_rules(docs, labels).collect()
        assert Counter(tuple(r)[:7] for r in found) == Counter((r[0], *base_measures(r[1])) for r in rows)
    by = {r.doc_id: r for r in found}
    assert by[1].kept and by[2].kept and not by[9].kept and not by[4].kept and by[4].score is None
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {r.doc_id for r in found if r.kept}
    assert quality.quality_rules(none, labels).count() == 0
    assert {r.kept for r in quality.quality_rules(docs, labels.limit(0)).collect() if not r.base_failed} == {True}


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_quality_target_is_all_trusted_documents(spark, broadcast):
    # All of 70,000 documents are trusted, so target and raw are the same and no bucket has a ratio.
    docs = spark.range(70_000).selectExpr("id AS doc_id", "concat('word ', id % 7) AS text")
    labels = spark.range(70_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=broadcast):
        assert quality.fit(docs, labels).ratios == [0] * quality.BUCKETS
        # Half of them: a bucket of the others only has less than its share, one of these only more.
        ratios = quality.fit(docs.withColumn("text", docs.doc_id.cast("string")), labels.where("doc_id % 2 = 0")).ratios
    assert min(ratios) < -500_000 and max(ratios) > 500_000


# -- op6 -------------------------------------------------------------------------

def test_url_aliases(spark):
    page = lambda i, url, to=None, meta=None: (i, url, "<p>" + (f"<link rel='canonical' href='{to}'>" if to else "")
                                               + (f'<meta http-equiv="refresh" content="0; url={meta}">' if meta else ""))
    pages = [page(1, "http://x.org/a", "http://y.org/b"), page(2, "https://y.org/b#t", None, "/c"),
             page(3, "http://y.org/c", None, "http://m.net/es/1"), page(4, "http://shop.com/z", "http://y.org/c"),
             page(5, "http://q.org/"), page(6, None), page(7, "nothing"), page(8, "http://WWW.Example.com/en/x"),
             page(9, "http://a.example.com/en/x"), (10, "http://y.org/c?x", None), page(1, "http://x.org/a")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(frame).collect()}
    assert found[1] == ("x.org", "/a", None, "block") and found[2][3] == found[3][3] == "block"
    assert found[4] == ("shop.com", "/z", "com/", "allow") and found[5][3] == found[10][3] == "allow"
    assert found[6] == found[7] == ("", "", None, "allow")
    assert found[8][2:] == ("www.example.com/en/", "allow") and found[9][2:] == ("example.com/en/", "block")
    log = spark.createDataFrame([("http://q.org/", "http://x.org/a"), (None, "http://x.org/a")], "a string, b string")
    assert {r.page_id: r.verdict for r in url_filters.filter_urls(frame, log).collect()}[5] == "block"
    assert url_filters.filter_urls(frame.limit(0)).count() == 0


def test_url_aliases_by_every_tag_and_relative_links(spark):
    """Links resolved by hand; the SQL agrees on the whole fixture."""
    link = "<LINK href='{}' rel=canonical>".format
    meta = "<meta content=\"5; URL='{}'\" http-equiv=refresh>".format
    held = [  # html, and whether it reaches http://a.net/es/ or http://b.org/x?p=1&q=2
        (link("http://c.org/") + link("http://a.net/es/1"), True),
        ("<meta http-equiv=refresh content=30>" + meta("http://a.net/es/1"), True),
        (link("../es/1"), True), (link("./q/../../es/./1"), True), (link("/es/1"), True), (link("//a.net/es/1"), True),
        (link("../../../../es/1"), True), (link("es/1"), False), (link("?es=1"), False), (link("#es"), False),
        (link("mailto:x@a.net/es/1"), False), (link(" http:&#47;&#x2F;b.org/x?p=1&amp;q=2 "), True),
        (link("http://b.org/x?p=1&q=3"), False), (link(""), False), (None, False)]
    pages = [(i, f"http://a.net/d{i}/e", html, i) for i, (html, _) in enumerate(held)]
    pages += [(100, "http://a.net/es/1", None, 0), (101, "https://b.org/x?p=1&q=2#f", link("http://a.net/es/1"), 0),
              (102, "http://z.net/d/e?es=1", link("?k"), 0), (103, "http://long.org/", "<p>" * 200_000 + link("http://a.net/es/1"), 0)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string, host int")
    found = {r.page_id: r for r in url_filters.filter_urls(frame).collect()}
    assert [found[i].verdict == "block" for i in range(len(held))] == [reaches for _, reaches in held]
    assert found[101].verdict == found[103].verdict == "block" and found[102].verdict == "allow"
    con = duckdb.connect()
    con.register("pages", frame.toPandas())
    want = con.execute(SQL["op6_url_filter"]).df().set_index("page_id")
    for i, r in found.items():
        rule = want.rule[i] if isinstance(want.rule[i], str) else None
        assert (r.host, r.path, r.rule, r.verdict) == (want.host[i], want.path[i], rule, want.verdict[i]), i


# -- op7 -------------------------------------------------------------------------

def test_mixing(docs, none):
    found = mixing.mix_sources(docs).collect()
    assert all(0 <= r.part_tokens <= r.n_tokens for r in found) and not {4, 5, 6} & {r.doc_id for r in found}
    supply = sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    taken = sum(r.copies * r.n_tokens + r.part_tokens for r in found)
    assert supply // 2 - 20 <= taken <= supply // 2
    assert mixing.mix_sources(none).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    counts = spark.createDataFrame([("head", "en", "a", 10), ("head", "en", "b", 1000), ("web", "en", "c", 1000)],
                                   "domain string, lang string, source string, n_tokens bigint")
    mix = mixing.Mix(({"head": 1, "web": 1}, {}, {}), share=0.4, epochs=1, seed=1)
    found = {r.source: r.budget for r in mixing.leaf_budgets(counts, mix).collect()}
    assert found == {"a": 10, "b": 392, "c": 402}


# -- op8 -------------------------------------------------------------------------

def test_decontamination(spark, none):
    items = [(1, varied(30, 1)), (2, varied(40, 2)), (3, varied(40, 2)), (4, None), (5, ""), (6, "one two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    edited = varied(40, 2).split()
    edited[20] = "changed"
    texts = [(1, varied(90, 8) + "\n" + varied(30, 1).upper() + " " + varied(50, 9)), (2, " ".join(edited)), (3, varied(400, 7)),
             (4, None), (5, ""), (6, "one two three"), (7, "One two"), (None, varied(30, 1)), (9, " ".join(varied(40, 2).split()[:20]))]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.first_word)
             for r in decontaminate.find_contamination(frame, bench).collect()}
    assert set(found) == {(1, 1), (7, 6), (None, 1)} | ({(2, 2), (2, 3)} & set(found))
    assert found[1, 1] == (1.0, 90) and ((2, 2) in found) == (31 / 41 >= 0.8)
    assert {r.doc_id for r in decontaminate.remove_contaminated(frame, bench).collect()} == {2, 3, 4, 5, 6, 9}
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(frame, bench.limit(0)).count() == 0


def test_hamming_index_finds_all_within_radius():
    import numpy as np
    rng = np.random.default_rng(3)
    run = rng.integers(0, 2**63, 26, dtype=np.uint64)
    index = decontaminate.build_index([(i, rng.integers(0, 2**63, 26, dtype=np.uint64)) for i in range(40)] + [(40, run)], {})
    group, mine = index.groups[0], decontaminate.fingerprints(run, np.zeros(1, np.int64), 26)
    for flips in range(65):
        bits = rng.permutation(64)[:flips].astype(np.uint64)
        other = mine ^ np.bitwise_or.reduce(np.uint64(1) << bits) if flips else mine
        want = {(0, i) for i, p in enumerate(group.prints) if int(p ^ other[0]).bit_count() <= decontaminate.RADIUS}
        assert set(decontaminate.within(group, other)) == want
        assert ((0, 40) in want) == (flips <= decontaminate.RADIUS)


def test_contamination_against_all_windows(spark):
    """Recall against every window and item: edits spread or in one place, boilerplate that items share,
    and an item's passage followed by the boilerplate of another one."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    frames = [words(40) for _ in range(4)]
    items = [words(rng.choice((30, 60, 61))) + frames[i % 4][:rng.choice((20, 40))] for i in range(40)]
    texts = []
    for i in range(240):
        text = list(rng.choice(items))
        if i % 3 == 0:  # boilerplate of another item behind the unique passage
            text = text[:-20] + rng.choice(frames)[-20:]
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            text[rng.randrange(len(text))] = "edited"
        texts.append(words(rng.randrange(30)) + text + words(rng.randrange(30)))
    bags = [[tuple(t[i:i + 5]) for i in range(len(t) - 4)] for t in items]
    held = Counter(s for b in bags for s in set(b))
    weigh = lambda c: sum(n / held.get(s, 1) for s, n in c.items())
    want = {}
    for d, text in enumerate(texts):
        run = [tuple(text[i:i + 5]) for i in range(len(text) - 4)]
        for i, bag in enumerate(bags):
            for at in range(max(1, len(run) - len(bag) + 1)):
                a, b = Counter(run[at:at + len(bag)]), Counter(bag)
                if a.keys() & b.keys():
                    value = weigh(a & b) / weigh(a | b)
                    if value >= 0.8 and value > want.get((d, i), (0, 0))[0] + 1e-12:
                        want[d, i] = (value, at)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_contamination(docs, bench).collect()}
    assert found.keys() <= want.keys() and len(found) >= 0.97 * len(want) and len(want) > 100
    near = [k for k, (value, _) in want.items() if value < 0.9]
    assert len(near) >= 20 and sum(k in found for k in near) >= 0.9 * len(near)
    assert sum(abs(found[k] - want[k][0]) < 1e-9 for k in found) >= 0.97 * len(found)


def test_index_compares_few_pairs():
    import numpy as np
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    group = decontaminate.Group(9, list(range(3000)), prints, *decontaminate._listed(prints))
    others = np.concatenate([prints[:50] ^ np.uint64(0b1011 << 30), rng.integers(0, 2**64, 400, dtype=np.uint64)])
    near = np.bitwise_count(others[:, None] ^ prints[None, :]) <= decontaminate.RADIUS
    assert decontaminate.within(group, others) == [tuple(map(int, x)) for x in np.argwhere(near)]
    at = decontaminate._blocks(others).ravel()
    listed = np.searchsorted(group.keys, at, "right") - np.searchsorted(group.keys, at, "left")
    assert listed.sum() < 0.25 * len(others) * len(prints)


def test_item_at_both_ends_of_a_long_text():
    """The sums of a stretch, not of the whole text, are held."""
    import numpy as np
    import tracemalloc
    rng = np.random.default_rng(8)
    item = rng.integers(0, 2**63, 40, dtype=np.uint64)
    run = np.concatenate([item, rng.integers(0, 2**63, 2_000_000, dtype=np.uint64), item])
    index = decontaminate.build_index([(1, item)], {})
    hit = decontaminate._hits(index, run)
    tracemalloc.start()
    assert decontaminate.matches(index, run, hit) == [(0, 1.0, 0)]
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()


# -- op9 -------------------------------------------------------------------------

def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "\\\\[INST]\\", "[[INST]]", "<<SYS>><</SYS>>", "<s></s>", "", None, "[ROLE x] é"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(nasty)]
    rows += [(2, 0, "system", "s", 0), (2, 1, "user", "u", 0), (2, 2, "assistant", "a", 0), (3, 0, "tool]é", "t", 0),
             (4, 1, "assistant", "x", 0), (None, 0, None, "n", 0), (2, 2, "assistant", "a", 0)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    made = chat.format_chats(frame)
    from pyspark.sql import functions as F
    back = {r.conv_id: r for r in made.withColumn("back", chat.read_chats(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in back[1].back] == [(r[2], r[3] or "") for r in rows[:10]]
    assert [t.role for t in back[3].back] == ["tool]é"] and [t.role for t in back[None].back] == [""]
    assert {i: r.valid for i, r in back.items()} == {1: True, 2: False, 3: False, 4: False, None: False}
    assert chat.format_chats(frame.limit(0)).count() == 0


# -- op10 ------------------------------------------------------------------------

@pytest.mark.parametrize("frequent", [class_lm.FREQUENT, 5])
def test_class_lm(docs, rows, none, monkeypatch, frequent):
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    texts = [(i, [*WORD.findall(lower(t)), "\n"]) for i, t, *_ in rows]
    count = Counter(w for i, ws in texts if not held(i) for w in ws)
    total, types = sum(count.values()), len(count)
    found = class_lm.class_lm_scores(docs).collect()
    want = Counter((i, held(i), len(ws), sum(w in count for w in ws), total, round(sum(
        math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws), 6)) for i, ws in texts)
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in found) == want
    assert all(r.score <= 0 for r in found)
    assert class_lm.class_lm_scores(none).count() == 0


def test_exchange_gain_is_exact():
    import numpy as np
    rng = np.random.default_rng(0)
    units, classes = 12, 4
    counts = rng.integers(0, 9, (units, units))
    kind = rng.integers(0, classes, units)

    def value(kind):
        joint = np.zeros((classes, classes))
        np.add.at(joint, (kind[:, None], kind[None, :]), counts)
        return class_lm._g(joint).sum() - class_lm._g(joint.sum(axis=0)).sum() - class_lm._g(joint.sum(axis=1)).sum(), joint

    for u in range(units):
        _, joint = value(kind)
        right = np.bincount(kind, counts[u], classes)
        left = np.bincount(kind, counts[:, u], classes)
        got = class_lm.best_class(joint, right, left, int(counts[u, u]), int(kind[u]))
        tried = []
        for c in range(classes):
            other = kind.copy()
            other[u] = c
            tried.append(value(other)[0])
        assert tried[got] == pytest.approx(max(tried))


def test_exchange_never_loses(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    total, classes = 60, 6
    true = rng.integers(0, classes, total)
    counts = rng.poisson(np.where((true[:, None] + 1) % classes == true[None, :], 9, 0.5))
    frame = spark.createDataFrame([(u, v, int(n)) for (u, v), n in np.ndenumerate(counts) if n], "u int, v int, n bigint")

    def joint_of(kind):
        joint = np.zeros((classes, classes), np.int64)
        np.add.at(joint, (kind[:, None], kind[None, :]), counts)
        return joint

    start, seen = np.arange(total) % classes, []
    kind, joint = class_lm.exchange(frame, start, classes, 0, seen.append)
    assert (joint == joint_of(kind)).all()
    steps = [class_lm.likelihood(joint_of(start)), *seen]
    assert all(a <= b for a, b in zip(steps, steps[1:]))
    assert steps[-1] == class_lm.likelihood(joint) > steps[0]
    for u in range(total):  # no move is left that gains
        assert class_lm.best_class(joint, np.bincount(kind, counts[u], classes), np.bincount(kind, counts[:, u], classes),
                                   int(counts[u, u]), int(kind[u])) == kind[u]


def test_exchange_packs_pairs_once(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(3)
    total, first = 60, 20
    counts = rng.poisson(0.4, (total, total)) * rng.integers(1, 40, (total, total))
    rows = [(u, v, int(n)) for (u, v), n in np.ndenumerate(counts) if n]
    frame = spark.createDataFrame([*rows, *rows], "u int, v int, n bigint")  # in two parts each
    monkeypatch.setattr(class_lm, "PACK", 100)

    def unpacked(pairs):
        right, left, blocks = Counter(), Counter(), []
        for r in pairs.collect():
            ru, rv, rn, lv, lu, ln = (np.frombuffer(r[c], np.int64 if c.endswith("n") else np.int32) for c in class_lm.PACKED)
            right.update({(int(a), int(b)): int(n) for a, b, n in zip(ru, rv, rn)})
            left.update({(int(a), int(b)): int(n) for a, b, n in zip(lu, lv, ln)})
            blocks.append({*ru.tolist(), *lv.tolist()})
        assert len(blocks) > class_lm.SHARES and sum(map(len, blocks)) == len(set().union(*blocks))  # a unit is in one row
        assert right == left
        return right

    pairs = class_lm.pairs_of(frame, total)
    with small_batches(spark, 1):
        among = class_lm.pairs_among(pairs, first)
    assert unpacked(pairs) == {(u, v): 2 * n for u, v, n in rows}
    assert unpacked(among) == {(u, v): 2 * n for u, v, n in rows if max(u, v) < first}
    # No round deals rows by unit: whatever the rounds, the pairs are shuffled once, before them.
    dealt = []
    monkeypatch.setattr(class_lm, "packed_pairs", lambda *a, f=class_lm.packed_pairs: dealt.append(a) or f(*a))
    kind, joint = class_lm.exchange(frame, np.arange(total) % 5, 5, 0.05)
    want = np.zeros((5, 5), np.int64)
    np.add.at(want, (kind[:, None], kind[None, :]), 2 * counts)
    assert len(dealt) == 1 and (joint == want).all()


@pytest.mark.parametrize("share,frequent", [(0.95, 1 << 18), (0.7, 4)])
def test_words_have_classes_of_their_own(spark, monkeypatch, share, frequent):
    import random
    monkeypatch.setattr(class_lm, "SHARE", share)
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    rng = random.Random(2)
    # Rare words of one ending: those with an a stand where cat stands, those with a b where dog stands.
    word = lambda often, x: rng.choice([often, f"{x}{rng.randrange(90)}xyz"])
    texts = [" ".join(f"the {word('cat', 'a')} of {word('dog', 'b')}" for _ in range(20)) for _ in range(15)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model, vocabulary = class_lm.train(frame)
    count = Counter(w for t in texts for w in [*t.split(), "end"])
    assert Counter(r.n for r in vocabulary.collect()) == Counter(count.values())
    digest = lambda w: next(class_lm.chunks(class_lm.pa.array([w]))).words.view("int64")[0]
    cls = {r.word: r.cls for r in vocabulary.collect()}
    kind = {w: cls[class_lm.np.uint64(class_lm.END_WORD).astype("int64") if w == "end" else digest(w)] for w in count}
    if share == 0.7:  # those below the cut are placed by their neighbours, whatever their ending
        least = max(m for m in count.values() if sum(k for k in count.values() if k >= m) >= share * sum(count.values()))
        a, b = ({c for w, c in kind.items() if w.startswith(x) and w.endswith("xyz") and count[w] < least} for x in "ab")
        assert a and b and not a & b
    # Class counts are those of the whole texts, and scores those of the model.
    joint = Counter((kind[x], kind[y]) for t in texts for x, y in zip(["end", *t.split()], [*t.split(), "end"]))
    tokens = Counter()
    for (_, c), m in joint.items():
        tokens[c] += m
    assert list(model.class_tokens) == [tokens[c] for c in range(class_lm.CLASSES)]
    assert list(model.class_types) == [sum(c == k for k in kind.values()) for c in range(class_lm.CLASSES)]
    new = "the a1xyz unheard of b2xyz b3xyz"
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, new])], "doc_id bigint, text string")
    found = {r.doc_id: r for r in class_lm.score_texts(asked, model, vocabulary).collect()}
    for i, t in enumerate([*texts, new]):
        words = [*t.split(), "end"]
        path = [kind.get(w, model.unseen) for w in ["end", *words]]
        want = sum(model.transitions[p, c] + math.log10(max(count[w], 1) / (tokens[c] + model.class_types[c] + 1))
                   for w, p, c in zip(words, path, path[1:]))
        assert found[i].score == pytest.approx(want) and found[i].n_known == sum(w in count for w in words)


# -- pipeline --------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert all(not base_measures(r[1])[-1] for r in rows)
    least = {i: c for i, _, c in brute_components(rows, 5, 80)}
    frame = spark.createDataFrame(rows, docs.schema)
    one = corpus_pipeline.ngram_jaccard_join(spark, frame, SF)
    assert sorted(r.doc_id for r in one.collect()) == sorted({least[r[0]] for r in rows})
    clean = corpus_pipeline.benchmark_decontamination(spark, one, SF)
    final = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert final and final <= {r.doc_id for r in clean.collect()}


def test_frequent_tokens_of_join_are_bounded(spark):
    drawn = random.Random(3)
    count = {drawn.randrange(-1 << 63, 1 << 63): n for n in [100, 90, 90, 50, *[8] * 4000]}
    counts = spark.createDataFrame(list(count.items()), "token bigint, n bigint").repartition(3)
    order = sorted(count, key=lambda t: (-count[t], t))
    for most in (0, 2, 3, 4, 1004, 4003, 4004, 9999):
        found = jaccard_join.frequent_tokens(counts, most).astype("int64").tolist()
        assert found == order[:len(found)]
        assert len(found) == {0: 0, 2: 1, 3: 3, 4: 4, 4004: 4004, 9999: 4004}.get(most, len(found))
        assert abs(len(found) - min(most, len(order))) <= 150
    assert len(jaccard_join.frequent_tokens(counts.where("false"), 10)) == 0


def test_join_leaves_no_shuffle_files(spark, docs):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {str(f) for d in folders for f in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}
    before = files()
    found = jaccard_join.near_duplicates(docs)
    for _ in range(40):  # Spark's cleaner removes them on a thread of its own
        left = files() - before
        if not left:
            break
        time.sleep(0.25)
    assert not left
    assert found.count() == docs.count()


def test_mixing_plans_budgets_once(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= len(re.findall(r"\bWindow \[", plan)) <= 3


def test_class_lm_holds_few_tokens_while_pairs_are_packed(spark, monkeypatch):
    np = class_lm.np
    monkeypatch.setattr(class_lm, "HELD", 100)
    frame = spark.createDataFrame([(varied(60, i),) for i in range(40)], "text string").coalesce(1)
    with small_batches(spark, 1):
        rows = class_lm.unit_bigrams(frame, np.zeros(0, np.uint64), np.zeros(0, np.int64), 1).where("side = 0").collect()
    tokens = [int(np.frombuffer(r.n, np.int64).sum()) for r in rows]
    assert sum(tokens) == 40 * 61 and max(tokens) <= 2 * 61
