"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat
from .class_lm import class_lm_scores
from .common import table
from .coordinates import minhash_duplicates
from .decontaminate import find_contamination
from .jaccard_join import near_duplicates
from .licenses import default_rules, scan_licenses
from .mixing import mix_sources, mix_sql
from .pivots import cluster_digests, cluster_vectors
from .prefix_trie import prefix_trie
from .quality import quality_rules
from .token_counts import count_tokens
from .url_filters import ENTITIES, HREF, RULES, filter_urls
from .warc import round_trip

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


@query()
def op3_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 4-word shingle sets have a similarity of 85 % or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


ECHO = "</s>[INST] ok [/INST]"


def _op9_sql() -> str:
    """Turns and digests in SQL; the formatted length counts marks and escapes."""
    def escaped(text):
        out = f"replace({text}, '\\', '\\\\')"
        for c in chat.TEMPLATE.controls:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out
    marks = " ".join(f"WHEN '{r}' THEN {len(t.opening) + len(t.closing)}" for r, t in chat.TEMPLATE.turns.items())
    before, after = chat.TEMPLATE.other.opening.split("{}")
    other = f"{len(before + after) + len(chat.TEMPLATE.other.closing)} + 2 * strlen(role)"
    allowed = " OR ".join(f"(prev = '{a}' AND role IN ({', '.join(repr(b) for b in after_)}))"
                          for a, after_ in chat.TEMPLATE.moves.items())
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{ECHO}'), (-1, 1, 'assistant', '{ECHO}'))),
o AS (SELECT *, coalesce(lag(role) OVER w, '') AS prev, row_number() OVER w AS k,
             count(*) OVER (PARTITION BY conv_id) AS m,
             (CASE role {marks} ELSE {other} END) + length({escaped('text')}) AS width
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(width)::BIGINT AS formatted_chars,
       bool_and({allowed}) AND max(CASE WHEN k = m THEN role END) = 'assistant' AS valid
FROM o GROUP BY conv_id"""


@query(_op9_sql())
def op9_chat_formatting(spark, sf_dir):
    """Conversations formatted, then read back from the formatted text and its loss mask."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    echo = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(ECHO).alias("text"))
    made = chat.format_chats(rows.unionByName(echo)).select(
        "conv_id", "formatted", "valid", chat.read_chats(F.col("formatted")).alias("back"),
        F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: chat.unescaped(s.text)),
                     "").alias("learned"))
    spoken = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid")


@query()
def op5_quality_rules(spark, sf_dir):
    """Base measures of every document and the verdict of the log-likelihood ratio."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op2_sql() -> str:
    """The same rules, intervals and suppression in SQL."""
    rules = ", ".join(f"({r.rule_id}, '{r.label}', '{r.keyword}', '{r.pattern}', {r.tier}, {r.score}, {r.base})"
                      for r in default_rules())
    return f"""
WITH rules(rule_id, label, keyword, pattern, tier, rule_score, base) AS (VALUES {rules}),
t AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END AS n_words,
        CASE WHEN w = '' THEN '' ELSE '|' || replace(w, ' ', ' |') || ' ' END AS seq FROM t),
hit AS (SELECT doc_id, rule_id, label, tier, rule_score, base,
          string_split(regexp_replace(seq, '(' || pattern || ')', chr(1) || '\\1' || chr(2), 'g'), '|') AS parts
        FROM s JOIN rules ON contains(seq, '|' || keyword || ' ') AND regexp_matches(seq, pattern)),
spans AS (SELECT doc_id, rule_id, label, tier, rule_score, base,
            unnest(list_filter(list_transform(parts, lambda p, i: CASE WHEN contains(p, chr(1)) THEN i - 1 END),
                               lambda x: x IS NOT NULL)) AS first,
            unnest(list_filter(list_transform(parts, lambda p, i: CASE WHEN contains(p, chr(2)) THEN i - 2 END),
                               lambda x: x IS NOT NULL)) AS last FROM hit),
judged AS (SELECT *, coalesce(CASE tier
    {' '.join(f"WHEN {k} THEN max(CASE WHEN tier <= {k} THEN last END) OVER o" for k in sorted({r.tier for r in default_rules()}))}
    END >= last, FALSE) AS suppressed FROM spans
  WINDOW o AS (PARTITION BY doc_id ORDER BY first, last DESC, tier, rule_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word,
    max(first) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR NOT suppressed) AS labels,
    max(rule_score) FILTER (base OR NOT suppressed) AS score FROM judged GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM s LEFT JOIN found USING (doc_id)"""


@query(_op2_sql())
def op2_license_scan(spark, sf_dir):
    """License phrases and labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _op6_sql() -> str:
    """Rules in SQL, and blocks carried over canonical links and refresh targets by recursion."""
    key = "CASE WHEN contains({0}, '://') THEN lower(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's')) || " \
          "regexp_extract({0}, '^.*?://[^/?#]*([^#]*)', 1, 's') END"
    fits = " UNION ALL ".join(
        f"SELECT * FROM (VALUES ('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}'))" for r, v in RULES)
    tags = {"CANON": r"""<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>""",
            "REFRESH": r"""<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>"""}
    quoted = HREF[5:].replace("'", "''")
    href = " || ".join(f"regexp_extract(t, '{quoted}', {i}, 'is')" for i in (1, 2, 3))
    decoded = "dst"
    for mark, reference in ENTITIES:
        mark = mark.replace("'", "''")
        decoded = f"regexp_replace({decoded}, '{reference[4:]}', '{mark}', 'gi')"
    return f"""
WITH RECURSIVE rules(rule, rhost, rpath, rverdict) AS ({fits}),
p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')) AS host,
             regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, {key.format('url')} AS key FROM p),
raw AS (SELECT url, unnest(list_transform(regexp_extract_all(html, '{tags["CANON"]}', 0, 'is'),
      lambda t: {href}) || list_transform(regexp_extract_all(html, '{tags["REFRESH"]}', 0, 'is'),
      lambda t: regexp_extract(t, '\\burl\\s*=\\s*["'']?([^"''>\\s]+)', 1, 'is'))) AS dst
  FROM p WHERE html ILIKE '%canonical%' OR html ILIKE '%refresh%'),
link AS (SELECT url, trim({decoded}) AS dst, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS site,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM raw),
whole AS (SELECT url, CASE WHEN dst = '' OR dst[1] = '#' THEN NULL
    WHEN regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN dst
    WHEN regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(dst, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || dst
    WHEN dst[1] = '/' THEN site || dst WHEN dst[1] = '?' THEN site || path || dst
    ELSE site || '/' || regexp_extract(path, '^/(.*/)', 1, 's') || dst END AS dst FROM link),
target AS (SELECT {key.format("url")} AS a, {key.format("dst")} AS b FROM (
    SELECT url, regexp_extract(dst, '^(.*?://[^/?#]*)', 1, 's') || array_to_string(list_reduce(list_transform(
      string_split(path, '/') || CASE WHEN regexp_matches(path, '/\\.\\.?$') THEN [''] ELSE []::VARCHAR[] END, lambda x: [x]),
      lambda done, x: CASE x[1] WHEN '.' THEN done WHEN '..' THEN done[1:greatest(len(done) - 1, 1)] ELSE done || x END), '/')
      || regexp_extract(dst, '^.*?://[^?#]*(.*)$', 1, 's') AS dst
    FROM (SELECT *, regexp_extract(dst, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM whole WHERE dst LIKE '%://%'))
  WHERE contains(url, '://')),
edge AS (SELECT a, b FROM target UNION SELECT b, a FROM target),
node AS (SELECT key FROM h UNION SELECT a FROM edge),
judged AS (SELECT key, arg_max(rverdict, length(rule)) AS verdict FROM node JOIN rules ON
    (split_part(split_part(key, '/', 1), '?', 1) = rhost OR ends_with(split_part(split_part(key, '/', 1), '?', 1), '.' || rhost))
    AND starts_with(regexp_extract(key, '^[^/?]*([^?]*)', 1, 's'), rpath) GROUP BY key),
reach(key) AS (SELECT key FROM judged WHERE verdict = 'block' AND key IN (SELECT a FROM edge)
               UNION SELECT b FROM reach JOIN edge ON edge.a = reach.key),
own AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rverdict, length(rule)) AS rverdict
        FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN key IN (SELECT key FROM reach) THEN 'block' END,
       'allow') AS verdict FROM h LEFT JOIN own USING (page_id)"""


@query(_op6_sql())
def op6_url_filter(spark, sf_dir):
    """Verdicts on every page's url, blocks carried to its aliases."""
    return filter_urls(table(spark, sf_dir, "pages"))


@query(mix_sql())
def op7_mix_sources(spark, sf_dir):
    """The documents of the mix, with whole epochs and the tokens of the last one."""
    return mix_sources(table(spark, sf_dir, "documents"))


@query()
def op8_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the item and the similarity."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM k""")
def op1_warc_segments(spark, sf_dir):
    """Pages written as WARC records with segments and chunked framing, and read back."""
    return round_trip(table(spark, sf_dir, "pages"))


@query()
def op4_token_counts(spark, sf_dir):
    """Tokens of every line of every document, a crossing token going to the line it begins in."""
    return count_tokens(table(spark, sf_dir, "documents"))


@query()
def op10_class_lm(spark, sf_dir):
    """Log probabilities of every document under unigrams and the class model."""
    return class_lm_scores(table(spark, sf_dir, "documents"))


def _op13_sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """The rounds written out; a vector is a list of integers."""
    gap = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    nearest = (f"SELECT vec_id, n, v, arg_min(c, d * {k} + c) AS cluster, min(d) AS distance FROM (SELECT x.vec_id, x.n, x.v, "
               f"c.c, {gap} AS d FROM x, c{{0}} AS c) GROUP BY vec_id, n, v")
    steps = "".join(f"""
a{r} AS ({nearest.format(r)}),
s{r} AS (SELECT cluster, i, floor_div FROM (SELECT cluster, i, (sum(v[i])::HUGEINT - ((sum(v[i])::HUGEINT % count(*)) + count(*)) % count(*)) // count(*)
  AS floor_div FROM a{r}, range(1, {dim + 1}) AS g(i) GROUP BY cluster, i)),
c{r + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (SELECT cluster, list(floor_div::BIGINT ORDER BY i) AS v
  FROM s{r} GROUP BY cluster) AS m ON m.cluster = c.c),""" for r in range(rounds))
    return f"""
WITH raw AS (SELECT vec_id, list_transform(embedding, lambda e: 64 * e::DOUBLE) AS e FROM embeddings),
x AS (SELECT vec_id, row_number() OVER () AS n, list_transform(e, lambda y: floor(y)::BIGINT) AS v FROM raw
  WHERE len(e) = {dim} AND len(list_filter(e, lambda y: y IS NOT NULL AND isfinite(y))) = {dim}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1)::INT AS c, v FROM x QUALIFY c < {k}),{steps}
f AS ({nearest.format(rounds)})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{rounds} AS c ON c.c = f.cluster"""


@query(_op13_sql())
def op13_centroid_clusters(spark, sf_dir):
    """Clusters of the embeddings after three rounds from 16 seeded centroids."""
    return cluster_digests(cluster_vectors(table(spark, sf_dir, "embeddings")))


@query()
def op12_minhash_duplicates(spark, sf_dir):
    """Components of documents whose 2-word shingle sets have a similarity of 80 % or more."""
    return minhash_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def _op11_sql(heads: int = 4, group: int = 20) -> str:
    """Prefixes as digests of the turns so far; a subtree's sum counts each node at its least member."""
    bits = "CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END"
    crc = ("xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), "
           f"lambda s, x: list_reduce(range(8), lambda a, b: {bits}, xor(s, x)), 4294967295::BIGINT))")
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j,
             sha256(strlen(role) || ':' || role || text) AS turn, len(regexp_extract_all(text, '[^ \t-\r]+')) AS words FROM t),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
c AS (SELECT n.conv_id, {crc} % {heads} AS h, n.conv_id - n.conv_id % {group} AS base FROM n),
r AS (SELECT c.conv_id, o.j AS d, turn, words FROM c JOIN o ON o.conv_id = c.base AND o.j <= c.h
      UNION ALL SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + o.j - c.h, turn, words
      FROM c JOIN o ON o.conv_id = c.conv_id AND o.j > c.h LEFT JOIN n AS b ON b.conv_id = c.base),
x AS (SELECT conv_id, d, words, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
y AS (SELECT *, lag(key) OVER w AS parent, lead(key) OVER w IS NULL AS final FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
node AS (SELECT key, min(d) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (final), '')) AS ends_sha256 FROM y GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
own AS (SELECT node.key, node.conv_id, (n_convs - 1) * words AS saved, (kids.n IS NULL)::INT AS leaf FROM node LEFT JOIN kids USING (key)),
below AS (SELECT y.key, sum(coalesce(own.saved, 0)) OVER w AS saved, sum(coalesce(own.leaf, 0)) OVER w AS leaves
  FROM y LEFT JOIN own ON own.key = y.key AND own.conv_id = y.conv_id WINDOW w AS (PARTITION BY y.conv_id ORDER BY y.d DESC)),
total AS (SELECT key, sum(saved) AS saved, sum(leaves) AS leaves FROM below GROUP BY key)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN total USING (key) LEFT JOIN kids USING (key) LEFT JOIN node AS up ON up.key = node.parent"""


@query(_op11_sql())
def op11_prefix_trie(spark, sf_dir):
    """The nodes of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
