"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole. In a byte-level vocabulary the tokens' bytes laid end to end are
the text, so the running sum of token lengths gives each token's span. The spans are joined to the
sections' intervals by binary search, and a token that crosses a boundary goes to one section by an
explicit rule, so that the counts of a document's sections add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # every executor needs the file at this path
# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_starts(text: bytes) -> np.ndarray:
    """Sections as lines, each with its line end: byte offsets of their starts, from 0."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], ends[ends < len(text)]])


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) per section for token spans [start, end) and section starts.

    first and last: the section of the token's first or last byte; most: the one that holds most of
    its bytes, the earlier of equal ones.
    """
    head = np.searchsorted(sections, starts, "right") - 1
    tail = np.searchsorted(sections, ends - 1, "right") - 1
    crossing = head != tail
    owner = tail if rule == "last" else head.copy()
    if rule == "most":
        for t in np.flatnonzero(crossing):
            cuts = np.concatenate([[starts[t]], sections[head[t] + 1:tail[t] + 1], [ends[t]]])
            owner[t] = head[t] + int(np.argmax(np.diff(cuts)))
    size = len(sections)
    return np.bincount(owner, minlength=size), np.bincount(owner[crossing], minlength=size)


def count_tokens(docs: DataFrame, rule: str = "first", sections: Callable[[bytes], np.ndarray] = line_starts,
                 vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_crossing), a row per section of each row of
    docs (doc_id, text; other columns are ignored).

    sections gives the byte offsets at which a text's sections start (ascending, the first 0); the
    spans returned are in characters. n_crossing counts the tokens that reach into other sections.
    A null or empty text is one section without tokens. Null ids stay null, repeated rows are counted
    one by one, an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ("doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing")

    def run(batches):
        encoding, lengths = _encoding(vocabulary, pattern)
        for batch in batches:
            ids, parts, size = [], [], 0

            def packed():
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(ids))),
                                                   *map(pa.array, columns)], names=list(names))

            for at, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                raw = text.encode()
                span = lengths[encoding.encode_to_numpy(text, disallowed_special=())] if raw else np.zeros(0, np.int64)
                ends = np.cumsum(span)
                begin = sections(raw)
                tokens, crossing = attribute(ends - span, ends, begin, rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                stop = np.append(begin[1:], len(raw))
                ids.append(np.full(len(begin), at))
                parts.append((np.arange(len(begin)), chars[begin], chars[stop], tokens, crossing))
                size += len(begin)
                if size > 50_000:
                    yield packed()
                    ids, parts, size = [], [], 0
            if parts:
                yield packed()

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def document_tokens(counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) from count_tokens."""
    return counts.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
