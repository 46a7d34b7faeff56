"""CSV files with quoted line ends, read by many tasks.

A file is read as physical lines in byte ranges. What a line does to the reader's state, inside a
quoted cell or outside, is a function of two values. Tasks compose the functions of their range and
send one row per range; composing these in file order tells every range in which state it begins.
Then each task joins its own lines to records. A record that crosses ranges leaves a fragment in each
of them, at most two per range, and these are put together at the end.

Quotes count only where a cell begins, as CSV readers have it, so a stray quote inside a cell changes
nothing. Line ends are LF or CRLF; those inside quotes are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

RECORD = "file string, start bigint, kind int, first boolean, record string"
WHOLE, HEAD, TAIL, MIDDLE = range(4)  # a record; the end, the beginning, the inside of one


def _transitions(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether the line ends inside a quoted cell: begun outside, begun inside."""
    comma = re.escape(sep)
    closed = rf'"[^"]*+(?:""[^"]*+)*+"[^{comma}]*'
    opened = lambda text: F.regexp_replace(text, f"(^|{comma}){closed}", "$1").rlike(f'(^|{comma})"')
    rest = F.regexp_replace(line, rf'^[^"]*+(?:""[^"]*+)*+"[^{comma}]*', "")
    some = F.contains(line, F.lit('"'))
    closes = line.rlike(r'^[^"]*+(?:""[^"]*+)*+"')
    return some & opened(line), ~some | ~closes | opened(rest)


def _lines(spark: SparkSession, path, sep: str) -> DataFrame:
    raw = spark.read.text(path, lineSep="\n")
    outside, inside = _transitions(F.col("value"), sep)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      "value", outside.alias("outside"), inside.alias("inside"))


def _states(outside: np.ndarray, inside: np.ndarray, state: np.ndarray) -> np.ndarray:
    """State before each line and after the last, for a state at the beginning (0 or 1)."""
    fixed = outside == inside  # such a line ends in one state, wherever it began; others keep or swap
    swaps = np.cumsum(outside & ~inside)
    at = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    base = np.where(at >= 0, outside[at], state)
    return np.concatenate([[state], base ^ ((swaps - np.where(at >= 0, swaps[at], 0)) & 1).astype(bool)]).astype(bool)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(range, is its first batch, rows): batches cut where the byte range changes."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        start = np.asarray(batch.column("start"))
        file = batch.column("file").dictionary_encode()
        code = np.asarray(file.indices)
        cuts = np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(start)]):
            key = (file.dictionary[int(code[a])].as_py(), int(start[a]))
            yield key, key != last, batch.slice(a, b - a)
            last = key


def _flags(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("outside", "inside"))


def _begun_inside(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """The state in which each byte range begins; a bit per range on the driver and in the tasks."""

    def run(batches):
        key, ends = None, (False, True)
        for now, new, rows in _ranges(batches):
            if new:
                if key:
                    yield row(key, ends)
                key, ends = now, (False, True)
            flags = _flags(rows)
            after = [bool(_states(*flags, s)[-1]) for s in (False, True)]
            ends = (after[ends[0]], after[ends[1]])
        if key:
            yield row(key, ends)

    def row(key, ends):
        return pa.RecordBatch.from_pydict({"file": [key[0]], "start": pa.array([key[1]], pa.int64()),
                                           "outside": [ends[0]], "inside": [ends[1]]})

    found = lines.select("file", "start", "outside", "inside").mapInArrow(
        run, "file string, start bigint, outside boolean, inside boolean").collect()
    state, file, out = False, None, {}
    for r in sorted(found, key=lambda r: (r.file, r.start)):
        state = state if r.file == file else False
        out[r.file, r.start], file = state, r.file
        state = r.inside if state else r.outside
    return out


def records(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """(file, start, first, record): the records of CSV files; first marks a file's first record."""
    lines = _lines(spark, path, sep)
    begun = _begun_inside(lines)
    sent = spark.sparkContext.broadcast(begun)

    def run(batches):
        key, state, held, kind, first = None, False, [], WHOLE, False
        for now, new, rows in _ranges(batches):
            if new:
                if key and held:
                    yield out(key, [MIDDLE if kind == HEAD else TAIL], [first], ["\n".join(held)])
                key, state = now, sent.value.get(now, False)
                held, kind, first = [], HEAD if state else WHOLE, now[1] == 0
            before = _states(*_flags(rows), state)
            state = bool(before[-1])
            text = rows.column("value").to_pylist()
            opens, ends = ~before[:-1], ~before[1:]
            kinds, firsts, made = [], [], []
            for line, begins, closes in zip(text, opens, ends):
                held.append(line)
                if closes:
                    kinds.append(kind)
                    firsts.append(first)
                    made.append(held[0] if len(held) == 1 else "\n".join(held))
                    held, kind, first = [], WHOLE, False
            if made:
                yield out(key, kinds, firsts, made)
        if key and held:
            yield out(key, [MIDDLE if kind == HEAD else TAIL], [first], ["\n".join(held)])

    def out(key, kinds, firsts, made):
        return pa.RecordBatch.from_pydict({
            "file": [key[0]] * len(made), "start": pa.array([key[1]] * len(made), pa.int64()),
            "kind": pa.array(kinds, pa.int32()), "first": firsts, "record": pa.array(made, pa.string())})

    found = lines.mapInArrow(run, RECORD)
    whole = found.where(F.col("kind") == WHOLE).drop("kind")
    if not any(begun.values()):
        return whole.unionByName(found.where(F.col("kind") == TAIL).drop("kind"))  # a cell left open at a file's end
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == TAIL)
    parts = found.where(F.col("kind") != WHOLE).withColumn("chain", F.count_if(F.col("kind") == TAIL).over(order))
    crossing = parts.groupBy("file", "chain").agg(
        F.min("start").alias("start"), F.bool_or("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x.record), "\n").alias("record"))
    return whole.unionByName(crossing.drop("chain"))


def split_csv(spark: SparkSession, path, schema: T.StructType, **options) -> DataFrame:
    """The rows of CSV files with a header each, all columns text; every record is parsed once."""
    sep = options.get("sep", options.get("delimiter", ","))
    rows = records(spark, path, sep).where("NOT first").select(F.regexp_replace("record", "\r$", "").alias("record"))
    settings = {k: str(v) for k, v in options.items() if k not in ("header", "multiLine")} | {"multiLine": "true"}
    parsed = F.from_csv("record", F.lit(schema.toDDL()), settings)
    return rows.where("record <> ''").select(parsed.alias("row")).select("row.*")
