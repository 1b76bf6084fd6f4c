"""Substring dedup by line and paragraph hashing.

Units are the lines of a text.  Lines longer than ``UNIT_WORDS`` words are cut further at content-defined points (words
whose pair hash is the least within ``REACH`` words), since a passage pasted into the middle of a line shares no whole
line with its source but falls back into step after one cut.  Units are normalised (lower case, words only), digests are
grouped over the whole corpus, the earliest occurrence by (document id, unit number) is kept and every later one is a
repeat.  Repeats that follow one another form a run; runs of at least ``min_run_words`` words are removed and reported
with their offsets in the original text.  A line that stands as a whole line earlier is removed whatever its length
(``whole_lines``), and so is a copy of a whole document; the least length holds only for runs of pieces of lines, which
words in common idioms would form by chance.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialise

UNIT_WORDS = 12
REACH = 4
_WORD = re.compile(r"\w+")
_UNITS = "id long, unit int, start int, stop int, words int, line_units int, d1 long, d2 long"


def units(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, stop, words, digest) of each unit with a word in it; offsets are code points, the end exclusive."""
    return ((start, stop, words, digest) for start, stop, words, line_units, digest in _units_and_lines(text) if line_units < 2)


def _units_and_lines(text: str | None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(start, stop, words, line_units, digest): the units and, before its own units, each line that is cut.

    ``line_units`` is 0 for a piece of a line, 1 for a line that is one unit, else the number of the line's units.
    """
    at = 0
    for line in (text or "").split("\n"):
        found = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(line)]
        cuts = [0, *_cut_points([w for _, _, w in found]), len(found)] if len(found) > UNIT_WORDS else [0, len(found)]
        n = len(cuts) - 1
        pieces = [(0, len(found), n), *((i, j, 0) for i, j in zip(cuts, cuts[1:]))] if n > 1 else [(0, len(found), 1)]
        for i, j, line_units in pieces:
            if i < j:
                joined = " ".join([w for _, _, w in found[i:j]]).encode("utf-8", "surrogatepass")
                yield at + found[i][0], at + found[j - 1][1], j - i, line_units, hashlib.blake2b(joined, digest_size=16).digest()
        at += len(line) + 1


def _cut_points(words: list[str]) -> list[int]:
    """Where a long line is cut: before words whose pair hash is strictly the least of the REACH before, and no more than those after."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]
    n = len(pair)
    if n <= 2 * REACH:
        return []
    view = np.lib.stride_tricks.sliding_window_view(pair, REACH)
    before, after = view[: n - 2 * REACH].min(axis=1), view[REACH + 1 : n - REACH + 1].min(axis=1)
    mid = pair[REACH : n - REACH]
    return (np.flatnonzero((mid < before) & (mid <= after)) + REACH).tolist()


def unit_table(docs: DataFrame, id_col: str, text_col: str, whole_lines: bool = False) -> DataFrame:
    """One row per unit; with ``whole_lines`` also one per cut line, which bears its first unit's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = ([], [], [], [], [], [])
            digests = bytearray()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = 0
                for start, stop, words, line_units, digest in _units_and_lines(text):
                    if line_units < 2 or whole_lines:
                        for col, x in zip(cols, (key, n, start, stop, words, line_units)):
                            col.append(x)
                        digests += digest
                    n += line_units < 2
            pairs = np.frombuffer(bytes(digests), dtype=np.int64).reshape(-1, 2)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "unit", "start", "stop", "words", "line_units", "d1", "d2"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _UNITS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = 18, whole_lines: bool = True) -> DataFrame:
    """(id, start, stop, words, n_units, kept_id): spans to remove, offsets in code points of the original text.

    ``kept_id`` is the least document id whose copy stays.  Repeats within one document count.  Documents without
    repeats give no row.  Null and empty texts have no units.  Rows without an id are ignored; rows that repeat an id
    and text repeat each other's units at equal rank and so neither is removed for the other.  Extra columns are
    ignored; an empty table gives an empty result.
    """
    every = materialise(unit_table(docs.where(F.col(id_col).isNotNull()), id_col, text_col, whole_lines), "units")
    place = F.struct("id", "unit")
    firsts = [F.min(place).alias("first")] + [F.min(F.when(F.col("line_units") > 0, place)).alias("first_line")] * whole_lines
    first = materialise(every.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), *firsts).where("n > 1").drop("n"), "unit-repeats")
    whole = (F.col("line_units") > 0) & (place != F.col("first_line")) if whole_lines else F.lit(False)
    later = every.join(first, ["d1", "d2"]).where("struct(id, unit) <> first")
    later = later.select("id", "unit", "start", "stop", "words", "line_units", F.col("first.id").alias("kept"), whole.alias("whole")).dropDuplicates(["id", "unit", "start", "line_units"])
    in_order = Window.partitionBy("id").orderBy("unit")
    if whole_lines:  # units of a repeated line are repeats too, since they stand in the earlier line
        covered = F.max(F.when(F.col("line_units") > 1, F.col("unit") + F.col("line_units") - 1)).over(in_order)
        later = later.withColumn("whole", F.col("whole") | F.coalesce(covered >= F.col("unit"), F.lit(False))).where("line_units < 2")
    run = F.col("unit") - F.dense_rank().over(in_order)
    if whole_lines:
        later = later.withColumn("run", run).withColumn("run_words", F.sum("words").over(Window.partitionBy("id", "run")))
        later = later.where(F.col("whole") | (F.col("run_words") >= min_run_words)).drop("run_words")
    out = (
        later.withColumn("run", run)
        .groupBy("id", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("n_units"), F.min("kept").alias("kept_id"))
    )
    return (out if whole_lines else out.where(F.col("words") >= min_run_words)).drop("run")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = 18, whole_lines: bool = True) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, the texts without their repeated spans."""
    cuts, key = fresh_name(docs, "spans"), fresh_name(docs, "span_id")
    spans = repeated_spans(docs, id_col, text_col, min_run_words, whole_lines).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cuts))
    spans = spans.withColumnRenamed("id", key)
    text = F.col(text_col)
    ends = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.char_length(text)))
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["stop"]))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a)), "")
    joined = docs.join(spans, F.col(id_col) == F.col(key), "left")
    return joined.withColumn(text_col, F.when(F.col(cuts).isNull(), text).otherwise(kept)).select(*docs.columns)
