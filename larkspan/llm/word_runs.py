"""Periodic runs of words, found as maximal pairs.

Two equal stretches of ``l`` words that start ``d`` words apart and can be extended neither to the left nor to the right
are a maximal pair.  Where ``d <= l`` their union is a stretch of period ``d`` that no neighbouring word extends, so the
maximal pairs under that one condition are exactly the runs, once for every multiple of the period; the least stays.

The pairs are read off the LCP-interval tree, bottom-up.  A node holds the places of its common words in order, with the
word left of each; where two children meet, a place of the smaller one looks at the places of the larger at most ``l``
away.  Three equal stretches that start within their own length are a progression by their period, so on either side of a
place all left words are equal but for the leftmost: one look tells whether a class of left words differs, and only then
pairs are read.  Nodes of one and the same left word are joined without a look.  That is O(n log^2 n) steps and the pairs,
which are O(n).

A run of ``least`` words holds a stretch of half as many that comes twice.  Words outside of such stretches need no
suffixes, so only texts that repeat a stretch are sorted: by prefix doubling, for all texts of a batch at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run that counts; periods are at most half of a run.
LEAST = 12
#: Texts are worked on in portions of about so many bytes, one text at least.
PORTION = 4_000_000
SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, parted by ASCII white space, and where each text's words begin (one entry more than texts)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, bounds = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), before[bounds - bounds[0]]


def _joint_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.unique(first * (second.max(initial=0) + 1) + second, return_inverse=True)[1].astype(np.int64)


def _ahead(ranks: np.ndarray, by: int, end: np.ndarray) -> np.ndarray:
    """The rank ``by`` places on, 0 beyond the text; ranks begin at 1."""
    at = np.arange(len(ranks)) + by
    return np.where(at < end, ranks[np.minimum(at, len(ranks) - 1)], 0)


class Suffixes:
    """The places whose next ``size`` words come again in the same text, in lexicographic order text by text.

    ``order`` lists them, ``lcp[k]`` tells how many words ``order[k - 1]`` and ``order[k]`` share, 0 where under ``size``.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray, size: int) -> None:
        n = len(words)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        end = bounds[1:][text]
        one = words + 1
        ranks, width = _joint_ranks(text, one) + 1, 1
        first = ranks
        while width < size:
            step = min(width, size - width)  # two windows that overlap cover any width
            ranks = _joint_ranks(ranks, _ahead(ranks, step, end)) + 1
            width += step
        order = np.argsort(ranks, kind="stable")
        levels, width = [], size
        slots = np.arange(n)
        keys = ranks[order]
        ranks = np.append(np.zeros(n, np.int64), -1)
        while len(slots):
            opens = np.append(True, keys[1:] != keys[:-1])
            begin = slots[np.maximum.accumulate(np.where(opens, np.arange(len(slots)), 0))]
            ranks = ranks.copy()
            ranks[order[slots]] = begin
            levels.append((width if not levels else levels[-1][0] * 2, ranks.astype(np.int32 if n < 2**31 else np.int64)))
            alone = opens & np.append(opens[1:], True)
            slots = slots[~alone]
            at = order[slots]
            keys = ranks[at] * (n + 1) + ranks[np.minimum(at + levels[-1][0], n)] + 1
            turn = np.argsort(keys, kind="stable")
            order[slots], keys = at[turn], keys[turn]
            if len(levels) == 1:
                several = slots
        self.order = order[several]
        a, b = self.order[:-1], self.order[1:]
        shared = np.zeros(len(a), np.int64)
        for step, ranks in reversed(levels):
            shared += step * (ranks[np.minimum(a + shared, n)] == ranks[np.minimum(b + shared, n)])
        first = np.append(first, -1)
        open_ = shared >= size
        for _ in range(size - 1):
            open_ = open_ & (first[np.minimum(a + shared, n)] == first[np.minimum(b + shared, n)])
            shared += open_
        self.lcp = np.append(0, np.where(shared >= size, shared, 0))


def _in_tree(places: list[int], lcp: list[int], left: list[int], found: dict[tuple[int, int], int]) -> None:
    """Adds the runs below one LCP interval: its suffixes in order, ``lcp[k]`` shared by those at ``k - 1`` and ``k``."""

    def emit(i: int, j: int, shared: int) -> None:
        run = (i, j + shared)
        found[run] = min(found.get(run, j - i), j - i)

    def meet(shared: int, one: tuple[list[int], int | None], other: tuple[list[int], int | None]) -> tuple[list[int], int | None]:
        (few, few_class), (many, many_class) = (one, other) if len(one[0]) <= len(other[0]) else (other, one)
        if few_class is None or few_class != many_class:
            for i in few:
                mine = left[i]
                k = bisect_right(many, i)
                if k < len(many) and left[many[k]] != mine:
                    while k < len(many) and many[k] <= i + shared:
                        emit(i, many[k], shared)
                        k += 1
                j = many[min(bisect_left(many, i - shared), len(many) - 1)]
                if i - shared <= j < i and left[j] != mine:
                    emit(j, i, shared)
        if len(few) * 8 < len(many):
            for i in few:
                insort(many, i)
        else:
            many.extend(few)
            many.sort()
        return many, few_class if few_class == many_class else None

    stack: list[tuple[list[int], int | None]] = []
    joints: list[int] = []
    for place, shared in zip(places, lcp):
        while joints and joints[-1] > shared:
            right = stack.pop()
            stack.append(meet(joints.pop(), stack.pop(), right))
        if stack:
            joints.append(shared)
        stack.append(([place], left[place]))
    while joints:
        right = stack.pop()
        stack.append(meet(joints.pop(), stack.pop(), right))


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period), ordered so, of the runs of at least ``least`` words; ``words`` are numbers.

    A run is at least twice its smallest period long.  ``bounds`` tells where each text begins.
    """
    size = (least + 1) // 2
    none = np.empty((0, 4), np.int64)
    n, text = len(words), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n <= size:
        return none
    # texts that repeat ``size`` words, told by hashes: a false match only costs time
    with np.errstate(over="ignore"):
        mixed = (text + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(size):
            mixed[: n - k] = (mixed[: n - k] ^ words[k:].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            mixed[: n - k] ^= mixed[: n - k] >> np.uint64(29)
    whole = np.arange(n) + size <= bounds[1:][text]
    ordered = np.sort(mixed[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return none
    place = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
    repeats = np.unique(text[whole & (twice[place] == mixed)])
    chosen = np.zeros(len(bounds) - 1, bool)
    chosen[repeats] = True
    part = words[chosen[text]]
    part_bounds = np.concatenate(([0], np.cumsum(np.diff(bounds)[repeats])))
    suffixes = Suffixes(part, part_bounds, size)
    order, lcp = suffixes.order, suffixes.lcp
    left = np.concatenate(([-1], part[:-1]))
    left[part_bounds[:-1]] = -1
    opens = np.flatnonzero(lcp == 0)
    sizes = np.diff(np.append(opens, len(order)))
    # intervals of two suffixes need no tree
    pairs = opens[sizes == 2]
    i, j, shared = np.minimum(order[pairs], order[pairs + 1]), np.maximum(order[pairs], order[pairs + 1]), lcp[pairs + 1]
    good = (left[i] != left[j]) & (j - i <= shared)
    found = {(a, b): d for a, b, d in zip(i[good].tolist(), (j + shared)[good].tolist(), (j - i)[good].tolist())}
    lefts = left.tolist() if (sizes > 2).any() else []
    for at, many in zip(opens[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        _in_tree(order[at : at + many].tolist(), lcp[at : at + many].tolist(), lefts, found)
    rows = np.array([(a, b - a, d) for (a, b), d in found.items() if b - a >= least], np.int64).reshape(-1, 3)
    owner = np.searchsorted(part_bounds, rows[:, 0], "right") - 1
    out = np.column_stack((repeats[owner], rows[:, 0] - part_bounds[owner], rows[:, 1:]))
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + PORTION, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _results(ids: pa.Array, texts: pa.Array, least: int) -> pa.RecordBatch:
    spelled, bounds = split_words(texts)
    words = np.asarray(spelled.dictionary_encode().indices).astype(np.int64)
    runs = find_runs(words, bounds, least)
    depth = np.zeros(len(words) + 1, np.int64)
    begin = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(depth, begin + runs[:, 3], 1)
    np.add.at(depth, begin + runs[:, 2], -1)
    stays = np.cumsum(depth[:-1]) == 0
    kept_before = np.concatenate(([0], np.cumsum(stays)))[bounds]
    kept = pa.ListArray.from_arrays(pa.array(kept_before, pa.int32()), spelled.filter(pa.array(stays)))
    held = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    parts = pa.StructArray.from_arrays([pa.array(runs[:, c].copy()) for c in (1, 2, 3)], names=["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(held, pa.int32()), parts)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), listed, pc.binary_join(kept, " ")], names=["id", "n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed): one row per document row.

    Words are parted by ASCII white space and numbered from 0.  ``runs`` are structs (start, length, period) in order of
    start, then period.  ``collapsed`` is the text without the words that a run holds after its first period, words
    joined by one space.  A null text counts as empty and has no words, no runs and an empty ``collapsed``.  Texts of any
    length are read whole, by one worker each.  Repeated rows and rows without an id are answered like others; extra
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                yield _results(part.column(0), part.column(1), least)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
