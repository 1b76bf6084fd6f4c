"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into ``k // 2 + 1`` segments, fewer than plain pigeonhole needs.  Of two fingerprints that
differ in at most ``k`` bits, one segment then differs in at most one bit, so each segment is indexed under every
variant with one bit wiped out: equal variants meet in an equality shuffle and are verified on all 64 bits.

Exact copies collapse to one fingerprint before any of that.  A bucket is read as a sorted stream and yields only
links to the least member of each of its components, never its pairs.  A bucket larger than ``bucket`` fingerprints is
not held: it is dealt again under finer keys, and again until every bucket fits (the bits that a bucket's members do not
share yet differ in at most ``k`` places, so of ``k + 1`` parts of them one is equal), which keeps the search exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialise
from .components import connected_components

SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of one UTF-8 text: ASCII lower case, white-space words, word shingles, XXH64 with seed 42."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=">u8")
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer.  A null text counts as empty, whose fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _segments(k: int) -> list[tuple[int, int]]:
    """(low bit, width) of each segment, two at least."""
    n = max(2, k // 2 + 1)
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _variants(prints: DataFrame, k: int) -> DataFrame:
    """(key, fp): key = wiped bit position and the segment without that bit."""
    keys = []
    for low, width in _segments(k):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        keys += [value.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((low + bit) << 32)) for bit in range(width)]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _stars(members: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
    """Components of ``members`` (distinct fingerprints) at ``k`` bits, as (members, least signed member)."""
    left, out = members, []
    while len(left):
        group, todo = [left[:1]], left[:1]
        left = left[1:]
        while len(todo) and len(left):
            near = np.bitwise_count(left ^ todo[0]) <= k
            todo = np.concatenate((todo[1:], left[near]))
            if near.any():
                group.append(left[near])
                left = left[~near]
        whole = np.concatenate(group)
        if len(whole) > 1:
            out.append((whole, int(whole.view(np.int64).min())))
    return out


def _bucket_reader(k: int, limit: int, keys: int):
    """Reads rows sorted by their first ``keys`` columns, the fingerprint last; emits (kind, a, b, c).

    The key is a variant's, or the mask of the bits that all members share and their value.  kind 0: a link from a to b.
    kind 1: fingerprint a of an overfull bucket, to be dealt under mask b and value c.
    """
    shared_by = {}
    for low, width in _segments(k):
        for bit in range(low, low + width):
            shared_by[bit] = ((1 << width) - 1 << low) & ~(1 << bit)

    def shared(key: tuple[int, ...]) -> int:
        return shared_by[key[0] >> 32] if keys == 1 else key[0] % 2**64

    def finer(key: tuple[int, ...], members: np.ndarray) -> list[np.ndarray]:
        """Under each of ``k + 1`` parts of the bits not shared yet."""
        mask = shared(key)
        free = [bit for bit in range(64) if not mask >> bit & 1]
        cuts = [len(free) * i // (k + 1) for i in range(k + 2)]
        rows = []
        for g in range(k + 1):
            under = np.uint64(mask | sum(1 << bit for bit in free[cuts[g] : cuts[g + 1]]))
            n = len(members)
            rows.append(np.stack((np.ones(n, np.int64), members.view(np.int64), np.full(n, under.view(np.int64)), (members & under).view(np.int64))))
        return rows

    def links(members: np.ndarray) -> list[np.ndarray]:
        rows = []
        for whole, least in _stars(members, k):
            ids = whole.view(np.int64)
            ids = ids[ids != least]
            rows.append(np.stack((np.zeros(len(ids), np.int64), ids, np.full(len(ids), least), np.zeros(len(ids), np.int64))))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, spilling = None, np.empty(0, np.uint64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([np.asarray(batch.column(i)) for i in range(keys)])
            prints = np.asarray(batch.column(keys)).view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], (cols[:, 1:] != cols[:, :-1]).any(axis=0))))
            ends = np.append(starts[1:], len(prints))
            rows = []
            first = 0
            if held_key is not None and tuple(cols[:, 0].tolist()) == held_key:
                mine, first = prints[: ends[0]], 1
                if spilling:
                    rows += finer(held_key, mine)
                else:
                    held = np.concatenate((held, mine))
            if (first < len(starts)) and held_key is not None:
                if not spilling and len(held) > 1:
                    rows += links(np.unique(held)) if len(held) <= limit else finer(held_key, held)
                held_key, held, spilling = None, np.empty(0, np.uint64), False
            sizes = (ends - starts)[first:-1]
            begin = starts[first:-1]
            two = begin[sizes == 2]
            a, b = prints[two], prints[two + 1]
            close = (np.bitwise_count(a ^ b) <= k) & (a != b)
            pair = np.stack((a[close], b[close])).view(np.int64)
            n = pair.shape[1]
            rows.append(np.stack((np.zeros(n, np.int64), pair.max(axis=0, initial=-(2**63)), pair.min(axis=0, initial=2**63 - 1), np.zeros(n, np.int64))))
            for at, size in zip(begin[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                members = prints[at : at + size]
                rows += links(np.unique(members)) if size <= limit else finer(tuple(cols[:, at].tolist()), members)
            if first < len(starts):
                held_key, held = tuple(cols[:, -1].tolist()), prints[starts[-1] :].copy()
            if not spilling and len(held) > limit:
                rows += finer(held_key, held)
                held, spilling = np.empty(0, np.uint64), True
            yield emit(rows)
        if held_key is not None and not spilling and len(held) > 1:
            yield emit(links(np.unique(held)))

    def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(rows, axis=1) if rows else np.empty((4, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in flat], names=["kind", "a", "b", "c"])

    return run


def fingerprint_links(prints: DataFrame, k: int = 3, bucket: int = 8192) -> DataFrame:
    """(a, b): links that give the components of all fingerprints ``fp`` (distinct) at ``k`` or fewer differing bits.

    Each further dealing of overfull buckets leaves its members fewer bits to differ in, so a handful of them end.  A
    bucket holds at least ``2 ** k``, as many as ``k`` bits can tell apart.
    """
    bucket = max(bucket, 1 << k)
    kinds = "kind long, a long, b long, c long"
    dealt = _variants(prints, k).repartition("key").sortWithinPartitions("key")
    found = materialise(dealt.mapInArrow(_bucket_reader(k, bucket, 1), kinds), "simhash-links")
    direct = found.where("kind = 0").select("a", "b")
    while not (over := found.where("kind = 1")).isEmpty():
        finer = over.select(F.col("b").alias("mask"), F.col("c").alias("value"), F.col("a").alias("fp")).distinct()
        finer = finer.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        found = materialise(finer.mapInArrow(_bucket_reader(k, bucket, 2), kinds), "simhash-finer")
        direct = direct.union(found.where("kind = 0").select("a", "b"))
    return direct.where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 3) -> DataFrame:
    """(id, fp, component_id): one row per document row.

    ``component_id`` is the least id reachable over links of at most ``k`` differing fingerprint bits, the row itself
    included.  Null and empty texts share fingerprint 0 and link like any other.  Rows without an id keep their
    fingerprint; they join components but cannot name one unless no member has an id (then it is null).  Repeated rows
    give repeated results.  Extra columns are ignored.  An empty table gives an empty result.
    """
    marked = materialise(with_fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    prints = materialise(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-distinct")
    found = connected_components(fingerprint_links(prints.select("fp"), k))
    rooted = materialise(
        prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root")),
        "simhash-roots",
    )
    named = materialise(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-names")
    by_print = materialise(rooted.join(named, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(by_print, "fp").select("id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, whose id names its component.

    Of several rows with that id the one with the least text, then the least other columns, stays.  Rows without an id
    cannot name a component and stay as they are.  An empty table gives an empty result; extra columns may have any names.
    """
    groups = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, k)
    kept = materialise(groups.where("id = component_id").groupBy("id").agg(F.count(F.lit(1)).alias("n")), "simhash-kept")
    mark = fresh_name(docs, "kept_id")
    out = docs.join(kept.select(F.col("id").alias(mark)).hint("merge"), F.col(id_col) == F.col(mark), "left_semi")
    if kept.where("n > 1").limit(1).count():
        many = kept.where("n > 1").select(F.col("id").alias(mark)).hint("merge")
        again = out.join(many, F.col(id_col) == F.col(mark), "left_semi")
        others = [c for c in docs.columns if c not in (id_col, text_col)]
        sortable = [F.to_json(F.struct(c)) for c in others]
        nth, order = fresh_name(docs, "nth"), [F.col(text_col).asc_nulls_first(), *sortable]
        one = again.withColumn(nth, F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where(F.col(nth) == 1).drop(nth)
        out = out.join(many, F.col(id_col) == F.col(mark), "left_anti").unionByName(one)
    return out.unionByName(docs.where(F.col(id_col).isNull()))
