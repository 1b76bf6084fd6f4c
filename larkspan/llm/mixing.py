"""Mixing sources to target weights through a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  Source quotas are the weighted
shares of all words, capped at ``max_repeats`` times a source's own size with the excess shared again by weight.  A flow
routes the patterns' word capacity to the quotas; taking a pattern a further time costs more each time, so repetition is
used only where a quota needs it.  Last, seeded documents realise each pattern's flow: all its documents are taken
``flow // capacity`` times, and those that come first in a seeded order once more.

A source that no other source overlaps is a flow of its own, the lesser of its quota and its repeated size, and stays a
row of a table; only patterns of overlapping sources reach the driver.  The seeded order is cut into hash ranges whose
sums are scanned first; row-level running sums are needed in the one range per pattern where the flow ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Patterns of overlapping sources that the driver's flow may hold; more are refused by name, never left out.
MAX_PATTERNS = 100_000
#: Patterns up to which the plan is broadcast (some 100 bytes each).
BROADCAST_PATTERNS = 100_000
RANGE_ROWS = 50_000


def source_targets(sources: DataFrame, total: int, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to ``sources`` (source, source_size): weighted shares of ``total``, none above ``max_repeats`` times its size, the excess reshared by weight.

    In the order of size by weight the full sources come first, so running sums find where the open ones begin.  The
    windows hold one row per source.
    """
    big = lambda c: c.cast("decimal(38,0)")
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum(big(F.col("source_size")) * max_repeats).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), big(F.lit(0)))
    rows = rows.withColumn("k", F.row_number().over(by_ratio)).withColumn("rest", big(F.lit(total)) - before)
    rows = rows.withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    full = F.col("rest") * F.col("weight") > big(F.col("source_size")) * max_repeats * F.col("open_weight")
    first = F.min(F.when(~full, F.struct("k", "rest", "open_weight"))).over(Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("first", first)
    share = (F.col("first.rest") * F.col("weight")).cast("double") / F.col("first.open_weight").cast("double")
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), (F.col("source_size") * max_repeats).cast("double")).otherwise(share)
    return rows.select(*sources.columns, target.alias("target"))


def route(patterns: Sequence[tuple[tuple[int, ...], int]], quota: Sequence[int], max_repeats: int = MAX_REPEATS) -> list[int]:
    """Words to take of each pattern (its sources, its capacity), by successive shortest paths.

    Arcs: start to pattern (``max_repeats`` parallel arcs of its capacity at cost 0, 1, 2, ...), pattern to each of its
    sources, source to end (its quota).  Repetition costs are convex, so cheaper rounds fill first.
    """
    n, m = len(patterns), len(quota)
    start, end = n + m, n + m + 1
    arcs: list[list[int]] = []  # to, room, cost
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    total = sum(quota)
    for i, (members, capacity) in enumerate(patterns):
        for again in range(max_repeats):
            arc(start, i, capacity, again)
        for s in members:
            arc(i, n + s, total, 0)
    for s, q in enumerate(quota):
        arc(n + s, end, q, 0)
    while True:
        cost, via, queue = {start: 0}, {}, [start]
        while queue:
            after = []
            for a in queue:
                for e in out[a]:
                    b, room, c = arcs[e]
                    if room > 0 and cost[a] + c < cost.get(b, 1 << 60):
                        cost[b], via[b] = cost[a] + c, e
                        after.append(b)
            queue = list(dict.fromkeys(after))
        if end not in cost:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        push = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= push
            arcs[e ^ 1][1] += push
    # a reverse arc's room is the flow on its arc
    return [sum(arcs[e][1] for e in out[i] if e % 2 and arcs[e][0] == start) for i in range(n)]


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix-1") -> DataFrame:
    """(id, size, sources, source_size, target, taken) for ``docs`` (id long, sources array<string>, size long).

    Sources stand in code-point order, null last, and weigh ``weights`` in turn.  ``source_size`` and ``target`` are
    those of the first of a document's sources.  ``taken`` is the words that the mix takes of a document, repeats
    counted: a multiple of its size, at most ``max_repeats`` times it.  Documents of size 0 take nothing.  Repeated ids
    are separate documents that tie, and share one place in the seeded order.  A null id sorts like an empty one.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("id", F.array_sort(F.array_distinct("sources")).alias("sources"), F.col("size").cast("long").alias("size")).withColumn("pattern", F.to_json("sources"))
    grouped = materialise(docs.groupBy("pattern", "sources").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-patterns")
    told = grouped.agg(F.count(F.lit(1)).alias("patterns"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(1)).alias("most")).first()
    each = grouped.select("pattern", F.size("sources").alias("width"), "size", F.explode("sources").alias("source"))
    per = each.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("patterns"), F.max("width").alias("width"))
    targets = materialise(source_targets(per, told["total"], weights, max_repeats), "mix-targets")
    alone = (F.col("patterns") == 1) & (F.col("width") == 1)

    flow = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeats), F.floor(flow / F.col("source_size")).cast("int"))).otherwise(0)
    simple = targets.where(alone).withColumn("flow", flow).withColumn("whole", whole.cast("long"))
    simple = simple.select(F.to_json(F.array("source")).alias("pattern"), "source_size", "target", "whole", F.when(F.col("whole") < max_repeats, F.col("flow") - F.col("whole") * F.col("source_size")).otherwise(0).alias("extra"))

    shared = each.join(targets.where(~alone).select(F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")), "left_semi").select("pattern").distinct()
    rows = grouped.where(F.size("sources") == 0).unionByName(grouped.join(shared, "pattern", "left_semi")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of overlapping sources")
    rows.sort(key=lambda r: [(s is None, s or "") for s in r["sources"]])
    known = sorted(targets.where(~alone).collect(), key=lambda r: (r["source"] is None, r["source"] or "")) if rows else []
    place = {r["source"]: i for i, r in enumerate(known)}
    taken = route([(tuple(place[s] for s in r["sources"]), r["size"]) for r in rows], [int(r["target"]) for r in known], max_repeats)
    plan = []
    for r, words in zip(rows, taken):
        times = min(words // r["size"], max_repeats) if r["size"] else 0
        first = known[place[r["sources"][0]]] if r["sources"] else None
        plan.append((r["pattern"], first["source_size"] if first else 0, first["target"] if first else 0.0, times, words - times * r["size"] if times < max_repeats else 0))
    plan = simple.unionByName(spark.createDataFrame(plan, "pattern string, source_size long, target double, whole long, extra long"))
    plan = materialise(plan, "mix-plan")
    bounded = F.broadcast if told["patterns"] <= BROADCAST_PATTERNS else lambda df: df

    most = told["most"]
    digits = max(2, ceil(log2(max(most / RANGE_ROWS, 1)) / 4))
    keyed = docs.withColumn("key", F.md5(F.concat_ws("/", F.lit(seed), F.col("id").cast("string"))))
    keyed = keyed.withColumn("range", F.substring("key", 1, digits))
    sums = keyed.groupBy("pattern", "range").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("range")) - F.col("words")
    ranges = sums.select("pattern", "range", upto.alias("before"), "words").join(bounded(plan), "pattern")
    last = materialise(ranges.where("before < extra AND before + words >= extra").select("pattern", F.col("range").alias("last"), "before"), "mix-ranges")
    marked = keyed.join(bounded(plan), "pattern").join(bounded(last), "pattern", "left")
    inside = marked.where("range = last")
    running = F.sum("size").over(Window.partitionBy("pattern").orderBy("key", F.col("id").isNull(), "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("once", (2 * (F.col("before") + running - F.col("size")) + F.col("size") <= 2 * F.col("extra")).cast("long"))
    outside = marked.where("last IS NULL OR range <> last").withColumn("once", F.coalesce(F.col("range") < F.col("last"), F.lit(False)).cast("long"))
    return inside.unionByName(outside).select("id", "size", "sources", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("once"))).alias("taken"), (F.col("whole") + F.col("once")).alias("times"))


def word_count(text: str = "text"):
    """Number of white-space words (``[^\\x20\\x09-\\x0D]+``) of a text, null as 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, sources, size) of documents with one source each, written once so that texts are read once."""
    return materialise(docs.select(F.col(id_col).cast("long").alias("id"), F.array(F.col(source_col)).alias("sources"), word_count(text_col).alias("size")), "mix-sizes")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows without an id stay once, since no decision can be carried back to them; repeated rows of an id are taken as
    often as the one of them that is taken most.  Columns may have any names; an empty table gives an empty one.
    """
    times, key, again = fresh_name(docs, "times"), fresh_name(docs, "taken_id"), fresh_name(docs, "again")
    taken = mix(measured(docs.where(F.col(id_col).isNotNull()), id_col, text_col, source_col), **options).where("times > 0")
    taken = materialise(taken.groupBy(F.col("id").alias(key)).agg(F.max("times").cast("int").alias(times)), "mix-taken")
    joined = docs.join(taken.hint("merge"), F.col(id_col) == F.col(key))
    out = joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(again)).select(*docs.columns)
    return out.unionByName(docs.where(F.col(id_col).isNull()))
