"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become template tokens: numbers, units that follow a number, and names (capitalised words inside a sentence) turn
into typed placeholders whose values are kept as slots.  Windows of five template tokens are hashed and equality-joined
with the benchmark's windows.  An item counts as found in a document if at least 0.8 of its windows are, and, where the
item has slots, if at least 0.8 of its slot values stand there themselves or map onto one value of the document's each: a
re-parameterised question swaps values consistently, unrelated text with the same template does not.  Both must hold over
the whole document or along one alignment, so an item that comes twice with different values is found too.  Along one
alignment two values may become the same one; over the whole document the mapping must be one-to-one.

Names show by their capitals, and a copy in other letter case has them elsewhere or nowhere.  So a window that holds names
also counts in plain words, names in lower case among them, on both sides: copies in lower, upper or title case meet there,
with their numbers and units as slots.

An item of fewer than five tokens is one window of its own length, and documents get windows of the short lengths that
the benchmark has.  Windows that many documents and many items share are not joined with each other: an item needs one
of its rarest windows (as many as it may lack, and one more), so documents are paired with items by those alone, and
only then are all windows of a pair compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialise

#: Unit words that become a placeholder after a number.
UNITS = "km|m|cm|mm|mi|miles|kg|g|mg|lb|lbs|oz|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|years|usd|eur|dollars|euros|percent"
WINDOW = 5
COVERAGE = 0.8
#: Above this many benchmark windows the join shuffles instead of broadcasting (16 bytes a window and its slots).
BROADCAST_WINDOWS = 500_000
#: In place of an alignment: all of them.
WHOLE = 1 << 30


def _template(text: Column) -> Column:
    """The text in lower case, ß as ss, since upper case has it so, with a mark before numbers (U+0001), units (U+0002) and names (U+0003)."""
    t = F.regexp_replace(text, "[\\u0001-\\u0003]", " ")
    t = F.regexp_replace(t, "([.,])(?<=\\p{Nd}.)(?=\\p{Nd})", "")
    t = F.regexp_replace(t, f"(?i)(\\p{{Nd}})[ ]?({UNITS}|%|€|\\$)(?![\\p{{L}}\\p{{M}}\\p{{N}}])", "$1 \u0002$2")
    t = F.regexp_replace(t, "(\\p{Lu})(?<=[\\p{L}\\p{N},;:] .)(?=\\p{Ll})", "\u0003$1")
    t = F.regexp_replace(t, "(\\p{Nd}++)", "\u0001$1")
    return F.replace(F.lower(F.coalesce(t, F.lit(""))), F.lit("ß"), F.lit("ss"))


def _tokens(template: Column) -> Column:
    return F.array_remove(F.split(template, "[^\\p{L}\\p{M}\\p{N}\\u0001-\\u0003%€$]+"), "")


def template_tokens(text: Column) -> Column:
    """Lower-cased tokens; those that stand for a slot begin with U+0001 (number), U+0002 (unit) or U+0003 (name)."""
    return _tokens(_template(text))


def _windows(df: DataFrame, id_name: str, at: str, lengths: tuple[int, ...], whole: bool = False) -> DataFrame:
    """(id, position, n, h, slots, plain): the windows of each of ``lengths``; with ``whole`` a text that is shorter than the longest is one window.

    A window with names comes twice, the second time with the names as plain words.
    """
    mark, name = F.lit("\u0004"), F.lit("\u0003")
    rows = df.select(id_name, _template(F.col("text")).alias("template"))
    marked = F.col("template").rlike("[\\u0001-\\u0003]")
    rows = rows.select(id_name, _tokens(F.col("template")).alias("raw"), F.col("template").contains("\u0003").alias("named"), marked.alias("marked"))
    bare = F.transform("raw", lambda x: F.when(x.startswith(name), F.substring(x, 2, 1 << 30)).when(x < mark, F.substring(x, 1, 1)).otherwise(x))
    spots = F.filter(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: F.get("raw", i).startswith(name))
    tok = F.when(F.col("marked"), F.transform("raw", lambda x: F.when(x < mark, F.substring(x, 1, 1)).otherwise(x)))
    rows = rows.select(id_name, "raw", tok.alias("tok"), F.when(F.col("named"), bare).alias("bare"), F.when(F.col("named"), spots).alias("spots"))

    def of(n):
        def one(i):
            raw, tok = ([F.get(F.col(c), i + F.lit(j)) for j in range(n)] for c in ("raw", "tok"))
            least, most = (F.least(*raw), F.greatest(*tok)) if n > 1 else (raw[0], tok[0])
            slots = F.when(least < mark, F.filter(F.slice("raw", i + 1, n), lambda x: x < mark))
            return F.struct(i.alias("i"), F.lit(n).alias("n"), F.xxhash64(*tok).alias("h"), slots.alias("slots"), (most >= mark).alias("plain"))

        def bared(i):
            slots = F.filter(F.slice("raw", i + 1, n), lambda x: x < name)
            return F.struct(i.alias("i"), F.lit(n).alias("n"), F.xxhash64(*[F.get(F.col("bare"), i + F.lit(j)) for j in range(n)]).alias("h"), F.when(F.size(slots) > 0, slots).alias("slots"), F.lit(True).alias("plain"))

        def unmarked(i):  # a text without numbers, units and names has neither slots nor windows of placeholders
            return F.struct(i.alias("i"), F.lit(n).alias("n"), F.xxhash64(*[F.get("raw", i + F.lit(j)) for j in range(n)]).alias("h"), F.lit(None).cast("array<string>").alias("slots"), F.lit(True).alias("plain"))

        fits = F.size("raw") == n if whole and n < max(lengths) else F.size("raw") >= n
        places = F.sequence(F.lit(0), F.greatest(F.size("raw") - n, F.lit(0)))
        typed = F.transform(places, one)
        named = F.array_distinct(F.flatten(F.transform("spots", lambda p: F.sequence(F.greatest(p - (n - 1), F.lit(0)), F.least(p, F.size("raw") - n)))))
        return F.when(fits & F.col("tok").isNull(), F.transform(places, unmarked)).when(fits & F.col("bare").isNull(), typed).when(fits, F.concat(typed, F.transform(named, bared)))

    found = [rows.select(id_name, F.explode(of(n)).alias("w")) for n in lengths]
    listed = found[0]
    for more in found[1:]:
        listed = listed.unionByName(more)
    return listed.select(id_name, F.col("w.i").alias(at), "w.n", "w.h", "w.slots", "w.plain")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    coverage: float = COVERAGE,
) -> DataFrame:
    """(id, item_id, n_windows, n_found, first_token, last_token, n_slots, n_consistent): items found in documents.

    Null and empty texts and items have no windows and match nothing.  An item shorter than a window is found wherever
    its tokens stand in a row.  Windows of placeholders alone are not counted.  Repeated rows of an id count as one
    document, repeated items as one item; rows without an id are ignored.  Extra columns are ignored and empty tables
    give an empty result.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL")
    theirs = _windows(items, "item_id", "item_at", tuple(range(window, 0, -1)), whole=True).where("plain")
    theirs = materialise(theirs.select("item_id", "item_at", "n", "h", F.col("slots").alias("item_slots")).distinct(), "benchmark-windows")
    needed = theirs.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"))
    small = theirs.count() <= BROADCAST_WINDOWS
    bounded = F.broadcast if small else lambda df: df
    short = [r["n"] for r in theirs.where(F.col("n") < window).select("n").distinct().collect()]  # fewer than ``window`` rows
    known = theirs.select("h", "n").distinct()
    mine = _windows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL"), "id", "at", (window, *short))
    hits = materialise(mine.drop("plain").join(bounded(known), ["h", "n"], "left_semi"), "benchmark-hits")

    # a window that no document has counts 0 and comes first: an item that lacks too many gets no pairs
    seen = hits.groupBy("h", "n").agg(F.count(F.lit(1)).alias("times"))
    # a place counts as often as both its windows, with and without names, and both are probed
    probes = theirs.select("item_id", "item_at", "h", "n").distinct().join(seen, ["h", "n"], "left")
    probes = probes.withColumn("times", F.sum(F.coalesce("times", F.lit(0))).over(Window.partitionBy("item_id", "item_at")))
    rarest = Window.partitionBy("item_id").orderBy("times", "item_at")
    probes = probes.withColumn("rank", F.dense_rank().over(rarest)).join(needed, "item_id")
    probes = probes.where(F.col("rank") <= F.col("n_windows") - F.ceil(coverage * F.col("n_windows") - 1e-9) + 1).select("item_id", "h", "n")
    pairs = hits.select("id", "h", "n").distinct().join(bounded(probes), ["h", "n"]).select("id", "item_id").distinct()
    hits = materialise(pairs.join(bounded(theirs), "item_id").join(hits, ["id", "h", "n"]), "benchmark-pairs")

    # judged over the whole document and over each alignment, since a document can hold an item twice with other values
    aligned = hits.withColumn("shift", F.explode(F.array(F.lit(WHOLE), F.col("at") - F.col("item_at"))))
    key = ["id", "item_id", "shift"]
    found = aligned.groupBy(*key).agg(F.countDistinct("item_at").alias("n_found"), F.min("at").alias("first_token"), F.max(F.col("at") + F.col("n") - 1).alias("last_token"))
    found = found.join(bounded(needed), "item_id").where(F.col("n_found") >= coverage * F.col("n_windows"))

    pairs = aligned.where("item_slots IS NOT NULL AND slots IS NOT NULL").select(*key, F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    pairs = pairs.select(*key, F.col("s.item_slots").alias("theirs"), F.col("s.slots").alias("ours")).distinct()
    per = pairs.groupBy(*key, "theirs").agg(F.count(F.lit(1)).alias("n"), F.min("ours").alias("ours"), F.max(F.col("ours") == F.col("theirs")).alias("same"))
    back = pairs.groupBy(*key, "ours").agg(F.count(F.lit(1)).alias("m"))
    slots = (
        per.join(back, [*key, "ours"])
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(F.col("same") | ((F.col("n") == 1) & ((F.col("m") == 1) | (F.col("shift") != WHOLE)))).alias("n_consistent"))
    )
    judged = found.join(slots, key, "left").fillna(0, ["n_slots", "n_consistent"]).where(F.col("n_consistent") >= coverage * F.col("n_slots"))
    best = judged.groupBy("id", "item_id").agg(F.max(F.struct("n_found", "shift", "n_windows", "first_token", "last_token", "n_slots", "n_consistent")).alias("b"))
    return best.select("id", "item_id", *[f"b.{c}" for c in ("n_windows", "n_found", "first_token", "last_token", "n_slots", "n_consistent")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found.

    Rows without an id stay; of repeated rows all go or stay; columns may have any names.
    """
    mark = fresh_name(docs, "bad_id")
    bad = materialise(contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias(mark)).distinct(), "contaminated-ids")
    return docs.join(bad.hint("merge"), F.col(id_col) == F.col(mark), "left_anti")
