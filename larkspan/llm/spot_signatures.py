"""Document fingerprints by spot signatures, in DataFrame functions alone.

Common words are anchors.  Each run of anchors that a content word follows gives one signature: its last anchor and the
chain of ``chain`` content words from there on, ``spacing`` apart, common words left out.  Running prose is full of
anchors; menus, tables and link lists are not, so a fingerprint rests on the prose.  The fingerprint is the set of the
signatures' digests.  Two sets are as alike as their Jaccard index says; sets whose lengths differ too much for the least
likeness asked for are told apart without looking at their members.

A text without anchors takes a chain from each of its words, so that other languages have fingerprints too; a text
without words has its whole self as one signature.  No set is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Common words of four languages; callers pass their own for others.
ANCHORS = (
    "a an and are as at be by for from had has have he in is it its not of on or she that the their they this to was were which will with you "
    "als auf aus bei das dem den der des die ein eine einem einen einer er es für im ist mit nicht sich sie sind und von war wie wird zu zum zur "
    "au aux avec ce cette dans du elle en est et il la le les mais ne nous ou par pas plus pour que qui se son sur un une vous "
    "al como con de del el ella entre esta este la las lo los más no para pero por se sin sobre su sus una y"
).split()
#: Content words of a chain, and how far apart they are.
CHAIN, SPACING = 3, 1
#: Rows of one stretch of the id order, and how many stretches there are at most: their first ids are held by the driver.
STRETCH, MOST_STRETCHES = 500, 100_000
#: Stretches that a task takes on average. Several small ones make tasks more even than one large one each.
STRETCHES_A_TASK = 8


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def signatures(text: Column, anchors: tuple[str, ...] | list[str] = ANCHORS, chain: int = CHAIN, spacing: int = SPACING) -> Column:
    """The sorted set of a text's signature digests (16 hex digits each); a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+")
    # anchors are glued to the content word that follows: the old man of the sea -> the^old man of^the^sea
    glued = F.array_join(F.transform(words, lambda w: F.when(w == "", w).when(w.isin(*anchors), F.concat(w, F.lit("^"))).otherwise(F.concat(w, F.lit(" ")))), "")
    parts = F.split(F.rtrim(F.regexp_replace(glued, "[^ ]*$", "")), " ")

    def chains(parts: Column) -> Column:
        def from_(part: Column, at: Column) -> Column:
            later = [F.substring_index(F.get(parts, at + k * spacing), "^", -1) for k in range(1, chain)]
            return F.concat_ws(" ", F.substring_index(part, "^", -2), *later)

        spots = F.filter(F.transform(parts, lambda part, at: F.when(part.contains("^"), from_(part, at))), lambda s: s.isNotNull())
        return _let(spots, lambda s: F.when(F.size(s) > 0, s).otherwise(F.transform(parts, from_)))

    found = _let(parts, lambda p: F.when(F.get(p, F.lit(0)) == "", F.array(F.concat(F.lit("^^"), text))).otherwise(chains(p)))
    return F.sort_array(F.array_distinct(F.transform(found, lambda s: F.substring(F.md5(s.cast("binary")), 1, 16))))


def likeness(one: Column, other: Column, least: float = 0.0) -> Column:
    """Jaccard index of two sets; 0 where their sizes alone rule out ``least``."""
    small, large = F.least(F.size(one), F.size(other)), F.greatest(F.size(one), F.size(other))
    jaccard = _let(F.size(F.array_intersect(one, other)), lambda n: n / (small + large - n))
    return F.when(small < least * large, F.lit(0.0)).otherwise(jaccard) if least else jaccard


def _stretch_starts(docs: DataFrame, id_col: str, rows: int, most: int) -> tuple[list[int], int]:
    """Ids that cut the id order into stretches of about ``rows`` rows, the least id first, at most ``most``; and the rows."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL")
    count = ids.count()
    n = max(1, min(most, -(-count // rows)))
    dealt = ids.repartitionByRange(n, "id").select(F.spark_partition_id().alias("part"), "id")
    return sorted(r["first"] for r in dealt.groupBy("part").agg(F.min("id").alias("first")).collect()), count


def _stretch(id_: Column, starts: list[int]) -> Column:
    """How many of ``starts`` are not above the id, by halving."""
    listed = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(starts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.get(listed, n + step - 1) <= id_, n + step).otherwise(n))


def with_next(docs: DataFrame, id_col: str, text_col: str, extra: Callable[[Column], Column], rows: int = STRETCH, most: int = MOST_STRETCHES) -> DataFrame:
    """(id, text, value, next_text, next_value): each row with an id, and the next in order of id, then text.

    ``value`` is ``extra(text)``, computed once a row.  The last row's next is the first.  The id order is cut into
    stretches; the first row of each is added to the end of the stretch before, so that one shuffle of the texts and a
    window within stretches suffice.
    """
    spark = docs.sparkSession
    starts, count = _stretch_starts(docs, id_col, rows, most)
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    n = max(1, len(starts))
    before = spark.createDataFrame([(first, k or n) for k, first in enumerate(starts)], "id long, stretch int")
    guests = mine.join(F.broadcast(before), "id").groupBy("stretch").agg(F.min("text").alias("text"))
    own = mine.select(_stretch(F.col("id"), starts or [0]).alias("stretch"), F.lit(False).alias("guest"), "id", "text")
    tasks = min(n, -(-count // (rows * STRETCHES_A_TASK)) or 1)
    placed = own.union(guests.select("stretch", F.lit(True), F.lit(None).cast("long"), "text")).repartition(tasks, "stretch")
    order = Window.partitionBy("stretch").orderBy("guest", "id", "text")
    valued = placed.withColumn("value", extra(F.col("text")))
    following = valued.select("guest", "id", "text", "value", F.lead("text").over(order).alias("next_text"), F.lead("value").over(order).alias("next_value"))
    return following.where("NOT guest").drop("guest")


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """(id, n_chars, edited, signatures, edited_signatures, near_edited, near_next): one row per document row.

    ``edited`` is the text whose last floor(n_chars / ``part``) code points are replaced by the first as many (or all) of
    the next document in order of id, then text; after the last comes the first, so a lone document follows itself.  A
    null text counts as empty.  Rows that repeat an id and text follow one another.  A row without an id has no place in
    the order: it keeps its own columns, and those that need a next document are null.  Extra columns are ignored; an
    empty table gives an empty result.
    """
    n = F.char_length("text")
    cut = F.floor(n / part).cast("int")
    rows = with_next(docs, id_col, text_col, signatures).select(
        "id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"),
        F.col("value").alias("signatures"),
        likeness(F.col("value"), F.col("next_value")).alias("near_next"),
    )
    rows = rows.withColumn("edited_signatures", signatures(F.col("edited")))
    rows = rows.withColumn("near_edited", likeness(F.col("signatures"), F.col("edited_signatures")))
    lone = docs.where(F.col(id_col).isNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lone = lone.select(F.lit(None).cast("long").alias("id"), n.cast("long").alias("n_chars"), signatures(F.col("text")).alias("signatures"))
    return rows.unionByName(lone, allowMissingColumns=True)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of every row with an id, and (class_id, signatures, n) of every class: rows of one and the same set.

    ``class_id`` is the class's least id.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), signatures(F.col(text_col)).alias("signatures"))
    rows = materialise(rows.withColumn("key", F.sha2(F.array_join("signatures", ""), 256)), "spot-signatures")
    classes = rows.groupBy("key").agg(F.min("id").alias("class_id"), F.min("signatures").alias("signatures"))
    classes = materialise(classes.withColumn("n", F.size("signatures")), "spot-classes")
    return rows.select("id", "key").join(classes.select("key", "class_id"), "key").select("id", "class_id"), classes.drop("key")


def similar_pairs(classes: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of all classes that are alike by at least ``least``, ``a`` the smaller set, or of two as large the lesser id.

    Classes are partitioned by length, each partition as wide as ``least`` allows, so that a set meets only its own
    partition and the next.  Of each set only its rarest signatures are probed, one more than it can lack: sets that share
    none of these cannot be alike.  Candidates are verified on whole sets.  A signature that many classes share is rare
    in none of them, unless they hold little else.
    """
    tokens = classes.select("class_id", "n", F.explode("signatures").alias("signature"))
    counts = tokens.groupBy("signature").agg(F.count(F.lit(1)).alias("held_by")).where("held_by > 1")
    rarest = Window.partitionBy("class_id").orderBy("held_by", "signature")
    # signatures of one class alone lead to nobody, but count as probed, since they are the rarest
    left = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    shared = tokens.join(counts, "signature")
    held = Window.partitionBy("class_id")
    probes = shared.withColumn("rank", F.row_number().over(rarest) + F.col("n") - F.count(F.lit(1)).over(held)).where(F.col("rank") <= left)
    partition = F.floor(F.log("n") / log(1 / least) + 1e-9) if least < 1 else F.col("n").cast("long")
    probes = materialise(probes.select("class_id", "n", "signature", partition.alias("part")), "spot-probes")
    small = probes.select(F.col("class_id").alias("a"), F.col("n").alias("a_n"), "signature", "part")
    reach = F.explode(F.array("part", F.col("part") - 1))
    large = probes.select(F.col("class_id").alias("b"), F.col("n").alias("b_n"), "signature", reach.alias("part"))
    ordered = "(a_n < b_n OR (a_n = b_n AND a < b))"
    met = small.join(large, ["part", "signature"]).where(f"{ordered} AND a_n + 1e-9 >= {least} * b_n").select("a", "b").distinct()
    sets = classes.select("class_id", "signatures")
    whole = met.join(sets.select(F.col("class_id").alias("a"), F.col("signatures").alias("one")), "a")
    whole = whole.join(sets.select(F.col("class_id").alias("b"), F.col("signatures").alias("other")), "b")
    return whole.select("a", "b", likeness(F.col("one"), F.col("other"), least).alias("likeness")).where(F.col("likeness") >= least)
