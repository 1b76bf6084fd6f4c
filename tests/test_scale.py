"""How plans move rows: what must not pass the driver, and what needs no shuffle."""

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_rooftop_broadcasts_nothing(spark):
    from larkspan import registry

    for name in ("join4_nearest_rooftop", "str10_distance_text", "agg28_match_sensitivity"):
        assert "Broadcast" not in plan_of(registry.QUERIES[name](spark, DATA)), name


def test_dealt_candidates_are_the_candidates_and_move_no_pairs(spark, monkeypatch):
    from larkspan.plans import search
    from larkspan.sources import adapters

    columns = ["route_id", "total_milli_mi", "tank_milli_mi", "on_board_milli_mi", "opis_id", "price_milli", "price_source", "pos_milli_mi"]
    want = sorted(map(tuple, adapters.candidates(spark, DATA).select(columns).collect()))
    for pairs in (1_000_000, 50):  # whole residues, and residues in parts
        monkeypatch.setattr(adapters, "TASK_PAIRS", pairs)
        monkeypatch.setattr(adapters, "MOST_DEALS", 7)
        dealt = adapters.dealt_candidates(spark, DATA)
        assert sorted(map(tuple, dealt.select(columns).collect())) == want
        every = adapters.dealt_candidates(spark, DATA, every_route=True)
        assert sorted(map(tuple, every.where("opis_id IS NOT NULL").select(columns).collect())) == want
        assert every.select("route_id").distinct().count() == adapters.routes(spark, DATA).count()
        for rows in (search.marked(dealt), search._reached(search.pruned(dealt)).groupBy("deal", "route_id").count(), search.problems(None, every)):
            assert plan_of(rows).count("Exchange") == 2  # routes and stations, no pairs


def test_inversions_equal_counted_pairs():
    import numpy as np

    from larkspan.operators import measure

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 200):
        for top in (1, 3, 1000):
            r = rng.integers(0, top, n)
            assert measure.inversions(r) == sum(int(r[i] > r[j]) for i in range(n) for j in range(i + 1, n))


def test_pairs_and_reach_come_back_whole(spark):
    from larkspan import registry
    from larkspan.plans import search
    from larkspan.sources import adapters

    c = adapters.candidates(spark, DATA)
    assert registry.QUERIES["join12_reach"](spark, DATA).count() == search.pruned(c).count()
    assert registry.QUERIES["join10_world_pairs"](spark, DATA).count() == c.where("opis_id % 35 <> 0").count()


def test_lines_are_made_in_their_routes_rows(spark):
    from larkspan import registry
    from larkspan.operators import corridor

    for name in ("arr1_leg_slices", "mat4_simplified_lines", "mat16_even_samples"):
        plan = plan_of(registry.QUERIES[name](spark, DATA))
        assert plan.count("Exchange") == 1 and "Sort" not in plan, name  # the routes', before they grow into lines
    odd = {1: [(0, 0), (0, 0), (1_000_000, 0), (1_000_000, 0), (3_000_000, 0)], 2: [(5, 5), (5, 5), (5, 5)], 3: [(7, 7)]}
    frame = spark.createDataFrame([(k, [(a, b) for a, b in v]) for k, v in odd.items()], "route_id long, line array<struct<lat_u:long,lng_u:long>>")
    got = sorted(map(tuple, corridor.even_samples(frame, 6).collect()))
    assert got == [(1, i, i / 2, 0.0) for i in range(7)] + [(2, i, 0.0, 0.0) for i in range(7)]


def test_candidates_are_counted_without_pairs(spark):
    from pyspark.sql import functions as F

    from larkspan import registry
    from larkspan.sources import adapters

    for name in ("agg11_source_counts", "fil13_input_rules", "join13_price_sweep"):
        assert "Join" not in plan_of(registry.QUERIES[name](spark, DATA)), name
    upto = F.floor(F.col("total_milli_mi") / 3).cast("long")
    got = {r["route_id"]: (r["n"], r["price"]) for r in adapters.candidate_sums(spark, DATA, upto, n=F.lit(1), price=F.col("price_milli")).collect()}
    want = adapters.candidates(spark, DATA).where(F.col("pos_milli_mi") <= upto).groupBy("route_id").agg(F.count(F.lit(1)), F.sum("price_milli")).collect()
    assert {k: v for k, v in got.items() if v[0]} == {r[0]: (r[1], r[2]) for r in want}


def test_corridor_pairs_stay_in_the_tasks_of_their_lines(spark):
    from larkspan import registry

    told = plan_of(registry.QUERIES["join1_corridor"](spark, DATA)).split("MapInArrow")
    assert len(told) == 2 and "Exchange" not in told[0] and "Aggregate" not in told[0]


def test_range_corridor_shuffles_no_pairs(spark):
    from larkspan import registry

    told = plan_of(registry.QUERIES["join3_range_corridor"](spark, DATA)).split("MapInArrow")
    assert len(told) == 2 and "Exchange" not in told[0] and "Aggregate" not in told[0]


def test_referee_compares_in_the_tasks_of_the_lines_and_sees_differences(spark):
    from larkspan import registry
    from larkspan.operators import corridor, near
    from larkspan.sources import adapters

    told = registry.QUERIES["set7_corridor_referee"](spark, DATA)
    assert plan_of(told).split("MapInArrow")[0].count("Exchange") == 1  # the sums
    fewer = lambda *a: ((b, e, near.Pairs(*[c[1:] for c in p])) for b, e, p in near.by_bands(*a))
    points, stations = adapters.route_lines(spark, DATA).where("route_id % 7 = 0"), adapters.stations(spark, DATA)
    rows = corridor.corridor_differences(points, stations, (fewer, near.by_ranges)).collect()
    assert sum(r["differing"] for r in rows) > 0 and sum(r["pairs"] for r in rows) == corridor.corridor_referee(points, stations).count()


def test_end_to_end_only_plans_leave_the_tasks_of_the_lines(spark):
    from larkspan import registry

    for name in ("pln14_end_to_end", "pln14_dispatched", "flagship_cheapest_plan"):
        told = plan_of(registry.QUERIES[name](spark, DATA)).split("MapInArrow")
        assert len(told) == 2 and told[0].count("Exchange") == 1  # plans, to their routes' rows


def test_kept_flags_are_the_windows_rule(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from larkspan.plans import search
    from larkspan.sources import adapters

    c = adapters.candidates(spark, DATA).withColumn("pos_milli_mi", F.floor(F.col("pos_milli_mi") / 40_000) * 40_000)
    rows = search.marked(c).orderBy("route_id", "pos_milli_mi", "price_milli", "opis_id").toPandas()
    route, pos, price = (rows[x].to_numpy() for x in ("route_id", "pos_milli_mi", "price_milli"))
    number = np.unique(route, return_inverse=True)[1]
    got = search.kept_flags(number, pos, price, (rows["price_source"] == "eia_regional_estimate").to_numpy(), pos + rows["tank_milli_mi"].to_numpy() >= rows["total_milli_mi"].to_numpy())
    assert (got == rows["removed"].isna().to_numpy()).all() and 0 < got.sum() < len(got)


def test_exact_plans_write_no_candidates(spark, monkeypatch):
    from larkspan import registry
    from larkspan.plans import search
    from larkspan.sources import files

    names, write = [], files.written
    watched = lambda df, label: (names.append(label), write(df, label))[1]
    monkeypatch.setattr(files, "written", watched)
    monkeypatch.setattr(search, "written", watched)
    monkeypatch.setattr(files, "_SHARED", {})
    told = registry.QUERIES["agg25_disagreement_rate"](spark, DATA).first()
    assert names == ["admitted", "exact-plans"] and told["routes"] == registry.QUERIES["pln6_exact"](spark, DATA).count() > 0


def test_legs_are_held_against_each_other_in_the_tasks_of_their_routes(spark):
    from pyspark.sql import functions as F

    from larkspan import registry
    from larkspan.operators import corridor
    from larkspan.sources import adapters

    told = plan_of(registry.QUERIES["join2_multi_leg_corridor"](spark, DATA)).split("MapInArrow")
    assert len(told) == 2 and "Exchange" not in told[0] and "Aggregate" not in told[0]
    p = adapters.route_points(spark, DATA).where("route_id < 40")
    cut = F.floor(F.col("total_milli_mi") * 2 / 5).cast("long")
    one = p.where("seq <= 24").select("route_id", F.lit(0).alias("leg"), F.lit(0).alias("offset_milli_mi"), cut.alias("total_milli_mi"), "seq", "lat_u", "lng_u")
    two = p.where("seq >= 24").select("route_id", F.lit(1).alias("leg"), cut.alias("offset_milli_mi"), (F.col("total_milli_mi") - cut).alias("total_milli_mi"), "seq", "lat_u", "lng_u")
    want = registry.QUERIES["join2_multi_leg_corridor"](spark, DATA).where("route_id < 40")
    got = corridor.multi_leg_join(one.unionByName(two), adapters.stations(spark, DATA))
    assert got.count() > 100 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # a leg without length and one of a single point give none; a station as near to two legs keeps the earlier
    odd = [(1, 0, 0, 1000, 0, 0, 0), (1, 0, 0, 1000, 1, 0, 0), (1, 1, 1000, 2000, 1, 0, 0), (1, 1, 1000, 2000, 2, 0, 1_000_000), (1, 2, 3000, 2000, 2, 0, 1_000_000), (1, 2, 3000, 2000, 3, 0, 2_000_000), (2, 0, 0, 5, 0, 0, 0)]
    frame = spark.createDataFrame(odd, "route_id long, leg int, offset_milli_mi long, total_milli_mi long, seq int, lat_u long, lng_u long")
    place = spark.createDataFrame([(7, 0, 1_000_000, "city", "ok"), (8, 0, 0, "rooftop", "ok"), (9, 40_000_000, 0, "city", "ok")], "opis_id int, lat_u long, lng_u long, geocode_precision string, geocode_status string")
    assert sorted(map(tuple, corridor.multi_leg_join(frame, place).collect())) == [(1, 7, 1, 0.0, 3.0), (1, 8, 1, 0.0, 1.0)]
