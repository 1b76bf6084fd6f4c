"""Scans, import rules, picks and throttles against plain loops, and the corridor join against its quadratic referee."""

import pytest
from pyspark.sql import functions as F

from larkspan.operators import corridor, measure, rules
from larkspan.plans import search
from larkspan.sources import adapters, files

DATA = "/root/testdata/sf0.001"


def test_grid_corridor_equals_referee(spark):
    points, stations = adapters.route_points(spark, DATA).where("route_id % 7 = 0"), adapters.stations(spark, DATA)
    pairs = [{tuple(r) for r in f(points, stations).collect()} for f in (corridor.corridor_join, corridor.corridor_referee)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_throttle_equals_a_loop(spark):
    rows = [(i, i % 3 if i % 11 else None, (i * i * 7919) % 500) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    got = {r["event_id"]: r["admitted"] for r in rules.throttled(events, 3, 20, 15, 200).collect()}
    want = {}
    for user in {u for _, u, _ in rows}:
        past = []
        for i, _, at in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            want[i] = sum(p > at - 20 for p in past) < 3 and sum(p > at - 200 for p in past) < 15
            if want[i]:
                past.append(at)
    assert got == want
    assert not any(r["admitted"] for r in rules.throttled(events, 0).collect())
    assert rules.throttled(events.limit(0)).count() == 0


def test_csv_round_trip_and_missing_column(spark):
    df = spark.createDataFrame([(2, None, 'a "b", c'), (1, "x", "é")], "id int, a string, b string")
    path = files.export_csv(df, "id", "test-csv")
    assert {tuple(r) for r in files.scan_csv(spark, path, ["id", "a"]).collect()} == {("1", "x"), ("2", None)}
    with pytest.raises(ValueError, match="gers_id"):
        files.scan_csv(spark, path, ["id", "gers_id"])


def test_price_list_and_extract(spark, tmp_path):
    head = "OPIS Truckstop ID,Truckstop Name,Address,City,State,Rack ID,Retail Price"
    (tmp_path / "p.csv").write_text(head + '\n7,"LOVES, EXIT 4","I-80, EXIT ""4""",Reno,NV,12,3.5\nx,a,b,c,d,e,3.5\n8,a,b,c,d,e,n/a\n9,,,,,,2.25\n')
    got = [(r["opis_id"], r["name"], r["address"], r["ok"]) for r in files.price_rows(spark, str(tmp_path / "p.csv")).collect()]
    assert got == [(7, "LOVES, EXIT 4", 'I-80, EXIT "4"', True), (None, "a", "b", False), (8, "a", "b", False), (9, None, None, True)]
    (tmp_path / "e.csv").write_text(",".join(files.EXTRACT_COLUMNS) + "\ng1,n,b,f,l, ny ,1,c,0.5,,-73.5,40.5\n,n,b,f,l,ny,1,c,0.5,,-73.5,40.5\ng2,n,b,f,l,ny,1,c,high,open,-73.5,40.5\n")
    assert [(r["gers_id"], r["address_region"], r["ok"]) for r in files.extract_rows(spark, str(tmp_path / "e.csv")).collect()] == [("g1", "NY", True), (None, "NY", False), ("g2", "NY", False)]
    (tmp_path / "bad.csv").write_text(head.replace(",Rack ID", "") + "\n")
    with pytest.raises(ValueError, match="Rack ID"):
        files.price_rows(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="no release"):
        files.releases(spark, str(tmp_path))


def test_batch_answers(spark):
    lines = ['1,a', '2,"a, b",No_Match', '3,"a, ""b""",Match,Exact,"c, d","-87.5,41.25",7,L', "4,a,Match,Exact", '"5","a","Tie"', None]
    got = {tuple(r) for r in files.batch_answers(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {(2, False, None, None), (3, True, 41.25, -87.5), (4, False, None, None), (5, False, None, None)}


def test_first_feature(spark):
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[%s]}}'
    bodies = ['{"features":[' + point % "-87.5,41.25" + "," + point % "3,4" + "]}", '{"features":[]}', '{"features":[' + point % "1" + "]}", "{}", "no json", None]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(files.first_feature(F.col("b")).alias("p")).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in got] == [(41.25, -87.5), None, None, None, None, None]


def test_directions(spark):
    leg = '{"distance":1609.344,"duration":60,"annotation":{"distance":[804.672,804.672],"duration":[30,30]}}'
    whole = '{"code":"Ok","routes":[{"geometry":{"coordinates":[[-118.5,34.0],[-87.5,41.5]]},"distance":4828.032,"duration":180,"legs":[%s,{"distance":3218.688,"annotation":{}},%s]},{"geometry":{"coordinates":[]},"distance":0,"duration":0}]}' % (leg, leg)
    frame = spark.createDataFrame([(1, whole), (2, '{"code":"NoRoute"}'), (3, '{"code":"Ok","routes":[]}'), (4, "x"), (5, None)], "id int, body string")
    got = {(r["id"], r["alternative_index"]): r for r in files.direction_routes(frame).collect()}
    one = got[1, 0]
    assert one["coordinates"] == [[-118.5, 34.0], [-87.5, 41.5]] and round(one["total_mi"], 9) == 3 and one["duration_s"] == 180
    assert [round(x, 9) for x in one["leg_distances_mi"]] == [1, 2, 1] and one["leg_lengths"] == [2, 0, 2]
    assert [round(x, 9) for x in one["annotation_mi"]] == [0.5] * 4 and one["annotation_s"] == [30.0] * 4
    assert got[1, 1]["leg_distances_mi"] == got[1, 1]["annotation_mi"] == []
    assert {k[0]: r["error"] for k, r in got.items() if k[1] is None} == {2: "NoRoute", 3: "Ok", 4: "unreadable", 5: "unreadable"}


def test_discordant_pairs_equal_a_loop(spark):
    rows = [(g, (i * 37 + g) % 23, (i * 53) % 19) for g in range(3) for i in range(60)] + [(9, 1, 1), (8, 2, 1), (8, 1, 2)]
    got = dict(map(tuple, measure.discordant_pairs(spark.createDataFrame(rows, "g int, a long, b long"), "g", "a", "b").collect()))
    want = {g: sum((p[1] - q[1]) * (p[2] - q[2]) < 0 for i, p in enumerate(rows) for q in rows[:i] if p[0] == q[0] == g) for g in (0, 1, 2, 8, 9)}
    assert got == {g: n for g, n in want.items() if n}


def test_stronger_pruning_equals_a_loop(spark):
    rows = [(r, 0, 1_500_000, 700_000, 700_000, i, f"s{i}", "TX", 2500 + (i * 7919 + r * 31) % 1500, ("opis_indexed", "eia_regional_estimate")[(i + r) % 3 == 0], (i * 37 + r) % 15 * 100_000) for r in range(6) for i in range(40)]
    names = "route_id long, alternative_index int, total_milli_mi long, tank_milli_mi long, on_board_milli_mi long, opis_id int, name string, state string, price_milli long, price_source string, pos_milli_mi long"
    c = spark.createDataFrame(rows, names)
    kept = sorted({tuple(r) for r in search.pruned(c).collect()}, key=lambda r: (r[0], r[10], r[8], r[5]))
    want, seen = set(), {}
    for r in kept:
        any_, real = seen.get(r[0], (None, None))
        est, tail = r[9] != "opis_indexed", r[10] + r[3] >= r[2]
        witness = any_ if est else real
        if tail and witness is not None and (witness - r[8]) * r[3] < 350_000_000:
            continue
        want.add((r[0], r[5]))
        if tail:
            seen[r[0]] = (min(any_ or r[8], r[8]), real if est else min(real or r[8], r[8]))
    assert {(r["route_id"], r["opis_id"]) for r in search.penalty_pruned(c).collect()} == want and len(want) < len(kept)


def test_long_segments_meet_the_same_stations(spark):
    points = spark.createDataFrame([(1, 1_000_000, i, 30_000_000 + 4_000_000 * i, -110_000_000 + 7_000_000 * i) for i in range(3)], "route_id long, total_milli_mi long, seq int, lat_u long, lng_u long")
    stations = adapters.stations(spark, "/root/testdata/sf0.01")
    assert {tuple(r) for r in corridor.corridor_join(points, stations).collect()} == {tuple(r) for r in corridor.corridor_referee(points, stations).collect()} != set()


def test_token_rule(spark):
    rows = [(["ev", "charging"],), (["ev"],), ([],), (None,), (["h2"],), (["charging", "ev"],)]
    got = spark.createDataFrame(rows, "t array<string>").select(F.coalesce(rules.token_rule(F.col("t"), ("h2",), ("ev charging",)), F.lit(False)).alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, False, False, True, False]


def test_frontier_equals_a_loop(spark):
    rows = [(i % 4, i, (i * 37) % 50, (i * 53) % 20) for i in range(200)]
    got = {(r["route_id"], r["opis_id"]) for r in rules.frontier(spark.createDataFrame(rows, "route_id long, opis_id int, pos_milli_mi long, price_milli long")).collect()}
    beats = lambda b, c: b[0] == c[0] and b[3] <= c[3] and (b[2] > c[2] or (b[2] == c[2] and (b[3], b[1]) < (c[3], c[1])))
    assert got == {c[:2] for c in rows if not any(beats(b, c) for b in rows)}


def test_broken_invariants_stop_the_read(spark):
    row = lambda source, ident, gers, kind, price: (ident, source, gers, kind, price, 3500)
    names = "opis_id long, source string, gers_id string, price_source string, price_milli long, baseline_milli long"
    good = [row("opis", 7, None, "opis_indexed", 3000), row("overture", 10**9 + 4, "g", "eia_regional_estimate", 3500)]
    assert rules.checked(rules.invariant_violations(spark.createDataFrame(good, names), 10**9, 10**9)).first()["max_other_id"] == 7
    for bad, name in ((row("opis", 10**9, None, "opis_indexed", 1), "in_reserved_span"), (row("overture", 10**9, None, "opis_indexed", 1), "bad_minted"), (row(None, 1, None, "opis_indexed", 1), "unknown_source"), (row("opis", 1, None, "eia_regional_estimate", 1), "estimate_off_baseline")):
        with pytest.raises(Exception, match=name):
            rules.checked(rules.invariant_violations(spark.createDataFrame([*good, bad], names), 10**9, 10**9)).collect()
