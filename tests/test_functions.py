"""Hand-made rows for edges: window ends, directions, ties, nulls, caps."""

import datetime as dt

from pyspark.sql import functions as F

from chronosieve.functions import direction as D
from chronosieve.functions import text as X
from chronosieve.operators import anchor as A
from chronosieve.operators import cohort as C
from chronosieve.operators import score as K
from chronosieve.operators import series as S

T0 = dt.datetime(2024, 1, 1)
H, US = dt.timedelta(hours=1), dt.timedelta(microseconds=1)


def events(spark, rows):
    """rows: (event_id, user_id, event_type, time after T0, value)"""
    return spark.createDataFrame([(i, u, k, T0 + t, v) for i, u, k, t, v in rows], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double")


def test_direction_edges(spark):
    cases = [(0.0, 1.0, "rising"), (0.0, 0.0, "stable"), (-1.0, -2.0, "stable"), (10.0, 12.0, "stable"), (10.0, 12.1, "rising"), (10.0, 8.0, "stable"), (10.0, 7.9, "falling")]
    got = spark.createDataFrame([c[:2] for c in cases], "b double, a double").select(D.direction("b", "a")).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]


def test_direction_in_range(spark):
    cases = [(1.0, 5.0, 4.0, 6.0, "Stable"), (1.0, 7.0, 4.0, 6.0, "Rising"), (9.0, 7.0, 4.0, 6.0, "Falling"), (7.0, 7.0, 4.0, 6.0, "Rising"), (10.0, 12.0, None, None, "Rising"), (10.0, 11.0, 6.0, 4.0, "Stable")]
    got = spark.createDataFrame([c[:4] for c in cases], "b double, a double, lo double, hi double").select(D.direction_in_range("b", "a", "lo", "hi")).collect()
    assert [r[0] for r in got] == [c[4] for c in cases]


def test_next_pairs_gap_ends(spark):
    e = events(spark, [(1, 1, "x", 0 * H, 1.0), (2, 1, "x", 1 * H, 2.0), (3, 1, "x", 49 * H, 3.0), (4, 1, "x", 49 * H + H - US, 4.0), (5, 1, "x", 100 * H, 4.0)])
    assert sorted(r.event_id for r in S.next_pairs(e, ["user_id"]).collect()) == [1, 2]


def test_ordered_pairs_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(k, rnd.randint(1, 3), "x", rnd.choice([4, 48, 4.5, 7, 96, 20]) * k * H / 7, float(rnd.randint(0, 9))) for k in range(60)]
    got = {(r.visible_id, r.target_id) for r in S.ordered_pairs(events(spark, rows), ["user_id"]).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and (a[3], a[0]) < (b[3], b[0]) and 4 * H <= b[3] - a[3] <= 48 * H}
    assert got == want


def test_sessions_split_at_the_gap(spark):
    day = 24 * H
    e = events(spark, [(1, 1, "x", 0 * H, 1.0), (2, 1, "x", 4 * day - US, 1.0), (3, 1, "x", 8 * day - US, 1.0)])
    assert [r.session for r in S.sessions(e, "user_id").orderBy("ts").collect()] == [1, 1, 2]


def test_pre_post_ends(spark):
    e = events(spark, [(1, 1, "p", 10 * H, 1.0), (2, 1, "x", 8 * H, 1.0), (3, 1, "x", 8 * H - US, 1.0), (4, 1, "x", 12 * H, 1.0), (5, 1, "x", 12 * H + US, 1.0), (6, 1, "x", 10 * H + US, 1.0)])
    got = {r.event_id: r.side for r in A.pre_post(A.first_event(e, "user_id", F.col("event_type") == "p"), e, "user_id", 2).collect()}
    assert got == {1: "pre", 2: "pre", 4: "post", 6: "post"}


def test_interval_join_whole_days(spark):
    day = 24 * H
    a = events(spark, [(1, 1, "t", 0 * H, 2.0)]).withColumn("threshold", F.lit(1.0))
    b = events(spark, [(2, 1, "p", day - US, 0.0), (3, 1, "p", day, 0.0), (4, 1, "p", 61 * day - US, 0.0), (5, 1, "p", 61 * day, 0.0)])
    assert sorted(r.procedure_id for r in A.interval_join(a, b, "user_id").collect()) == [3, 4]


def test_asof_ties(spark):
    left = events(spark, [(10, 1, "l", 5 * H, 0.0), (11, 2, "l", 5 * H, 0.0)])
    right = events(spark, [(1, 1, "r", 5 * H, 1.0), (2, 1, "r", 5 * H, 2.0), (3, 1, "r", 6 * H, 3.0)])
    assert [(r.event_id, r.asof_id, r.asof_value) for r in A.asof_backward(left, right, "user_id").orderBy("event_id").collect()] == [(10, 2, 2.0), (11, None, None)]
    near = events(spark, [(1, 1, "r", 4 * H, 1.0), (2, 1, "r", 6 * H, 2.0), (3, 1, "r", 4 * H, 3.0)])
    assert [r.nearest_id for r in A.asof_nearest(left, near, "user_id").orderBy("event_id").collect()] == [1, None]


def test_resample_like_interp(spark):
    import numpy as np

    xs, ys = [0.0, 1.0, 1.5, 7.0], [1.0, 3.0, 2.0, 9.0]
    p = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(zip(xs, ys, strict=True))] + [(2, 9, 4.0, 5.0)], "user_id long, event_id long, x double, y double")
    got = S.resampled(p, ["user_id"]).orderBy("user_id", "idx").collect()
    assert np.allclose([r.v for r in got if r.user_id == 1], np.interp(np.linspace(0, 7, 96), xs, ys))
    assert [r.v for r in got if r.user_id == 2] == [5.0] * 96


def test_cap_protected_never_takes_others_beyond_the_cap(spark):
    rows = [(k, 1, "p" if k < 4 else "o", k * H, 1.0) for k in range(8)]
    for n, want in ((3, {0, 1, 2, 3}), (4, {0, 1, 2, 3}), (6, {0, 1, 2, 3, 6, 7})):
        got = C.cap_protected(events(spark, rows), ["user_id"], F.col("event_type") == "p", [F.desc("ts")], n)
        assert {r.event_id for r in got.collect()} == want


def test_flags_and_codes(spark):
    df = spark.createDataFrame([("a", 10, " "), ("I21x", 10, "x"), ("42789", 9, None), ("V45", 9, "y")], "code string, version int, flag string")
    got = df.select(C.in_code_ranges(F.col("code"), F.col("version"), [("I20", "I25")], [(390, 459)]), C.flagged(F.col("flag"))).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, True), (True, False), (False, True)]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 1), (0.1, 0), (0.1000001, 1), (1.0, 1), (1.7, 1), (None, 1)], "c double, ok int")
    got = {r.bin: r.n for r in K.calibration_bins(df, F.col("c"), F.col("ok")).collect()}
    assert got == {1: 2, 2: 1, 10: 2}


def test_identifier_gate(spark):
    texts = [("call 1234567", False), ("on 2024-01-02", False), ("12.5 mg/dL given", False), ("plain", False), ("on 2024-01-02", True), ("id ABC on 2024-01-02", True)]
    got = spark.createDataFrame(texts, "t string, free boolean").select(X.blocked_reason(F.col("t"), ["ABC"], F.col("free"))).collect()
    assert [r[0] for r in got] == ["digits", "date", "value_unit", None, None, "id"]


def test_fingerprint_ignores_order_case_and_repeats(spark):
    df = spark.createDataFrame([(["b", "A"],), (["a", "B", "b"],), (["c"],)], "x array<string>")
    a, b, c = (r[0] for r in df.select(X.fingerprint(F.col("x"))).collect())
    assert a == b != c and len(a) == 16


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_direction_points_table(spark):
    from chronosieve.operators.score import direction_points

    table = [("Rising", "Rising", 1.0), (" rising", "Rising", 1.0), ("Stable", "Rising", 0.5), ("Rising", "Stable", 0.0), ("Stable", "Stable", 1.0), ("Falling", "Rising", 0.0), (None, "Stable", 0.0)]
    df = spark.createDataFrame(table, "p string, a string, want double")
    assert all(r.got == r.want for r in df.select("want", direction_points(F.col("p"), F.col("a")).alias("got")).collect())


def test_rewards_table(spark):
    import math

    from chronosieve.operators.score import graded_reward, request_reward

    names = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    for asked, just in ((("a", "b"), 1.0), (("a",), 0.5), (("a", "b", "c", "x", "y"), 0.0), ((), 0.0)):
        hit, n, wrong = len({"a", "b"} & set(asked)), len(asked), len(set(asked) - {"a", "b", "c"})
        want = 0.35 * hit / 2 + 0.2 * (1 - wrong / (n + 1e-6)) + 0.1 * -2 * (2 - hit) + 0.2 * -0.5 * max(0, n - 2 - 1) + 0.15 * just
        assert math.isclose(one(spark, request_reward(names(*asked), names("a", "b"), names("c"), F.lit(just)))[0], want, abs_tol=1e-12)
    for core, opt, irr, driver, just in ((2, 0, 0, 0, 1.0), (1, 3, 2, 1, 0.5), (0, 0, 0, 0, 0.0)):
        parts = 0.35 * core / 2 + 0.2 * (1 - driver / 4) + 0.1 * math.exp(-2 * (2 - core) / 2) + 0.2 * math.exp(-0.5 * max(0, (opt + irr - 2) / 3)) + 0.15 * just
        got = one(spark, graded_reward(*map(F.lit, (core, opt, irr, driver)), 2, 3, 4, F.lit(just)))[0]
        assert math.isclose(got, min(0.7, parts), abs_tol=1e-12)


def test_gate_knows_words_and_units(spark):
    table = {"5 mmHg": "value_unit", "3 U/L": "value_unit", "4.2 mmol/L": "value_unit", "7k/ul": "value_unit", "5 mmHgs": None, "x5 mg/dL": None, "on 2024-01-02.": "date", "12024-01-02": None, "id 1234567": "digits", "123456": None}
    df = spark.createDataFrame(list(table.items()), "t string, want string")
    assert [(r.t, r.got) for r in df.select("t", X.blocked_reason(F.col("t")).alias("got")).collect()] == list(table.items())


def test_phrases_and_merge(spark):
    from chronosieve.functions import guards as G

    stem = F.lit("Potassium is LIKELY TO RISE and will rise; it belongs to patient A")
    got = one(spark, G.phrases_in(stem, G.ASSERTIONS), G.phrases_in(stem, G.OWNER_REVEALS), G.phrases_in(F.lit(None).cast("string"), G.ASSERTIONS))
    assert got[0] == ["likely to rise", "will rise"] and got[1] == ["belongs to patient a"] and got[2] == []
    verdict = G.merged({"a": F.lit(True), "b": F.lit(True)}, {"b": F.lit(None).cast("boolean")})
    assert one(spark, *[c.alias(k) for k, c in verdict.items()]).asDict() == {"a": True, "b": True, "accept": True}
    verdict = G.merged({"a": F.lit(True), "b": F.lit(True)}, {"b": F.lit(False)})
    assert one(spark, *[c.alias(k) for k, c in verdict.items()]).asDict() == {"a": True, "b": False, "accept": False}


def test_chart_checks_table(spark):
    from chronosieve.functions import guards as G

    def checked(stem, gold, chain, cited):
        names = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
        chart = F.create_map(F.lit("Lactate"), F.lit(True), F.lit("Sodium"), F.lit(False))
        c = G.chart_checks(F.lit(stem), names(gold), chart, names(chain), F.lit(cited), ["induces", "impairs"], ["x-ray"])
        return tuple(one(spark, *c.values()))

    assert checked("what is it?", ["Lactate"], ["a induces", "b impairs"], True) == (True, True, True, True)
    assert checked("what is LACTATE?", ["Lactate"], ["a", "b", "c"], None) == (False, True, True, False)
    assert checked("an X-ray shows", ["Sodium", "Other"], ["a", "b"], False) == (False, False, False, False)
    assert checked("what is it?", [], [], True) == (False, False, False, True)


def test_trends_of_missing_and_tiny_slopes(spark):
    from chronosieve.operators.matching import slope_gap, trends_compatible

    table = [(1, 1.0, 1, 0.8, True, 0.2), (1, 1.0, 1, 0.79, False, 0.21), (1, 1.0, -1, -1.0, False, 2.0), (None, None, 1, 1.0, True, 0.0), (1, 0.0004, 1, 0.0009, True, 0.5 / 0.9), (0, 0.0, 0, 0.0, True, 0.0)]
    df = spark.createDataFrame(table, "da int, sa double, db int, sb double, fits boolean, gap double")
    for r in df.select("*", trends_compatible(*map(F.col, ("da", "sa", "db", "sb"))).alias("got"), slope_gap(F.col("sa"), F.col("sb")).alias("g")).collect():
        assert r.got == r.fits and abs(r.g - r.gap) < 1e-9


def test_candidate_pairs_equal_all_pairs(spark):
    import random

    from chronosieve.operators.matching import candidate_pairs

    rnd = random.Random(7)
    slope = lambda: rnd.choice([None, 0.0, rnd.uniform(0, 0.002), rnd.uniform(0, 5), rnd.choice([1.0, 0.8, 1.25])])
    rows = [(k, "s", k % 3, k % 2, rnd.randint(0, 9), (None if x is None else 1), x) for k in range(90) for x in [slope()]]
    df = spark.createDataFrame(rows, "id long, stratum string, kind int, f int, severity int, d int, s double")
    got = {(r.a_id, r.b_id): r.score for r in candidate_pairs(df, "stratum", "kind", "id", ["f"], [("d", "s")]).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[2] >= b[2]:
                continue
            x, y = a[6], b[6]
            top = max(x, y) if None not in (x, y) else None
            if top is not None and not (top < 0.001 or abs(x - y) <= 0.2 * top):
                continue
            want[a[0], b[0]] = 10 * (a[3] != b[3]) + abs(a[4] - b[4]) + (5 * abs(x - y) / top if top is not None and x + y > 0.001 else 0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_full_charts_from_zero(spark, tmp_path):
    from chronosieve.plans import catalog

    events(spark, [(1, 1, "error", 0 * H, 0.0), (2, 1, "error", 2 * H, 5.0), (3, 2, "error", 0 * H, 4.0), (4, 2, "error", 2 * H, 5.0)]).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["full_chart_cases"](spark, str(tmp_path)).orderBy("subject").collect()
    assert [(r.subject, r.truth, r.direction, r.change_permille) for r in got] == [(1, 5.0, "rising", None), (2, 5.0, "rising", 250)]


def test_halves_are_those_of_decimals(spark):
    cases = [(56.949999999999996, 57.0), (56.95, 57.0), (-56.949999999999996, -57.0), (56.949, 56.9), (56.94999, 56.9), (0.05, 0.1), (123456789.05, 123456789.1), (1e25, 1e25), (None, None)]
    got = spark.createDataFrame([c[:1] for c in cases], "x double").select(D.rounded("x", 1)).collect()
    assert [r[0] for r in got] == [c[1] for c in cases]


def every_hundredth(spark, tmp_path):
    """Events that hold each value of two digits below 600 for each type, five of one user and day; and DuckDB on them."""
    import duckdb

    path = str(tmp_path)
    rows = spark.range(300_000).withColumn("k", F.floor(F.col("id") / 5))
    kind = F.element_at(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])), (F.col("id") % 5 + 1).cast("int"))
    rows.select(F.col("id").alias("event_id"), F.lit(T0).cast("timestamp_ntz").alias("ts"), F.col("k").alias("user_id"), kind.alias("event_type"), (F.col("k") / 100).alias("value")).write.parquet(f"{path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS FROM '{path}/events.parquet/*.parquet'")
    return path, duck


def test_translated_cases_of_every_hundredth(spark, tmp_path):
    from decimal import ROUND_HALF_UP, Decimal

    from chronosieve.plans import bundles, catalog

    path, duck = every_hundredth(spark, tmp_path)
    got = catalog.QUERIES["translated_cases"](spark, path).toPandas()
    want = duck.execute(catalog.ORACLES["translated_cases"]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    dec = lambda x: Decimal(str(x))
    one, other = ({lab: (dec(mean), dec(sd)) for lab, _, _, mean, sd in rows} for rows in (bundles.ONE, bundles.OTHER))
    for r in got.itertuples():
        for lab, tenths, _ in map(str.split, r.panel.split(";")):
            exact = other[lab][0] + (Decimal(r.subject) / 100 - one[lab][0]) / one[lab][1] * other[lab][1]
            assert int(tenths) == int((exact * 10).to_integral_value(ROUND_HALF_UP)), (lab, r.subject)


def test_translated_values_of_every_hundredth(spark, tmp_path):
    import math
    from decimal import ROUND_HALF_UP, Decimal

    from chronosieve.plans import catalog, timelines

    path, duck = every_hundredth(spark, tmp_path)
    got = catalog.QUERIES["translated_values"](spark, path).toPandas()
    want = duck.execute(catalog.ORACLES["translated_values"]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    kinds = ["click", "error", "purchase", "signup", "view"]
    for r in got.itertuples():
        _, _, mean, sd = (Decimal(str(x)) for x in timelines.RANGES[kinds[r.event_id % 5]])
        v = Decimal(r.event_id // 5) / 100
        v = Decimal(math.floor(v)) if r.event_id % 3 == 0 else v
        t = 50 + 5 * (v - mean) / sd
        like = t.quantize(Decimal(1 if v == math.floor(v) else "0.1"), ROUND_HALF_UP)
        tenth = t.quantize(Decimal("0.1"), ROUND_HALF_UP)
        assert (r.like_it, r.kept) == (float(like), float(tenth if 45 <= tenth <= 55 else 50)), r


def test_leaks_are_whole_words_of_any_script(spark, tmp_path):
    import duckdb

    from chronosieve.functions import guards as G
    from chronosieve.plans import catalog

    stems = {"lañada": False, "voilà": False, "Éla": False, "la²": False, "la_": False, "la\u0301": False, "lathe": False, "a la carta": True, "la": True, "¿la?": True, "ñ la, ñ": True, "LA—": True, "": False}
    got = spark.createDataFrame([(s,) for s in stems], "s string").select(F.lower("s").rlike(G.whole_words(["the", "la"]))).collect()
    assert [r[0] for r in got] == list(stems.values())

    path = str(tmp_path)  # both labs rise over their ranges; one document has "la" only within other words
    rises = [("error", -H, 20.0), ("view", -H, 20.0), ("purchase", 0 * H, 1.0), ("error", H, 90.0), ("view", H, 90.0)]
    events(spark, [(5 * u + i, u, *r) for u in (1, 2) for i, r in enumerate(rises)]).coalesce(1).write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(1, "De lañada y élas"), (2, "Ñada a la carta")], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS FROM '{path}/events.parquet/*.parquet'")
    duck.execute(f"CREATE VIEW documents AS FROM '{path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["direction_checks"](spark, path).toPandas()
    want = duck.execute(catalog.ORACLES["direction_checks"]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    assert dict(zip(got.user_id, got.answerable)) == {1: True, 2: False}
