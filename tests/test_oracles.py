"""Every query against its DuckDB statement on the smallest tables; the others by their invariants."""

import math
import os

import duckdb
import pytest

from chronosieve.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{sf}/{name}'")
    return con


def rows(frame):
    clean = lambda v: None if v is None or str(v) in ("<NA>", "NaT") or isinstance(v, float) and math.isnan(v) else v
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_greedy_pairs_are_one_to_one(spark, sf):
    got = catalog.QUERIES["greedy_pairs"](spark, sf).toPandas()
    for _, g in got.groupby(["severity_bin", "a_kind", "b_kind"]):
        assert g.a_id.is_unique and g.b_id.is_unique


def one_after_another(rows, share=0.2, reuse=2):
    """rows: (id, treated, p) of one group -> pairs, each treated row in the order of p taking its nearest control with room."""
    p = [r[2] for r in rows]
    width = share * (sum((x - sum(p) / len(p)) ** 2 for x in p) / len(p)) ** 0.5
    used, pairs = {}, set()
    for pa, a in sorted((r[2], r[0]) for r in rows if r[1]):
        for d, b in sorted((abs(r[2] - pa), r[0]) for r in rows if not r[1]):
            if d > width:
                break
            if used.get(b, 0) < reuse:
                used[b] = used.get(b, 0) + 1
                pairs.add((a, b))
                break
    return pairs


def test_caliper_pairs_against_one_after_another(spark):
    import random

    from chronosieve.operators.matching import caliper_pairs

    rnd = random.Random(3)
    rows = [(g, k + 1000 * g, int(rnd.random() < 0.6), round(rnd.random(), 3)) for g in (0, 1) for k in range(70)]
    df = spark.createDataFrame(rows, "g int, id long, treated int, p double")
    got = caliper_pairs(df, ["g"], "id", "treated").collect()
    want = {(g, *x) for g in (0, 1) for x in one_after_another([r[1:] for r in rows if r[0] == g])}
    assert {(r.g, r.a_id, r.b_id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed, treated, n, points, share", [(1, 0.5, 300, 8, 0.2), (3, 0.3, 200, 9, 0.05), (2, 0.8, 90, 7, 0.3)])
def test_caliper_pairs_over_seams(spark, monkeypatch, seed, treated, n, points, share):
    """Blocks of a few points, with controls to spare and with too few of them: the same pairs as one scan over all."""
    import random

    from chronosieve.operators import calipers
    from chronosieve.operators.matching import caliper_pairs

    monkeypatch.setattr(calipers, "POINTS", points)
    rnd = random.Random(seed)
    rows = [(g, k + 1000 * g, int(rnd.random() < treated), round(rnd.random() ** (1 + g), 12)) for g in (0, 1) for k in range(n)]
    df = spark.createDataFrame([*rows, (0, -1, 1, None), (1, -2, 0, float("nan")), (None, -3, 1, 0.5), (None, -4, 0, 0.5)], "g int, id long, treated int, p double")
    got = caliper_pairs(df, ["g"], "id", "treated", share=share).collect()
    want = {(g, *x) for g in (0, 1) for x in one_after_another([r[1:] for r in rows if r[0] == g], share)}
    assert {(r.g, r.a_id, r.b_id) for r in got} == want and len(got) == len(want)


def test_caliper_pairs_of_one_point_and_of_nothing(spark, monkeypatch):
    """All rows at one p: each treated row, by id, takes the next place; treated rows beyond a block go into further ones."""
    from chronosieve.operators import calipers
    from chronosieve.operators.matching import caliper_pairs

    monkeypatch.setattr(calipers, "POINTS", 16)
    rows = [(k, 1, 0.5) for k in range(100)] + [(k, 0, 0.5) for k in range(100, 140)] + [(200, 0, 0.9), (201, 1, 0.9)]
    got = {(r.a_id, r.b_id) for r in caliper_pairs(spark.createDataFrame(rows, "id long, treated int, p double"), [], "id", "treated", share=0.1).collect()}
    assert got == {(k, 100 + k // 2) for k in range(80)} | {(201, 200)}
    assert caliper_pairs(spark.createDataFrame([], "id long, treated int, p double"), [], "id", "treated").collect() == []


def test_places_under_an_outlier(spark):
    """One far value: ranges stay about equally full, places and running sums exact, neighbours found across all boundaries."""
    from pyspark.sql import functions as F

    from chronosieve.operators import ranks

    rows = [(k, float((k * 7919) % 4001), "ab"[k % 2]) for k in range(4000)] + [(4000, 1e300, "a")]
    df = spark.createDataFrame(rows, "id long, x double, g string").repartition(6)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r.id: (r.number, r.total) for r in ranks.running(df, [F.col("x"), F.col("id")], {"number": F.lit(1), "total": F.col("id")}).collect()}
    total = 0
    for k, r in enumerate(order):
        assert got[r[0]] == (k, total)
        total += r[0]
    sizes = [r["count"] for r in ranks._laid_out(df, [F.col("x"), F.col("id")]).groupBy("__part").count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    before = {r.id: r.other for r in ranks.previous(df, ["g"], [F.col("x"), F.col("id")], "id", "other").collect()}
    for g in "ab":
        own = [r[0] for r in order if r[2] == g]
        assert [before[i] for i in own] == [None, *own[:-1]]


def test_greedy_pairs_against_score_order(spark):
    import random

    from chronosieve.operators.matching import greedy_pairs

    rnd = random.Random(4)
    rows = [("x", a, b, rnd.randint(1, 9) / 2) for a in range(25) for b in range(20) if rnd.random() < 0.4]
    used_a, used_b, want = set(), set(), set()
    for _, a, b, s in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    got = greedy_pairs(spark.createDataFrame(rows, "g string, a_id long, b_id long, score double"), ["g"]).collect()
    assert {(r.a_id, r.b_id) for r in got} == want and len(got) == len(want)


def test_overlap_pairs_respect_the_gates(spark, sf):
    got = catalog.QUERIES["overlap_pairs"](spark, sf).toPandas()
    assert set(got.columns) == {"a_kind", "b_kind", "a_id", "b_id", "pa", "pb"}
    assert got.a_id.is_unique and (len(got) == 0 or got.groupby("b_id").size().max() <= 2)


def newton(x, y):
    """L2-regularised logistic regression on standardised columns, the intercept free."""
    import numpy as np

    sd = x.std(0)
    z = np.hstack([np.ones((len(x), 1)), np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0)])
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    return 1 / (1 + np.exp(-z @ w))


def area(p, y):
    a, b = p[y == 1], p[y == 0]
    return sum((x > b).sum() + (x == b).sum() / 2 for x in a) / (len(a) * len(b))


def test_overlap_diagnosis_against_one_pair_after_another(spark):
    """All pairs of kinds in one pass: the same models, pairs, balance and verdicts as each alone."""
    import random

    import numpy as np

    from chronosieve.operators.matching import overlap_diagnosis

    rnd = random.Random(8)
    shift = {"dialysis": 0.0, "ventilator": 0.4, "intubation": 2.5, "dressing": 0.0, "crrt": 0.1}
    rows = [(k, kind, rnd.gauss(s, 1), rnd.gauss(0, 2), 7.0) for k, (kind, s) in enumerate((kind, s) for kind, s in shift.items() for _ in range(19 if kind == "crrt" else 60))]
    df = spark.createDataFrame(rows, "id long, kind string, x double, y double, constant double")
    system = {"dialysis": "renal", "crrt": "renal", "ventil": "respiratory", "intub": "respiratory"}
    pairs, told = overlap_diagnosis(df, "kind", "id", ["x", "y", "constant"], system, least=20, largest=0.1)
    told, got = {(r.a_kind, r.b_kind): r for r in told.collect()}, pairs.collect()
    assert set(told) == {("dialysis", "intubation"), ("dialysis", "ventilator")}
    for (a, b), r in told.items():
        own = [x for x in rows if x[1] in (a, b)]
        x, y = np.array([r[2:] for r in own]), np.array([r[1] == a for r in own], float)
        p = newton(x, y).round(12)
        matched = one_after_another([(o[0], int(t), float(v)) for o, t, v in zip(own, y, p, strict=True)])
        assert r.n_pairs == len(matched) and r.auc_before == pytest.approx(area(p, y), abs=6e-4)
        sides = [np.array([o[2:] for o in own if o[0] in {m[k] for m in matched}]) for k in (0, 1)]
        gap = abs(sides[0].mean(0) - sides[1].mean(0)) / (np.sqrt((sides[0].var(0) + sides[1].var(0)) / 2) + 1e-9)
        assert r.largest_smd == pytest.approx(gap.max(), abs=6e-4) and r.mean_smd == pytest.approx(gap.mean(), abs=6e-4) and r.kept == (round(gap.max(), 3) <= 0.1)
        both, t = np.vstack(sides), np.r_[np.ones(len(sides[0])), np.zeros(len(sides[1]))]
        assert r.auc_after == pytest.approx(area(newton(both, t).round(12), t), abs=6e-4)
        assert {(g.a_id, g.b_id) for g in got if (g.a_kind, g.b_kind) == (a, b)} == (matched if r.kept else set())
    assert {r.kept for r in told.values()} == {True, False}, told


def test_pool_is_the_same_on_every_run(spark, sf):
    one, two = (sorted(r.user_id for r in catalog.QUERIES["hash_pool_sample"](spark, sf).collect()) for _ in range(2))
    assert one == two and len(one) == len(set(one))


def packed(text, size, stride):
    import re

    chunks, buffer = [], ""
    for part in filter(None, (x.strip() for x in re.split(r"\n\n+", text.strip()))):
        if len(buffer) + len(part) <= size:
            buffer = (buffer + "\n\n" + part).strip()
            continue
        chunks += [buffer] * bool(buffer)
        buffer = part if len(part) <= size else ""
        if len(part) > size:
            chunks += filter(None, (part[k : k + size].strip() for k in range(0, len(part), stride)))
    return chunks + [buffer] * bool(buffer)


def test_packed_chunks(spark):
    from chronosieve.operators.retrieval import packed_chunks

    texts = ["aa\n\nbb\n\n" + "c" * 20 + "\n\ndd", "", None, "a b\nc\n\n\n\nd", " x " * 30, "\n\n", "ab cd ef gh ij\n\nkl", "12345678\n\n9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.chunk, r.body) for r in packed_chunks(df, "doc_id", "text", 8, 6).orderBy("doc_id", "chunk").collect()]
    assert got == [(i, k, c) for i, t in enumerate(texts) if t for k, c in enumerate(packed(t, 8, 6))]


def test_last_json_object(spark):
    from chronosieve.functions.text import last_json_object

    texts = ['x {"a": 1} y {"b": {"c": 2}} z', "no { here", None, '{"a": 1', "{'k': 'v'} {not json}", '{"b": {"c": "}"}}', "{" * 5000 + "}" * 4999, '{"x": 1} then {"open']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(last_json_object("t")).collect()]
    assert got == ['{"b": {"c": 2}}', None, None, None, '{"k": "v"}', '{"b": {"c": "}"}}', None, '{"x": 1}']


def test_quantiles_narrow_to_the_exact_value(spark, monkeypatch):
    import random

    import numpy as np

    from chronosieve.operators import ranks

    monkeypatch.setattr(ranks, "FEW", 5)
    monkeypatch.setattr(ranks, "BUCKETS", 4)
    rnd = random.Random(2)
    rows = [(g, v) for g in "abc" for v in [rnd.gauss(0, 1) ** 3 for _ in range(200)] + [7.0] * 150 * (g == "b") + [1e9] * (g == "c")] + [("d", 3.0), ("e", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.share): r.quantile for r in ranks.quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    want = {(g, s): float(np.quantile([v for h, v in rows if h == g and v == v], s)) for g in "abcd" for s in (0.0, 0.25, 0.5, 0.9, 1.0)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_settings_are_checked():
    from chronosieve.session import SECTIONS, check_settings

    fine = {k: {} for k in SECTIONS} | {"time_zero": {"policy": "first_micro"}}
    check_settings(fine)
    for broken in ({k: v for k, v in fine.items() if k != "cohort"}, fine | {"time_zero": {"policy": "other"}}):
        with pytest.raises(ValueError):
            check_settings(broken)
