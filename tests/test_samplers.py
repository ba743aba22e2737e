import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import sampling as S
from quarry.plans.fixtures import qa_view


@pytest.fixture(scope="module")
def qa(spark, sf_dir):
    return qa_view(spark, sf_dir, embeddings=True, events=True).cache()


METHODS = [
    ("uniform_random", {"n": 10}),
    ("stratified", {"n": 10}),
    ("stratified", {"n": 10, "allocation": "equal"}),
    ("stratified", {"n": 10, "allocation": "neyman", "variability_field": "difficulty"}),
    ("importance_weighted", {"n": 10}),
    ("active_learning", {"n": 10}),
    ("difficulty_aware", {"n": 10, "hard_frac": 0.5}),
    ("temporal_recent", {"n": 10, "days": 1}),
    ("temporal_recent", {"n": 10, "mode": "decay", "half_life_days": 1}),
    ("unanswerable_mix", {"n": 10}),
]


def _ids(df):
    return sorted((r[0], r[1]) for r in df.select("dataset", "entry_id").collect())


@pytest.mark.parametrize("method,params", METHODS)
def test_invariants(spark, qa, method, params):
    out, audit = S.run_sampler(qa, method, params, as_of="2024-01-03 00:00:00")
    ids = _ids(out)
    assert len(ids) == len(set(ids))
    counts = {r["dataset"]: r["_N"] for r in S.dataset_counts(qa).collect()}
    per = {}
    for d, _ in ids:
        per[d] = per.get(d, 0) + 1
    for d, n in counts.items():
        if method == "stratified":  # rounded allocations are not trimmed: may exceed n
            assert per.get(d, 0) >= min(10, n), (method, d)
        else:
            assert per.get(d, 0) == min(10, n), (method, d)
    again, _ = S.run_sampler(qa.repartition(1), method, params, as_of="2024-01-03 00:00:00")
    assert _ids(again) == ids  # same seed, other partitioning -> same sample
    other, _ = S.run_sampler(qa, method, dict(params, seed=7), as_of="2024-01-03 00:00:00")
    if method not in ("active_learning",):
        assert _ids(other) != ids
    a = {r["dataset"]: r["actual_n"] for r in audit.collect()}
    assert a == {d: per.get(d, 0) for d in counts}


def _round_robin(alloc, sizes, n, min_per):
    """Counts per stratum by listing slots: a stratum's j-th extra row is slot (j, rank), ranks by
    falling remainder then falling name; the first slots get the rows that the floors leave."""
    floor = {s: min(max(alloc[s], min_per), sizes[s]) for s in sizes}
    rank = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (alloc[s] - floor[s], s), reverse=True))}
    slots = sorted((j, rank[s], s) for s in sizes for j in range(sizes[s] - floor[s]))
    given = [s for _, _, s in slots[: max(0, n - sum(floor.values()))]]
    return {s: floor[s] + given.count(s) for s in sizes}


def test_round_robin_closed_form(spark):
    rng = np.random.default_rng(1)
    for trial in range(40):
        k = int(rng.integers(1, 8))
        sizes = {f"s{i}": int(rng.integers(1, 6)) for i in range(k)}
        N = sum(sizes.values())
        n = int(rng.integers(0, N))
        min_per = int(rng.integers(0, 3))
        alloc = {s: min(sz, int(round(n * sz / N))) for s, sz in sizes.items()}
        expect = _round_robin(alloc, sizes, n, min_per)
        rows = [("d", f"{s}-{j}", s) for s, sz in sizes.items() for j in range(sz)]
        df = spark.createDataFrame(rows, "dataset string, entry_id string, topic string")
        out, audit = S.run_sampler(df, "stratified", {"n": n, "strata_keys": ["topic"], "min_per_stratum": min_per})
        got = {}
        for r in out.collect():
            t = r["topic"]
            got[t] = got.get(t, 0) + 1
        if n >= N:
            continue
        assert {s: got.get(s, 0) for s in sizes} == expect, (sizes, n, min_per)


def test_kcenter_matches_numpy(spark, qa):
    n = 6
    out, audit = S.run_sampler(qa, "diversity_kcenter", {"n": n})
    got = {}
    for r in out.select("dataset", "entry_id").collect():
        got.setdefault(r[0], set()).add(r[1])
    rows = qa.select("dataset", "entry_id", "embedding",
                     S.uid(S._seed_col(42), "shuffle").alias("u0"),
                     S.uid(S._seed_col(42), "first").alias("u1")).collect()
    for d in got:
        rs = [r for r in rows if r["dataset"] == d]
        if len(rs) <= n:
            assert len(got[d]) == len(rs)
            continue
        x = np.array([r["embedding"] for r in rs], dtype=float)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        first = int(np.argmin([r["u1"] for r in rs]))
        sel = [first]
        md = 1 - x @ x[first]
        md[first] = -1
        u0 = np.array([r["u0"] for r in rs])
        while len(sel) < n:
            best = max(range(len(rs)), key=lambda i: (md[i], -u0[i]))
            sel.append(best)
            md = np.minimum(md, 1 - x @ x[best])
            md[sel] = -1
        assert {rs[i]["entry_id"] for i in sel} == got[d]
    a = audit.select("avg_pairwise_cosine").collect()
    assert all(r[0] is not None for r in a)


def test_n_validation():
    with pytest.raises(ValueError):
        S.merge_params("uniform_random", {"n": -1})
    with pytest.raises(ValueError):
        S.merge_params("uniform_random", {"n": "ten"})


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, "dataset string, entry_id string, " + schema)


def test_kcenter_copies_and_core_set(spark):
    df = _frame(spark, [("d", str(i), [0.26, 0.5, 0.45]) for i in range(12)], "embedding array<double>")
    assert S.run_sampler(df, "diversity_kcenter", {"n": 4})[0].count() == 4
    rng = np.random.default_rng(0)
    df = _frame(spark, [("d", str(i), v.tolist()) for i, v in enumerate(rng.normal(size=(200, 3)))], "embedding array<double>")
    for extra in ({}, {"core_set": 10}):
        out = S.run_sampler(df.repartition(4), "diversity_kcenter", {"n": 7} | extra)[0]
        assert out.count() == 7 and out.select("entry_id").distinct().count() == 7


def test_kcenter_groups_of_datasets(spark, monkeypatch):
    from quarry.operators import vectors

    df = _frame(spark, [(f"d{k}", str(i), [float(i), 1.0, float(k)]) for k in range(5) for i in range(6)], "embedding array<double>")
    want = _ids(S.run_sampler(df, "diversity_kcenter", {"n": 3})[0])
    monkeypatch.setattr(vectors, "MAX_CENTER_VALUES", 20)
    assert _ids(S.run_sampler(df, "diversity_kcenter", {"n": 3})[0]) == want and len(want) == 15


def test_zero_weights_and_bad_values(spark):
    df = _frame(spark, [(d, str(i), w) for d, w in (("zero", "0"), ("nan", "NaN"), ("neg", "-1"), ("text", "x"), ("good", "2")) for i in range(9)], "weight string")
    out, audit = S.run_sampler(df, "importance_weighted", {"n": 4})
    assert {r["dataset"]: r["actual_n"] for r in audit.collect()} == dict.fromkeys(("zero", "nan", "neg", "text", "good"), 4)


def test_shared_ids_draw_different_rows(spark):
    df = _frame(spark, [(d, str(i), i) for d in "ab" for i in range(200)], "pos long")
    out = {}
    for d, e in _ids(S.run_sampler(df, "uniform_random", {"n": 20})[0]):
        out.setdefault(d, set()).add(e)
    assert len(out["a"] & out["b"]) < 10


def test_fields_of_every_kind(spark):
    import json

    from quarry.operators.fields import resolve

    df = spark.createDataFrame([("d", json.dumps({"x": {"y": [1, 2]}}), {"k": 1.5}, (2, "t"))], "dataset string, js string, m map<string,double>, s struct<a:int,b:string>")
    df = df.withColumn("extra", F.parse_json(F.lit('{"w": "3.5", "flag": 0, "deep": {"n": 4, "on": true}, "v": {"a": "1", "b": null}}')))
    got = df.select(
        resolve(df, "m.k").number().alias("a"), resolve(df, "s.a").number().alias("b"), resolve(df, "deep.n").number().alias("c"),
        resolve(df, "w").number().alias("d"), resolve(df, "flag").truthy().alias("e"), resolve(df, "deep.on").truthy().alias("f"),
        resolve(df, "js.x.y").numbers().alias("g"), resolve(df, "nowhere").number().alias("h"), resolve(df, "s.zzz").number().alias("i"), resolve(df, "v").strings().alias("j"),
    ).first()
    assert tuple(got) == (1.5, 2.0, 4.0, 3.5, False, True, [1.0, 2.0], None, None, ["1", None])


def test_audit_names_empty_sets_and_absent_fields(spark):
    df = _frame(spark, [("a", "1", 1.0)], "pos double")
    names = spark.createDataFrame([("a",), ("none",)], "dataset string")
    rows = {r["dataset"]: r for r in S.run_sampler(df, "importance_weighted", {"n": 5}, datasets=names)[1].collect()}
    assert rows["none"]["actual_n"] == 0 and rows["a"]["absent_fields"] == ["weight"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        forms = ["2024-01-03T10:00:00+02:00", "2024-01-03 08:00:00Z", "2024-01-03T08:00", "20240103", "2024-01-03 08:00:00.123456", "nonsense", ""]
        df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, s string")
        got = [r[1] and str(r[1]) for r in sorted(df.select("i", S.parse_date(F.col("s"), "string")).collect())]
        assert got == ["2024-01-03 08:00:00"] * 3 + ["2024-01-03 00:00:00", "2024-01-03 08:00:00.123456", None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_register_sampler(spark):
    S.register_sampler("first_rows", lambda df, p, seed, part: (S.top_n(df, [F.col("entry_id")], p["n"], part), {}))
    df = _frame(spark, [("d", str(i), i) for i in range(9)], "pos long")
    assert [e for _, e in _ids(S.run_sampler(df, "first_rows", {"n": 2})[0])] == ["0", "1"]
