"""Rows that repeat ids or have no dataset; running sums over ranges; spread forms against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import identity as I
from quarry.operators import retrieval as RT
from quarry.operators import sampling as S
from quarry.operators import vectors as V
from quarry.operators.scoring import MetricSpec, score_columns
from quarry.plans import pipeline as PL
from quarry.sources import readers as RD


@pytest.fixture(scope="module")
def half_named(spark):
    """20 rows of dataset a and 20 without; ids 0..9, four rows each."""
    rows = [("a" if i % 2 else None, str(i // 4), i, f"q{i} word", f"r {i % 3}", f"r {i % 2}", float(i % 5), i % 3 == 0, [float(i % 7), 1.0, float(i)]) for i in range(40)]
    return spark.createDataFrame(rows, "dataset string, entry_id string, pos long, Question string, Response string, Predicted string, weight double, is_unanswerable boolean, embedding array<double>")


METHODS = [("uniform_random", {}), ("stratified", {"strata_keys": ["Response"]}), ("diversity_kcenter", {}), ("importance_weighted", {}), ("active_learning", {}),
           ("difficulty_aware", {"hard_frac": 0.5}), ("temporal_recent", {"mode": "decay"}), ("unanswerable_mix", {"target_ratio": 0.4})]


@pytest.mark.parametrize("method,params", METHODS)
def test_null_dataset_and_repeated_ids(half_named, method, params):
    out, audit = S.run_sampler(half_named, method, {"n": 5} | params)
    rows = [tuple(r) for r in out.select("dataset", "pos").collect()]
    assert len(set(rows)) == len(rows) and set(out.columns) == set(half_named.columns)
    per = {d: sum(1 for r in rows if r[0] == d) for d in ("a", None)}
    assert all(v >= 5 for v in per.values()) and (method == "stratified" or per == {"a": 5, None: 5})
    assert {r["dataset"]: r["actual_n"] for r in audit.collect()} == per
    again = S.run_sampler(half_named.repartition(7), method, {"n": 5} | params)[0].select("dataset", "pos").collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, rows))


def test_copies_are_numbered_by_place_then_content(spark):
    rows = [(None, "x", 3, "c"), (None, "x", 1, "a"), ("d", "x", 9, "z"), (None, None, None, "e"), (None, None, None, "b"), (None, None, None, "b")]
    df = spark.createDataFrame(rows, "dataset string, entry_id string, pos long, t string").repartition(3)
    got = sorted((tuple(r) for r in I.identified(df).select("dataset", "entry_id", "t", I.COPY).collect()), key=repr)
    assert {r[:3]: r[3] for r in got if r[1]} == {(None, "x", "a"): 0, (None, "x", "c"): 1, ("d", "x", "z"): 0}
    assert sorted(r[3] for r in got if r[1] is None) == [0, 1, 2]


def test_trials_and_token_metrics_on_repeated_ids(spark):
    rows = [("a", "1", "x", "x"), ("a", "1", "x", "y"), ("a", "2", "x", "z"), ("a", "2", "u v", "w w w")]
    df = spark.createDataFrame(rows, "dataset string, entry_id string, Response string, Predicted string")
    summary, _ = PL.run_trials(df, "uniform_random", {"n": 4}, trials=2, metrics=["em"])
    assert [(r["mean"], r["n"]) for r in summary.collect()] == [(0.25, 4)] * 2
    got = {(r["Response"], r["Predicted"]): (round(r["F1"], 6), r["jaccard"]) for r in score_columns(df, ["f1", "jaccard"], engine="tokens")[0].collect()}
    assert got == {("x", "x"): (1.0, 1.0), ("x", "y"): (0.0, 0.0), ("x", "z"): (0.0, 0.0), ("u v", "w w w"): (0.0, 0.0)}


@pytest.mark.parametrize("n", [0, 3])
def test_uniform_trials_are_the_sampler(half_named, n):
    rows = I.identified(half_named)
    drawn = S.uniform_trials(rows.repartition(5), n, ["42", "43"])
    for t, seed in enumerate((42, 43)):
        want = S.run_sampler(rows, "uniform_random", {"n": n, "seed": seed})[0].select("dataset", "entry_id", I.COPY)
        got = drawn.where(F.col("trial") == t).select("dataset", "entry_id", I.COPY)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert "Generate" not in drawn._jdf.queryExecution().toString()


def test_read_table_names_null_datasets(spark):
    df = spark.createDataFrame([(None, "q"), ("s", "q")], "dataset string, question string")
    assert sorted(r["dataset"] for r in RD.read_table(df, dataset_name="mine").collect()) == ["mine", "s"]


def test_unknown_metrics_are_errors():
    with pytest.raises(ValueError, match="rouge7"):
        MetricSpec.resolve(["em", "rouge7"])
    assert MetricSpec.resolve(["hit@7", "ROUGEL"]).wanted == {"hit@7", "rougel"}


@pytest.mark.parametrize("parts", [1, 6])
def test_running_numbers_and_sums(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["a", None]), r.randrange(5), i, r.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, i int, v int").repartition(parts)
    got = {x["i"]: (x["_row"], x["s"]) for x in I.running(df, ["g"], [F.desc("k"), F.col("i").asc()], {"s": F.col("v")}).collect()}
    for g in ("a", None):
        total = 0
        for n, row in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))):
            assert got[row[2]] == (n, total)
            total += row[3]


@pytest.mark.parametrize("allocation,min_per", [("proportional", 0), ("equal", 2), ("neyman", 0)])
def test_allocation_over_ranges_is_that_of_windows(spark, monkeypatch, allocation, min_per):
    r = random.Random(min_per)
    rows = [(r.choice(["a", None]), str(i), f"t{min(r.randrange(40), r.randrange(40))}", float(r.randrange(9))) for i in range(500)]
    df = spark.createDataFrame(rows, "dataset string, entry_id string, topic string, w double")
    params = {"n": 47, "strata_keys": ["topic"], "allocation": allocation, "variability_field": "w", "min_per_stratum": min_per}
    want = sorted(map(repr, map(tuple, S.stratum_counts(df, params).collect())))
    monkeypatch.setattr(S, "WINDOW_STRATA", 3)
    assert sorted(map(repr, map(tuple, S.stratum_counts(df, params).collect()))) == want
    out, audit = S.run_sampler(df, "stratified", params)
    assert {r["dataset"]: (r["n_strata"], sum(r["counts_by_stratum"].values())) for r in audit.collect()} == {
        r["dataset"]: (len({x[2] for x in rows if x[0] == r["dataset"]}), r["count"]) for r in out.groupBy("dataset").count().collect()}
    monkeypatch.setattr(S, "AUDIT_STRATA", 4)
    assert all(r["counts_by_stratum"] is None and r["n_strata"] > 4 for r in S.run_sampler(df, "stratified", params)[1].collect())


def greedy(vectors, n, u0, first):
    """Plain farthest-first over unit vectors."""
    x = np.array(vectors, float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    picks = [first]
    while len(picks) < min(n, len(x)):
        md = np.round(np.maximum(0, 1 - (x @ x[picks].T).max(axis=1)), V.DISTANCE_DIGITS)
        md[picks] = -1
        picks.append(int(np.lexsort((u0, -md))[0]))
    return picks


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_kcenter_equals_plain_greedy(spark, kind, monkeypatch):
    r = np.random.default_rng(len(kind))
    x = r.normal(size=(300, 12))
    if kind == "clusters":
        x = r.normal(size=(6, 12))[r.integers(0, 6, 300)] + 0.01 * x
    if kind == "copies":
        x = x[r.integers(0, 9, 300)]
    df = spark.createDataFrame([("a", str(i), v.tolist()) for i, v in enumerate(x)], "dataset string, entry_id string, embedding array<double>").repartition(5)
    u = {row["entry_id"]: (row["a"], row["b"]) for row in df.select("entry_id", S.uid(S._seed_col(42), "shuffle").alias("a"), S.uid(S._seed_col(42), "first").alias("b")).collect()}
    first = min(range(300), key=lambda i: u[str(i)][1])
    want = greedy(x, 25, np.array([u[str(i)][0] for i in range(300)]), first)
    for most in (4_000_000, 900):  # few rows are fetched a round, one dataset a group
        monkeypatch.setattr(V, "MAX_CENTER_VALUES", most)
        out, audit = S.run_sampler(df, "diversity_kcenter", {"n": 25})
        assert {row["entry_id"] for row in out.collect()} == set(map(str, want))


@pytest.mark.parametrize("core", [1, 40])
def test_core_set_gives_n_rows(spark, core):
    rows = [("a" if i % 2 else None, str(i % 30), [float(i % 5), float(i % 3), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "dataset string, entry_id string, embedding array<double>").repartition(4)
    assert S.run_sampler(df, "diversity_kcenter", {"n": 20, "core_set": core})[0].groupBy("dataset").count().select("count").collect() == [(20,), (20,)]


def test_long_vectors_are_normalised_in_linear_time(spark):
    df = spark.range(400).selectExpr("'a' AS dataset", "cast(id AS string) AS entry_id", "transform(sequence(0, 4095), j -> cast((id * 31 + j * 17) % 101 AS double)) AS embedding")
    assert S.run_sampler(df, "diversity_kcenter", {"n": 4})[0].count() == 4


@pytest.mark.parametrize("k", [1, 4])
def test_spread_kmeans_equals_one_task(spark, k, monkeypatch):
    r = np.random.default_rng(k)
    rows = []
    for e, n in (("one", 1), ("few", 4), ("many", 230), ("same", 40), (None, 70)):
        x = r.integers(0, 6, size=(n, 5)).astype(float) if e != "same" else np.ones((n, 5))
        rows += [("d", e, i, v.tolist()) for i, v in enumerate(x)]
    ch = spark.createDataFrame(rows, "dataset string, entry_id string, chunk_id int, vec array<double>").repartition(6)
    one = sorted(map(repr, map(tuple, RT.kmeans_per_entry(ch, k).collect())))
    assert len(one) == len(rows)
    for least, most in ((50, 4_000_000), (0, 30)):
        monkeypatch.setattr(RT, "MAX_CENTER_VALUES", most)
        assert sorted(map(repr, map(tuple, RT.kmeans_per_entry(ch, k, entry_chunks=least).collect()))) == one


@pytest.mark.parametrize("block", [7, 1000])
def test_graph_in_blocks(spark, block):
    r = np.random.default_rng(block)
    rows = [("d", e, i, (r.normal(size=4) * (i % 11 > 0)).tolist()) for e, n in (("x", 1), ("y", 40), (None, 13)) for i in range(n)]
    ch = spark.createDataFrame(rows, "dataset string, entry_id string, chunk_id int, vec array<double>").repartition(3)
    want, best = {}, {}
    for _, e, i, v in rows:
        for _, f, j, w in rows:
            den = np.linalg.norm(v) * np.linalg.norm(w)
            sim = float(np.dot(v, w) / den) if den else 0.0
            if e == f and i != j and sim > 0.5:
                want[e, i, j] = round(sim, 9)
                if (e, i) not in best or round(sim, 9) > best[e, i][0]:
                    best[e, i] = (round(sim, 9), j)
    got = {(r["entry_id"], r["src"], r["dst"]): round(r["weight"], 9) for r in RT.similarity_graph(ch, 0.5, block).collect()}
    assert got == want
    top = {(r["entry_id"], r["chunk_id"]): round(r["weight"], 9) for r in RT.strongest_neighbours(ch, 0.5, block).collect()}
    assert top == {k: s for k, (s, _) in best.items()}


def test_jsonl_lines_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([(f'{{"question": "q{i}"}}' if i % 3 else "  ",) for i in range(600)], "value string").repartition(7).write.text(str(tmp_path / "j"))
    want = {}
    for f in sorted((tmp_path / "j").glob("part-*.txt")):
        for line in f.read_text().splitlines():
            if line.strip():
                want[len(want)] = line.split('"')[3]
    try:
        for size in ("128m", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = RD.read_jsonl(spark, str(tmp_path / "j"))
            assert {r["pos"]: r["Question"] for r in df.select("pos", "Question").collect()} == want
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("per", [5, 100_000])
def test_hot_terms_are_dealt_over_salts(spark, monkeypatch, per):
    monkeypatch.setattr(V, "HOT_TERM_ROWS", per)
    rows = [("a" if i % 4 else None, str(i), "the " * (1 + i % 3) + f"w{i % 9}") for i in range(60)]
    df = spark.createDataFrame(rows, "dataset string, entry_id string, t string")
    got = {(r["dataset"], r["entry_id"], r["term"]): round(r["w"], 9) for r in V.tfidf_postings(df, F.col("t")).collect()}
    want = {}
    for d in ("a", None):
        own = [(e, t.split()) for x, e, t in rows if x == d]
        for e, words in own:
            for w in set(words):
                df_w = sum(w in ws for _, ws in own)
                want[d, e, w] = round(words.count(w) / len(words) * (np.log((len(own) + 1) / (df_w + 1)) + 1), 9)
    assert got == want
