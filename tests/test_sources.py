import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import readers as RD


def _write(d, name, obj, lines=False):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        if lines:
            f.write("\n\n".join(json.dumps(o) for o in obj) + "\n\n")
        else:
            json.dump(obj, f)
    return p


def test_json_shapes(spark):
    d = tempfile.mkdtemp(prefix="quarry-src-")
    p1 = _write(d, "list.json", [{"question": "q1", "answer": "a1"}, {"Question": "q2", "query": "ignored"}])
    p2 = _write(d, "data.json", {"data": [{"prompt": "q3"}]})
    p3 = _write(d, "named.json", {"setA": [{"question": "q4"}], "setB": [{"question": "q5", "contexts": ["x", None, 0, "y"]}]})
    p4 = _write(d, "row.json", {"question": "q6", "Predicted": None})
    rows = {(r["dataset"], r["Question"]) : r for p in (p1, p2, p3, p4) for r in RD.read_json(spark, p).collect()}
    assert ("uploaded", "q1") in rows and rows[("uploaded", "q1")]["Response"] == "a1"
    assert ("uploaded", "q2") in rows  # canonical spelling wins over the synonym
    assert ("uploaded", "q3") in rows
    assert ("setA", "q4") in rows
    assert rows[("setB", "q5")]["RetrievedContexts"] == ["x", "", "", "y"]
    assert rows[("uploaded", "q6")]["Predicted"] == ""  # present null -> ''
    assert rows[("uploaded", "q1")]["Predicted"] is None  # absent stays absent


def test_jsonl_and_many(spark):
    d = tempfile.mkdtemp(prefix="quarry-src-")
    p = _write(d, "x.jsonl", [{"question": f"q{i}", "id": f"id{i}"} for i in range(5)], lines=True)
    rows = RD.read_jsonl(spark, p).orderBy("pos").collect()
    assert [r["entry_id"] for r in rows] == [f"id{i}" for i in range(5)]
    a = _write(d, "same.json", [{"question": "a"}])
    d2 = tempfile.mkdtemp(prefix="quarry-src-")
    b = _write(d2, "same.json", [{"question": "b"}])
    got = {r["dataset"]: r["Question"] for r in RD.read_many(spark, [a, b]).collect()}
    assert got == {"same": "a", "same_2": "b"}


def test_canonical_keys():
    assert RD.canonical_key(" Ground-Truth ") == "Response"
    assert RD.canonical_key("PROMPT") == "Question"
    assert RD.canonical_key("topic") == "topic"


def test_other_json_shapes_are_an_error(spark):
    d = tempfile.mkdtemp(prefix="quarry-src-")
    for bad in ("5", "{}", '"text"'):
        p = os.path.join(d, "bad.json")
        with open(p, "w") as f:
            f.write(bad)
        with pytest.raises(Exception, match="JSON document"):
            RD.read_json(spark, p).collect()


def test_jsonl_ids_do_not_depend_on_packing(spark):
    d = tempfile.mkdtemp(prefix="quarry-src-")
    for k in range(3):
        _write(d, f"f{k}.jsonl", [{"question": f"question {k} {i} " + "x" * (i % 50)} for i in range(2000)], lines=True)
    seen = []
    for size, parts in (("128m", "1"), ("20k", "16")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        try:
            rows = RD.read_jsonl(spark, d)
            seen.append({(r["entry_id"], r["pos"], r["Question"]) for r in rows.collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen[0] == seen[1] and len(seen[0]) == 6000 and len({e for e, _, _ in seen[0]}) == 6000


def test_table_without_ids(spark):
    df = spark.createDataFrame([("q", "a"), ("q", "a"), ("r", None)], "question string, answer string")
    ids = sorted(r["entry_id"] for r in RD.read_table(df).collect())
    assert len(set(ids)) == 3 and ids == sorted(r["entry_id"] for r in RD.read_table(df.repartition(3)).collect())


def test_name_clash_skips_taken_names(spark):
    d = tempfile.mkdtemp(prefix="quarry-src-")
    a = _write(d, "x.json", [{"question": "a"}])
    b = _write(d, "y.json", {"x": [{"question": "b"}], "x_2": [{"question": "c"}]})
    got = {r["dataset"]: r["Question"] for r in RD.read_many(spark, [a, b]).collect()}
    assert got == {"x": "a", "x_2": "b", "x_2_2": "c"}


def test_normalise_lists_and_preview(spark):
    from quarry.operators import prep as PR

    df = spark.createDataFrame([("d", "1", 1, ["c1", None, "c2"], [0, 5], "", "m")], "dataset string, entry_id string, pos long, Context array<string>, RetrievedContexts array<int>, Predicted string, model_answer string")
    r = PR.normalize_rows(df).first()
    assert r["Context"] == "c1\n\nc2" and r["RetrievedContexts"] == ["", "5"]
    assert PR.preview(df.withColumn("Question", F.lit("q")).withColumn("Context", F.lit("c"))).first()["Predicted"] == "m"
    long = spark.createDataFrame([("d", str(i), i, "q", "x" * 9000 + str(i)) for i in (1, 2)], "dataset string, entry_id string, pos long, Question string, Context string")
    assert PR.load_and_normalize(long).count() == 2
    assert len(PR.load_and_normalize(long).first()["Context"]) == 9001
    assert PR.load_and_normalize(long, dedupe_context_chars=256).count() == 1


def test_trials_report(spark, tmp_path):
    from quarry.operators.report import trial_stats
    from quarry.sources.sinks import write_trials_report

    per = spark.createDataFrame([(0, "d", "EM", 0.5, 4), (1, "d", "EM", 1.0, 4)], "trial int, dataset string, metric string, mean double, n long")
    rows = spark.read.json(write_trials_report(per, trial_stats(per), str(tmp_path / "r"))).collect()
    assert len(rows) == 1 and [t["mean"] for t in rows[0]["trials_run"]] == [0.5, 1.0] and rows[0]["display"] == "0.750 ± 0.250"
