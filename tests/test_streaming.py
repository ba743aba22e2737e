import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators.report import metric_sums
from quarry.operators.sampling import run_sampler
from quarry.operators.scoring import score_columns
from quarry.plans.fixtures import qa_view
from quarry.streaming import running as RUN
from quarry.streaming.scoring import foreach_batch_scorer, score_stream


def test_stream_scoring(spark, sf_dir):
    src = tempfile.mkdtemp(prefix="quarry-stream-src-")
    qa = qa_view(spark, sf_dir, labels=False).select("dataset", "entry_id", "pos", "Question", "Context",
                                                     "Response", "Predicted", "RetrievedContexts", "RetrievedDocIds", "GoldDocId")
    qa.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(qa.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = score_stream(stream, ["em", "mrr"]).writeStream.format("memory").queryName("scored_stream").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored_stream")
    assert got.count() == qa.count()
    assert set(["EM", "MRR"]) <= set(got.columns)

    out = tempfile.mkdtemp(prefix="quarry-stream-out-")
    ck = tempfile.mkdtemp(prefix="quarry-stream-ck-")
    q2 = (spark.readStream.schema(qa.schema).parquet(src).writeStream
          .foreachBatch(foreach_batch_scorer(out, ["em", "f1"])).option("checkpointLocation", ck).start())
    q2.processAllAvailable()
    q2.stop()
    summ = spark.read.parquet(f"{out}/summary")
    assert summ.where(F.col("metric") == "F1").count() > 0


@pytest.mark.parametrize("cuts", [(30,), (7, 1, 22), (10, 10, 10)])
def test_running_sample_and_summary_equal_the_batch_answer(spark, tmp_path, cuts):
    rows = [("a" if i % 3 else None, str(i), f"x{i % 4}", f"x{i % 3}") for i in range(30)]
    schema = "dataset string, entry_id string, Response string, Predicted string"
    at = 0
    for k, n in enumerate(cuts):
        spark.createDataFrame(rows[at : at + n], schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in" / f"b={k}"))
        at += n
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for name, df, mode in (("sample", RUN.running_sample(stream(), 5), "update"), ("summary", RUN.running_summary(stream(), ["em", "levenshtein"]), "complete")):
        df.writeStream.format("memory").queryName(f"{name}_{len(cuts)}_{cuts[0]}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    batch = spark.createDataFrame(rows, schema)
    got = spark.table(f"sample_{len(cuts)}_{cuts[0]}").collect()
    last = {d: max(r.n_seen for r in got if r.dataset == d) for d in ("a", None)}
    assert last == {"a": 20, None: 10}
    want = {(r.dataset, r.entry_id) for r in run_sampler(batch, "uniform_random", {"n": 5})[0].collect()}
    assert {(r.dataset, r.entry_id) for r in got if r.n_seen == last[r.dataset]} == want
    sums = {(r.dataset, r.metric): (round(r.total, 6), r.n) for r in spark.table(f"summary_{len(cuts)}_{cuts[0]}").collect()}
    scored, keys = score_columns(batch, ["em", "levenshtein"])
    assert sums == {(r.dataset, r.metric): (round(r.total, 6), r.n) for r in metric_sums(scored, keys).collect()}
