"""Physical-plan checks: top-n per group is a map-side WindowGroupLimit; no cross joins."""

import os

import pytest

import __spark_entry__ as E

QUERIES = E.queries()


@pytest.mark.parametrize("name", ["b02_uniform", "b03a_stratified_proportional", "b06a_active_entropy", "a09_dedupe", "a10_cap"])
def test_window_group_limit(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) + final


@pytest.mark.parametrize("name", ["c09_neighbour_refinement", "b15_sparse_cosine", "e03_trials", "d20_coverage"])
def test_no_cross_join(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_hard_fraction_is_limited_twice(spark, sf_dir):
    assert _plan(spark, sf_dir, "b07b_difficulty_hard_frac").count("WindowGroupLimit") >= 4


@pytest.mark.parametrize("name", ["d04_f1", "d27_score_local", "d07_levenshtein", "c11_raptor", "c12c_graphrag_shared_ids"])
def test_maps_without_exchange(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)  # the one exchange deals out a scan of a single row group
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == plan.count("RoundRobinPartitioning") <= 1


def test_summary_folds_before_the_exchange(spark, sf_dir):
    plan = _plan(spark, sf_dir, "e02_overall")
    assert plan.count("FileScan") == 1 and plan.count("Exchange") - plan.count("RoundRobinPartitioning") == 2


def test_read_many_joins_by_path(spark, sf_dir):
    assert "NestedLoop" not in _plan(spark, sf_dir, "a03_read_many")


def test_a03_documents_are_bounded(spark, sf_dir, monkeypatch):
    """The files of a03 grow with the data, none is much over the bound, and the rows stay the same."""
    from oracle_check import compare, duck

    from quarry.plans import queries

    read, sizes = queries.RD.read_many, []
    monkeypatch.setattr(queries, "A03_BYTES", 2_000, raising=False)
    monkeypatch.setattr(queries.RD, "read_many", lambda s, paths: sizes.extend(os.path.getsize(p.removeprefix("file://")) for p in paths) or read(s, paths))
    assert compare(spark, duck(sf_dir), "a03_read_many", QUERIES["a03_read_many"], E.oracle_sql()["a03_read_many"], sf_dir)["ok"]
    text = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("sum(octet_length(text)) AS b", "max(octet_length(text)) AS m").first()
    assert len(sizes) > 6 and len(sizes) >= text["b"] // 4_000 and max(sizes) < 2 * 2_000 + 2 * text["m"]


def test_checkpoint_folder_is_required_off_local(monkeypatch):
    from quarry import session

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
