"""Values of the retrieval techniques, generation and the api-mode pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.vectors import hashed_encoder, pandas_embedder
from quarry.operators import retrieval as RT
from quarry.plans import pipeline as PL

TEXTS = {
    ("a", "1"): "red apple pie. green apple tart. blue sky today. red apple cake. rain and snow today.",
    ("b", "1"): "stocks fell. bonds rose. stocks rose. gold fell. silver rose a lot.",
    ("b", "2"): "",
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(d, e, int(e), "red apple" if d == "a" else "stocks fell", t, "x", ["old"]) for (d, e), t in TEXTS.items()]
    return spark.createDataFrame(data, "dataset string, entry_id string, pos long, Question string, Context string, Response string, RetrievedContexts array<string>")


def _cos(a, b):
    n = np.sqrt((a @ a) * (b @ b))
    return a @ b / n if n else 0.0


def _chunks(text, k=20):
    return [text[i : i + k] for i in range(0, len(text), k)]


def _plain_graphrag(question, text, k=20, top=3, edge=0.5):
    enc = hashed_encoder()
    parts = _chunks(text, k)
    v, q = enc(parts), enc([question])[0]
    order = sorted(range(len(parts)), key=lambda i: (-_cos(q, v[i]), i))[:top]
    out = []
    for i in order:
        best = max((j for j in range(len(parts)) if j != i), key=lambda j: (_cos(v[i], v[j]), -j))
        out.append(parts[best] if _cos(v[i], v[best]) > edge else parts[i])
    return out


def test_graphrag_values_and_shared_ids(rows):
    got = {(r["dataset"], r["entry_id"]): r for r in RT.run_retrieval(rows, "graphrag", chunk_size=20, excerpts_as_contexts=True).collect()}
    for key, text in TEXTS.items():
        q = "red apple" if key[0] == "a" else "stocks fell"
        assert got[key]["RetrievedExcerpts"] == (_plain_graphrag(q, text) if text else [])
        assert got[key]["RetrievedContexts"] == got[key]["RetrievedExcerpts"]
    assert got["b", "2"]["Predicted"] == "" and got["b", "2"]["prompt"] is None


@pytest.mark.parametrize("technique", ["raptor", "graphrag"])
def test_row_path_equals_operators(rows, technique):
    by_row = RT.run_retrieval(rows, technique, chunk_size=20)
    enc = pandas_embedder(hashed_encoder)
    opaque = RT.run_retrieval(rows, technique, chunk_size=20, embedder=lambda c: enc(c))
    pick = lambda df: sorted((r["dataset"], r["entry_id"], tuple(r["RetrievedExcerpts"]), r["Predicted"]) for r in df.collect())
    assert pick(by_row) == pick(opaque)


def test_kmeans_is_a_fixed_point():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.normal(size=(rng.integers(1, 40), 4)).round(1)
        labels = RT.kmeans_labels(x, 5)
        assert labels[0] == 0 and set(labels) == set(range(labels.max() + 1)) and labels.max() < 5
        firsts = [int(np.argmax(labels == j)) for j in range(labels.max() + 1)]
        assert firsts == sorted(firsts)
        centers = np.stack([x[labels == j].mean(axis=0) for j in range(labels.max() + 1)])
        d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
        assert np.allclose(d[np.arange(len(x)), labels], d.min(axis=1))


def test_graph_in_blocks(rows, monkeypatch):
    ch = RT.embed(RT.chunk(rows, "Context", 10), "text")
    want = sorted(map(tuple, RT.similarity_graph(ch, 0.2).collect()))
    monkeypatch.setattr(RT, "GRAPH_BLOCK", 2)
    assert sorted(map(tuple, RT.similarity_graph(ch, 0.2).collect())) == want and want


def test_one_bad_prompt_fails_alone():
    def gen(prompts):
        if "bad" in prompts:
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    assert RT.answers_for(gen, ["a", "bad", "c"]) == (["A", None, "C"], [None, "RuntimeError('no')", None])
    short = RT.answers_for(lambda p: p[:1], ["a", "b"])
    assert short == (["a", "b"], [None, None])


def _counting(path):
    def factory():
        def gen(prompts):
            with open(path, "a") as f:
                f.write("x" * len(prompts))
            return [f"answer {len(p)}" for p in prompts]

        return gen

    return factory


@pytest.mark.parametrize("with_dir", [False, True])
def test_generator_sees_each_sampled_row_once(spark, rows, tmp_path, with_dir):
    log = tmp_path / "calls"
    cfg = {"mode": "api", "subsampling": {"method": "uniform_random", "n": 2}, "evals": {"metrics": ["em", "f1"]}}
    if with_dir:
        cfg["artifacts_dir"] = str(tmp_path / "out")
    names = spark.createDataFrame([("a",), ("b",), ("empty",)], "dataset string")
    out = PL.run_pipeline(rows, cfg, generator=_counting(str(log)), datasets=names)
    preds = {(r["dataset"], r["entry_id"]): r["Predicted"] for r in out["predictions"].collect()}
    enriched = {(r["dataset"], r["entry_id"]): r["Predicted"] for r in out["enriched"].collect()}
    summary = {(r["dataset"], r["metric"]): r["n"] for r in out["metrics_summary"].collect()}
    out["sampling_audit"].collect(), out["missing_predicted"].collect()
    assert preds == enriched and len(preds) == 3
    assert len(log.read_text()) == 3
    assert summary["b", "EM"] == 2 and summary["empty", "EM"] == 0
    if with_dir:
        back = {(r["dataset"], r["entry_id"]): r["Predicted"] for r in spark.read.json(str(tmp_path / "out/predictions")).collect()}
        assert back == preds


def test_registries(rows):
    RT.register_generator("length", lambda: lambda prompts: [str(len(p)) for p in prompts])
    RT.register_technique("question_only", lambda df, generator=None: RT.generate(df.withColumn("prompt", F.col("Question")), factory=generator))
    got = RT.run_retrieval(rows, "question_only", generator="length").collect()
    assert {r["Predicted"] for r in got} == {"9", "11"}
    with pytest.raises(ValueError):
        RT.run_retrieval(rows, "nothing")
