"""What moves between tasks, and what Python is given, per query step."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import arrow_metrics as AM
from quarry.functions.vectors import cosines
from quarry.operators import retrieval as RT
from quarry.operators.scoring import score_columns

ROWS = [("a", "1", "one two. three", "one two three four five", "one two three", "x"), ("a", "2", "q", "", "", "y"), (None, "3", "six", "six seven", "six", None)]
NAMES = "dataset string, entry_id string, Question string, Context string, Response string, topic string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["bleu", "rouge2", "f1"])
def test_token_counts_are_folded_where_they_are_made(spark, metric):
    df = spark.createDataFrame(ROWS, NAMES).withColumn("Predicted", F.col("Context"))
    scored, keys = score_columns(df, [metric], engine="tokens")
    dealt = [x for x in _plan(scored.select(*keys)).splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if "_P#" in x]
    plain, _ = score_columns(df, [metric])
    rows = lambda d: sorted([(str(r["dataset"]), r["entry_id"], round(r[keys[0]], 9)) for r in d.collect()])
    assert rows(scored) == rows(plain)


def test_giant_entries_are_counted_over_all_tasks(spark, monkeypatch):
    from quarry.operators import scoring

    monkeypatch.setattr(scoring, "GIANT_ENTRY", 20)
    df = spark.createDataFrame(ROWS, NAMES).withColumn("Predicted", F.col("Context"))
    scored, _ = score_columns(df, ["f1"], engine="tokens")
    plain, _ = score_columns(df, ["f1"])
    assert any("_P#" in x for x in _plan(scored).splitlines() if "Exchange hashpartitioning" in x)
    assert sorted(round(r["F1"], 9) for r in scored.collect()) == sorted(round(r["F1"], 9) for r in plain.collect())


@pytest.mark.parametrize("technique", ["graphrag", "raptor"])
def test_techniques_give_python_the_texts_alone(spark, technique):
    out = RT.run_retrieval(spark.createDataFrame(ROWS, NAMES), technique)
    assert "MapInArrow" not in _plan(out)  # which hands all columns over
    assert {r["entry_id"]: r["topic"] for r in out.collect()} == {"1": "x", "2": "y", "3": None}


def test_refinement_makes_no_pairs(spark):
    chunks = spark.createDataFrame(
        [("a", "1", i, v, f"t{i}") for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [1.0, 0.1], [0.0, 1.0]])] + [("b", "1", 0, [1.0, 0.0], "alone"), (None, "1", 0, [1.0, 0.0], "none")],
        "dataset string, entry_id string, chunk_id int, vec array<double>, text string")
    top = chunks.where("chunk_id IN (0, 3)").withColumn("rank", F.when(F.col("chunk_id") == 0, 1).otherwise(2))
    out = RT.refine_with_neighbours(top, chunks, 0.5)
    assert "MapInArrow" in _plan(out)
    got = {(r["dataset"], r["rank"]): (r["refined_id"], r["refined_text"]) for r in out.collect()}
    assert got == {("a", 1): (1, "t1"), ("a", 2): (3, "t3"), ("b", 1): (0, "alone"), (None, 1): (0, "none")}


def test_cosines_of_odd_lists():
    a = pa.array([[1.0, 0.0], [1.0, 1.0], None, [1.0, None], [0.0, 0.0], [1.0]])
    b = pa.array([[1.0, 0.0], [1.0, 0.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0]])
    assert cosines(a, b).to_pylist() == [1.0, pytest.approx(0.5**0.5), 0.0, 0.0, 0.0, None]


def test_chunks_count_code_points(spark):
    df = spark.createDataFrame([("a", "1", "é😀\nab" * 3), ("a", "2", ""), ("a", "3", None)], "dataset string, entry_id string, Context string")
    got = sorted((r["chunk_id"], r["text"]) for r in RT.chunk(df, "Context", 4).collect())
    whole = "é😀\nab" * 3
    assert got == [(i, whole[4 * i : 4 * i + 4]) for i in range(4)]


def test_sentences_found_whole_need_no_alignment(monkeypatch):
    monkeypatch.setattr(AM, "_lcs_indices", lambda *_: pytest.fail("aligned"))
    assert AM.rouge_lsum("a b c\nd e", "d e\na b c") == 1.0


def test_edit_distance_after_common_ends():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abé") for _ in range(draw.randrange(9)))
    for _ in range(500):
        a, b = word(), word()
        head, tail = word(), word()
        assert AM.edit_distance(head + a + tail, head + b + tail) == plain(head + a + tail, head + b + tail)
    assert AM.edit_distance("ab" * 500_000 + "x", "ab" * 500_000 + "yz") == 2


def test_matching_blocks_as_difflib(monkeypatch):
    import difflib

    from quarry.functions import matching_blocks as MB

    rng = random.Random(11)
    a, b = ["", "x", "", "ab" * 150], ["", "", "y", "ba" * 150]
    for letters in ("ab", "abc ", "aaaaab", "the quick brown fox éß\U0001d11e\0"):
        for n in (5, 40, 199, 200, 260, 600):
            x = "".join(rng.choices(letters, k=n))
            cut = rng.randrange(n)
            a += [x, x, x, "aab" + x, x]
            b += ["".join(rng.choices(letters, k=rng.randint(0, n))), x[cut:] + x[:cut], x[:cut] + "#" + x[cut + 1 :], "aac" + x[::-1], x]
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert MB.ratios(a, b) == want
    monkeypatch.setattr(MB, "PAIRS_AT_ONCE", 300)  # many slices, and difflib for the large ones
    monkeypatch.setattr(MB, "PAIRS_OF_ONE", 2000)
    assert MB.ratios(a, b) == want


def test_seqmatch_work_grows_with_the_text_not_with_its_blocks():
    import difflib
    import time

    from quarry.functions.matching_blocks import ratios

    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("etaoinshrdlucmfw", k=5)) for _ in range(350)) for _ in range(60)]

    def cpu(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    plain = cpu(lambda: [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(texts[:10], texts[1:11])])
    assert cpu(lambda: ratios(texts[:-1], texts[1:])) / 59 < plain / 10 / 2


def test_sentences_share_one_integer_as_if_alone(monkeypatch):
    rng = random.Random(13)

    def plain(r, c):
        t = [[0] * (len(c) + 1) for _ in range(len(r) + 1)]
        for i in range(1, len(r) + 1):
            for j in range(1, len(c) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if r[i - 1] == c[j - 1] else max(t[i - 1][j], t[i][j - 1])
        got, i, j = set(), len(r), len(c)
        while i and j:
            if r[i - 1] == c[j - 1]:
                got.add(i - 1)
                i, j = i - 1, j - 1
            elif t[i - 1][j] == t[i][j]:
                i -= 1
            else:
                j -= 1
        return got

    for bits, rows in ((4096, 4 << 20), (20, 3)):
        monkeypatch.setattr(AM, "LCS_BITS", bits)
        monkeypatch.setattr(AM, "LCS_ROWS", rows)
        for _ in range(150):
            refs, others = ([[rng.choice("abcdefgh"[: rng.randint(2, 8)]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))] for _ in "xy")
            others[0] = [rng.choice("abyz") for _ in others[0]]
            want = [i in set().union(*(plain(r, c) for c in others)) for r in refs for i in range(len(r))]
            assert AM._on_any_lcs(refs, others) == want


def test_bag_scores_by_counters():
    from collections import Counter

    rng = random.Random(14)
    for _ in range(200):
        p, g = ([rng.choice("bcdef") for _ in range(rng.randint(0, 12))] for _ in "xy")
        got = AM.bag_scores(set(AM.BAG_METRICS), p, g, {"b", "c"}, " ".join(p), " ".join(g))
        grams = lambda s, n: Counter(zip(*(s[i:] for i in range(n))))
        hits = [(grams(p, n) & grams(g, n)).total() for n in (1, 2, 3, 4)]
        assert AM._shared_ngrams(*AM._numbered(p, g)[1:], 4) == hits if p and g else True
        for n in (1, 2):
            a, b = max(1, len(p) - n + 1), max(1, len(g) - n + 1)
            assert got[f"rouge{n}"] == pytest.approx(2 * hits[n - 1] / (a + b) if p and g else 0.0)
        if p and g:
            assert got["jaccard"] == len({*p} & {*g}) / len({*p, *g})
            assert got["coverage_recall"] == sum(t in "bc" for t in g) / len(g)
            assert got["f1"] == pytest.approx(2 * hits[0] / (len(p) + len(g)))


def test_words_of_any_alphabet():
    texts = ["", "The, a É-é x_9!", "a the ß\U0001d11e", "İI \ud800 an"]
    plain = lambda s: [t for t in s.lower().translate(str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")).split() if t not in ("a", "an", "the")]
    assert [AM.norm_words(t) for t in texts] == [plain(t) for t in texts]
    assert AM._rouge_tok("É-9aBİxß_z") == ["9abi", "x", "z"]


@pytest.mark.parametrize("held", [2_000_000, 4, 0])
def test_tfidf_unit_rows_equal_postings(spark, monkeypatch, held):
    from quarry.operators import vectors as V
    from quarry.operators.identity import identified, match

    rng = random.Random(15)
    rows = [(rng.choice(["d", "e", None]), str(i // 2), " ".join(rng.choices(["One", "two,", "deux-trois", "É", "x" + str(i)], k=rng.randint(0, 9)))) for i in range(40)]
    df = identified(spark.createDataFrame([*rows, ("d", None, None), ("d", "z", "...")], "dataset string, entry_id string, question string"))
    monkeypatch.setattr(V, "MAX_IDF_TERMS", held)
    got = V.unit_rows(df, {}, 42, ["dataset"])
    if held > 100:  # no posting is dealt by its term
        assert not [x for x in _plan(got).splitlines() if "Exchange hashpartitioning" in x and ("_k#" in x or "term#" in x)]
    key = ["dataset", "entry_id", V.COPY]
    post = V.tfidf_postings(df, F.col("question"), ("dataset",), key[1:])
    want = match(post, V.norms(post, ("dataset",), key[1:]), key).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("i"), (F.col("w") / F.col("norm")).alias("v")))).alias("v"))
    want = {tuple(r[c] for c in key): [(x.i, pytest.approx(x.v, rel=1e-12)) for x in r.v] for r in want.collect()}
    found = {tuple(r[c] for c in key): [*zip(r.idx, r.val)] for r in got.collect()}
    assert len(found) == 42 and {k: v for k, v in found.items() if v} == want
