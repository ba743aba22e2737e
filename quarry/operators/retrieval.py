"""Retrieval techniques as DataFrame plans: chunk -> embed -> (cluster | graph) -> top-k ->
prompt -> generate.

An entry is (dataset, entry_id); ids are unique within a dataset only. Each step is an operator on
chunk tables of its own. The techniques run all steps of an entry where its row is: one map over
the rows, one embedding per chunk, no exchange. They need the embedder's ``factory``
(``pandas_embedder``); with an opaque embedder they are composed of the operators instead.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_embedder, cosine, rows_of
from ..session import saved
from .identity import match

IDS = ("dataset", "entry_id")
#: Chunks of an entry in a block; a task compares two blocks.
GRAPH_BLOCK = 1024

# ---- fixed values: technique defaults and the prompt layout -------------------------
TECHNIQUE_DEFAULTS = {
    "rag": {},
    "raptor": {"chunk_size": 100, "num_clusters": 5, "top_k": 3},
    "graphrag": {"chunk_size": 100, "top_k": 3, "edge_threshold": 0.5},
}
PROMPT_HEAD = "User Question: "
PROMPT_MID = "\n\nRelevant Excerpt(s):\n\n"
EXCERPT_SEP = "\n\n"


def chunk(df: DataFrame, text_col: str = "Context", chunk_size: int = 100, keys=IDS) -> DataFrame:
    """Consecutive fixed-size character chunks, no overlap; empty text -> no chunks."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    # One pass over the text; the full text is not copied into every exploded row.
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{int(chunk_size)}}}"), F.lit(0))
    return df.select(*keys, F.posexplode(pieces).alias("chunk_id", "text"))


def embed(df: DataFrame, text_col: str, out_col: str = "vec", embedder=None) -> DataFrame:
    return df.withColumn(out_col, as_embedder(embedder)(F.col(text_col)))


def top_k_by_similarity(cands: DataFrame, query_vec: Column, cand_vec: Column, k: int, part=IDS, tie=("chunk_id",)) -> DataFrame:
    """Top k candidates per group by cosine (desc), ties -> lower ``tie`` columns.
    Literal k -> map-side WindowGroupLimit."""
    scored = cands.withColumn("sim", cosine(query_vec, cand_vec))
    w = Window.partitionBy(*part).orderBy(F.desc("sim"), *[F.col(t) for t in tie])
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= int(k))


# ---- RAPTOR: per-entry k-means ---------------------------------------------------------

def kmeans_labels(x: np.ndarray, num_clusters: int) -> np.ndarray:
    """Lloyd's k-means: farthest-first start from the first row, ties to the lower index, rounds
    until no label changes (each lowers the error, so they end), labels numbered by first row."""
    k = max(1, min(int(num_clusters), len(x)))
    sq = (x * x).sum(axis=1)
    to = lambda c: sq[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]  # noqa: E731  squared distances
    picks, near = [0], to(x[:1])[:, 0]
    while len(picks) < k and near.max() > 1e-9:
        picks.append(int(near.argmax()))
        near = np.minimum(near, to(x[picks[-1:]])[:, 0])
    centers, seen = x[picks].copy(), set()
    while True:
        labels = to(centers).argmin(axis=1)
        if labels.tobytes() in seen:  # unchanged, or a circle of equally good labels by rounding
            break
        seen.add(labels.tobytes())
        member = np.zeros((len(centers), len(x)))
        member[labels, np.arange(len(x))] = 1.0
        n = member.sum(axis=1, keepdims=True)
        centers = np.where(n > 0, member @ x / np.maximum(n, 1.0), centers)
    first = {int(j): i for i, j in enumerate(dict.fromkeys(labels.tolist()))}
    return np.array([first[j] for j in labels.tolist()])


#: Entries of at most so many chunks are clustered by one task each; larger ones over all tasks.
ENTRY_CHUNKS = 50_000
#: Values of all centers that one broadcast may hold (32 MB of doubles).
MAX_CENTER_VALUES = 4_000_000
_LABELS = "dataset string, entry_id string, chunk_id int, cluster_id int"


def kmeans_per_entry(chunks: DataFrame, num_clusters: int = 5, entry_chunks: int = ENTRY_CHUNKS) -> DataFrame:
    """(dataset, entry_id, chunk_id, vec) -> (dataset, entry_id, chunk_id, cluster_id) by the rule of
    ``kmeans_labels``. An entry of at most ``entry_chunks`` chunks is one group of one task; larger ones
    go through ``spread_kmeans``, which never brings an entry into a task."""
    chunks = chunks.select(*IDS, "chunk_id", "vec")
    large = saved(chunks.groupBy(*IDS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > entry_chunks), "large-entries")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        labels = kmeans_labels(_matrix(table.column("vec").combine_chunks()), num_clusters)
        return table.drop_columns("vec").append_column("cluster_id", pa.array(labels, pa.int32()))

    if large.isEmpty():
        return chunks.groupBy(*IDS).applyInArrow(run, _LABELS)
    chunks = saved(chunks, "chunk-vectors")
    small = match(chunks, large, IDS, "left_anti").groupBy(*IDS).applyInArrow(run, _LABELS)
    return small.unionByName(spread_kmeans(match(chunks, large.select(*IDS), IDS, "left_semi"), num_clusters))


def _matrix(vecs: pa.Array) -> np.ndarray:
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vecs), -1)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centers."""
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centers.T) + (centers * centers).sum(axis=1)[None, :]


def _by_entry(batches) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(entry, chunk ids, vectors) of the rows of each entry in each batch."""
    for b in batches:
        number: dict[tuple, int] = {}
        of = np.array([number.setdefault(k, len(number)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
        ids, x = b.column(2).to_numpy(), _matrix(b.column(3)) if b.num_rows else None
        for key, k in number.items():
            mine = slice(None) if len(number) == 1 else of == k
            yield key, ids[mine], x[mine]


def _per_entry(chunks: DataFrame, centers: dict[tuple, np.ndarray], fold: Callable, schema: str) -> DataFrame:
    """One map over (dataset, entry_id, chunk_id, vec) with the centers broadcast: ``fold(state, ids, x,
    centers)`` gathers a task's rows of an entry, ``state`` (a list of rows behind the entry's key)
    leaves the task. Nothing else is shuffled."""
    shared = chunks.sparkSession.sparkContext.broadcast(centers)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}
        for key, ids, x in _by_entry(batches):
            if key in shared.value:
                states[key] = fold(states.get(key), ids, x, shared.value[key])
        rows = [(*key, *row) for key, state in states.items() for row in state]
        if rows:
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
            columns = [pa.array(v, kinds[c.split()[1]]) for v, c in zip(zip(*rows), schema.split(", "))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return chunks.mapInArrow(run, schema)


def farthest_chunks(chunks: DataFrame, centers: dict[tuple, np.ndarray]) -> DataFrame:
    """(dataset, entry_id, near, chunk_id, vec): of each entry the chunk farthest from its centers,
    ties to the lower chunk."""

    def fold(state, ids, x, c):
        near = _distances(x, c).min(axis=1)
        far = near.max()
        i = np.flatnonzero(near == far)[ids[near == far].argmin()]
        best = (float(far), int(ids[i]), x[i].tolist())
        return [max([best, *(state or [])], key=lambda r: (r[0], -r[1]))]

    found = _per_entry(chunks, centers, fold, "dataset string, entry_id string, near double, chunk_id int, vec array<double>")
    return found.groupBy(*IDS).agg(F.max_by(F.struct("near", "chunk_id", "vec"), F.struct("near", -F.col("chunk_id"))).alias("r")).select(*IDS, "r.*")


def lloyd_round(chunks: DataFrame, centers: dict[tuple, np.ndarray]) -> DataFrame:
    """(dataset, entry_id, cluster_id, n, total, first, mark): of each cluster, after every chunk went to
    its nearest center (ties to the lower one), the number and sum of its vectors, its first chunk, and
    a checksum of the chunks in it. A task adds up its own rows first."""

    def fold(state, ids, x, c):
        state = state or [[j, 0, np.zeros(x.shape[1]), None, 0] for j in range(len(c))]
        labels = _distances(x, c).argmin(axis=1)
        for j in np.unique(labels).tolist():
            mine = ids[labels == j].astype(np.int64)
            row = state[j]
            row[1] += len(mine)
            row[2] = row[2] + x[labels == j].sum(axis=0)
            row[3] = int(mine.min()) if row[3] is None else min(row[3], int(mine.min()))
            row[4] += int((((mine + 1) * 0x9E3779B1) % 0x7FFFFFFF).sum())
        return state

    schema = "dataset string, entry_id string, cluster_id int, n long, total array<double>, first int, mark long"
    parts = _per_entry(chunks, centers, fold, schema)
    sums = parts.groupBy(*IDS, "cluster_id").agg(
        F.sum("n").alias("n"), F.collect_list("total").alias("_totals"), F.min("first").alias("first"), F.sum("mark").alias("mark"))  # a row a task
    add = F.aggregate("_totals", F.transform(F.col("_totals")[0], lambda _: F.lit(0.0)), lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return sums.select(*IDS, "cluster_id", "n", add.alias("total"), "first", "mark")


def spread_kmeans(chunks: DataFrame, num_clusters: int = 5) -> DataFrame:
    """``kmeans_labels`` of entries of any size: Lloyd's rounds over all tasks. Every round is one map
    over the written vectors with the centers broadcast and a few rows an entry and task out; the
    farthest-first start takes ``num_clusters`` such rounds. Entries go in groups whose centers fit
    ``MAX_CENTER_VALUES``, so neither the broadcast nor the driver grows with the data."""
    chunks = saved(chunks.select(*IDS, "chunk_id", "vec"), "chunk-vectors")
    spark = chunks.sparkSession
    firsts = chunks.groupBy(*IDS).agg(F.min_by("vec", "chunk_id").alias("vec"), F.count(F.lit(1)).alias("n"))
    out, group, values = [], {}, 0
    for r in firsts.toLocalIterator():
        size = num_clusters * len(r["vec"])
        if group and values + size > MAX_CENTER_VALUES:
            out.append(_spread_group(chunks, group, num_clusters))
            group, values = {}, 0
        group[r["dataset"], r["entry_id"]] = (np.array([r["vec"]], float), r["n"])
        values += size
    if group:
        out.append(_spread_group(chunks, group, num_clusters))
    done = spark.createDataFrame([], _LABELS)
    for labels in out:
        done = done.unionByName(labels)
    return done


def _spread_group(chunks: DataFrame, first: dict[tuple, tuple[np.ndarray, int]], num_clusters: int) -> DataFrame:
    centers = {key: c for key, (c, _) in first.items()}
    growing = {key: c for key, c in centers.items() if min(num_clusters, first[key][1]) > 1}
    while growing:
        for r in farthest_chunks(chunks, growing).collect():  # a row an entry of the group
            key = r["dataset"], r["entry_id"]
            if r["near"] > 1e-9:
                centers[key] = growing[key] = np.vstack([growing[key], r["vec"]])
            if r["near"] <= 1e-9 or len(growing[key]) >= min(num_clusters, first[key][1]):
                growing.pop(key)
    moving, seen, order = dict(centers), {key: set() for key in centers}, {}
    while moving:
        rounds: dict[tuple, list] = {}
        for r in lloyd_round(chunks, moving).collect():  # a row a center of the group
            rounds.setdefault((r["dataset"], r["entry_id"]), []).append(r)
        for key, rows in rounds.items():
            rows.sort(key=lambda r: r["cluster_id"])
            mark = tuple((r["n"], r["first"], r["mark"]) for r in rows)
            if mark in seen[key]:  # unchanged, or a circle of equally good labels
                order[key] = [r["cluster_id"] for r in sorted((r for r in rows if r["n"]), key=lambda r: r["first"])]
                moving.pop(key)
                continue
            seen[key].add(mark)
            moving[key] = centers[key] = np.array([np.array(r["total"]) / r["n"] if r["n"] else centers[key][r["cluster_id"]] for r in rows])
    shared = chunks.sparkSession.sparkContext.broadcast((centers, order))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, order = shared.value
        for key, ids, x in _by_entry(batches):
            if key in centers:
                number = np.zeros(len(centers[key]), np.int64)
                number[order[key]] = np.arange(len(order[key]))
                labels = number[_distances(x, centers[key]).argmin(axis=1)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), pa.array(ids, pa.int32()), pa.array(labels, pa.int32())], names=[*IDS, "chunk_id", "cluster_id"])

    return saved(chunks.mapInArrow(label, _LABELS), "cluster-labels")


def cluster_summaries(chunks: DataFrame, labels: DataFrame, keys=IDS) -> DataFrame:
    """Texts of a cluster joined by a space in chunk order: (keys..., cluster_id, summary)."""
    j = chunks.join(labels, [*keys, "chunk_id"])
    g = j.groupBy(*keys, "cluster_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("_c"))
    return g.select(*keys, "cluster_id", F.array_join(F.transform("_c", lambda x: x["text"]), " ").alias("summary"))


# ---- GraphRAG: similarity graph and refinement ---------------------------------------

def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    den = np.sqrt(np.outer((x * x).sum(axis=1), (y * y).sum(axis=1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den > 0, x @ y.T / den, 0.0)


def _block_pairs(chunks: DataFrame, block: int) -> DataFrame:
    """Chunk rows dealt to the pairs of blocks (i <= j) of their entry, ``block`` chunk ids a block; a row
    goes to every pair its block is in. Most entries are one block, whose rows are not copied."""
    chunks = chunks.select(*IDS, "chunk_id", "vec").withColumn("_own", F.floor(F.col("chunk_id") / block).cast("int"))
    last = chunks.groupBy(*IDS).agg(F.max("_own").alias("_last"))
    rows = match(chunks, last, IDS)
    pair = lambda b: F.struct(F.least("_own", b).alias("i"), F.greatest("_own", b).alias("j"))
    return rows.withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0), F.col("_last")), pair))).select(*IDS, "chunk_id", "vec", "_own", "_at.i", "_at.j")


def _pair_rows(table: pa.Table) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(entry, ids and vectors of block i, of block j, whether they are one block)."""
    table = table.sort_by("chunk_id")
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    own, ids = table.column("_own").to_numpy(), table.column("chunk_id").to_numpy()
    x = _matrix(table.column("vec").combine_chunks())
    key = tuple(table.column(c)[0].as_py() for c in IDS)
    return key, ids[own == i], x[own == i], ids[own == j], x[own == j], i == j


def similarity_graph(chunks: DataFrame, threshold: float = 0.5, block: int = GRAPH_BLOCK) -> DataFrame:
    """Edges (dataset, entry_id, src, dst, weight) in both directions for chunk pairs of one entry
    with cosine > threshold. A task compares two blocks of an entry, never a whole large entry; only
    edges leave it."""

    def run(table: pa.Table) -> pa.Table:
        key, a_ids, a, b_ids, b, same = _pair_rows(table)
        sim = _cosines(a, b)
        if same:
            np.fill_diagonal(sim, -2.0)
        i, j = np.nonzero(sim > threshold)
        src, dst, weight = a_ids[i], b_ids[j], sim[i, j]
        if not same:
            src, dst, weight = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
        keys = [pa.array([k] * len(src), pa.string()) for k in key]
        return pa.table([*keys, pa.array(src, pa.int32()), pa.array(dst, pa.int32()), pa.array(weight)], names=[*IDS, "src", "dst", "weight"])

    return _block_pairs(chunks, block).groupBy(*IDS, "i", "j").applyInArrow(run, "dataset string, entry_id string, src int, dst int, weight double")


def strongest_neighbours(chunks: DataFrame, threshold: float = 0.5, block: int = GRAPH_BLOCK) -> DataFrame:
    """(dataset, entry_id, chunk_id, neighbour, weight): each chunk's strongest neighbour in the graph
    (ties to the lower chunk; chunks without one are left out). A pair of blocks sends one row a
    chunk; their maxima are combined."""

    def best(ids: np.ndarray, other: np.ndarray, sim: np.ndarray) -> list[tuple]:
        at = sim.argmax(axis=1) if sim.shape[1] else np.zeros(len(ids), np.int64)  # other ids ascend
        top = sim[np.arange(len(ids)), at] if sim.shape[1] else np.full(len(ids), -2.0)
        keep = top > threshold
        return list(zip(ids[keep].tolist(), other[at[keep]].tolist(), top[keep].tolist())) if keep.any() else []

    def run(table: pa.Table) -> pa.Table:
        key, a_ids, a, b_ids, b, same = _pair_rows(table)
        sim = _cosines(a, b)
        if same:
            np.fill_diagonal(sim, -2.0)
        rows = best(a_ids, b_ids, sim) + ([] if same else best(b_ids, a_ids, sim.T))
        keys = [pa.array([k] * len(rows), pa.string()) for k in key]
        kinds = [pa.int32(), pa.int32(), pa.float64()]
        return pa.table([*keys, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=[*IDS, "chunk_id", "neighbour", "weight"])

    found = _block_pairs(chunks, block).groupBy(*IDS, "i", "j").applyInArrow(run, "dataset string, entry_id string, chunk_id int, neighbour int, weight double")
    top = found.groupBy(*IDS, "chunk_id").agg(F.max_by(F.struct("neighbour", "weight"), F.struct("weight", -F.col("neighbour"))).alias("r"))
    return top.select(*IDS, "chunk_id", "r.*")


_REFINED = "dataset string, entry_id string, rank int, refined_id int, refined_text string"


def refine_with_neighbours(top: DataFrame, chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each top node is replaced by its strongest graph neighbour (cosine > threshold,
    ties -> lowest index), or kept when isolated. Top nodes and chunks of an entry meet in one sorted
    stream, the nodes first: a task holds the k nodes of an entry and a batch of chunks, and makes
    no rows of pairs."""
    top = saved(top, "top-nodes")
    columns = lambda df, rank, text: df.select(*IDS, rank.cast("int").alias("rank"), F.col("chunk_id").cast("int"), "vec", text.alias("text"))
    keyed = chunks.where(F.col("dataset").isNotNull() & F.col("entry_id").isNotNull())
    rows = columns(top, F.col("rank"), F.lit(None).cast("string")).unionByName(columns(keyed, F.lit(None), F.col("text")))
    rows = rows.repartition(*IDS).sortWithinPartitions(*IDS, F.col("rank").asc_nulls_last(), "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            found: list[tuple] = []
            keys, texts = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), b.column("text")
            ranks, ids, x = b.column("rank").to_pylist(), b.column("chunk_id").to_numpy(), rows_of(b.column("vec"))[0].T
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for at, end in zip(starts, [*starts[1:], len(keys)]):
                if now is None or keys[at] != now.key:
                    found += now.refined() if now else []
                    now = _Nodes(keys[at])
                nodes = at
                while nodes < end and ranks[nodes] is not None:
                    nodes += 1
                now.add(ranks[at:nodes], ids[at:nodes], x[at:nodes])
                now.meet(ids[nodes:end], x[nodes:end], texts, nodes)
            if found:
                yield _refined_batch(found)
        if now is not None:
            yield _refined_batch(now.refined())

    class _Nodes:
        """The top nodes of one entry and the best neighbour of each so far."""

        def __init__(self, key: tuple):
            self.key, self.ranks, self.ids, self.x, self.best = key, [], [], None, []

        def add(self, ranks, ids, x) -> None:
            if len(ranks):
                self.ranks += ranks
                self.ids += ids.tolist()
                self.x = x if self.x is None else np.vstack([self.x, x])
                self.best += [(threshold, None, None)] * len(ranks)

        def meet(self, ids, x, texts, at) -> None:
            if not self.ranks or not len(ids):
                return
            sim = _cosines(self.x, x)
            sim[np.array(self.ids)[:, None] == ids[None, :]] = -2.0
            for r, j in enumerate(sim.argmax(axis=1).tolist()):
                if sim[r, j] > self.best[r][0]:
                    self.best[r] = (sim[r, j], int(ids[j]), texts[at + j].as_py())

        def refined(self) -> list[tuple]:
            return [(*self.key, rank, b[1], b[2]) for rank, b in zip(self.ranks, self.best) if b[1] is not None]

    def _refined_batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _REFINED.split(", ")])

    best = rows.mapInArrow(run, _REFINED)
    out = top.join(best, [*IDS, "rank"], "left")
    return out.withColumn("refined_id", F.coalesce("refined_id", "chunk_id")).withColumn("refined_text", F.coalesce("refined_text", "text"))


# ---- prompts and generation -------------------------------------------------------------

def rag_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), F.coalesce(question, F.lit("")), F.lit(PROMPT_MID), F.coalesce(context, F.lit("")))


def excerpts_prompt(df: DataFrame, excerpts: DataFrame, text_col: str, keys=IDS) -> DataFrame:
    """Join excerpts (keys..., rank, text) in rank order into the prompt of each row."""
    agg = excerpts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(text_col).alias("t")))).alias("_ex"))
    j = df.join(agg, list(keys), "left")
    joined = F.array_join(F.transform(F.coalesce(F.col("_ex"), F.array()), lambda x: x["t"]), EXCERPT_SEP)
    return j.withColumn("prompt", rag_prompt(F.col("Question"), joined)).withColumn(
        "RetrievedExcerpts", F.transform(F.coalesce(F.col("_ex"), F.array()), lambda x: x["t"])
    ).drop("_ex")


GenerateFn = Callable[[list[str]], list[str]]


def extractive_generator() -> GenerateFn:
    """Default deterministic answerer: the first sentence of the first excerpt (no model)."""

    def gen(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            body = p.split(PROMPT_MID, 1)[1] if PROMPT_MID in p else ""
            first = body.split(EXCERPT_SEP, 1)[0]
            end = min([i for i in (first.find(". "), first.find("\n")) if i >= 0], default=len(first))
            out.append(first[: end + 1].strip() if end < len(first) else first.strip())
        return out

    return gen


GENERATORS: dict[str, Callable[[], GenerateFn]] = {"extractive": extractive_generator}


def register_generator(name: str, factory: Callable[[], GenerateFn]) -> None:
    """Make ``factory() -> generate(list of prompts)`` usable by name."""
    GENERATORS[name] = factory


def answers_for(gen: GenerateFn, prompts: list[str]) -> tuple[list, list]:
    """(answers, errors). A batch that fails or answers the wrong number of prompts is halved until
    the prompts that fail stand alone; only those have no answer."""
    try:
        got = list(gen(prompts))
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        return got, [None] * len(got)
    except Exception as e:  # noqa: BLE001
        if len(prompts) == 1:
            return [None], [repr(e)]
        half = len(prompts) // 2
        left, right = answers_for(gen, prompts[:half]), answers_for(gen, prompts[half:])
        return left[0] + right[0], left[1] + right[1]


def generate(df: DataFrame, prompt_col: str = "prompt", factory: Callable[[], GenerateFn] | str | None = None,
             out_col: str = "Predicted", batch: int = 256) -> DataFrame:
    """One answer per prompt: the generator is built once per task and fed ``batch`` prompts at a
    time. A NULL prompt is not sent and gets ''. A failing prompt yields NULL and the error text."""
    build = GENERATORS[factory] if isinstance(factory, str) else factory or extractive_generator
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (out_col, "GenerationError")]

    @F.arrow_udf(T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]))
    def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gen = build()
        for b in batches:
            ans, err = [""] * len(b), [None] * len(b)
            ask = [i for i, there in enumerate(b.is_valid().to_pylist()) if there]
            for at in range(0, len(ask), batch):
                part = ask[at : at + batch]
                for i, a, e in zip(part, *answers_for(gen, b.take(pa.array(part)).to_pylist())):
                    ans[i], err[i] = a, e
            yield pa.StructArray.from_arrays([pa.array(ans, pa.string()), pa.array(err, pa.string())], names=["answer", "error"])

    answered = df.select(*rest, answers.asNondeterministic()(F.col(prompt_col)).alias("__generated"))  # a prompt is sent once
    return answered.select(*rest, F.col("__generated.answer").alias(out_col), F.col("__generated.error").alias("GenerationError"))


# ---- techniques ------------------------------------------------------------------------

def _pieces(text: str | None, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text or ""), size)]


def _best(query: np.ndarray, vecs: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows most similar to the query, ties to the lower index."""
    return np.argsort(-_cosines(query[None, :], vecs)[0], kind="stable")[:k]


def _raptor_row(encode, question, context, chunk_size, num_clusters, top_k) -> list[str]:
    texts = _pieces(context, chunk_size)
    labels = kmeans_labels(np.stack(encode(texts)).astype(float), num_clusters)
    summaries = [" ".join(t for t, j in zip(texts, labels) if j == c) for c in range(labels.max() + 1)]
    vecs = np.stack(encode([question or "", *summaries])).astype(float)
    return [summaries[i] for i in _best(vecs[0], vecs[1:], top_k)]


def _graphrag_row(encode, question, context, chunk_size, top_k, edge_threshold) -> list[str]:
    texts = _pieces(context, chunk_size)
    vecs = np.stack(encode([question or "", *texts])).astype(float)
    chunks = vecs[1:]
    out = []
    for i in _best(vecs[0], chunks, top_k):
        sim = _cosines(chunks[i : i + 1], chunks)[0]
        sim[i] = -1.0
        j = int(sim.argmax())
        out.append(texts[j] if sim[j] > edge_threshold else texts[i])
    return out


#: Rows whose texts are Python strings at a time.
ROWS_AT_ONCE = 256


def _excerpts_by_row(df: DataFrame, embedder, row_fn, **params) -> DataFrame:
    """``df`` with ``RetrievedExcerpts``, computed where the row is; no excerpts without context. Python
    sees the two columns it reads, ``ROWS_AT_ONCE`` rows at a time."""
    factory = as_embedder(embedder).factory

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def excerpts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encode = factory()
        for questions, contexts in batches:
            parts = [pa.array([], pa.list_(pa.string()))]
            for at in range(0, len(questions), ROWS_AT_ONCE):
                rows = zip(*(c.slice(at, ROWS_AT_ONCE).to_pylist() for c in (questions, contexts)))
                parts.append(pa.array([row_fn(encode, q, c, **params) if c else [] for q, c in rows], pa.list_(pa.string())))
            yield pa.concat_arrays(parts)

    return df.drop("RetrievedExcerpts").withColumn("RetrievedExcerpts", excerpts(F.col("Question"), F.col("Context")))


def raptor_excerpts(df: DataFrame, chunk_size=100, num_clusters=5, top_k=3, embedder=None) -> DataFrame:
    """(dataset, entry_id, rank, cluster_id, text): RAPTOR from the operators above."""
    ch = embed(chunk(df, "Context", chunk_size), "text", "vec", embedder)
    summ = embed(cluster_summaries(ch, kmeans_per_entry(ch, num_clusters)), "summary", "vec", embedder)
    q = embed(df.select(*IDS, "Question"), "Question", "qvec", embedder).select(*IDS, "qvec")
    top = top_k_by_similarity(summ.join(q, list(IDS)), F.col("qvec"), F.col("vec"), top_k, tie=("cluster_id",))
    return top.select(*IDS, "rank", "cluster_id", F.col("summary").alias("text"))


def graphrag_excerpts(df: DataFrame, chunk_size=100, top_k=3, edge_threshold=0.5, embedder=None) -> DataFrame:
    """(dataset, entry_id, rank, chunk_id, refined_id, text): GraphRAG from the operators above."""
    ch = saved(embed(chunk(df, "Context", chunk_size), "text", "vec", embedder), "chunk-vectors")  # read twice
    q = embed(df.select(*IDS, "Question"), "Question", "qvec", embedder).select(*IDS, "qvec")
    top = top_k_by_similarity(ch.join(q, list(IDS)), F.col("qvec"), F.col("vec"), top_k)
    ref = refine_with_neighbours(top, ch, edge_threshold)
    return ref.select(*IDS, "rank", "chunk_id", "refined_id", F.col("refined_text").alias("text"))


def _answered(df: DataFrame, generator, excerpts_as_contexts: bool) -> DataFrame:
    """Prompt and answer from RetrievedExcerpts; entries without context are not sent."""
    body = F.array_join("RetrievedExcerpts", EXCERPT_SEP)
    has_text = F.length(F.coalesce(F.col("Context"), F.lit(""))) > 0
    if excerpts_as_contexts:
        df = df.withColumn("RetrievedContexts", F.col("RetrievedExcerpts"))
    return generate(df.withColumn("prompt", F.when(has_text, rag_prompt(F.col("Question"), body))), factory=generator)


def _technique(df, embedder, generator, excerpts_as_contexts, row_fn, composed, **params) -> DataFrame:
    if hasattr(as_embedder(embedder), "factory"):
        found = _excerpts_by_row(df, embedder, row_fn, **params)
    else:
        found = excerpts_prompt(df, composed(df, embedder=embedder, **params), "text").drop("prompt")
    return _answered(found, generator, excerpts_as_contexts)


def run_rag(df: DataFrame, generator=None, **_ignored) -> DataFrame:
    return generate(df.withColumn("prompt", rag_prompt(F.col("Question"), F.col("Context"))), factory=generator)


def run_raptor(df: DataFrame, chunk_size=100, num_clusters=5, top_k=3, embedder=None, generator=None, excerpts_as_contexts=False) -> DataFrame:
    return _technique(df, embedder, generator, excerpts_as_contexts, _raptor_row, raptor_excerpts, chunk_size=chunk_size, num_clusters=num_clusters, top_k=top_k)


def run_graphrag(df: DataFrame, chunk_size=100, top_k=3, edge_threshold=0.5, embedder=None, generator=None, excerpts_as_contexts=False) -> DataFrame:
    return _technique(df, embedder, generator, excerpts_as_contexts, _graphrag_row, graphrag_excerpts, chunk_size=chunk_size, top_k=top_k, edge_threshold=edge_threshold)


TECHNIQUES = {"rag": run_rag, "raptor": run_raptor, "graphrag": run_graphrag}


def register_technique(name: str, run, defaults: dict | None = None) -> None:
    """Add ``run(df, generator=..., **params)`` as a retrieval technique."""
    TECHNIQUES[name], TECHNIQUE_DEFAULTS[name] = run, dict(defaults or {})


def run_retrieval(df: DataFrame, technique: str = "rag", **params) -> DataFrame:
    run = TECHNIQUES.get(technique)
    if run is None:
        raise ValueError(f"no retrieval technique is called {technique!r}; there are {', '.join(sorted(TECHNIQUES))}")
    return run(df, **(TECHNIQUE_DEFAULTS[technique] | {k: v for k, v in params.items() if v is not None}))


def missing_predictions(df: DataFrame) -> DataFrame:
    """Rows without a prediction per dataset (NULL = absent)."""
    pred = F.col("Predicted") if "Predicted" in df.columns else F.lit(None)
    return df.groupBy("dataset").agg(F.count_if(pred.isNull()).alias("missing_predicted"), F.count(F.lit(1)).alias("n"))
