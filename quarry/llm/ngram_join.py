"""N-gram Jaccard join with multiple-global-order prefix filtering.

A document's set holds the hashes of its distinct ``k``-word shingles. Two sets with Jaccard
similarity of at least t share a token among the first ``n - ceil(t n) + 1`` tokens of each under
ANY one global order, so a candidate pair must share prefix tokens under every order used. The
orders sort tokens by document frequency (rare first) and break ties by different hashes; one
more coarsens the frequency to its power of two, which mixes tokens that the others keep apart.

Frequencies are exact (see repeats.py) and cost one pass over shingle hashes. Tokens that occur
in one document only come first and match nothing, so a document with as many of them as its
prefix is long has no partner and is done. The others (copies, near copies, documents made of
shared passages) go on with their prefixes and sets:

* Equal sets are one node (class); only its prefix and set go further.
* Where a token joins few nodes, their pairs are listed, must share a token under every order, pass
  the size filter, and are compared.
* Where it joins many, listing pairs would grow with the square of the group: the nodes that such
  tokens connect form a cluster, classed by set size (sets of classes that are not neighbours cannot
  be alike enough) and cut into blocks, and two blocks are compared in one task by a matrix
  product over their shared tokens. Only each node's number of links and the links of a
  spanning forest leave the task. Pairs inside a cluster are not listed again, so every pair is
  compared once, and no link between different texts is lost.

Components come from repeated contraction to the least neighbour. Nothing is collected.

Words are runs of bytes other than 0x20, 0x09-0x0D, with A-Z lowered. Fewer than k words make one
shingle of the whole sequence; null, empty and blank texts have an empty set and no links. In
``similarity_components`` rows without doc_id have a null component and link with nothing, as there is
no id to name them by; ``one_of_each_group`` links them like all others. Rows that repeat a doc_id
are documents of their own with the same id. Other columns are ignored; an empty table gives no
rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, only, saved, sized_broadcast, text_or_empty, unused
from quarry.llm.repeats import Totals, chunks_of, with_repeats

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SETS = "doc_id long, n long, alone boolean, text_id string, node binary, p1 array<long>, p2 array<long>, p3 array<long>, shingles binary"


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the k-word shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    m = len(h) - k + 1
    s = np.zeros(m, np.uint64)
    for j in range(k):
        s = (s ^ h[j : j + m]) * _M1
        s ^= s >> np.uint64(32)
    return np.unique(s)


def least_overlap(n: int, percent: int) -> int:
    """ceil(percent n / 100)."""
    return -(-percent * n // 100)


def prefixes(s: np.ndarray, df: np.ndarray, percent: int) -> list[np.ndarray] | None:
    """The tokens of each order's prefix that occur elsewhere, or None if there are none."""
    room = len(s) - least_overlap(len(s), percent) + 1 - int(np.count_nonzero(df == 1))
    if room <= 0:
        return None
    t, f = s[df > 1], df[df > 1]
    coarse = np.floor(np.log2(f.astype(np.float64)))
    return [t[np.lexsort((mix64(t, 1), f))[:room]], t[np.lexsort((mix64(t, 2), f))[:room]], t[np.lexsort((mix64(t, 3), coarse))[:room]]]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a and b| >= percent |a or b| of two ascending sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b)) if len(a) < 64 else _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


def document_sets(docs: DataFrame, k: int, percent: int, unnamed: bool = False) -> DataFrame:
    """A row a document: n, and for those that may have partners node, prefixes and set. ``unnamed``:
    documents without doc_id may have partners too. ``alone`` says that the row has a doc_id that no
    other row has; ``text_id`` (md5 of the text) tells rows apart that are not alone."""

    def sets(table: pa.Table) -> list[np.ndarray]:
        return [shingle_set(t, k) for t in table.column("text").to_pylist()]

    def keys(table: pa.Table) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *sets(table)])

    def use(table: pa.Table, totals: Totals) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _SETS.split(", ")}
        ids, subs, texts = (table.column(c).to_pylist() for c in ("doc_id", "sub", "text"))
        rows_of = Counter(ids)  # rows of one id are in one chunk, or numbered by sub
        for doc_id, sub, text, s in zip(ids, subs, texts, sets(table)):
            p = prefixes(s, totals.of(s), percent) if len(s) and (unnamed or doc_id is not None) else None
            alone = doc_id is not None and sub is None and rows_of[doc_id] == 1
            out["doc_id"].append(doc_id)
            out["n"].append(len(s))
            out["alone"].append(alone)
            out["text_id"].append(None if alone or not p else hashlib.md5(text.encode()).hexdigest())
            out["node"].append(xxhash.xxh3_128_digest(s.tobytes()) if p else None)
            for i, name in enumerate(("p1", "p2", "p3")):
                out[name].append(p[i].view(np.int64) if p else None)
            out["shingles"].append(s.astype("<u8").tobytes() if p else None)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    rows, n, bits, _ = chunks_of(only(docs, "doc_id", "text"))
    return saved(with_repeats(rows.drop("row"), n, bits, keys, use, _SETS), "ngram-sets")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """|x and y| of every x in a and y in b: a product of 0/1 matrices over the tokens that several
    sets have, a few thousand columns at a time."""
    every = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    _, col, n = np.unique(every, return_inverse=True, return_counts=True)
    shared = n[col] > 1
    number = np.cumsum(n > 1) - 1
    row, col = row[shared], number[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        i, j = np.searchsorted(col, (at, at + columns))
        m = np.zeros((len(a) + len(b), columns), np.float32)
        m[row[i:j], col[i:j] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def block_links(table: pa.Table, percent: int, apart: bool) -> pa.Table:
    """Links among the rows (node, copies, side, shingles) of a block, or only between its two
    sides: rows (a, b, NULL) of a spanning forest, and (a, NULL, n) with n the documents that node a
    links to."""
    node, copies = table.column("node").to_pylist(), table.column("copies").to_numpy()
    side = np.array(table.column("side").to_pylist())
    sets = [np.frombuffer(x, dtype="<u8") for x in table.column("shingles").to_pylist()]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if apart else (np.arange(len(node)),) * 2
    a, b, n = [], [], []
    if len(left) and len(right):
        size = np.array([len(s) for s in sets])
        both = overlaps([sets[i] for i in left], [sets[j] for j in right])
        linked = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
        if not apart:
            np.fill_diagonal(linked, False)
        counts = np.zeros(len(node), np.int64)
        counts[left] += linked @ copies[right]
        if apart:
            counts[right] += linked.T @ copies[left]
        root = list(range(len(node)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(linked)):
            x, y = top(left[i]), top(right[j])
            if x != y:
                root[x] = y
                a.append(node[left[i]]), b.append(node[right[j]]), n.append(None)
        for i in np.flatnonzero(counts):
            a.append(node[i]), b.append(None), n.append(int(counts[i]))
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def all_links(nodes: DataFrame, percent: int, listed: int, block: int) -> DataFrame:
    """(a, b, n): links that connect all components (n NULL), and numbers of links (b NULL), as in
    ``block_links``. A token that joins at most ``listed`` nodes has its pairs listed."""
    postings = nodes.select(F.explode("p1").alias("token"), "node", "n", "copies")
    tokens = postings.groupBy("token").agg(F.count("*").alias("joined"), F.min("node").alias("least")).where("joined > 1")
    postings = saved(postings.join(tokens, "token"), "postings")
    often = postings.where(F.col("joined") > listed)
    clusters = components(often.select(F.col("least").alias("a"), F.col("node").alias("b"))).withColumnRenamed("label", "cluster")
    return _listed_links(nodes, postings.where(F.col("joined") <= listed), clusters, percent).unionByName(_cluster_links(nodes, clusters, percent, block))


def _listed_links(nodes: DataFrame, postings: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    rows = postings.join(clusters, "node", "left")
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in ("token", "node", "n", "copies", "cluster")]) for s in "ab")
    near = (F.col("token_a") == F.col("token_b")) & (F.col("node_a") < F.col("node_b")) & ~F.col("cluster_a").eqNullSafe(F.coalesce("cluster_b", F.lit(b"")))
    near &= (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    pairs = a.join(b, near).select("node_a", "node_b", "copies_a", "copies_b").distinct()
    sets = nodes.select("node", "p2", "p3", "shingles")
    for s in "ab":
        pairs = pairs.join(sets.select(*[F.col(c).alias(f"{c}_{s}") for c in sets.columns]), f"node_{s}")
    shared = pairs.where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))

    def verify(batches):
        for t in batches:
            keep = [linked(np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8"), percent) for x, y in zip(t.column(4), t.column(5))]
            t = t.filter(pa.array(keep, pa.bool_()))
            a, b, n_a, n_b = (t.column(i).to_pylist() for i in range(4))
            none = [None] * len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a + a + b, pa.binary()), pa.array(b + none + none, pa.binary()), pa.array(none + n_b + n_a, pa.int64())], names=["a", "b", "n"])

    columns = ("node_a", "node_b", "copies_a", "copies_b", "shingles_a", "shingles_b")
    return shared.select(*columns).mapInArrow(verify, "a binary, b binary, n long")


def _cluster_links(nodes: DataFrame, clusters: DataFrame, percent: int, block: int) -> DataFrame:
    """Links inside clusters. Sets of a cluster are classed by size so that only sets of one class or of
    neighbouring classes can reach the similarity; a class is cut into blocks by a hash, and a
    task compares two blocks."""
    classed = clusters.join(nodes.select("node", "n", "copies", "shingles"), "node")
    # sizes of classes two apart differ by more than the threshold allows, whatever the rounding
    size_class = F.floor(F.log("n") / F.lit(-math.log(percent / 100) * (1 + 1e-9))).cast("long") if percent < 100 else F.col("n")
    classed = saved(classed.withColumn("class", size_class), "classed")
    sizes = classed.groupBy("cluster", "class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = sized_broadcast(saved(sizes, "classes"), 500_000)
    here = sizes
    above = sizes.select("cluster", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    below = sizes.select("cluster", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    at = classed.join(here, ["cluster", "class"]).join(sized_broadcast(above, 500_000), ["cluster", "class"], "left").join(sized_broadcast(below, 500_000), ["cluster", "class"], "left")
    at = at.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def blocks(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def place(low: Column, up: Column, i: Column, j: Column, side: Column) -> Column:
        return F.struct(low.alias("low"), up.alias("up"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    own, c = F.col("own"), F.col("class")
    same = F.transform(blocks("blocks"), lambda j: place(c, c, F.least(own, j), F.greatest(own, j), own > j))
    with_above = F.transform(blocks("above"), lambda j: place(c, c + 1, own, j, F.lit(0)))
    with_below = F.transform(blocks("below"), lambda j: place(c - 1, c, j, own, F.lit(1)))
    every = same if percent >= 100 else F.concat(same, with_above, with_below)
    rows = at.withColumn("at", F.explode(every)).select("node", "copies", "shingles", "cluster", "at.*")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        _, low, up, i, j = (x.as_py() for x in key)
        return block_links(table, percent, (low, i) != (up, j))

    return rows.groupBy("cluster", "low", "up", "i", "j").applyInArrow(compare, "a binary, b binary, n long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of the links (a, b). Each round points
    every node to its least neighbour, jumps once, and contracts; rounds stop when no link is
    left between different labels."""
    links = saved(links.where("a <> b").distinct(), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        jump = to.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
        to = saved(to.join(jump, "to", "left").select("a", F.coalesce("beyond", "to").alias("to")), "least")
        labels = saved(labels.join(to.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a, b = to.select("a", F.col("to").alias("x")), to.select(F.col("a").alias("b"), F.col("to").alias("y"))
        links = saved(links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "links")
    return labels


def _joined(docs: DataFrame, k: int, percent: int, listed: int, block: int, unnamed: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets, nodes, links, labels): a node is a distinct set, its label the least node of its
    component (nodes without links have no label)."""
    sets = document_sets(docs, k, percent, unnamed)
    one = F.min(F.struct("doc_id", "n", "p1", "p2", "p3", "shingles")).alias("r")
    nodes = saved(sets.where("node IS NOT NULL").groupBy("node").agg(one, F.count("*").alias("copies")).select("node", "copies", "r.*"), "nodes")
    found = saved(all_links(nodes, percent, listed, block), "links")
    return sets, nodes, found, components(found.where("b IS NOT NULL").select("a", "b"))


def similarity_components(docs: DataFrame, k: int, percent: int, listed: int = 48, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents it links to)."""
    sets, nodes, found, labels = _joined(docs, k, percent, listed, block, False)
    members = sets.where("node IS NOT NULL")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    by_label = nodes.select("node", "doc_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = by_label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    n_links = (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    component = by_label.join(least, "label").join(counts, "node", "left").select("node", "component_id", n_links)
    alone = F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).alias("component_id")
    done = members.select("doc_id", F.col("n").alias("n_shingles"), "node").join(component, "node").drop("node")
    return sets.where("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), alone, F.lit(0).cast("long").alias("n_links")).unionByName(done)


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, listed: int = 48, block: int = 512) -> DataFrame:
    """The rows of ``docs`` without those whose component (rows without doc_id take part) has an earlier
    one: the least doc_id stays, rows without one come last, then by the md5 of the text; of rows that
    repeat id and text one stays. Rows without words stay. Keeps the columns of ``docs``."""
    sets, _, _, labels = _joined(docs, k, percent, listed, block, True)
    rank = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.coalesce("text_id", F.lit("")).alias("text_id")).alias("rank")
    members = sets.where("node IS NOT NULL").select("node", "doc_id", "alone", "text_id", rank)
    members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node")
    stays = members.groupBy("label").agg(F.min("rank").alias("stays"))
    members = saved(members.join(stays, "label").select("doc_id", "alone", "text_id", (F.col("rank") == F.col("stays")).alias("stays")), "judged")
    id_name, text_name = unused(docs, "judged_id"), unused(docs, "judged_text")
    by_id = docs["doc_id"].cast("long").eqNullSafe(F.col(id_name))
    by_text = by_id & (F.md5(text_or_empty(docs["text"]).cast("binary")) == F.col(text_name))
    gone = saved(members.where("alone AND NOT stays").select(F.col("doc_id").alias(id_name)), "gone")
    kept = docs.join(sized_broadcast(gone, 2_000_000), by_id, "left_anti")
    others = members.where("NOT alone").groupBy(F.col("doc_id").alias(id_name), F.col("text_id").alias(text_name)).agg(F.first("stays").alias("stays"), F.count("*").alias("rows"))
    others = saved(others, "told-apart-by-text")
    if others.isEmpty():
        return kept
    keys = lambda which: sized_broadcast(others.where(which).select(id_name, text_name), 500_000)
    kept = kept.join(keys("NOT stays"), by_text, "left_anti")
    twice = keys("stays AND rows > 1")
    one = kept.join(twice, by_text, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, by_text, "left_anti").unionByName(one)
