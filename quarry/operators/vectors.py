"""Sparse vectors as long tables, corpus TF-IDF, sparse cosine, and the greedy k-center
(farthest-first) sampler.

TF-IDF vectors are postings ``(dataset, entry_id, term, w)``; the k-center reads every row's unit
vector as one sparse array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sampler_tokens
from ..session import saved
from .identity import COPY, match


def tfidf_postings(df: DataFrame, text: Column, part=("dataset",), ids=("entry_id",)) -> DataFrame:
    """Per-dataset corpus TF-IDF: tf = count/len, idf = ln((N+1)/(df+1)) + 1.
    Returns (part..., ids..., term, w). A dataset or id may be NULL.

    A term of many rows would be one hot join key, so its idf is joined by (term, salt) where its
    document frequency is above ``HOT_TERM_ROWS``: postings of such a term are dealt over as many salts
    as it fills, its one idf row is copied to each."""
    part, ids = list(part), list(ids)
    toks = df.select(*part, *ids, sampler_tokens(text).alias("_t"))
    ex = toks.select(*part, *ids, F.greatest(F.size("_t"), F.lit(1)).alias("_L"), F.explode("_t").alias("term"))
    tf = saved(ex.groupBy(*part, *ids, "term").agg(F.count(F.lit(1)).alias("_c"), F.first("_L").alias("_L")), "term-counts")  # read by what follows
    ndocs = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_N"))
    dfreq = tf.groupBy(*part, "term").agg(F.count(F.lit(1)).alias("_df"))
    idf = match(dfreq, ndocs, part).select(*part, "term", "_df", (F.log((F.col("_N") + 1.0) / (F.col("_df") + 1.0)) + 1.0).alias("_idf"))
    return match(*salted(tf, idf, "_df", [*part, "term"], ids), [*part, "term", "_salt"]).select(
        *part, *ids, "term", (F.col("_c") / F.col("_L") * F.col("_idf")).alias("w")
    )


#: Rows of a join key from which on it is dealt over several tasks.
HOT_TERM_ROWS = 100_000


def salted(rows: DataFrame, table: DataFrame, count: str, key: list[str], by: list[str], per: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``table`` (one row a key, with the ``count`` of the rows that have it) with a
    ``_salt`` to join on beside ``key``: 0, but for keys of more than ``per`` rows, whose rows are
    dealt by a hash of ``by`` and whose table row is copied to each salt. Hot keys are at most one in
    ``per`` rows; their list is broadcast if it is small, else joined."""
    per = per or HOT_TERM_ROWS
    salts = F.ceil(F.col(count) / per).cast("int")
    hot = saved(table.where(F.col(count) > per).select(*key, salts.alias("_salts")), "hot-keys")
    zero = F.lit(0).cast("int")
    if hot.isEmpty():
        return rows.withColumn("_salt", zero), table.withColumn("_salt", zero)
    few = hot.limit(MAX_HOT_KEYS + 1).count() <= MAX_HOT_KEYS
    rows = match(rows, F.broadcast(hot) if few else hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = F.when(F.col(count) > per, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(zero))
    return rows, table.withColumn("_salt", F.explode(copies))


#: Hot keys that a broadcast may hold.
MAX_HOT_KEYS = 200_000


def dense_postings(df: DataFrame, vec: Column, part=("dataset",)) -> DataFrame:
    part = list(part)
    return (
        df.select(*part, "entry_id", F.posexplode(vec.cast("array<double>")).alias("_i", "w"))
        .where(F.col("w") != 0)
        .select(*part, "entry_id", F.col("_i").cast("string").alias("term"), "w")
    )


def norms(postings: DataFrame, part=("dataset",), ids=("entry_id",)) -> DataFrame:
    return postings.groupBy(*part, *ids).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cosine_to(postings: DataFrame, nrm: DataFrame, center: DataFrame, part=("dataset",)) -> DataFrame:
    """Cosine of every vector with its group's center. ``center`` = (part..., term, wc, cnorm),
    one vector per group (small). Vectors sharing no term get no row (cosine 0)."""
    part = list(part)
    dots = (
        match(postings, center, [*part, "term"])
        .groupBy(*part, "entry_id", "cnorm")
        .agg(F.sum(F.col("w") * F.col("wc")).alias("_dot"))
    )
    return match(dots, nrm, [*part, "entry_id"]).select(
        *part, "entry_id",
        F.when((F.col("norm") == 0) | (F.col("cnorm") == 0), 0.0)
        .otherwise(F.col("_dot") / (F.col("norm") * F.col("cnorm"))).alias("cos"),
    )


def embedding_valid(vec: Column) -> Column:
    """A numeric list: non-null and every element non-null."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x))


#: Values of all chosen vectors that one broadcast may hold (32 MB of doubles).
MAX_CENTER_VALUES = 4_000_000
#: Distances equal to so many digits are ties, whatever the order of their sums.
DISTANCE_DIGITS = 12


def unit_rows(df: DataFrame, p: dict, seed, part) -> DataFrame:
    """(part..., entry_id, copy, u0, u1, note, idx, val): every row's unit vector, sparse and sorted by
    index. Embeddings are used when every row of a dataset has one (index = dimension), else the
    TF-IDF of the text (index = 64-bit hash of the term). Zero vectors keep no index."""
    from .fields import resolve
    from .sampling import field, row_u

    key = [*part, "entry_id", COPY]
    emb = resolve(df, p.get("embedding_field", "embedding")).numbers()
    rows = df.select(*key, emb.alias("_emb"), field(df, p.get("text_field", "question")).alias("_text"), row_u(seed, "shuffle").alias("u0"), row_u(seed, "first").alias("u1"))
    dense = saved(rows.groupBy(*part).agg(F.bool_and(F.coalesce(embedding_valid(F.col("_emb")), F.lit(False))).alias("_dense")), "kcenter-dense")
    rows = match(rows, dense, part)
    out = _dense_units(rows.where("_dense"), key)
    if not dense.where(~F.col("_dense")).isEmpty():
        out = out.unionByName(_tfidf_units(rows.where(~F.col("_dense")), part, key))
    return out


def _dense_units(rows: DataFrame, key: list[str]) -> DataFrame:
    from_dense = F.transform("_emb", lambda x, i: F.struct(i.cast("bigint").alias("i"), x.alias("v")))
    rows = rows.select(*key, "u0", "u1", F.lit("used provided embeddings").alias("note"), F.filter(from_dense, lambda x: x["v"] != 0).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
    # the norm is bound once a row, as an element: inside the inner lambda it would be summed again for
    # every value
    val = F.transform(F.array(norm), lambda n: F.transform("_v", lambda x: x["v"] / n))[0]
    return rows.select(*key, "u0", "u1", "note", F.col("_v.i").alias("idx"), val.alias("val"))


#: Terms whose idf a task looks up: 32 MB. Beyond, those of the fewest rows are joined.
MAX_IDF_TERMS = 2_000_000


def _tfidf_units(rows: DataFrame, part: list[str], key: list[str]) -> DataFrame:
    """Unit rows of ``tfidf_postings``, a row's terms kept together: they are counted in its row, and
    weighted there by the idf of the terms that most rows have. Only postings of the other terms are
    dealt by term, and what they weigh is brought back to their rows."""
    rows = rows.select(*key, "u0", "u1", F.lit("used TF-IDF fallback").alias("note"), sampler_tokens(F.col("_text")).alias("_t"))
    rows = rows.select(*key, "u0", "u1", "note", F.greatest(F.size("_t"), F.lit(1)).alias("_L"), _term_counts(F.col("_t")).alias("_c"))
    in_part = [x for c in part for x in (F.col(c), F.col(c).isNull())]  # the hash passes over a NULL
    hashes = F.transform("_c.term", lambda t: F.xxhash64(t))
    rows = saved(rows.select(*key, "u0", "u1", "note", "_L", hashes.alias("_i"), F.col("_c.n").alias("_n")), "term-counts")
    rows = rows.withColumn("_k", F.transform("_i", lambda i: F.xxhash64(*in_part, i)))
    n_rows = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_N"))
    dfreq = rows.select(*part, F.explode("_k").alias("_k")).groupBy(*part, "_k").agg(F.count(F.lit(1)).alias("_df"))
    idf = (F.log((F.col("_N") + 1.0) / (F.col("_df") + 1.0)) + 1.0).alias("_idf")
    table = saved(match(dfreq, n_rows, part).select("_k", "_df", idf), "idf")
    size = F.floor(F.log2("_df")).alias("size")
    least, held = None, 0
    for r in table.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect():  # a row a power of two
        held += r["n"]
        if held > MAX_IDF_TERMS:
            break
        least = r["size"]
    seen = table.where(size >= least) if least is not None else table.limit(0)
    seen = seen.select("_k", "_idf").toArrow()
    at = np.argsort(seen["_k"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((seen["_k"].to_numpy()[at], seen["_idf"].to_numpy()[at]))
    names = [*key, "u0", "u1", "note"]
    kept = [rows.schema[c] for c in names]
    more: list[Column] = []
    dealt = held > MAX_IDF_TERMS
    if dealt:
        lack = T.StructType([*[rows.schema[c] for c in key], T.StructField("_k", T.LongType())])

        def others(batches):
            for b in batches:
                k = b.column("_k")
                row, flat = _row_of(k), k.flatten()
                out = np.flatnonzero(np.isnan(_looked_up(*shared.value, flat.to_numpy())))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row[out])) for c in key), flat.take(pa.array(out))], names=lack.names)

        rare = rows.select(*key, "_k").mapInArrow(others, lack)
        rest = table if least is None else table.where(size < least)
        rare = match(rare, rest.select("_k", "_idf"), ["_k"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_k", "_idf"))).alias("_more"))
        rows = match(rows, rare, key, "left")
        more = [F.col("_more._k").alias("_mk"), F.col("_more._idf").alias("_mi")]
    schema = T.StructType([*kept, T.StructField("idx", T.ArrayType(T.LongType())), T.StructField("val", T.ArrayType(T.DoubleType()))])

    def weigh(batches):
        for b in batches:
            i, k, row = b.column("_i").flatten().to_numpy(), b.column("_k").flatten().to_numpy(), _row_of(b.column("_k"))
            idf = _looked_up(*shared.value, k)
            if dealt:
                mk, mi = b.column("_mk"), b.column("_mi")
                lacking = np.flatnonzero(np.isnan(idf))
                lacking = lacking[np.lexsort((k[lacking], row[lacking]))]  # the order of _more
                assert (mk.flatten().to_numpy() == k[lacking]).all()
                idf[lacking] = mi.flatten().to_numpy()
            v = b.column("_n").flatten().to_numpy() / b.column("_L").to_numpy()[row] * idf
            order = np.lexsort((v, i, row))
            i, v = i[order], v[order]
            # summed from the first to the last
            norm = np.sqrt(np.bincount(row, v * v, b.num_rows))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (i, v / norm[row])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *lists], names=schema.names)

    return rows.select(*names, "_L", "_i", "_n", "_k", *more).mapInArrow(weigh, schema)


@F.arrow_udf(T.StructType([T.StructField("term", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.IntegerType()))]))
def _term_counts(tokens: pa.Array) -> pa.Array:
    """The distinct tokens of each row and how often it has them."""
    coded = tokens.flatten().dictionary_encode()
    terms = coded.dictionary
    row, code = _row_of(tokens), coded.indices.to_numpy().astype(np.int64)
    pairs, n = np.unique(row * (len(terms) + 1) + code, return_counts=True)
    row, code = np.divmod(pairs, len(terms) + 1)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(tokens)))]), pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, x) for x in (terms.take(pa.array(code)), pa.array(n, pa.int32()))], names=["term", "n"])


def _row_of(lists: pa.Array) -> np.ndarray:
    """The row of each value."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, NaN where ``keys`` (ascending) lacks it."""
    if not len(keys):
        return np.full(len(wanted), np.nan)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.nan)


class _Rows:
    """Sparse unit vectors of a batch, end to end; a plain matrix where all have the same indices."""

    def __init__(self, idx: pa.Array, val: pa.Array):
        self.ends = (idx.offsets.to_numpy() - idx.offsets[0].as_py()).astype(np.int64)
        self.idx, self.val = idx.flatten().to_numpy(), val.flatten().to_numpy()
        size = np.diff(self.ends)
        self.matrix = None
        if len(size) and size[0] and (size == size[0]).all():
            table = self.idx.reshape(len(size), -1)
            if (table == table[0]).all():
                self.matrix = self.val.reshape(len(size), -1)

    def vector(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.idx[self.ends[i] : self.ends[i + 1]], self.val[self.ends[i] : self.ends[i + 1]]

    def similarity(self, center: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Dot products with a sparse vector. Equal rows have equal sums wherever they stand."""
        ci, cv = center
        out = np.zeros(len(self.ends) - 1)
        if not len(ci) or not len(self.idx):
            return out
        if self.matrix is not None and np.array_equal(ci, self.idx[: len(ci)]) and len(ci) == self.matrix.shape[1]:
            return (self.matrix * cv).sum(axis=1)
        at = np.searchsorted(ci, self.idx)
        at[at == len(ci)] = 0
        part = np.where(ci[at] == self.idx, self.val * cv[at], 0.0)
        full = self.ends[1:] > self.ends[:-1]
        out[full] = np.add.reduceat(part, self.ends[:-1][full])
        return out


Center = tuple[str, int, np.ndarray, np.ndarray]  # entry_id, copy, idx, val


def _keys(b, part: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The distinct datasets of a batch, and the number of each row's."""
    number: dict[tuple, int] = {}
    of = [number.setdefault(k, len(number)) for k in zip(*(b.column(c).to_pylist() for c in part))]
    return list(number), np.array(of, np.int64)


def _nearer(state: DataFrame, part: list[str], fresh: dict[tuple, list[Center]]) -> DataFrame:
    """``state`` (unit rows with ``near``, the greatest similarity to a chosen row) after the ``fresh``
    centers: each row meets each center once in its life. Chosen rows and rows of datasets that are
    not named go. ``md`` is the rounded distance."""
    shared = state.sparkSession.sparkContext.broadcast(fresh)
    schema = T.StructType([*[f for f in state.schema if f.name != "md"], T.StructField("md", T.DoubleType())])

    def run(batches):
        for b in batches:
            keys, of = _keys(b, part)
            for k, key in enumerate(keys):
                if key in shared.value:  # its rows meet its own centers
                    yield nearer(b.filter(pa.array(of == k)) if len(keys) > 1 else b, shared.value[key])

    def nearer(b: pa.RecordBatch, centers: list[Center]) -> pa.RecordBatch:
        rows = _Rows(b.column("idx"), b.column("val"))
        near, keep = b.column("near").to_numpy().copy(), np.ones(b.num_rows, bool)
        ids, copies = b.column("entry_id"), b.column(COPY).to_numpy()
        for entry, copy, ci, cv in centers:
            near = np.maximum(near, rows.similarity((ci, cv)))
            hit = pc.equal(ids, entry) if entry is not None else pc.is_null(ids)
            keep &= ~((copies == copy) & hit.fill_null(False).to_numpy(zero_copy_only=False))
        md = np.round(np.maximum(0.0, 1.0 - near), DISTANCE_DIGITS)
        columns = [pa.array(near) if n == "near" else pa.array(md) if n == "md" else b.column(n) for n in schema.names]
        return pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep))

    return state.mapInArrow(run, schema)


def _safe_picks(rows: list, n: int, complete: bool) -> list[Center]:
    """The next at most ``n`` picks of one dataset among its farthest rows, by (distance, earlier in
    shuffled order). The last row bounds those not seen: their distances only fall, so a pick that
    ranks before the last row did at the start is the pick among all. ``complete``: there are none."""
    md, u0 = np.array([r["md"] for r in rows]), np.array([r["u0"] for r in rows])
    lists = [pa.array([r[c] for r in rows], t) for c, t in (("idx", pa.list_(pa.int64())), ("val", pa.list_(pa.float64())))]
    vectors = _Rows(*lists)
    near = np.array([r["near"] for r in rows])
    bound = (np.inf, 0.0) if complete else (-md[-1], u0[-1])
    free = np.ones(len(rows), bool)
    picks: list[Center] = []
    while len(picks) < n and free.any():
        i = int(np.lexsort((u0, -np.where(free, md, -1.0)))[0])
        if picks and (-md[i], u0[i]) >= bound:
            break
        free[i] = False
        center = vectors.vector(i)
        picks.append((rows[i]["entry_id"], rows[i][COPY], *center))
        near = np.maximum(near, vectors.similarity(center))
        md = np.round(np.maximum(0.0, 1.0 - near), DISTANCE_DIGITS)
    return picks


def _picks(pool: DataFrame, part: list[str], first: dict[tuple, Center], n: int, width: int) -> dict[tuple, list[Center]]:
    """The n picks of each dataset of ``first``. A round updates the distances by the centers chosen
    since (one map, written), fetches each dataset's farthest rows, and picks as many of them as are
    proved to be the next."""
    chosen = {k: [c] for k, c in first.items()}
    fresh = {k: [c] for k, c in first.items()}
    state = pool.withColumn("near", F.lit(float("-inf")))
    fetch = max(1, min(4 * n, MAX_CENTER_VALUES // (len(first) * (width + 1))))
    while fresh:
        state = saved(_nearer(state, part, fresh), "kcenter-state")
        top = Window.partitionBy(*part).orderBy(F.desc("md"), "u0", "entry_id", COPY)
        far = state.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= fetch + 1)
        rows: dict[tuple, list] = {}
        for r in far.orderBy("_r").collect():  # fetch + 1 rows a dataset of this group
            rows.setdefault(tuple(r[c] for c in part), []).append(r)
        fresh = {}
        for key, found in rows.items():
            more = _safe_picks(found, n - len(chosen[key]), len(found) <= fetch)
            chosen[key] += more
            if len(chosen[key]) < n:
                fresh[key] = more
    return chosen


def kcenter(df: DataFrame, p: dict, seed, part) -> tuple[DataFrame, dict]:
    """Greedy farthest-first: start at a random row, repeatedly add the row with the largest
    min distance (1 - cosine) to the chosen set; ties -> earlier in shuffled order. Copies of a
    chosen row are chosen last, so n rows come out whenever there are n.

    The distances are kept between rounds, so every row meets every center once (n times the rows
    in all), and a round yields as many picks as its farthest rows prove (see ``_safe_picks``).
    The vectors in the driver and in a broadcast are bounded by ``MAX_CENTER_VALUES``: datasets are
    taken in groups that fit.

    ``p["core_set"]`` (for very large n and data) first reduces every partition to that many
    farthest-first rows, n at least; the greedy then runs on their union, a constant factor from the
    exact answer."""
    part = list(part)
    n = int(p["n"])
    spark = df.sparkSession
    units = saved(unit_rows(df, p, seed, part), "kcenter-units")
    stats = units.groupBy(*part).agg(F.count(F.lit(1)).alias("_N"), F.first("note").alias("note"), F.max(F.size("idx")).alias("_w"),
                                     F.min_by(F.struct("entry_id", COPY, "idx", "val"), F.struct("u1", "entry_id", COPY)).alias("_first"))
    stats = saved(stats, "kcenter-stats")
    pool = units
    if p.get("core_set"):
        pool = saved(core_set(units, part, max(n, int(p["core_set"]))), "kcenter-core")
    picks: list[tuple] = []
    group: dict[tuple, Center] = {}
    width = 0

    def finish() -> None:
        if group:
            picks.extend((*key, e, c) for key, rows in _picks(pool, part, group, n, width).items() for e, c, _, _ in rows)

    for r in stats.where(F.col("_N") > n).orderBy(*part).toLocalIterator() if n else ():
        if group and (len(group) + 1) * n * (max(width, r["_w"]) + 1) > MAX_CENTER_VALUES:
            finish()
            group, width = {}, 0
        f = r["_first"]
        group[tuple(r[c] for c in part)] = (f["entry_id"], f[COPY], np.array(f["idx"], np.int64), np.array(f["val"]))
        width = max(width, r["_w"])
    finish()
    key = [*part, "entry_id", COPY]
    picked = spark.createDataFrame(picks, T.StructType([df.schema[c] for c in key]))
    out = match(df, picked, key, "left_semi").unionByName(match(df, stats.where(F.col("_N") <= n), part, "left_semi"))
    if not n:
        out = df.limit(0)
    mine = match(units, out.select(*key), key, "left_semi")  # the picked vectors alone are exploded
    post = mine.select(*key, F.explode(F.arrays_zip("idx", "val")).alias("x")).select(*key, F.col("x.idx").alias("term"), F.col("x.val").alias("w"))
    avg = avg_pairwise_cosine(post, norms(post, part, ("entry_id", COPY)), out.select(*key), part, ("entry_id", COPY))
    return out, {"_avg_cos": match(stats.select(*part, "note"), avg, part, "left")}


def _farthest_first(rows: _Rows, mine: np.ndarray, first: int, m: int) -> list[int]:
    """``m`` rows of ``mine`` (positions), each the farthest from those before it."""
    near, keep, i = np.full(len(rows.ends) - 1, -np.inf), [], first
    free = np.zeros(len(near), bool)
    free[mine] = True
    while len(keep) < min(m, len(mine)):
        keep.append(i)
        free[i] = False
        near = np.maximum(near, rows.similarity(rows.vector(i)))
        i = int(np.where(free, near, np.inf).argmin())
    return keep


def core_set(units: DataFrame, part: list[str], m: int) -> DataFrame:
    """At most ``m`` farthest-first rows of each dataset in each partition: batch after batch, the rows
    kept so far and the batch are reduced together, so a task holds a batch and ``m`` rows a dataset."""

    def run(batches):
        held = None
        for b in batches:
            if held is not None:
                b = pa.concat_batches([held, b])
            keys, of = _keys(b, part)
            rows, u1 = _Rows(b.column("idx"), b.column("val")), b.column("u1").to_numpy()
            keep: list[int] = []
            for k in range(len(keys)):
                mine = np.flatnonzero(of == k)
                keep += _farthest_first(rows, mine, int(mine[np.argmin(u1[mine])]), m)
            held = b.take(pa.array(sorted(keep), pa.int64()))
        if held is not None:
            yield held

    return units.mapInArrow(run, units.schema)


def avg_pairwise_cosine(post: DataFrame, nrm: DataFrame, picked: DataFrame, part=("dataset",), ids=("entry_id",)) -> DataFrame:
    """Mean cosine over all pairs of the picked rows, one aggregate, no self-join:
    sum_{i<j} cos = (|sum u_i|^2 - #nonzero) / 2 with u_i the unit vectors."""
    part, key = list(part), [*part, *ids]
    unit = match(match(post, picked, key, "left_semi"), nrm, key).where(F.col("norm") > 0)
    per_term = unit.groupBy(*part, "term").agg(F.sum(F.col("w") / F.col("norm")).alias("_s"))
    sq = per_term.groupBy(*part).agg(F.sum(F.col("_s") * F.col("_s")).alias("_sq"))
    cnt = match(picked, nrm, key, "left").groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("norm") > 0, 1).otherwise(0)).alias("_nz")
    )
    j = match(cnt, sq, part, "left")
    val = F.when(F.col("_n") <= 1, 1.0).otherwise(
        (F.coalesce(F.col("_sq"), F.lit(0.0)) - F.col("_nz")) / (F.col("_n") * (F.col("_n") - 1))
    )
    return j.select(*part, F.round(val, 4).alias("avg_pairwise_cosine"))
