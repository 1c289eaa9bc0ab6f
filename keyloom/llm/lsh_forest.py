"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree hashes a vector (its direction less the mean direction) to a string of BITS signs of random projections and keeps the
strings sorted. A query descends to its longest common prefix in each tree and then ascends in all trees at once: the
prefix length goes down from BITS until the trees together hold enough entries under the query's
prefixes. All entries there are compared.

How many entries are enough is measured, so that recall holds at any size and for any shape of the data: for PROBES queries the true
neighbours are found by comparing them with all vectors, and the number is what leaves the asked share of these under the
prefixes. A recall of 1 asks for all entries, which makes the search exact.

The sorted arrays are shards by tree and by a short prefix, so that a query goes to one shard of each
tree, and to the neighbouring ones where it ascends further; a shard that is much too large is dealt by hash into several, which all
get its queries (numbers of entries under a prefix add up, so the search is the same). Equal vectors are one entry that carries
their smallest ids. Trees hold directions in a byte for each component with a bound of the error, and a query keeps all entries
that the bounds leave open; the few of these are compared by their original vectors.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; vectors of other lengths are searched apart; a vector's own id is never an answer to it;
ties go to the smaller id; repeated rows count once; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

TREES, BITS, SEED = 32, 64, 17
#: Queries that the number of entries is measured on; share of their neighbours that must be among these; entries wanted at least.
PROBES, RECALL, LEAST = 64, 0.97, 2048
#: Rows that a shard should have; over LARGE times as many, it is split.
SHARD, LARGE = 16_384, 4


def usable(vector: str) -> Column:
    """Whether a vector can be compared."""
    x = F.col(vector)
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def hashes(x: np.ndarray, tree: int, bits: int = BITS) -> np.ndarray:
    """A tree's hash strings of the rows, the first sign in the highest bit."""
    planes = np.random.default_rng([SEED, tree, x.shape[1]]).standard_normal((x.shape[1], bits))
    signs = np.packbits(x @ planes > 0, axis=1)
    return signs.view(">u8")[:, 0].astype(np.uint64)


def under(keys: np.ndarray, asked: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted keys that share the first ``length`` signs with each asked one begin and end."""
    rest = np.where(length > 0, (np.uint64(1) << (np.uint64(BITS) - np.maximum(length, 1).astype(np.uint64))) - np.uint64(1), ~np.uint64(0))
    return np.searchsorted(keys, asked & ~rest), np.searchsorted(keys, asked | rest, "right")


def in_range(x: np.ndarray) -> np.ndarray:
    """The rows, those whose squares would leave the range of doubles times a power of two, which changes no direction."""
    most = np.abs(x).max(1, keepdims=True, initial=0)
    odd = (most < 1e-140) | (most > 1e140)
    return np.where(odd, np.ldexp(x, -np.frexp(most)[1]), x) if odd.any() else x


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and q, in doubles; the same for a pair in whatever company."""
    x, q = in_range(x), in_range(q)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))


def directions(x: np.ndarray) -> np.ndarray:
    x = in_range(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def in_bytes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions as whole numbers of a byte, the scale of each, and by how much a product with a direction may be off."""
    scale = (np.abs(unit).max(1) / 127).astype(np.float32)
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - code * scale[:, None].astype(float)
    return code, scale, (np.sqrt((rest * rest).sum(1)) + 1e-5).astype(np.float32)


def _distinct(rows: DataFrame, top: int) -> DataFrame:
    """vec, ids (the top + 1 smallest of those that have it), rep (the smallest), asks (whether one of them is a query)."""
    # the limit is taken in each task before the shuffle, so a common vector isn't a hot key
    w = Window.partitionBy("vec", "asks").orderBy("id")
    few = rows.distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top + 1)
    ids = F.slice(F.array_sort(F.array_distinct(F.collect_list("id"))), 1, top + 1)
    return few.groupBy("vec").agg(ids.alias("ids"), F.bool_or("asks").alias("asks")).withColumn("rep", F.col("ids")[0]).withColumn("dim", F.size("vec"))


def _by_dim(b: pa.RecordBatch):
    """Parts of a batch whose first column is dim, by its values."""
    dims = b.column(0).to_numpy()
    for dim in np.unique(dims):
        yield int(dim), b.take(pa.array(np.flatnonzero(dims == dim)))


def _centres(distinct: DataFrame) -> dict[int, np.ndarray]:
    """The mean direction for each length of vectors."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in _by_dim(b) if b.num_rows else ():
                x = directions(matrix(part.column(1)))
                sums[dim] = sums.get(dim, np.zeros(dim + 1)) + np.append(x.sum(0), len(x))
        for dim, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1, dim, np.int32)), pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(v)], names=["dim", "place", "x"])

    out: dict[int, np.ndarray] = {}
    for r in distinct.select("dim", "vec").mapInArrow(run, "dim int, place int, x double").groupBy("dim", "place").agg(F.sum("x").alias("x")).collect():  # one number for each component
        out.setdefault(r["dim"], np.zeros(r["dim"] + 1))[r["place"]] = r["x"]
    return {d: v[:-1] / v[-1] for d, v in out.items()}


class Forest:
    """Where vectors are in the trees: centres and depths of shards by the vectors' length, and which shards are dealt into how many."""

    def __init__(self, centres: dict[int, np.ndarray], depth: dict[int, int], split: dict[tuple[int, int, int], int]):
        self.centres, self.depth, self.split = centres, depth, split

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        return hashes(directions(x) - self.centres[x.shape[1]], tree)

    def entries(self, distinct: DataFrame, codes: bool) -> DataFrame:
        """A row for each vector and tree: dim, tree, shard, part, hash, rep (and code, scale, error)."""
        schema = "dim int, tree int, shard long, part int, hash long, rep long" + (", code binary, scale float, error float" if codes else "")
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches):
            for b in batches:
                for dim, part in _by_dim(b) if b.num_rows else ():
                    x, rep, d = matrix(part.column(2)), part.column(1), self.depth[dim]
                    spread = ((rep.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                    more = []
                    if codes:
                        code, scale, error = in_bytes(directions(x))
                        more = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error)]
                    for tree in range(TREES):
                        h = self.strings(x, tree)
                        shard = (h >> np.uint64(BITS - d) if d else np.zeros(len(x), np.uint64)).astype(np.int64)
                        k = np.array([self.split.get((dim, tree, int(v)), 1) for v in shard], np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, np.int32)), pa.array(np.full(len(x), tree, np.int32)), pa.array(shard), pa.array((spread % k).astype(np.int32)), pa.array(h.view(np.int64)), rep, *more], names=names)

        return distinct.select("dim", "rep", "vec").mapInArrow(run, schema)

    def asked(self, queries: DataFrame) -> DataFrame:
        """The queries (dim, rep, vec, length) at all parts of their own shard of each tree, and of those that a shorter length takes in."""
        vec = dict(queries.dtypes)["vec"]

        def run(batches):
            for b in batches:
                for dim, part in _by_dim(b) if b.num_rows else ():
                    x, d = matrix(part.column(2)), self.depth[dim]
                    short = np.minimum(part.column(3).to_numpy(zero_copy_only=False), d).astype(np.int64)
                    for tree in range(TREES):
                        h = self.strings(x, tree)
                        row, shard, no = [], [], []
                        for i, n in enumerate(short):
                            first = int(h[i]) >> (BITS - int(n)) << (d - int(n)) if n else 0
                            for v in range(first, first + (1 << (d - int(n)))):
                                for k in range(self.split.get((dim, tree, v), 1)):
                                    row.append(i), shard.append(v), no.append(k)
                            if len(row) > 1 << 14 or i == len(short) - 1:
                                at = pa.array(row, pa.int64())
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim, np.int32)), pa.array(np.full(len(row), tree, np.int32)), pa.array(shard, pa.int64()), pa.array(no, pa.int32()), pa.array(h[row].view(np.int64)), part.column(1).take(at), part.column(2).take(at), part.column(3).take(at)], names=["dim", "tree", "shard", "part", "hash", "rep", "vec", "length"])
                                row, shard, no = [], [], []

        return queries.select("dim", "rep", "vec", F.col("length").cast("int").alias("length")).mapInArrow(run, f"dim int, tree int, shard long, part int, hash long, rep long, vec {vec}, length int")


def _true_neighbours(distinct: DataFrame, probes: list, top: int) -> list:
    """dim, probe, vec of the nearest other vectors of each probe, by comparing it with all."""
    of = {d: [(r["rep"], np.array(r["vec"], float)) for r in probes if r["dim"] == d] for d in {r["dim"] for r in probes}}
    vec = dict(distinct.dtypes)["vec"]

    def run(batches):
        for b in batches:
            for dim, part in _by_dim(b) if b.num_rows else ():
                if dim not in of:
                    continue
                reps = part.column(1).to_numpy(zero_copy_only=False)
                cos = directions(matrix(part.column(2))) @ directions(np.array([v for _, v in of[dim]])).T
                cos[reps[:, None] == np.array([r for r, _ in of[dim]])] = -2
                k = min(top, len(cos))
                at = np.argpartition(-cos, k - 1, axis=0)[:k].T.ravel()
                who = np.repeat(np.arange(cos.shape[1]), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array([of[dim][i][0] for i in who], pa.int64()), pa.array(cos[at, who]), part.column(2).take(pa.array(at))], names=["dim", "probe", "score", "vec"])

    found = distinct.select("dim", "rep", "vec").mapInArrow(run, f"dim int, probe long, score double, vec {vec}").where("score > -2")
    w = Window.partitionBy("dim", "probe").orderBy(F.desc("score"))
    return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top).select("dim", "probe", "vec").collect()  # top for each probe


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first signs two strings share."""
    return sum((((a ^ b) >> np.uint64(BITS - n)) == 0).astype(int) for n in range(1, BITS + 1))


def nearest(vectors: DataFrame, is_query: Column, top: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest found, by cosine.

    recall: the share of true neighbours that is asked for; it holds on average, as far as PROBES queries tell. 1 is exact.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    place = ["dim", "tree", "shard", "part"]
    with Scratch(spark) as s:
        rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        distinct = s.table(_distinct(rows, top), "distinct")
        sizes = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}  # one number for each length of vectors
        depth = {d: max(0, int(np.log2(max(1, n / SHARD)))) for d, n in sizes.items()}
        whole = Forest(_centres(distinct), depth, {})
        counts = s.table(whole.entries(distinct, False).groupBy("dim", "tree", "shard").count(), "counts")
        # only shards of over LARGE * SHARD rows come to the driver: there are fewer than rows * TREES / (LARGE * SHARD)
        forest = Forest(whole.centres, depth, {(r["dim"], r["tree"], r["shard"]): -(-r["count"] // (2 * SHARD)) for r in counts.where(F.col("count") > LARGE * SHARD).collect()})
        queries = distinct.where("asks")
        total = s.table(_totals(forest, distinct, queries.withColumn("length", F.lit(BITS)), place), "totals")
        want = _wanted(forest, distinct, queries, total, counts, top, recall, sizes)
        level = s.table(_levels(forest, queries, total, counts, want), "levels")
        near = _searched(forest, distinct, queries.join(level, ["dim", "rep"]), place, top)
        # the best that is certain of an entry, by any tree; then all that may be better than the last of the certain ones
        best = near.groupBy("rep", "other").agg(F.max("low").alias("low"), F.max("high").alias("high"))
        by = Window.partitionBy("rep")
        best = best.withColumn("nth", F.row_number().over(by.orderBy(F.desc("low"), "other")))
        pairs = s.table(best.withColumn("least", F.min(F.when(F.col("nth") <= top + 1, F.col("low"))).over(by)).where("high >= least").select("rep", "other"), "pairs")
        best = _compared(pairs, distinct).select("rep", "score", F.explode("ids").alias("vec_id"))
        # one more than asked for: the query's own id may be among them
        order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
        best = s.table(best.dropDuplicates(["rep", "vec_id"]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1).select("rep", "vec_id", "score"), "best")
        # queries of one vector share an answer; the answer has one row for each vector, so a common vector isn't multiplied on both sides
        answer = s.table(best.groupBy("rep").agg(F.collect_list(F.struct("score", "vec_id")).alias("found")), "answers")
        of = s.table(rows.where("asks").select("id", "vec").distinct().join(distinct.select("vec", "rep"), "vec").select(F.col("id").alias("query_id"), "rep"), "queries")
        flat = of.join(answer, "rep").select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", "f.vec_id").where("vec_id <> query_id")
        flat = flat.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id with several vectors
        ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
        return s.keep(ranked.select("query_id", "rank", "vec_id", "score"))


def _totals(forest: Forest, distinct: DataFrame, queries: DataFrame, place: list[str]) -> DataFrame:
    """dim, rep, n0 to n64: how many entries of its own shards are under a query's prefixes of each length, over all trees."""
    lengths = np.arange(BITS + 1)

    def count(entries: pa.Table, asks: pa.Table) -> pa.Table:
        keys = np.sort(entries["hash"].to_numpy().view(np.uint64))
        q = asks["hash"].to_numpy().view(np.uint64)
        ends = [under(keys, q, np.full(len(q), n)) for n in lengths]
        return pa.table({"dim": asks["dim"], "rep": asks["rep"], **{f"n{n}": pa.array((ends[n][1] - ends[n][0]).astype(np.int64)) for n in lengths}})

    hashed = forest.entries(distinct, False).select(*place, "hash").groupBy(*place)
    found = hashed.cogroup(forest.asked(queries).select(*place, "hash", "rep").groupBy(*place)).applyInArrow(count, "dim int, rep long, " + ", ".join(f"n{n} long" for n in lengths))
    return found.groupBy("dim", "rep").agg(*[F.sum(f"n{n}").alias(f"n{n}") for n in lengths])


def _of_dim(values: dict, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for d, v in values.items():
        out = F.when(F.col("dim") == d, F.lit(v).cast(kind)).otherwise(out)
    return out


def _above(forest: Forest, queries: DataFrame, counts: DataFrame) -> DataFrame:
    """dim, rep, n, entries: the same for lengths shorter than the shards' prefixes, from the shards' sizes."""
    spread = lambda df: df.withColumn("depth", _of_dim(forest.depth, "int")).where("depth > 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("depth") - 1))).withColumn("prefix", F.expr("shiftright(shard, depth - n)"))
    sizes = spread(counts).groupBy("dim", "tree", "n", "prefix").agg(F.sum("count").alias("entries"))
    asks = forest.asked(queries.withColumn("length", F.lit(BITS))).where("part = 0").select("dim", "rep", "tree", "shard")
    return spread(asks).join(sizes, ["dim", "tree", "n", "prefix"]).groupBy("dim", "rep", "n").agg(F.sum("entries").alias("entries"))


def _wanted(forest: Forest, distinct: DataFrame, queries: DataFrame, total: DataFrame, counts: DataFrame, top: int, recall: float, sizes: dict[int, int]) -> dict[int, int]:
    """For each length of vectors, how many entries hold the share ``recall`` of the probes' true neighbours."""
    if recall >= 1:
        return {d: TREES * n + 1 for d, n in sizes.items()}
    w = Window.partitionBy("dim").orderBy(F.xxhash64("rep"))
    probes = queries.select("dim", "rep", "vec").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= PROBES).drop("nth")
    rows = probes.collect()  # PROBES for each length of vectors
    ids = queries.sparkSession.createDataFrame([(r["dim"], r["rep"]) for r in rows], "dim int, rep long") if rows else None
    under_them = {(r["dim"], r["rep"]): [r[f"n{n}"] for n in range(BITS + 1)] for r in total.join(F.broadcast(ids), ["dim", "rep"]).collect()} if rows else {}
    above = {(r["dim"], r["rep"], r["n"]): r["entries"] for r in _above(forest, queries.join(F.broadcast(ids), ["dim", "rep"]), counts).collect()} if rows and any(forest.depth.values()) else {}
    of, need = {(r["dim"], r["rep"]): np.array([r["vec"]], float) for r in rows}, {}
    for r in _true_neighbours(distinct, rows, top) if rows else ():
        k, v = (r["dim"], r["probe"]), np.array([r["vec"]], float)
        n = 1 + max(int(common_prefix(forest.strings(v, t), forest.strings(of[k], t))[0]) for t in range(TREES))
        # it is found if the query stops at a prefix that it shares: if the next longer one holds too few
        have = 0 if n > BITS else under_them.get(k, [0] * (BITS + 1))[n] if n >= forest.depth[k[0]] else above[(*k, n)]
        need.setdefault(k[0], []).append(have + 1)
    return {d: max(LEAST, sorted(x)[min(len(x) - 1, int(np.ceil(recall * len(x))))]) if (x := need.get(d)) else LEAST for d in sizes}


def _levels(forest: Forest, queries: DataFrame, total: DataFrame, counts: DataFrame, want: dict[int, int]) -> DataFrame:
    """dim, rep, length: the longest prefixes under which there are as many entries as wanted, or none."""
    most, deep = _of_dim(want, "long"), _of_dim(forest.depth, "int")
    at = F.coalesce(*[F.when((F.col(f"n{n}") >= most) & (deep <= n), F.lit(n)) for n in range(BITS, -1, -1)])
    level = total.select("dim", "rep", at.alias("length"))
    if any(forest.depth.values()):
        far = queries.join(level.where("length is null").select("dim", "rep"), ["dim", "rep"], "left_semi")
        short = _above(forest, far, counts).where(F.col("entries") >= most).groupBy("dim", "rep").agg(F.max("n").alias("short"))
        level = level.join(short, ["dim", "rep"], "left").withColumn("length", F.coalesce("length", "short"))
    return level.select("dim", "rep", F.coalesce("length", F.lit(0)).alias("length"))


def _searched(forest: Forest, distinct: DataFrame, queries: DataFrame, place: list[str], top: int) -> DataFrame:
    """rep, other, low, high: the entries under each query's prefixes that may be among its nearest, and what their cosines lie between."""

    def search(e: pa.Table, asks: pa.Table) -> pa.Table:
        order = np.argsort(e["hash"].to_numpy().view(np.uint64), kind="stable")
        keys, reps = e["hash"].to_numpy().view(np.uint64)[order], e["rep"].to_numpy()[order]
        rep, other, low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        if len(order) and asks.num_rows:
            q = directions(matrix(asks["vec"])).astype(np.float32)
            codes = np.frombuffer(b"".join(e["code"].to_pylist()), np.int8).reshape(len(order), -1)[order].astype(np.float32)
            scale, error = (e[c].to_numpy()[order] for c in ("scale", "error"))
            a, b = under(keys, asks["hash"].to_numpy().view(np.uint64), asks["length"].to_numpy())
            for i, own in enumerate(asks["rep"].to_pylist()):
                near = (codes[a[i] : b[i]] @ q[i]) * scale[a[i] : b[i]]
                if not len(near):
                    continue
                sure, k = near - error[a[i] : b[i]], min(top + 1, len(near))
                some = np.flatnonzero(near + error[a[i] : b[i]] >= np.partition(sure, -k)[-k])
                rep.append(np.full(len(some), own)), other.append(reps[a[i] + some]), low.append(sure[some].astype(float)), high.append((near[some] + error[a[i] + some]).astype(float))
        return pa.table({"rep": np.concatenate(rep), "other": np.concatenate(other), "low": np.concatenate(low), "high": np.concatenate(high)})

    entries = forest.entries(distinct, True).select(*place, "hash", "rep", "code", "scale", "error").groupBy(*place)
    asked = forest.asked(queries).select(*place, "hash", "rep", "vec", "length").groupBy(*place)
    return entries.cogroup(asked).applyInArrow(search, "rep long, other long, low double, high double")


def _compared(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """rep, ids (of the other), score of each pair, by the original vectors."""
    both = pairs.join(distinct.select("rep", F.col("vec").alias("x")), "rep").join(distinct.select(F.col("rep").alias("other"), F.col("vec").alias("y"), "ids", "dim"), "other")

    def run(batches):
        for b in batches:
            for _, part in _by_dim(b) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(cosines(matrix(part.column(4)), matrix(part.column(3))))], names=["rep", "ids", "score"])

    return both.select("dim", "rep", "ids", "x", "y").mapInArrow(run, "rep long, ids array<long>, score double")
