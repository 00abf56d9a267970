"""Exact top-k search by inner product over vectors sorted by length.

Components are scaled and floored to integers, so scores are exact. Vectors are dealt to blocks by descending
length. The eigenvectors of the vectors' second moments (the right singular vectors) rotate them so that the
first few coordinates hold most of a product; a partial sum over those plus the Cauchy-Schwarz bound of the
residuals bounds each product, and only what can still reach a query's k-th best is computed in full. The longest
vectors of all give each query its first k-th best, so that whole blocks of short vectors fall to the bound
|q| * max |x| without a look.

Queries are worked through in blocks against blocks of vectors: a pair of blocks is one unit of work of bounded
size, and a query's partial lists of k are merged by a ranking.

Rows: null vectors, and those with null or non-finite components, take no part, nor do rows without an id; vectors of
unlike lengths are compared as if filled up with zeros; rows that repeat an id and score count once; ties go
to the smaller id; an empty table gives an empty result; other columns are not read. Scores beyond the range of
a long are clipped to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import stored

#: Vectors of a block, queries of a block, and vectors that give the first bounds.
BLOCK, QUERY_BLOCK, HEAD = 4096, 1024, 2048
#: Share of the squared lengths that the partial sums should hold.
ENERGY = 0.75
_MAX, _MIN = (1 << 63) - 1, -(1 << 63)


def _good(id_col: str, vector_col: str) -> Column:
    """Which vectors take part."""
    return F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))


def shift_of(vectors: DataFrame, id_col: str, vector_col: str) -> int:
    """By how many binary places components are shifted down so that sums of their squares stay finite: 0 unless a component is
    over 1e120. Shifts by powers of two are exact."""
    largest = vectors.where(_good(id_col, vector_col)).agg(F.max(F.aggregate(vector_col, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double")))))).first()[0]
    return max(0, math.frexp(largest or 0.0)[1] + 8 - 400)


def integers(vectors: DataFrame, id_col: str, vector_col: str, shift: int = 0) -> DataFrame:
    """(id, x array<double>, norm): floor(256 * component) / 2^shift; only vectors that take part."""

    def whole(v: Column) -> Column:
        v = v.cast("double")  # from 2^44 on, 256 times a double is a whole number
        return F.when(F.abs(v) < 2.0**44, F.floor(v * 256.0).cast("double") * 2.0**-shift).otherwise(v * 2.0 ** (8 - shift))

    rows = vectors.where(_good(id_col, vector_col)).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), whole).alias("x"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Arrays of doubles as rows, filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Right singular vectors, strongest first, and how many of them hold ENERGY. The second moments are dim * dim sums."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            total += x.T @ x
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    moments = np.zeros((dim, dim))
    for r in rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        moments[r.i, r.j] = r.v
    if not np.isfinite(moments).all():
        return np.eye(dim), dim
    values, vectors = np.linalg.eigh(moments)
    share = np.cumsum(np.maximum(values[::-1], 0))
    keep = int(np.searchsorted(share, ENERGY * share[-1])) + 1 if share[-1] > 0 else dim
    return np.ascontiguousarray(vectors[:, ::-1]), min(keep, dim)


def blocks(rows: DataFrame, dim: int, size: int, where: Column | None = None) -> DataFrame:
    """Blocks of `size` vectors by descending length: (block, ids, x, longest) with packed ids and components."""

    def run(batches):
        from pyspark import TaskContext

        base, k, held, count = TaskContext.get().partitionId() << 32, 0, [], 0

        def pack(part: pa.Table):
            column = part.column("x").combine_chunks()
            x = _matrix(column if isinstance(column, pa.Array) else column.chunk(0), dim)
            return pa.RecordBatch.from_arrays([pa.array([base + k]), pa.array([part.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([float(part.column("norm").to_numpy().max())])], names=["block", "ids", "x", "longest"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= size:
                joined = pa.Table.from_batches(held)
                yield pack(joined.slice(0, size))
                k += 1
                held, count = joined.slice(size).to_batches(), count - size
        if count:
            yield pack(pa.Table.from_batches(held))

    chosen = rows if where is None else rows.where(where)
    # the id splits equal lengths, so that one common vector does not fill a partition
    ordered = chosen.repartitionByRange(F.col("norm").desc(), F.col("id")).sortWithinPartitions(F.col("norm").desc(), "id")
    return ordered.select("id", "x", "norm").mapInArrow(run, "block long, ids binary, x binary, longest double")


def exact_products(q: np.ndarray, x: np.ndarray, shift: int = 0) -> np.ndarray:
    """Inner products of whole-numbered rows (shifted down by `shift`), pair by pair, as int64; clipped to its range."""
    if not len(q):
        return np.zeros(0, np.int64)
    if not shift and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)

    def number(v: float) -> int:
        top, bottom = v.as_integer_ratio()
        return (top << shift) // bottom

    return np.array([min(max(sum(number(a) * number(b) for a, b in zip(u, v, strict=True)), _MIN), _MAX) for u, v in zip(q.tolist(), x.tolist(), strict=True)], np.int64)


def bounds_of(at: np.ndarray, scores: np.ndarray, queries: int, k: int, shift: int) -> np.ndarray:
    """The k-th best score of each query that has k, in the terms of shifted products; none where that score was clipped from below."""
    bound, worst = np.full(queries, -np.inf), np.full(queries, np.inf)
    np.minimum.at(worst, at, scores.astype(np.float64))
    full = np.bincount(at, minlength=queries) == k
    keep = full & (worst > float(_MIN))
    bound[keep] = np.ldexp(worst[keep], -2 * shift)
    return bound


def best(qi: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best entries: higher score first, then smaller id; an id counts once."""
    order = np.lexsort((ids, -scores.astype(np.float64), qi)) if np.abs(scores).max(initial=0) < 1 << 52 else np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -int(scores[i]), ids[i])), np.int64)
    if not len(order):
        return order
    q, i, s = qi[order], ids[order], scores[order]
    same = np.zeros(len(order), bool)
    same[1:] = (q[1:] == q[:-1]) & (i[1:] == i[:-1]) & (s[1:] == s[:-1])
    order, q = order[~same], q[~same]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return order[rank < k]


def search_block(q_ids, q, bound, ids, x, k: int, turn: np.ndarray, keep: int, shift: int = 0, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block of vectors (longest first) for each query whose k-th best is at least `bound`.
    Returns query places, ids and scores."""
    found_q, found_i, found_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    q_len, x_len = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    q_turn, x_turn = q @ turn[:, :keep], x @ turn[:, :keep]
    q_rest = np.sqrt(np.maximum(q_len**2 - (q_turn**2).sum(1), 0))
    x_rest = np.sqrt(np.maximum(x_len**2 - (x_turn**2).sum(1), 0))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        slack = 1e-6 * (1.0 + q_len * x_len[part].max(initial=0))  # rounding of the rotated sums
        alive = np.flatnonzero(q_len * x_len[part].max(initial=0) + slack >= bound)
        if not len(alive):
            break  # vectors only get shorter
        upper = q_turn[alive] @ x_turn[part].T + np.outer(q_rest[alive], x_rest[part])
        a, b = np.nonzero(upper + slack[alive, None] >= bound[alive, None])
        qi, xi = alive[a], b + at
        other = q_ids[qi] != ids[xi]
        qi, xi = qi[other], xi[other]
        if not len(qi):
            continue
        qi, cand, score = np.concatenate((found_q, qi)), np.concatenate((found_i, ids[xi])), np.concatenate((found_s, exact_products(q[qi], x[xi], shift)))
        top = best(qi, cand, score, k)
        found_q, found_i, found_s = qi[top], cand[top], score[top]
        bound = np.maximum(bound, bounds_of(found_q, found_s, len(q), k, shift))
    return found_q, found_i, found_s


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best of all other rows for each row that `is_query` names (by `id`)."""
    shift = shift_of(vectors, id_col, vector_col)
    rows = stored(integers(vectors, id_col, vector_col, shift))
    result = "query_id long, id long, score long"
    stats = rows.agg(F.max(F.size("x")).alias("dim"), F.count("*").alias("n")).first()
    dim = max(1, stats.dim or 0)
    turn, keep = rotation(rows, dim)
    data = stored(blocks(rows, dim, BLOCK))
    head_rows = rows.orderBy(F.col("norm").desc(), "id").limit(HEAD).toArrow()  # HEAD rows, however many there are
    head_ids = head_rows["id"].to_numpy()
    head_x = _matrix(head_rows["x"].combine_chunks(), dim) if len(head_ids) else np.zeros((0, dim))
    sent = rows.sparkSession.sparkContext.broadcast((turn, keep, head_ids, head_x))

    def seed(batches):
        turn, keep, head_ids, head_x = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["x"], "<f8").reshape(-1, dim)
                at, _, scores = search_block(q_ids, q, np.full(len(q), -np.inf), head_ids, head_x, k, turn, keep, shift)
                bound = bounds_of(at, scores, len(q), k, shift)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([row["ids"]], pa.binary()), pa.array([row["x"]], pa.binary()), pa.array([bound.astype("<f8").tobytes()], pa.binary()), pa.array([float(np.linalg.norm(q, axis=1).max(initial=0))]), pa.array([float(bound.min(initial=np.inf))])], names=["q_block", "q_ids", "q", "bound", "q_longest", "least"])

    asked = stored(blocks(rows, dim, QUERY_BLOCK, is_query).mapInArrow(seed, "q_block long, q_ids binary, q binary, bound binary, q_longest double, least double"))

    # pairs of blocks by their numbers; a pair whose longest vectors can't reach any query's bound is left out
    n_blocks = data.select(F.collect_list(F.struct("block", "longest")).alias("all"))
    pairs = asked.select("q_block", "q_longest", "least").join(F.broadcast(n_blocks)).select("q_block", "q_longest", "least", F.explode("all").alias("b")).where(F.col("q_longest") * F.col("b.longest") * (1 + 1e-9) + 1e-6 >= F.col("least")).select("q_block", F.col("b.block").alias("block"))
    work = pairs.join(asked.select("q_block", "q_ids", "q", "bound"), "q_block").join(data, "block").select("q_ids", "q", "bound", "ids", "x")

    def run(batches):
        turn, keep, _, _ = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("q_ids", "q", "bound", "ids", "x")}
                q_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                at, found, scores = search_block(q_ids, np.frombuffer(row["q"], "<f8").reshape(-1, dim), np.frombuffer(row["bound"], "<f8"), ids, np.frombuffer(row["x"], "<f8").reshape(-1, dim), k, turn, keep, shift)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "id", "score"])

    found = work.mapInArrow(run, result).distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
