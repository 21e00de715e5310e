"""Whitening of vectors by a bidiagonal solver: no covariance matrix is ever formed.

Rows are centred exactly (integer sums of every dimension come first), and each task reduces its
centred rows to a triangle R by QR, block after block. Triangles are stacked and reduced again, some
dozens at a time, until one is left; its size is dimensions squared, whatever the number of rows. R is then
brought to bidiagonal form by Householder reflections, the squared singular values come from
the differential qd algorithm with shifts (dqds), which finds small ones as exactly as large ones, and a
twisted factorisation of the bidiagonal's product gives the vector of each wanted value. Vectors of
values that lie close together are iterated and kept orthogonal to each other. Reflected back, they
are the unit eigenvectors of the covariance.

A vector is taken as whole numbers, x = floor(1024 * c) + 100000. Rows whose vector is null, or holds
null or non-finite entries, or entries of 2^30 and beyond (whose x is no longer exact here), are left out, and so are
empty vectors and vectors whose length is not the most frequent one (the longer of two as frequent).
Repeated rows and rows without an id are rows of their own. Components whose share of the trace is below
1e-13 have no direction that double precision can tell (equal vectors, fewer rows than
components) and give no rows, so one vector alone gives none; neither does an empty table. `deviation` is a decimal of
38 digits; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.groups import in_groups
from veritally.session import materialize

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 30)
#: Partial results that one task folds into one.
FOLD = 32
BLOCK_ROWS = 8192
LEAST_SHARE = 1e-13
EPS = float(np.finfo(float).eps)

PARTIAL = "slot long, n long, values array<double>"
ROW = "vec_id bigint, component int, deviation decimal(38,0), whitened double"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# --- the solver, on one small matrix -------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflections (unit vectors, one per step) of a square matrix."""
    a = np.array(r, float)
    d = len(a)
    right: list[np.ndarray] = []

    def reflection(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        v = x / norm
        v[0] += 1.0 if v[0] >= 0 else -1.0
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflection(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        w = reflection(a[k, k + 1 :].copy()) if k + 2 < d else None
        if w is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
        right.append(np.zeros(0) if w is None else w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def reflected(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """A vector of the bidiagonal's columns in the columns of the matrix it came from."""
    z = z.copy()
    for k in range(len(right) - 1, -1, -1):
        if len(right[k]):
            z[k + 1 :] -= 2 * right[k] * (right[k] @ z[k + 1 :])
    return z


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd transform; the last value is the smallest of its remainders, negative if the shift was too large."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] <= 0.0:
            return new_q, new_e, -1.0
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
        if d < least:
            least = d
    new_q[n - 1] = d
    return new_q, new_e, least


def _safe_shift(q: list[float], e: list[float]) -> float:
    """A shift not above the smallest value: one over the trace of the inverse, from the squared columns of the factor's inverse."""
    total = column = 0.0
    for i, value in enumerate(q):
        if value <= 0.0:
            return 0.0
        column = (1.0 + (e[i - 1] * column if i else 0.0)) / value
        total += column
    return (1.0 - 8 * EPS) / total


def _likely_shift(q: list[float], e: list[float]) -> float:
    """The smaller value of the last two rows after a transform without shift; close to the smallest value once the end has settled."""
    a, b, c = q[-2], e[-1], q[-1]
    total = a + b + c
    root = max(total * total - 4 * a * c, 0.0) ** 0.5
    return 2 * a * c / (total + root) if total + root > 0 else 0.0


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, largest first."""
    scale = max(float(np.max(np.abs(diagonal), initial=0.0)), float(np.max(np.abs(above), initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    values: list[float] = []
    pieces = [([float(x / scale) ** 2 for x in diagonal], [float(x / scale) ** 2 for x in above], 0.0)]
    tiny = EPS * EPS
    while pieces:
        q, e, moved = pieces.pop()
        for _ in range(100 * len(q) + 100):
            # Entries above the diagonal that no longer count cut the piece; the last row then stands alone, or a part does.
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * (moved + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut is not None:
                pieces.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                break
            # The larger end belongs on top: values then leave at the bottom, smallest first. Turned
            # over and transposed, a bidiagonal matrix is one again, with its entries reversed.
            if q[0] < q[-1] / 4:
                q, e = q[::-1], e[::-1]
            shift = _likely_shift(q, e) * (1.0 - 1e-8)
            new_q, new_e, least = _dqds_step(q, e, shift) if shift > 0 else ([], [], -1.0)
            if least < 0:
                shift = _safe_shift(q, e)
                new_q, new_e, least = _dqds_step(q, e, shift)
                while least < 0:
                    shift = shift / 2 if shift > 1e-300 else 0.0
                    new_q, new_e, least = _dqds_step(q, e, shift)
                    if shift == 0.0:
                        new_q[-1] = max(new_q[-1], 0.0)
                        break
            q, e, moved = new_q, new_e, moved + shift
        else:
            raise ArithmeticError("dqds did not settle")
        values.append(moved + q[0])
    return np.sort(np.array(values))[::-1] * scale * scale


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float, against: list[np.ndarray], start: np.ndarray | None = None) -> np.ndarray:
    """The unit eigenvector of B'B for `value`: factored from the top and from the bottom, joined at the row where the remainder is smallest.

    With vectors to be kept orthogonal to, the joined factorisation is used to iterate.
    """
    d = len(diagonal)
    main = diagonal * diagonal
    main[1:] += above * above
    side = diagonal[:-1] * above
    floor = EPS * max(float(np.max(main)), 1e-300) * 1e-3

    def kept(x: float) -> float:
        return x if abs(x) > floor else (floor if x >= 0 else -floor)

    top, bottom = np.empty(d), np.empty(d)
    top[0] = kept(main[0] - value)
    for i in range(1, d):
        top[i] = kept(main[i] - value - side[i - 1] * side[i - 1] / top[i - 1])
    bottom[d - 1] = kept(main[d - 1] - value)
    for i in range(d - 2, -1, -1):
        bottom[i] = kept(main[i] - value - side[i] * side[i] / bottom[i + 1])
    remainder = top + bottom - (main - value)
    twist = int(np.argmin(np.abs(remainder)))

    def solve(right_side: np.ndarray) -> np.ndarray:
        """One step of inverse iteration with the factorisation twisted at `twist`."""
        y = right_side.copy()
        for i in range(1, twist + 1):
            y[i] -= side[i - 1] / top[i - 1] * y[i - 1]
        carried = y[twist]
        for i in range(d - 2, twist, -1):
            y[i] -= side[i] / bottom[i + 1] * y[i + 1]
        if twist < d - 1:
            carried -= side[twist] / bottom[twist + 1] * y[twist + 1]
        z = np.zeros(d)
        z[twist] = carried / kept(remainder[twist])
        for i in range(twist - 1, -1, -1):
            z[i] = (y[i] - side[i] * z[i + 1]) / top[i]
        for i in range(twist + 1, d):
            z[i] = (y[i] - side[i - 1] * z[i - 1]) / bottom[i]
        return z

    def cleaned(z: np.ndarray) -> np.ndarray:
        z = z / np.max(np.abs(z))
        for _ in range(2):
            for v in against:
                z = z - v * (v @ z)
        return z / np.linalg.norm(z)

    if start is None:
        start = np.zeros(d)
        start[twist] = 1.0
    z = cleaned(solve(start))
    for _ in range(4 if against else 2):
        z = cleaned(solve(z))
    return z


def directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All squared singular values of R, largest first, and the unit right vectors and refined values of the first `components`."""
    diagonal, above, right = bidiagonal(r)
    values = dqds(diagonal, above)
    scale = float(np.sqrt(values[0])) if len(values) and values[0] > 0 else 1.0
    small = diagonal / scale, above / scale
    vectors: list[np.ndarray] = []
    refined = []
    pick = np.random.default_rng(len(values))
    for k, value in enumerate(values[:components] / (scale * scale)):
        near = [v for v, other in zip(vectors, values / (scale * scale), strict=False) if abs(other - value) <= 1e-3 * max(abs(value), abs(other))]
        z = twisted_vector(*small, float(value), near, pick.standard_normal(len(diagonal)) if near else None)
        vectors.append(z)
        v = reflected(z, right)
        v /= np.linalg.norm(v)
        v *= -1.0 if v[np.argmax(np.abs(v))] < 0 else 1.0
        refined.append((v, float(np.sum((r @ v) ** 2))))
    vs = np.array([v for v, _ in refined]).reshape(len(refined), len(diagonal))
    return values, vs, np.array([e for _, e in refined])


# --- the passes over the rows ----------------------------------------------------------------------------------------


def _matrix(column: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `column` that count, as whole numbers, and their places."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    nulls = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)) if values.null_count else np.zeros(0, np.int64)
    flat = values.to_numpy(zero_copy_only=False).astype(float)
    if len(nulls):
        flat[nulls] = np.nan
    at = np.flatnonzero((np.diff(offsets) == length) & ~column.is_null().to_numpy(zero_copy_only=False))
    rows = flat[offsets[at][:, None] + np.arange(length)] if len(at) else np.zeros((0, length))
    with np.errstate(invalid="ignore"):
        good = (np.abs(rows) < LARGEST).all(1)
    return np.floor(rows[good] * SCALE).astype(np.int64) + SHIFT, at[good]


def _folded(parts: DataFrame, fold: Callable[[list[tuple[int, np.ndarray]]], tuple[int, np.ndarray]]) -> tuple[int, np.ndarray] | None:
    """The partial results (slot, n, values) folded into one, `FOLD` at a time, in the order of their slots."""

    def work(group: pa.Table) -> pa.RecordBatch:
        group = group.sort_by("slot")
        n, values = fold([(k, np.array(v, float)) for k, v in zip(group["n"].to_pylist(), group["values"].to_pylist(), strict=True)])
        slot = group["slot"][0].as_py() // FOLD
        return pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([n], pa.int64()), pa.array([values], pa.list_(pa.float64()))], names=["slot", "n", "values"])

    parts = materialize(parts, "partial")
    left = parts.agg(F.max("slot")).first()[0]
    while left:
        dealt = parts.withColumn("_to", F.floor(F.col("slot") / FOLD))
        parts = materialize(in_groups(dealt, ["_to"], work, PARTIAL), "partial")
        left //= FOLD
    last = parts.first()  # the only row
    return None if last is None else (last.n, np.array(last["values"], float))


def _partials(rows: DataFrame, one: Callable[[Iterator[pa.Array]], tuple[int, np.ndarray] | None]) -> DataFrame:
    """One partial result per task over the vectors of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = one(batch.column(1) for batch in batches)
        if found is not None:
            slot = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([found[0]], pa.int64()), pa.array([found[1]], pa.list_(pa.float64()))], names=["slot", "n", "values"])

    return rows.mapInArrow(run, PARTIAL)


def _sums(rows: DataFrame, length: int) -> tuple[int, list[int]]:
    """The number of rows that count and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(length, np.int64)
        for batch in batches:
            x, _ = _matrix(batch.column(1), length)
            n, total = n + len(x), total + x.sum(0)
        fields = [pa.array(np.arange(length + 1), pa.int64()), pa.array([*total.tolist(), n], pa.int64())]
        yield pa.RecordBatch.from_arrays(fields, names=["dim", "total"])

    found = {r.dim: int(r.total) for r in rows.mapInArrow(run, "dim long, total long").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return found.get(length, 0), [found.get(i, 0) for i in range(length)]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from the whole part and the remainder of S/n, so that the subtraction loses nothing."""
    whole, rest = sums // n, sums % n
    return (x - whole.astype(np.int64)).astype(float) - (rest / n).astype(float)


def _triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def _merged_moments(parts: list[tuple[int, np.ndarray]], k: int) -> tuple[int, np.ndarray]:
    """Counts, means and centred products of the parts together; products are of centred values at every step."""
    n, mean, products = 0, np.zeros(k), np.zeros((k, k))
    for m, values in parts:
        other, more = values[:k], values[k:].reshape(k, k)
        step = other - mean
        products = products + more + np.outer(step, step) * (n * m / (n + m))
        mean = mean + step * (m / (n + m))
        n += m
    return n, np.concatenate([mean, products.ravel()])


def _exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The sum over dimensions of (n * x - S)^2 in whole numbers of any size."""
    if not len(x):
        return []
    span = max(n * int(np.abs(x).max()), int(max(abs(int(s)) for s in sums)))
    if 2 * span < 1 << 62:
        gap = n * x - sums.astype(np.int64)
        largest = int(np.abs(gap).max())
        if largest * largest * x.shape[1] < 1 << 62:
            return (gap * gap).sum(1).tolist()
    gap = n * x.astype(object) - sums.astype(object)
    return (gap * gap).sum(1).tolist()


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Four passes over the vectors: lengths, sums, triangles, and the moments of the whitened values;
    each leaves a few numbers or one small matrix per task. The rows themselves are never shuffled.
    """
    nothing = vectors.sparkSession.createDataFrame([], ROW + ", n bigint, explained double, identity_error double").select(*COLUMNS)
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    lengths = vectors.select(F.size(vectors[vector_col]).alias("length")).filter("length > 0")
    length = lengths.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    if length is None:
        return nothing
    d = int(length["length"])
    n, totals = _sums(rows, d)
    if n == 0:
        return nothing
    sums = np.array(totals, object)

    def triangle(columns: Iterator[pa.Array]) -> tuple[int, np.ndarray] | None:
        held, count = None, 0
        for column in columns:
            x, _ = _matrix(column, d)
            for at in range(0, len(x), BLOCK_ROWS):
                block = _centred(x[at : at + BLOCK_ROWS], n, sums)
                held = _triangle([block] if held is None else [held, block])
            count += len(x)
        return None if held is None else (count, held.ravel())

    def triangles(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        held = parts[0][1].reshape(-1, d)
        for _, v in parts[1:]:
            held = _triangle([held, v.reshape(-1, d)])
        return sum(m for m, _ in parts), held.ravel()

    found = _folded(_partials(rows, triangle), triangles)
    r = np.zeros((d, d))
    small = found[1].reshape(-1, d)
    r[: len(small)] = small
    values, axes, squares = directions(r, min(components, d))
    trace = float(values.sum())
    told = squares > LEAST_SHARE * trace if trace > 0 else np.zeros(len(squares), bool)
    axes, squares = axes[told], squares[told]
    k = len(axes)
    if not k:
        return nothing
    # x - S/n along a component, over the square root of its eigenvalue.
    maps = (axes / np.sqrt(squares / n)[:, None]).T

    def moments(columns: Iterator[pa.Array]) -> tuple[int, np.ndarray] | None:
        parts = []
        for column in columns:
            x, _ = _matrix(column, d)
            for at in range(0, len(x), BLOCK_ROWS):
                w = _centred(x[at : at + BLOCK_ROWS], n, sums) @ maps
                mean = w.mean(0)
                parts.append((len(w), np.concatenate([mean, ((w - mean).T @ (w - mean)).ravel()])))
                parts = [_merged_moments(parts, k)]
        return parts[0] if parts else None

    _, values_of = _folded(_partials(rows, moments), lambda parts: _merged_moments(parts, k))
    error = float(np.abs(values_of[k:].reshape(k, k) / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column(1), d)
            for low in range(0, len(x), BLOCK_ROWS):
                block = x[low : low + BLOCK_ROWS]
                w = _centred(block, n, sums) @ maps
                ids = batch.column(0).take(pa.array(np.repeat(at[low : low + BLOCK_ROWS], k)))
                deviation = pa.array(_exact_deviation(block, n, sums), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(block)), k)))
                number = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(block)))
                yield pa.RecordBatch.from_arrays([ids, number, deviation, pa.array(w.ravel())], names=["vec_id", "component", "deviation", "whitened"])

    explained = F.element_at(F.array(*[F.lit(float(e / trace)) for e in squares]), F.col("component"))
    return rows.mapInArrow(project, ROW).select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )
