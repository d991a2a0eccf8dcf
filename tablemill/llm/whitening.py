"""Whitening of vectors by principal components, found by spectral divide and conquer.

Rows give sums and centred products, which Spark adds up; what comes to the driver is a matrix of the
vectors' dimension. Its eigenvectors are found by splitting, not by an iteration on single vectors: the
polar factor of the matrix minus a shift is +1 on the space of eigenvalues above the shift and -1 below, so
(factor + 1) / 2 projects onto it. Bases of both spaces turn the matrix into two smaller ones, which are split
again. Polar factors come from QDWH, Halley's iteration with weights that follow the smallest singular
value, which needs six steps however badly the matrix is conditioned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.store import Workspace
from tablemill.llm.vectors import usable

EPS = np.finfo(np.float64).eps
CHUNK = 4096
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# -- eigenvectors ---------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps.

    Each step is x(aI + b x'x)(I + c x'x)^-1; the inverse is taken by QR of the stacked matrix while c is
    large, which is stable for any condition, and by solving with I + c x'x once it is near the identity.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS  # singular values below it only take more steps
    eye = np.eye(n)
    for _ in range(60):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * x.T @ x, x.T).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved < np.cbrt(EPS) / 10 and 1 - low < 10 * EPS:
            break
    return x


def _spaces(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces above and below ``shift``, or None where the shift splits nothing."""
    n = len(a)
    above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(np.trace(above)))
    if not 0 < rank < n:
        return None
    # columns of a projector span its space; a second pass mends what a bad choice of columns costs
    order = np.argsort(-np.linalg.norm(above, axis=0), kind="stable")
    q, _ = np.linalg.qr(above[:, order])
    basis, _ = np.linalg.qr(above @ q[:, :rank])
    full, _ = np.linalg.qr(np.hstack((basis, np.eye(n) - above @ above)))
    return full[:, :rank], full[:, rank:n]


def _split(a: np.ndarray, basis: np.ndarray, size: float) -> list[tuple[float, np.ndarray]]:
    """Eigenvalues and vectors of ``a``, whose space has ``basis``."""
    stack, out = [(a, basis)], []
    while stack:
        a, basis = stack.pop()
        n = len(a)
        middle = np.trace(a) / n
        rest = np.linalg.norm(a - middle * np.eye(n))
        if n == 1 or rest <= 4 * EPS * size:
            out += [(float(a[i, i]), basis[:, i]) for i in range(n)]
            continue
        # an eigenvalue at the shift belongs to neither side, and the bases do not part the matrix
        best = float("inf"), None
        for shift in (np.median(np.diag(a)), middle, middle + rest / (3 * n), middle - rest / (3 * n)):
            spaces = _spaces(a, float(shift))
            if spaces:
                best = min(best, (float(np.linalg.norm(spaces[0].T @ a @ spaces[1])), spaces), key=lambda b: b[0])
            if best[0] <= 4 * n * EPS * max(rest, EPS * size):
                break
        spaces = best[1]
        if spaces is None:
            raise ArithmeticError("no shift splits the covariance")
        for space in spaces:
            part = space.T @ a @ space
            stack.append(((part + part.T) / 2, basis @ space))
    return out


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors, nearer by one step that squares the error of approximate ones.

    Values too near each other to be told apart have any basis of their space, which is only straightened.
    """
    lost = np.eye(len(a)) - x.T @ x
    turned = x.T @ a @ x
    turned = (turned + turned.T) / 2  # rounding apart, a step only turns
    value = np.diag(turned) / (1 - np.diag(lost))
    apart = value[None, :] - value[:, None]
    near = np.abs(apart) <= np.sqrt(EPS) * np.linalg.norm(a)
    step = np.where(near, lost / 2, (turned + value[None, :] * lost) / np.where(near, 1, apart))
    x = x + x @ step
    return value, x / np.linalg.norm(x, axis=0)


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns."""
    size = np.linalg.norm(covariance)
    if size == 0 or not len(covariance):
        return np.zeros(len(covariance)), np.eye(len(covariance))
    found = _split(covariance / size, np.eye(len(covariance)), 1.0)
    vectors = np.column_stack([v for _, v in found])
    values, vectors = refined(covariance / size, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, vectors[:, order]


# -- tables ---------------------------------------------------------------------------------------


def _matrices(batches, dim: int):
    """Ids and whole numbers of each batch as a matrix; see :func:`whiten` for the scale."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part.column(0), np.asarray(part.column(1).flatten()).reshape(-1, dim)


def _sums(dim: int):
    def run(batches):
        total, n = [0] * dim, 0
        for _, y in _matrices(batches, dim):
            if np.abs(y).max(initial=0) < 1 << 50:
                part = y.sum(0, dtype=np.int64).tolist()
            else:
                part = y.astype(object).sum(0).tolist()
            total = [a + b for a, b in zip(total, part, strict=True)]
            n += len(y)
        if n:
            yield pa.RecordBatch.from_pydict({"j": pa.array(range(dim), pa.int32()), "n": [n] * dim, "s": [str(t) for t in total]})

    return run


def _centred(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * y - sums, exact (as objects where 64 bits do not hold it), and that over n."""
    widest = max(int(y.max(initial=0)), -int(y.min(initial=0)), *map(abs, sums)) if len(y) else 0
    if widest * n < 1 << 61:
        off = y * np.int64(n) - np.array(sums, dtype=np.int64)
        return off, off / n
    off = y.astype(object) * n - np.array(sums, dtype=object)
    return off, (off / n).astype(np.float64)


def _products(dim: int, of):
    """Sums of the products of all pairs of columns, the lower triangle as rows (i, j, v)."""
    i, j = np.tril_indices(dim)

    def run(batches):
        total, some = np.zeros((dim, dim)), False
        for z in of(batches):
            total += z.T @ z
            some = True
        if some:
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    return run


def _matrix(products: DataFrame, dim: int) -> np.ndarray:
    """The sum over tasks; what comes to the driver depends on the dimension only."""
    found = products.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((dim, dim))
    out[found["i"], found["j"]] = out[found["j"], found["i"]] = found["v"]
    return out


def _deviation(off: np.ndarray) -> list[int | None]:
    if off.dtype != object and np.abs(off).max(initial=0) < 3_000_000_000 / np.sqrt(max(1, off.shape[1])):
        return (off * off).sum(1).tolist()
    exact = (off.astype(object) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, k: int = 32) -> DataFrame:
    """Each vector's first ``k`` principal components, scaled to unit variance and no covariance.

    ``vectors`` has vec_id and embedding. An entry c counts as x = floor(64 c) + 1,000,000. The fit list is all
    vectors that take part, n of them with sums S; components are unit eigenvectors of their covariance
    (divisor n), numbered from 1 by falling eigenvalue e. A row per vector and component: vec_id,
    component, n, deviation (the sum over dimensions of (n x - S)^2, exact; null from 2**63 on),
    whitened (x - S/n projected, over sqrt(e)), explained (e over the trace), identity_error (the largest
    entry by which the covariance of whitened departs from the identity, measured on all rows).

    Vectors that are null or empty, or hold null or non-finite entries or entries whose x is no 64-bit number, take
    no part. Vectors of each length are a fit list of their own. Components without variance (to working precision)
    cannot be scaled and are left out, so equal vectors alone, or one, give no rows; nor does an empty table. Null and
    repeated ids are carried along; repeated rows count as often as they come. Other columns are not looked at.

    Broadcast are a mean and k directions; rows are never grouped or shuffled, only sums are.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "whitened")
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * 64))
    fits = F.forall("embedding", lambda c: F.abs(c.cast("double") * 64) < float(1 << 62))
    good = vectors.where(usable(F.col("embedding"))).where(fits)
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(whole, lambda x: x.cast("long")).alias("y"))
    out = None
    for dim in sorted(r["dim"] for r in rows.select(F.size("y").alias("dim")).distinct().collect()):
        mine = rows.where(F.size("y") == dim)
        found = _whitened(mine, dim, k, work)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], OUT) if out is None else out


def _whitened(rows: DataFrame, dim: int, k: int, work: Workspace) -> DataFrame:
    added = rows.mapInArrow(_sums(dim), "j int, n long, s string").groupBy("j")
    added = {r["j"]: r for r in added.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n, sums = added[0]["n"], [int(added[j]["s"]) for j in range(dim)]

    def centred(batches):
        for _, y in _matrices(batches, dim):
            yield _centred(y, n, sums)[1]

    covariance = _matrix(rows.mapInArrow(_products(dim, centred), "i int, j int, v double"), dim) / n
    values, directions = components(covariance)
    kept = int((values[:k] > dim * EPS * values[0]).sum()) if dim and values[0] > 0 else 0
    if not kept:
        return rows.sparkSession.createDataFrame([], OUT)
    turn = directions[:, :kept] / np.sqrt(values[:kept])

    def turned(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("z", pa.list_(pa.float64()))])
        for ids, y in _matrices(batches, dim):
            off, middle = _centred(y, n, sums)
            z = middle @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * kept, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(_deviation(off), pa.int64()), lists], schema=schema)

    made = work.write(rows.mapInArrow(turned, "vec_id long, deviation long, z array<double>"))

    def again(batches):
        for _, z in _matrices((b.select(["vec_id", "z"]) for b in batches), kept):
            yield z  # centred: x - S/n sums to zero over the fit list

    measured = _matrix(made.mapInArrow(_products(kept, again), "i int, j int, v double"), kept) / n
    error = float(np.abs(measured - np.eye(kept)).max())
    explained = F.array(*[F.lit(float(v)) for v in values[:kept] / np.trace(covariance)])
    long = made.select("vec_id", "deviation", F.posexplode("z").alias("place", "whitened"))
    return long.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("place")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
