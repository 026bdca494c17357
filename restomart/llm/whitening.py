"""Whitened amounts of orders: principal components from a distributed covariance, one narrow pass per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import materialize

# Money columns of a stored order that make up its vector of amounts.
AMOUNTS = ("subtotal_cents", "tax_cents", "tip_cents", "total_cents", "delivery_fee_cents", "service_fee_cents",
           "commission_cents")
STEPS = 256  # whole steps per unit that an amount is counted in
COMPONENTS = 4
CLUSTER_GAP = 1e-3  # eigenvalues nearer than this share of the norm are made orthogonal to each other
EPS = np.finfo(float).eps


def order_amounts(orders: DataFrame) -> DataFrame:
    """``id`` and ``amounts`` of stored orders: their money columns as one vector."""
    return orders.select("id", F.array(*[F.col(c).cast("double") for c in AMOUNTS]).alias("amounts"))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that bring a symmetric matrix to that form."""
    a, d, reflectors = np.array(a, float), len(a), []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        beside = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= beside
        size = np.linalg.norm(v)
        v = v / size if size > 0 else np.zeros_like(v)
        reflectors.append(v)
        block = a[k + 1:, k + 1:]
        p = 2 * block @ v
        q = p - (v @ p) * v
        block -= np.outer(v, q) + np.outer(q, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = beside
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value of ``x``: the negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny / EPS
    count, q = np.zeros(len(x), int), np.ones(len(x))
    for i, t in enumerate(diagonal):
        q = t - x - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection until the bounds are neighbours."""
    d, reach = len(diagonal), np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    wanted = d - 1 - np.arange(k)
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    span = max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - span * EPS * d, high + span * EPS * d
    while True:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        less = below(diagonal, off, middle) > wanted
        low, high = np.where(less, low, middle), np.where(less, middle, high)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, norm: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row exchanges."""
    d, least = len(diagonal), EPS * max(norm, np.finfo(float).tiny)
    u, v, w = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    steps = []
    for i in range(d - 1):
        low, next_u, next_v = off[i], u[i + 1], v[i + 1]
        exchanged = abs(low) > abs(u[i])
        if exchanged:
            factor = u[i] / low
            u[i], old = low, v[i]
            v[i], w[i] = next_u, next_v
            u[i + 1], v[i + 1] = old - factor * next_u, -factor * next_v
        else:
            u[i] = u[i] if abs(u[i]) > least else np.copysign(least, u[i])
            factor = low / u[i]
            u[i + 1] = next_u - factor * v[i]
        steps.append((exchanged, factor))
    u[-1] = u[-1] if abs(u[-1]) > least else np.copysign(least, u[-1])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i, (exchanged, factor) in enumerate(steps):
            if exchanged:
                x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
            else:
                x[i + 1] -= factor * x[i]
        for i in range(d - 1, -1, -1):
            x[i] -= (v[i] * x[i + 1] if i + 1 < d else 0.0) + (w[i] * x[i + 2] if i + 2 < d else 0.0)
            x[i] /= u[i]
        return x
    return solve


def principal_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors (rows).

    Householder reflections make the matrix tridiagonal, bisection on Sturm counts finds the
    eigenvalues, and inverse iteration the vectors; those of close eigenvalues are made orthogonal to
    each other in every step. The sign makes the largest entry positive.
    """
    d = len(a)
    scale = np.abs(a).max(initial=0.0)
    if scale == 0:
        return np.zeros(k), np.eye(d)[:k]
    diagonal, off, reflectors = tridiagonal(a / scale)
    values, norm = leading_eigenvalues(diagonal, off, k), np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)
    rng, found, cluster = np.random.default_rng(11), [], 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER_GAP * norm:
            cluster = i
        # Equal eigenvalues get shifts a rounding apart, so that their systems differ.
        solve, x = _solver(diagonal, off, value - (i - cluster) * EPS * norm, norm), rng.standard_normal(d)
        for _ in range(5):
            for other in [*found[cluster:], *found[cluster:]]:
                x -= (other @ x) * other
            x = solve(x / np.linalg.norm(x))
            for other in [*found[cluster:], *found[cluster:]]:
                x -= (other @ x) * other
            x /= np.linalg.norm(x)
        found.append(x)
    out = []
    for x in found:
        for k_, v in reversed(list(enumerate(reflectors))):
            x[k_ + 1:] -= 2 * (v @ x[k_ + 1:]) * v
        out.append(x * np.copysign(1.0, x[np.argmax(np.abs(x))]))
    return values * scale, np.array(out).reshape(k, d)


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(column)).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(d: int, centre: Sequence[float], axes: np.ndarray | None):
    """Per task the sums of centred entries (``i`` = -1) and of their products (row ``i``), of the steps
    themselves or of their projections on ``axes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = d if axes is None else len(axes)
        total, sums = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            x = _matrix(batch, "steps", d) - np.asarray(centre)
            x = x if axes is None else x @ axes.T
            total += x.T @ x
            sums += x.sum(axis=0)
        rows = np.vstack([sums, total])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(-1, width), width)), pa.array(np.tile(np.arange(width), width + 1)),
            pa.array(rows.ravel())], names=["i", "j", "value"])
    return run


def _summed(distinct: DataFrame, d: int, centre: Sequence[float], axes: np.ndarray | None = None) -> np.ndarray:
    """Row 0: sums; the rest: product sums. A task sends one number per entry; they are added in Spark."""
    parts = distinct.mapInArrow(_products(d, centre, axes), "i long, j long, value double")
    width = d if axes is None else len(axes)
    out = np.zeros((width + 1, width))
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"] + 1, r["j"]] = r["value"]
    return out


def _whitened(n: int, sums: Sequence[int], centre: Sequence[float], axes: np.ndarray, roots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sums)
        for batch in batches:
            x = _matrix(batch, "steps", d)
            far = max((max(abs(n * int(x[:, j].max(initial=0)) - s), abs(n * int(x[:, j].min(initial=0)) - s))
                       for j, s in enumerate(sums)), default=0)
            if d * far * far < 1 << 62:
                away = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                away = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
            scores = (x - np.asarray(centre)) @ axes.T / roots
            fits = [v if v < 1 << 63 else None for v in away]
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("row")), pa.array(fits, pa.int64()),
                pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * scores.shape[1], scores.ravel())], names=["row", "deviation", "scores"])
    return run


def _usable(amounts: Column) -> Column:
    value = lambda v: v.cast("double")
    plain = lambda v: v.isNotNull() & ~F.isnan(value(v)) & (F.abs(value(v)) < float("inf"))
    return amounts.isNotNull() & (F.size(amounts) > 0) & F.coalesce(F.forall(amounts, plain), F.lit(False))


def whitened_amounts(orders: DataFrame, components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """Orders' amounts on the leading principal components, scaled to unit variance.

    Takes ``orders`` with ``id`` and ``amounts`` (an array of numbers; ``order_amounts`` makes it from the
    money columns of stored orders, and any table of vectors will do). An amount c counts as
    floor(``steps`` * c) whole steps. Mean and covariance are those of the distinct vectors of steps, so
    that an order that is copied often does not pull them. Gives one row per order and component:
    ``id``, ``component`` (from 1, by falling variance), ``n`` (distinct vectors), ``deviation`` (sum of
    (n * x - S)^2, exact; null if beyond 64 bits), ``whitened``, ``explained`` (share of the total
    variance) and ``identity_error`` (largest distance of the whitened covariance from the identity).

    Sums, centred products and the check of the result are three passes of partial sums over the distinct
    vectors; only the d x d matrix reaches the driver, which finds its leading eigenvectors. Their
    broadcast is of ``components`` x d numbers.

    Orders without amounts, with a null or non-finite amount, or with none at all are left out. Vectors
    of another length than the most frequent one (the longest such) are left out too. Components whose
    variance is nil up to rounding cannot be scaled and are not given, so one distinct vector, like an
    empty table, gives an empty result. Equal rows and null ids give their own rows. Other columns are
    ignored.
    """
    usable = orders.filter(_usable(F.col("amounts"))).select(
        F.struct("id").alias("row"),
        F.transform("amounts", lambda c: F.floor(steps * c.cast("double")) + F.lit(0)).alias("steps"))
    length = usable.groupBy(F.size("steps").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = orders.schema["id"].dataType.simpleString()
    out = f"row struct<id: {kind}>, deviation long, scores array<double>"
    if length is None:
        found, n, explained, error = orders.sparkSession.createDataFrame([], out), 0, [], 0.0
    else:
        d = length["d"]
        usable = usable.filter(F.size("steps") == d)
        distinct = materialize(usable.select("steps").distinct(), "distinct-amounts")
        totals = distinct.select(F.posexplode("steps").alias("j", "x")).groupBy("j").agg(
            F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
        sums, n = [int(r["s"]) for r in sorted(totals, key=lambda r: r["j"])], totals[0]["n"]
        centre = [s / n for s in sums]
        covariance = _summed(distinct, d, centre)[1:] / n
        covariance = (covariance + covariance.T) / 2
        values, axes = principal_components(covariance, min(components, d))
        kept = values > d * EPS * max(values[0], 0.0)
        values, axes = values[kept], axes[kept]
        explained = (values / np.trace(covariance)).tolist() if len(values) else []
        roots, error = np.sqrt(values), 0.0
        if len(values):
            scaled = axes / roots[:, None]
            means = _summed(distinct, d, centre, scaled)[0] / n
            # The second pass is centred on the mean of what the first one gave.
            moved = [c + m for c, m in zip(centre, np.linalg.lstsq(scaled, means, rcond=None)[0])]
            error = float(np.abs(_summed(distinct, d, moved, scaled)[1:] / n - np.eye(len(values))).max())
        found = usable.mapInArrow(_whitened(n, sums, centre, axes, roots), out)
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    return found.select("row.id", F.posexplode("scores").alias("at", "whitened"), "deviation").select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
