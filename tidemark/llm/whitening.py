"""Whitening of embeddings: covariance of all dimension pairs in one aggregation, LAPACK on the result.

Entries become whole numbers x = floor(1024 c) + 100000. One pass takes their sums and ranges, a
second one the sums of products of every pair of dimensions of the upper triangle, each centred at
the whole number next to its mean. These sums are whole numbers as well, and so exact in doubles
while n times the square of the widest range stays below 2^53; what is left to the exact mean is
subtracted in fractions, and the covariance is rounded once. Wider data loses the last digits only.

Cases. Rows whose vector is null, or holds null, NaN or infinite entries, are dropped, as are those
not of the commonest length (the longest of equals; an empty vector never counts). Repeated rows count
each; ids may be null or repeat. An empty table gives no rows. Entries beyond +-2^52 are taken as that.
Components without variance have null whitened values. A deviation beyond 64 bits is null. Other
columns stay, but those named as the new ones; names with a leading underscore are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
SUMS = 9_000  # of pairs in one aggregation: all of them up to 133 dimensions, beyond in several
LEAST = 1e-12  # of the largest eigenvalue; below, a component has no variance
EXACT = 2**62


@dataclass(frozen=True)
class Whitening:
    """n vectors of d dimensions; sums of x; centre: whole numbers next to the means; eigenvalues
    falling, with one row of components for each; trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    centre: tuple[int, ...]
    reach: int
    values: np.ndarray
    components: np.ndarray
    trace: float


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a vector of finite numbers."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)


def _whole(df: DataFrame, vector: str, d: int) -> DataFrame:
    """df's usable rows of d dimensions with _x, the array of their whole numbers."""
    reach = F.lit(2.0**52)
    whole = F.transform(vector, lambda c: (F.floor(SCALE * F.greatest(F.least(c.cast("double"), reach), -reach)) + SHIFT).cast("long"))
    return usable(df, vector).filter(F.size(vector) == d).withColumn("_x", whole)


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Components of all usable vectors of df; None where there are none.

    What reaches the driver is one row of 3 d and d (d + 1) / 2 numbers, whatever the rows.
    """
    lengths = usable(df, vector).groupBy(F.size(vector).alias("d")).count()
    commonest = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if commonest is None:
        return None
    d, n = commonest["d"], commonest["count"]
    x = _whole(df, vector, d).select("_x")
    first = x.agg(
        *(F.expr(f"sum(cast(_x[{k}] as decimal(20, 0))) as s{k}") for k in range(d)),
        *(F.expr(f"min(_x[{k}]) as l{k}") for k in range(d)),
        *(F.expr(f"max(_x[{k}]) as h{k}") for k in range(d)),
    ).first()
    sums = [int(first[f"s{k}"]) for k in range(d)]
    centre = [round(Fraction(s, n)) for s in sums]
    reach = max(max(first[f"h{k}"] - c, c - first[f"l{k}"]) for k, c in enumerate(centre))
    y = x.selectExpr(*(f"cast(_x[{k}] - {c}L as double) as _y{k}" for k, c in enumerate(centre)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    products: list[float] = []
    for at in range(0, len(pairs), SUMS):
        products += y.agg(*(F.expr(f"sum(_y{i} * _y{j}) as p{i}_{j}") for i, j in pairs[at : at + SUMS])).first()
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    cov = np.zeros((d, d))
    for (i, j), p in zip(pairs, products, strict=True):
        exact = Fraction(p) / n - Fraction(rest[i] * rest[j], n * n)
        cov[i, j] = cov[j, i] = float(exact)
    values, vectors = np.linalg.eigh(cov)
    return Whitening(n, tuple(sums), tuple(centre), reach, values[::-1], vectors.T[::-1], float(np.trace(cov)))


def transform(df: DataFrame, model: Whitening, k: int = 8, vector: str = "embedding") -> DataFrame:
    """df's usable rows with deviation (exact) and whitened, an array of the first k components."""
    d, n = len(model.sums), model.n
    k = min(k, d)
    kept = [f"`{c}`" for c in df.columns if c not in ("deviation", "whitened")]
    out = _whole(df, vector, d)
    rest = [s - n * c for s, c in zip(model.sums, model.centre, strict=True)]
    # n x - S = n (x - centre) - rest, squared and summed in whole numbers
    if d * (n * (model.reach + 1)) ** 2 < EXACT:
        terms = [f"({n}L * (_x[{i}] - {c}L) - {r}L)" for i, (c, r) in enumerate(zip(model.centre, rest, strict=True))]
        deviation = " + ".join(f"{t} * {t}" for t in terms)
    else:
        wide = [f"try_subtract(try_multiply(cast({n} as decimal(19, 0)), cast(_x[{i}] - {c}L as decimal(19, 0))), cast({r} as decimal(38, 0)))" for i, (c, r) in enumerate(zip(model.centre, rest, strict=True))]
        deviation = "cast(0 as decimal(38, 0))"
        for t in wide:
            deviation = f"try_add({deviation}, try_multiply({t}, {t}))"
        deviation = f"try_cast({deviation} as bigint)"
    least = LEAST * max(float(model.values[0]), 0.0)
    centred = out.selectExpr(*kept, f"{deviation} as deviation", *(f"cast(_x[{i}] - {c}L as double) - ({r / n!r}D) as _y{i}" for i, (c, r) in enumerate(zip(model.centre, rest, strict=True))))
    whitened = []
    for e, w in zip(model.values[:k], model.components[:k], strict=True):
        dot = " + ".join(f"_y{i} * ({float(c)!r}D)" for i, c in enumerate(w))
        whitened.append(f"({dot}) / {float(np.sqrt(e))!r}D" if e > least else "cast(null as double)")
    return centred.selectExpr(*kept, "deviation", f"array({', '.join(whitened)}) as whitened")


def identity_error(whitened: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of whitened, less the identity, over all rows.

    covar_pop centres as it goes; components without variance are left out.
    """
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = whitened.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    off = [abs(v - (i == j)) for (i, j), v in zip(pairs, row, strict=True) if v is not None]
    return max(off, default=None)


def whiten(df: DataFrame, k: int = 8, vector: str = "embedding") -> DataFrame:
    """df's usable rows, one for each of the first k components: component, n, deviation, whitened,
    explained and identity_error, which is measured over all rows."""
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    df = df.drop(*new)
    own = [f"`{c}`" for c in df.columns]
    model = fit(df, vector)
    if model is None:
        kinds = ("int", "bigint", "bigint", "double", "double", "double")
        return df.limit(0).selectExpr(*own, *(f"cast(null as {kind}) as {name}" for name, kind in zip(new, kinds, strict=True)))
    k = min(k, len(model.sums))
    rows = transform(df, model, k, vector)
    error = identity_error(rows, k)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values[:k]]
    each = F.array(*(F.struct(F.lit(c + 1).alias("component"), F.col("whitened")[c].alias("whitened"), F.lit(explained[c]).cast("double").alias("explained")) for c in range(k)))
    one = F.lit(error).cast("double").alias("identity_error")
    return rows.withColumn("_c", F.explode(each)).select(*own, "_c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "_c.whitened", "_c.explained", one)
