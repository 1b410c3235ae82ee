"""Whitening of embeddings with the covariance of one aggregation.

Entries become whole numbers x = floor(256 * c). The fit list is each distinct vector of
them once. One pass gives its size and sums; the next one evaluates, for every pair of
dimensions of the upper triangle, the sum of products of entries less their means, as
generated SQL expressions in one aggregation; LAPACK (a symmetric eigensolver) then works
on the matrix, whose size is that of the dimensions alone. With more than PANEL
dimensions the triangle is cut into panels of rows, an aggregation each, as a plan holds
only so many expressions.

Defined cases: rows whose vector is null or has null, NaN or infinite entries are left
out, as are empty vectors and those of another length than most of the rest have (of
equally frequent lengths the longest counts); entries beyond 2^53 count as that; deviations beyond
38 digits (in the query: beyond a long) are null. Repeated
vectors are in the fit list once and each gets its rows. Components whose variance is
below 1e-12 of the whole (all of them, if the fit list has one vector) are left out, as
nothing can be divided by it; so an input without spread, or an empty one, gives no row.
Null ids stay as they are; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.llm.util import cut

#: Dimensions whose whole triangle is one aggregation, and expressions of one otherwise.
PANEL, EXPRESSIONS = 96, 4_000
#: Entries beyond this are not whole numbers that a double tells apart.
MOST = 2**53
#: Share of the variance under which a component is nothing but rounding.
LEAST = 1e-12


def quantised(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, x (whole numbers) of the rows whose vectors are whole and of the usual length."""
    kept = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    kept = kept.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("v") > 0))
    held = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, F.lit(-float(MOST))), F.lit(float(MOST)))), F.lit(-MOST)), F.lit(MOST)).cast("long")
    return kept.select("vec_id", F.transform("v", held).alias("x"))


def usual_length(rows: DataFrame) -> int:
    """The most frequent length of x; 0 for no rows."""
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    return found["d"] if found else 0


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums of each dimension, and the covariance matrix of fit (x)."""
    first = fit.selectExpr("count(*) AS n", *[f"sum(cast(x[{i}] AS decimal(20, 0))) AS s{i}" for i in range(d)]).first()
    n, sums = first["n"], [int(first[f"s{i}"]) for i in range(d)]
    mean = [s / n for s in sums]
    cell = "sum((x[{i}] - {mi!r}D) * (x[{j}] - {mj!r}D)) AS v{i}_{j}"
    step = d if d <= PANEL else max(1, EXPRESSIONS // d)
    cov = np.zeros((d, d))
    for top in range(0, d, step):
        pairs = [(i, j) for i in range(top, min(d, top + step)) for j in range(i, d)]
        for at in range(0, len(pairs), max(len(pairs) if d <= PANEL else EXPRESSIONS, 1)):
            some = pairs if d <= PANEL else pairs[at : at + EXPRESSIONS]
            row = fit.selectExpr(*[cell.format(i=i, j=j, mi=mean[i], mj=mean[j]) for i, j in some]).first()
            for (i, j), total in zip(some, row, strict=True):
                cov[i, j] = cov[j, i] = total / n
    return n, sums, cov


def decompose(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Falling eigenvalues, unit eigenvectors as rows, trace; of the first components that have a variance."""
    values, vectors = np.linalg.eigh(cov)  # LAPACK; rising
    trace = float(np.trace(cov))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > LEAST * trace]
    return values[order], vectors[:, order].T, trace


def _projection(d: int, mean: list[float], vector: np.ndarray, value: float) -> str:
    return " + ".join(f"(x[{i}] - {mean[i]!r}D) * {float(vector[i] / np.sqrt(value))!r}D" for i in range(d))


def whiten(table: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row and component (from 1): vec_id, component, n, deviation (decimal, exact), whitened, explained, identity_error."""
    rows = quantised(table, vec_id, embedding)
    d = usual_length(rows)
    shape = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    none = rows.where("false").selectExpr(*[f"cast(null AS {t}) AS {c}" for c, t in (x.split(" ") for x in shape.split(", "))])
    if not d:
        return none
    rows = rows.where(F.size("x") == d)
    fit = cut(rows.select("x").distinct())
    n, sums, cov = moments(fit, d)
    values, vectors, trace = decompose(cov, components)
    if not len(values):
        return none
    mean = [s / n for s in sums]
    made = [_projection(d, mean, v, e) for v, e in zip(vectors, values, strict=True)]
    error = identity_error(fit, made)
    off = [f"cast({n}BD * x[{i}] - {sums[i]}BD AS decimal(38, 0))" for i in range(d)]
    deviation = F.expr(f"aggregate(array({', '.join(off)}), cast(0 AS decimal(38, 0)), (s, y) -> try_add(s, cast(try_multiply(y, y) AS decimal(38, 0))))")
    parts = [F.struct(F.lit(k + 1).alias("component"), F.expr(m).alias("whitened"), F.lit(float(values[k] / trace)).alias("explained")) for k, m in enumerate(made)]
    out = rows.select("vec_id", deviation.cast("decimal(38,0)").alias("deviation"), F.explode(F.array(*parts)).alias("c"))
    return out.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))


def identity_error(fit: DataFrame, made: list[str]) -> float:
    """The largest entry, by amount, of the covariance of the made columns over fit, less the identity."""
    white = fit.selectExpr(*[f"{m} AS w{k}" for k, m in enumerate(made)])
    means = white.agg(*[F.avg(f"w{k}") for k in range(len(made))]).first()
    centred: list[Column] = [F.col(f"w{k}") - F.lit(means[k]) for k in range(len(made))]
    pairs = [(i, j) for i in range(len(made)) for j in range(i, len(made))]
    found = white.agg(*[F.avg(centred[i] * centred[j]).alias(f"e{k}") for k, (i, j) in enumerate(pairs)]).first()
    return max(abs(found[k] - (i == j)) for k, (i, j) in enumerate(pairs))
