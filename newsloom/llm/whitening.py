"""Whitening of embeddings by the covariance of their integer form."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import PREFIX, read_table

#: An entry c becomes floor(SCALE * c) + SHIFT (fixed values); entries of LARGEST and more in magnitude have no such long and count as not finite.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**40
#: Components that are returned.
COMPONENTS = 8


@dataclasses.dataclass(frozen=True)
class Whitening:
    """A fit: count, exact sums, unit eigenvectors in rows, eigenvalues falling, the trace, and whether deviations fit in long."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    fits_long: bool

    @property
    def usable(self) -> list[bool]:
        """Components along which the vectors vary at all, to double precision."""
        least = self.trace * len(self.sums) * np.finfo(float).eps
        return [bool(e > least) for e in self.eigenvalues]


def valid_vectors(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(rows whose vector can be used, their dimension). Null vectors, ones with null or non-finite entries and empty ones go. A
    covariance needs one dimension: that of most vectors, the larger on a tie; others go too. The dimension is 0 if none is left."""
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c) < F.lit(LARGEST), F.lit(False)))
    found = rows.where(F.coalesce(usable, F.lit(False)) & (F.size(vector) > 0))
    best = found.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = best["d"] if best else 0
    return found.where(F.size(vector) == d), d


def _integer(c: str) -> str:
    """SQL of an entry's long form."""
    return f"(cast(floor({SCALE} * cast({c} AS double)) AS bigint) + {SHIFT})"


def centred_products(rows: DataFrame, vector: str, sums: list[int], n: int) -> np.ndarray:
    """The sums of (x_i - S_i / n) (x_j - S_j / n) over all rows, in one aggregation. A group is a row i of the upper triangle, and a
    generated expression a column j, so that each pair of dimensions has its sum; as d (d + 1) / 2 columns of a single row they would
    be too much for generated code. Partial sums are combined before the shuffle: d rows of d numbers a task."""
    d = len(sums)
    names = [f"y{j}" for j in range(d)]
    centred = rows.selectExpr(*[f"coalesce({_integer(f'`{vector}`[{j}]')} - {s / n!r}D, 0D) AS y{j}" for j, s in enumerate(sums)])
    dealt = centred.selectExpr(*names, f"posexplode({_array(names)}) AS (i, y)")
    found = dealt.groupBy("i").agg(*[F.expr(f"sum(if(i <= {j}, y * y{j}, 0D)) AS p{j}") for j in range(d)])
    upper = np.zeros((d, d))
    for r in found.collect():
        upper[r["i"]] = r[1:]
    return np.triu(upper) + np.triu(upper, 1).T


def fit_whitening(rows: DataFrame, vector: str, d: int) -> Whitening | None:
    """Two aggregations over all rows: counts, sums and ranges of the dimensions, then their centred products. What reaches the driver is
    d rows and d by d numbers, whatever the rows; LAPACK decomposes the covariance there. Components fall by eigenvalue, each
    with its largest entry positive. None for an empty table."""
    entries = rows.selectExpr(f"posexplode(`{vector}`) AS (i, c)").selectExpr("i", f"{_integer('c')} AS x")
    per = entries.groupBy("i").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i").collect()
    if not per:
        return None
    n, sums = per[0]["n"], [r["s"] for r in per]
    cov = centred_products(rows, vector, sums, n) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    components = vectors.T[order]
    components *= np.where(components[np.arange(d), np.abs(components).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    reach = [max(abs(n * r["low"] - r["s"]), abs(n * r["high"] - r["s"])) for r in per]
    widest = max(n * max(abs(r["low"]), abs(r["high"])) for r in per)
    return Whitening(n, sums, components, values[order], float(np.trace(cov)), sum(r * r for r in reach) < 2**63 and widest < 2**63)


def _array(values) -> str:
    return f"array({', '.join(values)})"


def _deviation(fit: Whitening) -> str:
    """SQL of the sum of (n x - S)^2. Plain longs where the ranges of the dimensions prove that no row can overflow them; else decimals,
    and null where the exact number has no long."""
    if fit.fits_long:
        parts = f"zip_with({PREFIX}x, {_array(f'{s}L' for s in fit.sums)}, (x, s) -> x * {fit.n}L - s)"
        return f"aggregate({parts}, 0L, (total, v) -> total + v * v)"
    wide = "cast(try_subtract(try_multiply(cast(x AS decimal(20,0)), cast({n} AS decimal(18,0))), cast(s AS decimal(20,0))) AS decimal(38,0))"
    parts = f"zip_with({PREFIX}x, {_array(f'{s}L' for s in fit.sums)}, (x, s) -> {wide.format(n=fit.n)})"
    return f"try_cast(aggregate({parts}, cast(0 AS decimal(38,0)), (total, v) -> cast(try_add(total, try_multiply(v, v)) AS decimal(38,0))) AS bigint)"


def _projected(rows: DataFrame, vector: str, fit: Whitening, k: int, keep: list[str]) -> DataFrame:
    """keep, the long form of the vectors, and the coordinates w0 to w{k-1}. Arrays, not a column a dimension: a projection on every component
    is too much code for one method."""
    x = f"transform(`{vector}`, c -> {_integer('c')}) AS {PREFIX}x"
    y = f"zip_with({PREFIX}x, {_array(f'{s / fit.n!r}D' for s in fit.sums)}, (x, mean) -> x - mean) AS {PREFIX}y"
    found = rows.selectExpr(*keep, x).selectExpr(*keep, f"{PREFIX}x", y)
    for c in range(k):
        weights = _array(f"{float(w)!r}D" for w in fit.components[c] / np.sqrt(fit.eigenvalues[c])) if fit.usable[c] else None
        dot = f"aggregate(zip_with({PREFIX}y, {weights}, (y, w) -> y * w), 0D, (total, v) -> total + v)" if weights else "cast(NULL AS double)"
        found = found.withColumn(f"w{c}", F.expr(dot))
    return found


def identity_error(rows: DataFrame, vector: str, fit: Whitening, k: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the components that vary, from one more
    aggregation; None if none does."""
    used = [c for c in range(min(k, len(fit.sums))) if fit.usable[c]]
    if not used:
        return None
    white = _projected(rows, vector, fit, min(k, len(fit.sums)), [])
    found = white.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in used for b in used if a <= b]).first().asDict()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a in used for b in used if a <= b)


def whiten(rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component 1 to k (all, if there are fewer): the id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries go, as do those of another dimension than most; so an empty
    table gives an empty result. Ids may be null or repeat: rows are neither joined nor grouped. Along components without variance
    `whitened` is null, and identity_error leaves them out (null if none is left); `explained` is null if nothing varies. Other
    columns are dropped, whatever their names. The fit reads the table four times in the JVM and shuffles only partial sums.
    """
    schema = f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found, d = valid_vectors(rows.select(id_column, vector), vector)
    fit = fit_whitening(found, vector, d) if d else None
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = min(k, d)
    error = identity_error(found, vector, fit, k)
    white = _projected(found, vector, fit, k, [f"`{id_column}`"])
    number = lambda v: f"{v!r}D" if v is not None else "cast(NULL AS double)"
    share = [float(fit.eigenvalues[c]) / fit.trace if fit.trace > 0 else None for c in range(k)]
    rows_of = ", ".join(f"struct({c + 1} AS component, w{c} AS whitened, {number(share[c])} AS explained)" for c in range(k))
    white = white.selectExpr(f"`{id_column}`", f"{_deviation(fit)} AS {PREFIX}deviation", f"array({rows_of}) AS {PREFIX}rows")
    return white.selectExpr(f"`{id_column}`", f"{PREFIX}deviation", f"inline({PREFIX}rows)").selectExpr(
        f"`{id_column}`", "component", f"{fit.n}L AS n", f"{PREFIX}deviation AS deviation", "whitened", "explained", f"{number(error)} AS identity_error"
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten() over all of embeddings."""
    return whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
