"""Whitening of embeddings by QDWH spectral divide-and-conquer.

The covariance V of all different vectors is summed up in Spark: first counts and sums, then products of
centred vectors, one matrix per task. Its eigenvectors come from polar decompositions. For a shift s between
eigenvalues, V - s I = U H with U the matrix sign function, so (U + I) / 2 projects on the eigenvectors above
s. QDWH finds U by dynamically weighted Halley steps, each a QR factorisation. Bases of both subspaces make two
smaller problems, until each has one eigenvalue. The axes are then broadcast and vectors projected on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.llm.textops import map_batches
from rateframe.llm.va_search import whole_numbers
from rateframe.session import materialize

EPS = float(np.finfo("float64").eps)
FLUSH_ENTRIES = 1 << 22
BROADCAST_NUMBERS = 1 << 20
MODEL = "d int, n long, sums array<long>, axes array<struct<component:int,axis:array<double>,scale:double,explained:double>>"


# --- QDWH on one symmetric matrix ---------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps in QR form."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS / n  # a bound below the least singular value: too small a one costs a step, no accuracy
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved < np.cbrt(EPS) and 1 - low < 10 * EPS:
            break
    return x


def _shifts(v: np.ndarray) -> Iterator[float]:
    """Numbers to divide the eigenvalues at. The mean always has some on both sides, and so have numbers near it."""
    diagonal = np.diag(v)
    mean, spread = diagonal.mean(), np.linalg.norm(v - diagonal.mean() * np.eye(len(v))) / len(v)
    yield float(np.median(diagonal))
    yield float(mean)
    for step in (0.11, -0.13, 0.29, -0.31, 0.47, -0.53, 0.71, -0.73, 0.89, -0.97):
        yield float(mean + step * spread)


def _divide(v: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below a shift; None if all eigenvalues are equal."""
    n = len(v)
    if np.linalg.norm(v - np.trace(v) / n * np.eye(n)) <= tolerance:
        return None
    start = np.random.default_rng(n).standard_normal((n, n))
    best = None
    for shift in _shifts(v):
        shifted = v - shift * np.eye(n)
        if not np.linalg.norm(shifted):
            continue
        projector = (polar_factor(shifted) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        upper, _ = np.linalg.qr(projector @ start[:, :k])
        upper, _ = np.linalg.qr(projector @ upper)
        whole, _ = np.linalg.qr(upper, mode="complete")
        lower = whole[:, k:]
        mixed = np.linalg.norm(lower.T @ v @ upper)  # what is left between the subspaces
        if best is None or mixed < best[0]:
            best = (mixed, upper, lower)
        if mixed <= tolerance:
            break
    return best[1:]


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix. Equal eigenvalues have
    some orthonormal basis."""
    tolerance = 4 * EPS * len(v) * np.linalg.norm(v)
    axes, open_ = [], [np.eye(len(v))]
    while open_:
        basis = open_.pop()
        inner = basis.T @ v @ basis
        parts = _divide((inner + inner.T) / 2, tolerance) if basis.shape[1] > 1 else None
        if parts is None:
            axes.append(basis)
        else:
            open_ += [basis @ part for part in parts]
    vectors = np.hstack(axes)
    vectors, signs = np.linalg.qr(vectors)
    vectors = vectors * np.where(np.diag(signs) < 0, -1, 1)
    values = np.einsum("ij,ik,kj->j", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(v))]
    return values, vectors * np.where(lead < 0, -1, 1)


# --- sums in Spark --------------------------------------------------------------

def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    return batch["d"].to_numpy()


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A list column whose values have one length, as a matrix."""
    flat = batch[column].flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _products(batches):
    """Sums of products of centred components, upper triangle, per vector length."""
    held: dict[int, np.ndarray] = {}

    def flush():
        for d, total in held.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d, "int32")), pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(total[i, j])],
                names=["d", "i", "j", "product"],
            )
        held.clear()

    for batch in batches:
        lengths = _lengths(batch)
        for d in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == d))
            centred = _matrix(part, "x") - _matrix(part, "sums") / part["n"].to_numpy()[:, None]
            held[d] = held.get(d, 0.0) + centred.T @ centred
            if sum(m.size for m in held.values()) > FLUSH_ENTRIES:
                yield from flush()
    yield from flush()


def _axes(components: int):
    """The model of one vector length from its (i, j, product) entries."""

    def fit(entries: pa.Table) -> pa.Table:
        d, n, sums = entries["d"][0].as_py(), entries["n"][0].as_py(), entries["sums"][0].as_py()
        v = np.zeros((d, d))
        i, j, product = (entries[c].to_numpy() for c in ("i", "j", "product"))
        v[i, j] = v[j, i] = product / n
        values, vectors = spectrum(v)
        trace = float(np.trace(v))
        least = EPS * d * max(values[0], 0.0)
        axes = [
            {
                "component": c + 1,
                "axis": vectors[:, c].tolist(),
                "scale": float(1 / np.sqrt(values[c])) if values[c] > least else 0.0,
                "explained": float(max(values[c], 0.0) / trace) if trace > 0 else 0.0,
            }
            for c in range(min(components, d))
        ]
        kind = pa.list_(pa.struct([("component", pa.int32()), ("axis", pa.list_(pa.float64())), ("scale", pa.float64()), ("explained", pa.float64())]))
        return pa.table({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([sums], pa.list_(pa.int64())), "axes": pa.array([axes], kind)})

    return fit


def _with_model(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Rows with the model of their length, which is broadcast if all models together are small."""
    numbers = model.agg(F.sum(F.col("d") * F.lit(8))).first()[0] or 0
    return rows.join(F.broadcast(model) if numbers <= BROADCAST_NUMBERS else model, "d")


def fit(different: DataFrame, components: int) -> DataFrame:
    """The model (d, n, sums, axes) per vector length of a table of different (x array<long>, d)."""
    sums = different.select("d", F.posexplode("x").alias("i", "x")).groupBy("d", "i").agg(F.count("*").alias("n"), F.sum("x").alias("sum"))
    sums = sums.groupBy("d").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "sum"))), lambda s: s["sum"]).alias("sums"))
    sums = materialize(sums, "vector-sums")
    numbers = sums.agg(F.sum("d")).first()[0] or 0
    small = F.broadcast(sums) if numbers <= BROADCAST_NUMBERS else sums
    products = map_batches(different.join(small, "d").select("d", "n", "x", "sums"), _products, "d int, i int, j int, product double")
    products = products.groupBy("d", "i", "j").agg(F.sum("product").alias("product"))
    return materialize(products.join(small, "d").groupBy("d").applyInArrow(_axes(components), MODEL), "axes")


# --- projections -----------------------------------------------------------------

def _deviation():
    """Exact sum of (n x - S) squared; null beyond 64 bits."""
    parts = F.zip_with("x", "sums", lambda x, s: F.try_subtract(F.try_multiply(F.col("n"), x), s))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: F.try_add(total, F.try_multiply(p, p)))


def _projected(rows: DataFrame) -> DataFrame:
    """(vec_id, n, deviation, component, whitened, explained) of rows with their model."""
    centred = F.zip_with("x", "sums", lambda x, s: x - s.cast("double") / F.col("n"))
    rows = rows.select("*", centred.alias("centred"), _deviation().alias("deviation"))
    rows = rows.select("*", F.explode("axes").alias("a"))
    product = F.aggregate(F.zip_with("centred", "a.axis", lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)
    return rows.select("*", F.col("a.component").alias("component"), (product * F.col("a.scale")).alias("whitened"), F.col("a.explained").alias("explained"))


def _identity_error(different: DataFrame, model: DataFrame, components: int) -> DataFrame:
    """Per length, the largest entry of the whitened vectors' covariance minus the identity."""
    rows = _with_model(different, model)
    centred = F.zip_with("x", "sums", lambda x, s: x - s.cast("double") / F.col("n"))
    rows = rows.select("d", "axes", centred.alias("centred"))

    def whitened(c: int):
        axis = F.get("axes", F.lit(c))
        return F.aggregate(F.zip_with("centred", axis["axis"], lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p) * axis["scale"]

    rows = rows.select("d", *[whitened(c).alias(f"w{c}") for c in range(components)], *[(F.get("axes", F.lit(c))["scale"] > 0).alias(f"has{c}") for c in range(components)])
    errors = [
        F.when(F.bool_and(f"has{a}") & F.bool_and(f"has{b}"), F.abs(F.covar_pop(f"w{a}", f"w{b}") - (1.0 if a == b else 0.0)))
        for a in range(components) for b in range(a, components)
    ]
    worst = F.array_max(F.array(*errors))
    return rows.groupBy("d").agg(F.coalesce(worst, F.lit(0.0)).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component (at most ``components``, at most as many as dimensions): vec_id, component from 1
    by falling variance, n (different vectors), deviation, whitened, explained (its share of the variance), identity_error.

    Vectors become whole numbers floor(scale * x). Rows whose vector is null, empty or holds null or non-finite entries are left
    out; a null vec_id stays null. Repeated rows stay rows but count once in the fit. Vectors of different lengths have
    fits of their own. A component without variance has whitened 0 and is left out of identity_error, which is 0 if
    none is left; without any variance explained is 0. Equal variances share some orthonormal basis. A deviation
    beyond 64 bits is null. An empty table gives no rows. Other columns are not read.
    """
    x = whole_numbers(F.col(vector), scale)
    rows = vectors.select(F.col(id_column).alias("vec_id"), x.alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    rows = materialize(rows.withColumn("d", F.size("x")), "whole-vectors")
    different = materialize(rows.select("x", "d").distinct(), "different-vectors")
    model = fit(different, components)
    errors = materialize(_identity_error(different, model, components), "identity-errors")
    model = materialize(model.join(errors, "d"), "axes-checked")
    result = _projected(_with_model(rows, model))
    return result.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
