"""Embedding near-duplicates within a label by PCA-ordered tiles.

Vectors are scaled to unit length and rotated into the principal axes of all
vectors, which keeps every cosine. A cosine of at least t means a squared
distance of at most 2 - 2t, so linked vectors are at most sqrt(2 - 2t) apart on
the first axis: strips of that width only meet themselves and the next one.
Strips are cut into tiles of bounded size. Inside a pair of tiles the leading
axes are multiplied first; what the rest can still add is at most the product
of the two suffix norms, and pairs that cannot reach t are dropped after each
group of axes. The few that remain are decided by the cosine of the original
vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components
from .forest import forest

SLACK = 1e-9  # of bounds against rounding; the last comparison has none


def _unit(vectors: list) -> list[np.ndarray | None]:
    """Double vectors, or None where nothing may link."""
    out = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        out.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def _usable(vectors: DataFrame) -> DataFrame:
    """(label, v binary, dims, vec_id) of rows that may link: v holds the double components."""

    def run(batches):
        for batch in batches:
            found = [(i, x) for i, x in enumerate(_unit(batch.column(2).to_pylist())) if x is not None]
            rows = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), batch.column(1).take(rows),
                pa.array([(x + 0.0).tobytes() for _, x in found], pa.binary()), pa.array([len(x) for _, x in found], pa.int32()),
            ], names=["vec_id", "label", "v", "dims"])

    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>")
    ).mapInArrow(run, "vec_id long, label string, v binary, dims int")


def _axes(distinct: DataFrame, dims: int) -> np.ndarray:
    """Principal axes (columns, most variance first) of all unit vectors with ``dims`` components.

    Each task sends one dims x dims sum, row by row, and Spark adds them up; the
    driver gets dims rows.
    """

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = np.array([np.frombuffer(v) for v in batch.column(0).to_pylist()]).reshape(-1, dims)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            total += x.T @ x
        i, j = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = distinct.where(F.col("dims") == dims).select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    matrix = np.zeros((dims, dims))
    for r in sums:
        matrix[r.i, r.j] = r.s
    values, axes = np.linalg.eigh((matrix + matrix.T) / 2)
    return axes[:, np.argsort(-values, kind="stable")]


def _matrix(column) -> np.ndarray:
    return np.array([np.frombuffer(v) for v in column])


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, group: int = 8, memory: int = 1 << 21):
    """Index pairs (i, j) with cosine(x[i], y[j]) >= threshold, by early stopping on suffix norms."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    a, b = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    dims = a.shape[1]
    rest = lambda m, d: np.sqrt(np.maximum(0, (m[:, d:] ** 2).sum(1)))
    out_i, out_j = [], []
    step = max(1, memory // max(1, len(b)))
    d = min(group, dims)
    rest_b = rest(b, d)
    for at in range(0, len(a), step):
        part = a[at : at + step]
        dot = part[:, :d] @ b[:, :d].T
        i, j = np.nonzero(dot + rest(part, d)[:, None] * rest_b[None, :] >= threshold - SLACK)
        sums, i = dot[i, j], i + at
        for lead in range(d, dims, group):
            upto = min(lead + group, dims)
            sums = sums + np.einsum("ij,ij->i", a[i, lead:upto], b[j, lead:upto])
            stays = sums + rest(a, upto)[i] * rest(b, upto)[j] >= threshold - SLACK
            i, j, sums = i[stays], j[stays], sums[stays]
            if not len(i):
                break
        exact = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= threshold
        out_i.append(i[exact])
        out_j.append(j[exact])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, their lengths agree
    and their cosine in double precision is at least ``threshold``. Null, empty
    or zero vectors and those with a null or non-finite component link with
    nothing. n_links counts the other rows linked directly, copies included;
    component_id is the least vec_id reachable, kept says that it is the row's
    own. Equal vectors of a label are compared once. A tile's links go out as
    counts and a spanning forest, so a dense group costs rows in proportion to
    its size. Other columns are ignored; an empty table gives an empty result.
    """
    usable = keep(_usable(vectors))
    distinct = keep(
        usable.groupBy("label", "v", "dims").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    found = None
    for (dims,) in distinct.select("dims").distinct().collect():  # vector lengths, in practice one
        axes = _axes(distinct, dims)
        part = _tile_links(distinct.where(F.col("dims") == dims), axes, width, threshold, tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = distinct.select(F.col("node").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    found = keep(found)
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    roots = components(found.where("b >= 0").select("a", "b"))
    nodes = distinct.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = keep(nodes)
    nodes = nodes.join(keep(nodes.groupBy("root").agg(F.min("least").alias("component_id"))), "root")  # written, so a hot root is split
    named = nodes.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    ids = usable.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    # Rows that cannot link are the rest; rows are matched by position in their id, so repeats stay apart.
    lone = _lone(vectors)
    return ids.unionByName(lone).select("vec_id", F.col("n_links").cast("long"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _lone(vectors: DataFrame) -> DataFrame:
    """Rows whose vector or label links with nothing: components of their own."""
    e = F.col("embedding").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    unusable = F.col("label").isNull() | e.isNull() | F.exists(e, bad) | ~F.exists(e, lambda c: c != 0)
    return vectors.where(F.coalesce(unusable, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))


def _tile_links(distinct: DataFrame, axes: np.ndarray, width: float, threshold: float, tile: int) -> DataFrame:
    """(a, b, n): for b = -1, n rows link to node a in one pair of tiles; else a and b are joined."""

    def strips(batches):
        for batch in batches:
            x = _matrix(batch.column(2).to_pylist()).reshape(-1, len(axes))
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            strip = np.floor(x @ axes[:, 0] / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(strip)], names=["node", "label", "v", "copies", "strip"])

    placed = keep(distinct.select("node", "label", "v", "copies").mapInArrow(strips, "node long, label string, v binary, copies long, strip int"))
    tiles = placed.groupBy("label", "strip").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    after = tiles.select("label", (F.col("strip") - 1).alias("strip"), F.col("tiles").alias("after"))
    before = tiles.select("label", (F.col("strip") + 1).alias("strip"), F.col("tiles").alias("before"))
    tiles = tiles.join(after, ["label", "strip"], "left").join(before, ["label", "strip"], "left").na.fill(0, ["after", "before"])
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda strip, kind, i, j: F.struct(strip.alias("strip"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    strip = F.col("strip")
    pairs = F.concat(
        F.transform(upto(F.col("tiles")), lambda k: pair(strip, 0, F.least(F.col("own"), k), F.greatest(F.col("own"), k))),
        F.transform(upto(F.col("after")), lambda k: pair(strip, 1, F.col("own"), k)),
        F.transform(upto(F.col("before")), lambda k: pair(strip - 1, 1, k, F.col("own"))),
    )
    dealt = (
        placed.join(tiles, ["label", "strip"]).withColumn("own", own)
        .select("node", "label", "v", "copies", "strip", "own", F.explode(pairs).alias("p"))
        .select("node", "v", "copies", "label", F.col("p.strip").alias("s"), F.col("p.kind").alias("kind"), F.col("p.i").alias("i"), F.col("p.j").alias("j"),
                F.when(F.col("p.kind") == 1, F.col("strip") == F.col("p.strip")).otherwise(F.col("own") == F.col("p.i")).alias("left"))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["left"].to_numpy()
        same = pdf["kind"].iloc[0] == 0 and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        x = pdf if same else pdf[left]
        y = pdf if same else pdf[~left]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        i, j = linked(_matrix(x["v"]), _matrix(y["v"]), axes, threshold)
        nx, ny = x["node"].to_numpy(), y["node"].to_numpy()
        cx, cy = x["copies"].to_numpy(), y["copies"].to_numpy()
        if same:
            i, j = i[i != j], j[i != j]
            counts = [(nx, np.bincount(i, cy[j], len(nx)))]
            a, b = forest(len(nx), i, j)
            edges = nx[a], nx[b]
        else:
            counts = [(nx, np.bincount(i, cy[j], len(nx))), (ny, np.bincount(j, cx[i], len(ny)))]
            both = np.concatenate([nx, ny])
            a, b = forest(len(both), i, j + len(nx))
            edges = both[a], both[b]
        node = np.concatenate([n[c > 0] for n, c in counts])
        n = np.concatenate([c[c > 0] for _, c in counts]).astype(np.int64)
        return pd.DataFrame({"a": np.concatenate([node, edges[0]]), "b": np.concatenate([np.full(len(node), -1), edges[1]]), "n": np.concatenate([n, np.zeros(len(edges[0]), np.int64)])})

    return dealt.groupBy("label", "s", "kind", "i", "j").applyInPandas(compare, "a long, b long, n long")
