"""Operator 4, near-duplicate embeddings: int8 tile products with rigorous error bounds.

Unit vectors are rounded to 8-bit steps of their own scale. The length of the
rounding error of each vector is known, so the error of a product of two
rounded vectors is bounded: |x.y - x'.y'| <= |x'| |y - y'| + |x - x'|. Tiles of
rounded vectors are multiplied at once; pairs whose bound stays below the
threshold are out, pairs whose bound stays above it are in, and only the pairs
between are computed again in double precision.

Equal vectors of a label are one class, so a hot group of copies is one row.
The classes of a label are dealt into blocks, and every two blocks of a label
meet in one task, which returns a number of links and a component root for
each of its classes, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged
from quern.llm.links import components

THRESHOLD = 0.93
#: Classes in a block.
BLOCK = 2048
#: Rows of a product computed at a time.
STRIP = 512
#: More than the rounding of double precision sums.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, the length of the rounded vector and of its error, for unit rows."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rounded = codes * scale[:, None]
    length = np.sqrt((rounded * rounded).sum(axis=1))
    error = np.sqrt(((unit - rounded) ** 2).sum(axis=1))
    return codes, scale, length, error


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows; float32 sums stay below 2^24 in slices of 1024."""
    total = np.zeros((len(left), len(right)))
    for k in range(0, left.shape[1], 1024):
        total += left[:, k : k + 1024].astype(np.float32) @ right[:, k : k + 1024].astype(np.float32).T
    return total


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of all pairs with cosine >= threshold; ``same``: pairs above the diagonal only."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    qx, sx, lx, ex = quantise(x / nx[:, None])
    qy, sy, ly, ey = (qx, sx, lx, ex) if same else quantise(y / ny[:, None])
    rows, cols = [], []
    for a in range(0, len(x), STRIP):
        b = min(a + STRIP, len(x))
        about = products(qx[a:b], qy) * sx[a:b, None] * sy[None, :]
        bound = lx[a:b, None] * ey[None, :] + ex[a:b, None]
        i, j = np.nonzero(about + bound >= threshold - SLACK)
        if same:
            above = j > i + a
            i, j = i[above], j[above]
        unsure = about[i, j] - bound[i, j] < threshold + SLACK
        good = ~unsure
        at = np.flatnonzero(unsure)
        for k in range(0, len(at), 65536):
            p = at[k : k + 65536]
            u, v = x[i[p] + a], y[j[p]]
            good[p] = (u * v).sum(axis=1) / (nx[i[p] + a] * ny[j[p]]) >= threshold
        rows.append(i[good] + a)
        cols.append(j[good])
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cols) if cols else np.zeros(0, int)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of n nodes reaches by the links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _tile(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("cls", "ascending")]).combine_chunks()
        block = table.column("block").to_numpy()
        values = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        matrix = values.reshape(len(block), -1)
        first, last = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        cut = int(np.searchsorted(block, last)) if first != last else 0
        if first == last:
            i, j = tile_links(matrix, matrix, threshold, True)
        else:
            i, j = tile_links(matrix[:cut], matrix[cut:], threshold, False)
            j = j + cut
        copies = table.column("n").to_numpy()
        links = np.bincount(i, copies[j], len(block)) + np.bincount(j, copies[i], len(block))
        some = np.flatnonzero(links > 0)
        cls = table.column("cls")
        return pa.table(
            {
                "cls": cls.take(pa.array(some)),
                "links": pa.array(links[some].astype(np.int64)),
                "root": cls.take(pa.array(local_roots(len(block), i, j)[some])),
            }
        )

    return tile


def _usable(vector: Column, label: Column) -> Column:
    """A label, and a vector of finite numbers that are not all zero."""
    as_double = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(as_double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & fine & F.exists(as_double, lambda v: v != 0), F.lit(False))


def link_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable, itself included) and kept.

    Vectors are linked if their labels are equal and their cosine in double
    precision is at least ``threshold``. A vector that is null, empty, zero or
    holds null or non-finite numbers, or has no label, links with nothing;
    vectors of different length do not link. Equal vectors link and are
    counted one by one. Repeated ids are kept row by row. An empty table gives
    no rows; other columns are ignored.
    """
    rows = staged(
        vectors.select(
            F.col(id_col).alias("id"),
            F.col(label_col).alias("label"),
            F.col(vector_col).cast("array<double>").alias("embedding"),
            _usable(F.col(vector_col), F.col(label_col)).alias("usable"),
        ).withColumn(
            "cls",
            F.when(F.col("usable"), F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("string")))),
        ),
        "vector-rows",
    )
    classes = staged(
        rows.filter("usable")
        .groupBy("cls", "label", "embedding")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
        .withColumn("dim", F.size("embedding")),
        "vector-classes",
    )
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = met.select(
        "label",
        "dim",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "cls",
        "n",
        "embedding",
    )
    found = staged(
        tiles.groupBy("label", "dim", "i", "j").applyInArrow(_tile(threshold), "cls string, links long, root string"),
        "vector-links",
    )
    roots = staged(components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))), "vector-roots")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("cls", "n", "least").join(links, "cls", "left")
    known = known.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    known = staged(
        known.select("cls", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root")),
        "vector-known",
    )
    first = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(first, "root").select("cls", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component")
    result = rows.select("id", "cls").join(known, "cls", "left")
    component = F.coalesce("component", "id")
    return result.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for :func:`link_vectors` of ``embeddings``."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {threshold}
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_id AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least_id USING (vec_id) LEFT JOIN counted USING (vec_id)
"""
