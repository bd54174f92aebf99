"""Operator 7: near-duplicate embeddings by tiled comparison in PCA order.

Vectors with equal labels are compared by cosine in double precision.  Equal vectors are one class with a weight, told by
two hashes.  The classes' unit vectors are rotated so that leading dimensions carry most of the spread, ordered by the
first, and cut into tiles of a fixed number of rows.  Tiles of one label whose ranges of the first dimension are too far
apart for any link are never paired: ranges meet in bands of that dimension, dealt by a salt.  A pair of tiles accumulates leading dimensions first; what the others can add is bounded by the
product of the suffix norms, and pairs that cannot reach the threshold stop there.  Pairs that pass are computed anew
from the vectors as given.

The rotation is fitted on a bounded sample; it orders dimensions and never decides a link.  A tile reports a number of
links a row and a spanning forest of its links, so what leaves a task grows with rows and not with pairs.  Every class
of a label meets every other that can link, whatever their number: a hot label is many tiles on many tasks.

Defined cases: labels may have any type that can be compared and written as text; 0.0 and -0.0 are equal, and so are NaN
and NaN.  Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing.
Vectors of unlike lengths do not link.  Very large and very small components are scaled by a power of two first, so that no
square overflows or vanishes.  Rows that repeat a vec_id are vectors of their own with that id.  Columns beside vec_id,
embedding and label are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, told_apart, written
from .components import components

THRESHOLD = 0.98
TILE_ROWS = 2048
#: Vectors and components that the rotation is fitted on at most, and the longest vectors that are rotated.
PCA_ROWS, PCA_NUMBERS, PCA_WIDTH = 10_000, 8_000_000, 4096
SALTS = 64
#: Tasks over which the tiles of one label and band meet.
TILE_SALTS = 16
#: Leading dimensions after which pairs are stopped, then stopped again.
STEPS = (8, 24)


#: Rows of one tile that meet the other tile at once.
STRIP = 256


def compare(x: np.ndarray, y: np.ndarray, rotation: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For strips of x: the strip's first row, and rows (within the strip) and columns of all pairs at or over the threshold."""
    norms = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    a, b = (x / norms[0][:, None]) @ rotation, (y / norms[1][:, None]) @ rotation
    low, steps = threshold - 1e-9, [s for s in STEPS if s < a.shape[1]] or [a.shape[1]]
    rest = {at: (np.linalg.norm(a[:, at:], axis=1), np.linalg.norm(b[:, at:], axis=1)) for at in steps}
    for first in range(0, len(x), STRIP):
        s = a[first : first + STRIP]
        dot = s[:, : steps[0]] @ b[:, : steps[0]].T
        rows, columns = np.nonzero(dot + np.outer(rest[steps[0]][0][first : first + STRIP], rest[steps[0]][1]) >= low)
        dot = dot[rows, columns]
        for done, at in zip(steps, steps[1:], strict=False):
            dot = dot + np.einsum("ij,ij->i", s[rows, done:at], b[columns, done:at])
            keep = dot + rest[at][0][first + rows] * rest[at][1][columns] >= low
            rows, columns, dot = rows[keep], columns[keep], dot[keep]
        linked = np.empty(len(rows), bool)
        for at in range(0, len(rows), 1 << 16):
            r, c = first + rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            linked[at : at + (1 << 16)] = np.einsum("ij,ij->i", x[r], y[c]) / (norms[0][r] * norms[1][c]) >= threshold
        yield first, rows[linked], columns[linked]


class Forest:
    """Components of the rows of a pair of tiles, and one link for each merger."""

    def __init__(self, n: int):
        self.of, self.edges = np.arange(n), []

    def join_row(self, i: int, others: np.ndarray) -> None:
        """Links i to all of ``others``."""
        met, at = np.unique(self.of[others], return_index=True)
        apart = met != self.of[i]
        if apart.any():
            self.edges += [(i, int(others[k])) for k in at[apart]]
            self.of[np.isin(self.of, met[apart])] = self.of[i]


def _by_row(rows: np.ndarray, columns: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The rows that occur, and each one's columns; ``rows`` is sorted."""
    present, at = np.unique(rows, return_index=True)
    return present.tolist(), np.split(columns, at[1:]) if len(present) else []


def fit_rotation(classes: DataFrame, rows: int = PCA_ROWS) -> dict[int, np.ndarray]:
    """For each length of vectors, the principal axes of at most ``rows`` unit vectors, widest first; longer vectors than
    PCA_WIDTH have none and stay as they are."""
    short = classes.filter(F.size("vector") <= PCA_WIDTH)
    widest = short.agg(F.max(F.size("vector"))).first()[0]
    if not widest:
        return {}
    chosen = short.select("node", "vector").orderBy(F.xxhash64("node"), "node").limit(min(rows, max(1, PCA_NUMBERS // widest))).collect()
    out = {}
    for n in {len(r["vector"]) for r in chosen}:
        a = np.array([r["vector"] for r in chosen if len(r["vector"]) == n], float)
        a /= np.linalg.norm(a, axis=1)[:, None]
        out[n] = np.linalg.eigh(a.T @ a)[1][:, ::-1].copy()
    return out


def _tiles(classes: DataFrame, rotations: dict[int, np.ndarray], rows: int) -> DataFrame:
    """One row a tile: label, width, tile, low, high (of the first dimension), nodes, weights, vectors."""
    unit = lambda n: rotations.get(n, np.eye(n))
    first_schema = pa.schema([("node", pa.int64()), ("label", pa.string()), ("width", pa.int32()), ("weight", pa.int64()), ("first", pa.float64()), ("data", pa.binary())])
    tile_schema = pa.schema([("label", pa.string()), ("width", pa.int32()), ("tile", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("nodes", pa.binary()), ("weights", pa.binary()), ("data", pa.binary())])

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, float) for v in batch.column(3).to_pylist()]
            first = [float(v @ unit(len(v))[:, 0] / np.linalg.norm(v)) for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(v) for v in vectors], pa.int32()), batch.column(2), pa.array(first, pa.float64()), pa.array([v.tobytes() for v in vectors], pa.binary())], schema=first_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, at = TaskContext.get().partitionId() << 32, [], None

        def tile() -> pa.RecordBatch:
            nonlocal number
            number += 1
            nodes, weights, firsts, data = zip(*held, strict=True)
            held.clear()
            row = [at[0], at[1], number, min(firsts), max(firsts), np.array(nodes, "i8").tobytes(), np.array(weights, "i8").tobytes(), b"".join(data)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, tile_schema, strict=True)], schema=tile_schema)

        for batch in batches:
            for node, label, width, weight, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((label, width) != at or len(held) >= rows):
                    yield tile()
                at = label, width
                held.append((node, weight, first, data))
        if held:
            yield tile()

    placed = classes.select("node", "label", "weight", "vector").mapInArrow(rotate, "node long, label string, width int, weight long, first double, data binary")
    placed = written(placed, scratch(classes.sparkSession, "vector-places"))  # the range partitioner reads it twice
    ranged = placed.repartitionByRange("label", "width", "first").sortWithinPartitions("label", "width", "first", "node")
    return ranged.mapInArrow(cut, "label string, width int, tile long, low double, high double, nodes binary, weights binary, data binary")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vectors: vec_id, embedding, label.  Returns vec_id, n_links, component_id, kept for every row."""
    spark, made = vectors.sparkSession, []

    def keep(df: DataFrame, label: str) -> DataFrame:
        made.append(scratch(spark, label))
        return written(df, made[-1])

    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label")
    if vectors.schema["label"].dataType.typeName() in ("float", "double"):
        label = label + F.lit(0.0)  # -0.0 is 0.0
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("string").alias("label"), doubles.alias("vector"))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    largest = F.array_max(F.transform("vector", F.abs))
    power = F.least(F.greatest(F.floor(F.log2(largest)), F.lit(-1022)), F.lit(1022))
    scale = F.when((largest > 1e100) | (largest < 1e-100), F.pow(F.lit(2.0), -power)).otherwise(1.0)
    rows = rows.withColumn("usable", usable).withColumn("scale", scale).withColumn("vector", F.when(F.col("usable"), F.transform("vector", lambda x: x * F.col("scale") + F.lit(0.0)))).drop("scale")
    node = lambda k: F.when(F.col("usable"), F.xxhash64(F.lit(k), "label", "vector"))
    rows = rows.withColumn("node", node(0)).withColumn("check", node(1)).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    rows = told_apart(keep(rows, "vectors"), keep)
    good = rows.filter("usable")
    parts = good.groupBy("node", "salt").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = parts.groupBy("node").agg(F.min("least").alias("least"), F.sum("weight").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = keep(classes, "vector-classes")
    rotations = fit_rotation(classes)
    tiles = keep(_tiles(classes, rotations, tile_rows), "vector-tiles")
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    band = lambda x: F.floor(x / reach).cast("int")
    low, high = F.col("low") - reach / 2, F.col("high") + reach / 2
    placed = tiles.select("label", "width", "tile", low.alias("low"), high.alias("high")).withColumn("band", F.explode(F.sequence(band(F.col("low")), band(F.col("high")))))
    left = placed.withColumn("salt", F.pmod(F.xxhash64("tile"), F.lit(TILE_SALTS)).cast("int"))
    right = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(TILE_SALTS - 1))))
    left, right = (df.select("label", "width", "band", "salt", F.col("tile").alias(f"{s}_tile"), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high")) for s, df in (("a", left), ("b", right)))
    begins = F.greatest("a_low", "b_low")
    near = (F.col("a_tile") <= F.col("b_tile")) & (begins <= F.least("a_high", "b_high")) & (F.col("band") == band(begins))  # in the first band of both, once
    pairs = left.join(right, ["label", "width", "band", "salt"]).filter(near).select("a_tile", "b_tile")
    side = lambda s: tiles.select(F.col("tile").alias(f"{s}_tile"), F.struct("width", "nodes", "weights", "data").alias(s))
    work = pairs.join(side("a"), "a_tile").join(side("b"), "b_tile").select("a_tile", "b_tile", "a", "b").repartition(F.xxhash64("a_tile", "b_tile"))
    found_schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a_tile, b_tile, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (nx, wx, x), (ny, wy, y) = ((np.frombuffer(t["nodes"], "i8"), np.frombuffer(t["weights"], "i8"), np.frombuffer(t["data"], float).reshape(-1, t["width"])) for t in (a, b))
                same = a_tile == b_tile
                counts, base = (np.zeros(len(nx), "i8"), np.zeros(len(ny), "i8")), 0 if same else len(nx)
                forest = Forest(len(nx) + (0 if same else len(ny)))
                for first, r, c in compare(x, y, rotations.get(a["width"], np.eye(a["width"])), threshold):
                    if same:
                        above = c > first + r
                        r, c = r[above], c[above]
                    for i, columns in zip(*_by_row(r, c), strict=True):
                        counts[0][first + i] += wy[columns].sum()
                        counts[1][columns] += wx[first + i]
                        forest.join_row(first + i, base + columns)
                for nodes, n in ((nx, counts[0]), (ny, counts[1])):
                    has = np.nonzero(n)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[has]), pa.array(n[has]), pa.nulls(len(has), pa.int64())], schema=found_schema)
                if forest.edges:
                    e = np.array(forest.edges)
                    ends = nx if same else np.concatenate([nx, ny])
                    yield pa.RecordBatch.from_arrays([pa.array(ends[e[:, 0]]), pa.array(np.zeros(len(e), "i8")), pa.array(ends[e[:, 1]])], schema=found_schema)

    found = keep(work.mapInArrow(link, "node long, links long, other long"), "vector-links")
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    joined = classes.select("node", "least", "weight").join(roots, "node", "left").join(counts, "node", "left")
    joined = joined.select("node", "least", "weight", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    settled = keep(joined.join(least, "component").select("node", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-components")
    by_salt = parts.select("node", "salt").join(settled, "node")
    linked = good.select("vec_id", "node", "salt").join(by_salt, ["node", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keep(linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vector-groups")
    remove(spark, *made[:-1])
    return out
