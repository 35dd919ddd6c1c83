"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors at cosine c or more lie within epsilon = sqrt(2 - 2c). Their coordinates on the leading principal
directions fall into grid cells of width epsilon; vectors sorted by cells are cut into sequence
intervals. Pairs of intervals that may hold a link are joined recursively: halves whose bounding boxes lie
further apart than epsilon are skipped, small ones are compared in full by cosine in double precision.

Cells and boxes only skip what is provably distant; the directions are fitted on a bounded sample, and any
orthonormal directions give the same links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelry.llm.shared import components, saved

SAMPLE_ROWS, DIRECTIONS = 4096, 4
INTERVAL_ROWS, LEAF_ROWS = 512, 128
#: Room for rounding when a distance is used to skip.
_SLACK = 1e-6
_POINT = "label string, dim int, rep long, copies long, vec array<double>, place array<double>"
_INTERVAL = "interval string, label string, dim int, low array<double>, high array<double>, reps binary, copies binary, vecs binary, places binary"


def directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """Orthonormal leading directions for each vector length in a bounded sample of ``SAMPLE_ROWS`` vectors."""
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("dim", "vec").collect()
    by_dim: dict[int, list] = {}
    for dim, vec in rows:
        by_dim.setdefault(dim, []).append(vec)
    fitted = {}
    for dim, vecs in by_dim.items():
        x = _units(np.array(vecs, float))[0]
        x = x - x.mean(axis=0)
        _, axes = np.linalg.eigh(x.T @ x)
        fitted[dim] = axes[:, ::-1][:, :DIRECTIONS].copy()
    return fitted


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms, scaled first so that very large or small components keep their digits."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / norm, norm


def _placed(classes: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            values = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dims)
            out = np.zeros((len(dims), DIRECTIONS))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = _units(values[(ends[rows] - dim)[:, None] + np.arange(dim)])[0]
                basis = axes.get(int(dim), np.eye(dim)[:, :DIRECTIONS])
                out[rows, : basis.shape[1]] = x @ basis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1) * DIRECTIONS, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "place"])

    return classes.select("label", "dim", "rep", "copies", "vec").mapInArrow(place, _POINT)


def _intervals(points: DataFrame, epsilon: float, rows: int) -> DataFrame:
    """Sequence intervals: consecutive points in grid order, of one label and length."""
    cells = [F.floor(F.get("place", F.lit(i)) / epsilon) for i in range(DIRECTIONS)]
    key = [F.col("label"), F.col("dim"), *cells, F.col("rep")]
    parts = rows // (8 * INTERVAL_ROWS) + 1
    ordered = points.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_numpy()
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            places = batch.column("place").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIRECTIONS)
            values, ends = batch.column("vec").flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            reps, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
            first, out = 0, []
            while first < batch.num_rows:
                last = first + 1
                while last < batch.num_rows and last - first < INTERVAL_ROWS and labels[last] == labels[first] and dims[last] == dims[first]:
                    last += 1
                box = places[first:last]
                out.append((
                    f"{part:09d}-{made:09d}", labels[first], int(dims[first]), box.min(axis=0).tolist(), box.max(axis=0).tolist(),
                    reps[first:last].astype("<i8").tobytes(), copies[first:last].astype("<i8").tobytes(),
                    values[ends[first] - dims[first] : ends[last - 1]].astype("<f8").tobytes(), box.tobytes(),
                ))
                made, first = made + 1, last
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4)
            names = ["interval", "label", "dim", "low", "high", "reps", "copies", "vecs", "places"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 9, kinds)], names)

    return ordered.mapInArrow(cut, _INTERVAL)


def _box_tree(boxes: DataFrame) -> list[DataFrame]:
    """Levels of (label, dim, node, parent, low, high): the intervals, then the parts they are in, then eight parts at a time,
    up to one node a label and length. Nodes follow the sequence, so those of a level lie side by side on the grid."""
    part = F.split("interval", "-")[0].cast("long")
    level = boxes.select("label", "dim", F.col("interval").alias("node"), part.alias("parent"), "low", "high")
    levels, most = [level], boxes.agg(F.max(part)).first()[0] or 0
    low = F.array(*[F.min(F.get("low", F.lit(i))) for i in range(DIRECTIONS)])
    high = F.array(*[F.max(F.get("high", F.lit(i))) for i in range(DIRECTIONS)])
    while True:
        nodes = level.groupBy("label", "dim", F.col("parent").alias("node")).agg(low.alias("low"), high.alias("high"))
        level = saved(nodes.select("label", "dim", "node", F.shiftright("node", 3).alias("parent"), "low", "high"), "boxes")
        levels.append(level)
        if most == 0:
            return levels
        most >>= 3


def _interval_pairs(boxes: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b) of intervals of one label and length whose boxes come within epsilon; each pair once, and each with itself.

    A recursive join of the sequence with itself, level by level of its tree: of a pair of nodes that are near, the children
    are paired, at most 64 pairs; of a pair that is provably distant none. So no pairing is keyed by a label or a cell.
    """
    *levels, top = _box_tree(boxes)
    pairs = top.select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    gap = lambda i: F.greatest(F.lit(0.0), F.get("b_low", F.lit(i)) - F.get("a_high", F.lit(i)), F.get("a_low", F.lit(i)) - F.get("b_high", F.lit(i)))
    far = sum((gap(i) * gap(i) for i in range(1, DIRECTIONS)), gap(0) * gap(0))
    for level in reversed(levels):
        side = lambda s: level.select("label", "dim", F.col("parent").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "low", "high")])  # noqa: B023, E731
        both = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
        near = (F.col("a_node") <= F.col("b_node")) & (far <= epsilon * epsilon + _SLACK)
        pairs = saved(both.where(near).select("label", "dim", F.col("a_node").alias("a"), F.col("b_node").alias("b")), "pairs")
    return pairs.select(F.col("a").alias("a_interval"), F.col("b").alias("b_interval"))


def join_intervals(a: dict, b: dict, least: float, same: bool) -> np.ndarray:
    """Which points of the two intervals are linked, as a matrix; blocks that are provably distant stay unread."""
    epsilon2 = 2 - 2 * least + _SLACK
    linked = np.zeros((len(a["reps"]), len(b["reps"])), bool)
    todo = [(0, len(a["reps"]), 0, len(b["reps"]))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        pa_, pb_ = a["places"][a0:a1], b["places"][b0:b1]
        gap = np.maximum(0, np.maximum(pb_.min(axis=0) - pa_.max(axis=0), pa_.min(axis=0) - pb_.max(axis=0)))
        if (gap * gap).sum() > epsilon2:
            continue
        if max(a1 - a0, b1 - b0) > LEAF_ROWS:
            if a1 - a0 >= b1 - b0:
                middle = (a0 + a1) // 2
                todo += [(a0, middle, b0, b1), (middle, a1, b0, b1)]
            else:
                middle = (b0 + b1) // 2
                todo += [(a0, a1, b0, middle), (a0, a1, middle, b1)]
            continue
        dots = a["scaled"][a0:a1] @ b["scaled"][b0:b1].T
        linked[a0:a1, b0:b1] = dots >= least * (a["norms"][a0:a1] * b["norms"][b0:b1].T)
    if same:
        linked |= linked.T
        np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray, same: bool) -> np.ndarray:
    """For each point (first those of a, then of b) the first point of its component within the block."""
    n_a, n_b = linked.shape
    root = np.arange(n_a if same else n_a + n_b)
    i, j = np.nonzero(linked)
    if not same:
        j = j + n_a
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Only vectors of equal, non-null label and equal length are compared. Null, zero and non-finite vectors,
    and rows with a null id, link with nothing. Equal vectors of one label are one point of the join and
    count by their number; rows that repeat an id count as vectors of their own. An empty table gives no rows.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    fit = (
        F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
        & ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists(doubles, lambda x: x != 0)
    )
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.when(F.coalesce(fit, F.lit(False)), doubles).alias("vec"))
    classes = saved(
        rows.where("vec is not null").groupBy("label", "vec")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vec")),
        "vectors",
    )
    points = saved(_placed(classes, directions(classes)), "points")
    epsilon = math.sqrt(max(1e-12, 2 - 2 * least))
    blocks = saved(_intervals(points, epsilon, classes.count()), "intervals")
    pairs = _interval_pairs(blocks, epsilon)
    tasks = pairs.count() // 4 + 1
    fields = ["dim", "reps", "copies", "vecs", "places"]
    side = lambda s: blocks.select(F.col("interval").alias(f"{s}_interval"), *[F.col(c).alias(f"{s}_{c}") for c in fields])
    joined = pairs.join(side("a"), "a_interval").repartition(tasks, "a_interval", "b_interval").join(side("b"), "b_interval")
    names = ["a_interval", "b_interval", *[f"{s}_{c}" for s in "ab" for c in fields]]

    def read(row: dict, s: str) -> dict:
        vecs = np.frombuffer(row[f"{s}_vecs"], "<f8").reshape(-1, row[f"{s}_dim"])
        scaled = vecs / np.abs(vecs).max(axis=1, keepdims=True)
        return {
            "reps": np.frombuffer(row[f"{s}_reps"], "<i8"), "copies": np.frombuffer(row[f"{s}_copies"], "<i8"), "scaled": scaled,
            "norms": np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)),
            "places": np.frombuffer(row[f"{s}_places"], float).reshape(-1, DIRECTIONS),
        }

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(j)[k].as_py() for j, c in enumerate(names)}
                same = row["a_interval"] == row["b_interval"]
                a = read(row, "a")
                b = a if same else read(row, "b")
                linked = join_intervals(a, b, least, same)
                root = forest(linked, same)
                ids, count = a["reps"], linked @ b["copies"]
                if not same:
                    ids, count = np.concatenate((ids, b["reps"])), np.concatenate((count, a["copies"] @ linked))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (ids, count, ids[root])], ["rep", "links", "root"])

    found = saved(joined.select(*names).mapInArrow(links, "rep long, links long, root long"), "links")
    group = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        classes.select("label", "vec", "rep", "copies").join(totals, "rep", "left")
        .join(group.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    return (
        rows.join(known, ["label", "vec"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
