"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors, a cosine of at least t is a distance of at most eps = sqrt(2 - 2t). Vectors are projected
on their leading principal dimensions, with the length of what these leave out beside them (a distance there is never
larger), and sorted by the grid cells of width eps, dimension by dimension. The sorted sequence is cut into blocks of a
fixed number of vectors or bytes, whichever is less, each with the box of its projections. Block pairs are found by an equi-join on the first dimension's cells and kept unless
their boxes are more than eps apart; each pair is a task, which joins its two intervals recursively, halving
the longer one and skipping halves whose boxes are too far apart, down to small products of matrices. A task
gives the number of links of each vector and a spanning star of what hangs together, never the pairs.

The principal dimensions come from a bounded sample (``sample`` vectors of the smallest hashes); they only
decide the order and what can be skipped, so the join is exact whatever they are. Equal vectors are one
class. Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths are never compared; a null vec_id counts as larger than every other;
repeated rows are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.common import arrow_batch, arrow_schema, bucket_bits, running_before, saved
from sheetweave.llm.components import components
from sheetweave.llm.jaccard import FOUND, stars

#: Dimensions whose cells make the order, and that are projected on; a box has one more, the length of what they leave out.
CELLS, LEADING = 4, 8
BOX = LEADING + 1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal(sample: list[bytes], dims: int = LEADING) -> dict[int, np.ndarray]:
    """By length, an orthonormal basis of the leading dimensions."""
    out = {}
    for d in {len(b) for b in sample}:
        x = unit(np.stack([np.frombuffer(b, "<f8") for b in sample if len(b) == d]))
        out[d // 8] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dims]
    return out


def read_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): little-endian doubles, null where the vector can't link."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))

    def run(batches: Iterator) -> Iterator:
        schema = arrow_schema("vec_id long, v binary")
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = x.values.to_numpy(zero_copy_only=False).astype("<f8") if x.is_valid else None
                if x is not None and 0 < (top := np.abs(x).max()):
                    x = x / 2.0 ** np.frexp(top)[1] + 0.0  # neither sums of squares nor -0.0 make a difference
                rows.append((i, x.tobytes() if x is not None else None))
            if rows:
                yield arrow_batch(rows, schema)

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v).alias("v")).mapInArrow(run, "vec_id long, v binary")


def placed(reps: DataFrame, basis: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Adds dim, the cell key and the projections (doubles, as binary)."""
    kind = "rep long, size long, first_id long, v binary, dim long, cell long, box binary"

    def run(batches: Iterator) -> Iterator:
        schema = arrow_schema(kind)
        for batch in batches:
            rows = []
            for rep, size, first, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(v, "<f8")
                own = basis.get(len(x), np.eye(len(x))[:, :LEADING])
                u = x / np.linalg.norm(x)
                p = u @ own
                rest = np.linalg.norm(u - own @ p)
                key = 0
                for c in np.floor(p[:CELLS] / eps).astype(int).clip(-512, 511).tolist():
                    key = key << 10 | c + 512
                rows.append((rep, size, first, v, len(x), key, np.append(np.pad(p, (0, LEADING - len(p))), rest).tobytes()))
            if rows:
                yield arrow_batch(rows, schema)

    return reps.select("rep", "size", "first_id", "v").mapInArrow(run, kind)


BLOCK = "dim long, block long, reps binary, sizes binary, vectors binary, boxes binary, low array<double>, high array<double>"


def blocks_of(ranked: DataFrame, size: int, most_bytes: int) -> DataFrame:
    """One row for each block: its vectors in order, and the box of their projections."""
    def pack(key, table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        table = table.sort_by("rank")
        boxes = b"".join(table.column("box").to_pylist())
        p = np.frombuffer(boxes, "<f8").reshape(-1, BOX)
        row = (key[0].as_py(), key[1].as_py(), table.column("rep").to_numpy().astype("<i8").tobytes(), table.column("size").to_numpy().astype("<i8").tobytes(), b"".join(table.column("v").to_pylist()), boxes, p.min(0).tolist(), p.max(0).tolist())
        return pa.Table.from_batches([arrow_batch([row], arrow_schema(BLOCK))])

    rows = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(most_bytes) / (8 * F.col("dim")))))
    cut = ranked.withColumn("block", F.floor(F.col("rank") / rows))
    return cut.select("dim", "block", "rank", "rep", "size", "v", "box").groupBy("dim", "block").applyInArrow(pack, BLOCK)


class Interval:
    def __init__(self, u: np.ndarray, p: np.ndarray) -> None:
        self.u, self.p, self.f = u, p, u.astype(np.float32)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self.boxes:
            self.boxes[lo, hi] = self.p[lo:hi].min(0), self.p[lo:hi].max(0)
        return self.boxes[lo, hi]


def join(a: Interval, b: Interval, same: bool, threshold: float, eps: float, leaf: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b with a cosine of at least threshold; if same, each pair once."""
    todo = [(0, len(a.u), 0, len(b.u))]
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i:
            continue
        (alo, ahi), (blo, bhi) = a.box(i, j), b.box(k, m)
        gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
        if gap @ gap > eps * eps * (1 + 1e-9) + 1e-12:
            continue
        if j - i <= leaf and m - k <= leaf:
            if (a.f[i:j] @ b.f[k:m].T).max() >= threshold - 1e-5:
                near = a.u[i:j] @ b.u[k:m].T >= threshold
                if same:
                    near &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
                x, y = np.nonzero(near)
                if len(x):
                    yield x + i, y + k
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]


def link(tasks: DataFrame, threshold: float, eps: float) -> DataFrame:
    """tasks: dim, a, b, side and a block. Gives (rep, links, root)."""
    def run(key, table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        rows = sorted(table.select(["side", "reps", "sizes", "vectors", "boxes"]).to_pylist(), key=lambda r: r["side"])
        same, dim = key[1] == key[2], key[0].as_py()
        got = [Interval(unit(np.frombuffer(r["vectors"], "<f8").reshape(-1, dim)), np.frombuffer(r["boxes"], "<f8").reshape(-1, BOX)) for r in rows]
        reps = np.concatenate([np.frombuffer(r["reps"], "<i8") for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], "<i8") for r in rows])
        order = np.argsort(reps, kind="stable")
        place = np.empty(len(reps), np.int64)
        place[order] = np.arange(len(reps))
        shift, links, xs, ys = 0 if same else len(got[0].u), np.zeros(len(reps), np.int64), [], []
        for x, y in join(got[0], got[-1], same, threshold, eps):
            y = y + shift
            np.add.at(links, x, sizes[y])
            np.add.at(links, y, sizes[x])
            xs.append(place[x])
            ys.append(place[y])
        root = stars(len(reps), xs, ys)
        found = [(int(reps[k]), int(links[k]), int(reps[order[root[place[k]]]])) for k in np.flatnonzero(links)]
        schema = arrow_schema(FOUND)
        return pa.Table.from_batches([arrow_batch(found, schema)]) if found else schema.empty_table()

    return tasks.groupBy("dim", "a", "b").applyInArrow(run, FOUND)


def near_vectors(df: DataFrame, *, threshold: float = 0.9, block: int = 16_384, block_bytes: int = 8 << 20, sample: int = 10_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    A task holds two blocks. Each block is shipped to every block near it, so larger ones ship less and need more memory.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    vectors = saved(read_vectors(df, id_col, vector_col).withColumn("rep", F.xxhash64("v")))
    good = vectors.where("v is not null")
    basis = principal([r["v"] for r in good.select("rep", "v").orderBy("rep").limit(sample).select("v").collect()])
    classes = good.groupBy("rep", "v").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"))
    reps = placed(classes, basis, eps)
    reps = saved(reps)
    n = reps.count()
    bits = min(20, bucket_bits(n))
    spread = reps.withColumn("_h", F.xxhash64("rep", F.lit(6))).withColumn("_sub", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    spread = spread.withColumn("_bucket", F.shiftleft("cell", bits) + F.col("_sub")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_before(spread, "dim", "_bucket", ["_h", "rep"], "one", "rank")
    packed = saved(blocks_of(ranked, block, block_bytes))
    boxes = packed.select("dim", "block", "low", "high")
    first = lambda side: F.explode(F.sequence(F.floor(F.col("low")[0] / eps) - int(side == "b"), F.floor(F.col("high")[0] / eps) + int(side == "b"))) if eps else F.lit(0)
    left = boxes.select("dim", F.col("block").alias("a"), F.col("low").alias("alow"), F.col("high").alias("ahigh"), first("a").alias("c"))
    right = boxes.select("dim", F.col("block").alias("b"), F.col("low").alias("blow"), F.col("high").alias("bhigh"), first("b").alias("c"))
    gaps = F.zip_with(F.zip_with("alow", "bhigh", lambda x, y: x - y), F.zip_with("blow", "ahigh", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps * (1 + 1e-9) + 1e-12
    pairs = left.join(right, ["dim", "c"]).where((F.col("a") <= F.col("b")) & near).select("dim", "a", "b").distinct()
    sides = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block")))))
    tasks = pairs.select("dim", "a", "b", sides.alias("s")).select("dim", "a", "b", "s.side", "s.block").join(packed.drop("low", "high"), ["dim", "block"]).drop("block")
    found = saved(link(tasks, threshold, eps))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select("rep", "root"))
    of_rep = reps.select("rep", "first_id", "size").join(links, "rep", "left").join(parts, F.col("rep") == F.col("id"), "left").select("rep", "first_id", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("part"))
    least = saved(of_rep.groupBy("part").agg(F.min("first_id").alias("component_id")))  # saved, so that the join can split a large part
    of_rep = of_rep.join(least, "part").select("rep", "component_id", (F.col("size") - 1 + F.col("links")).alias("n_links"))
    out = good.join(of_rep, "rep").select("vec_id", "n_links", "component_id")
    alone = vectors.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
