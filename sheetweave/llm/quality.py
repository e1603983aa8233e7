"""Quality scores learned from preference pairs (Bradley-Terry).

A better and a worse labelled document form a pair; the chance that the better one wins is the logistic
function of the difference of their scores, which are linear in standardised text features. The weights
minimise the mean logistic loss of the feature differences plus a small ridge. The threshold is the quantile
of the training scores at the share of worse documents, and the reported score is the logistic function of
the distance from it.

Labels only choose the weights; scores use the text alone. ``fit`` learns from every labelled row and every pair of a
better and a worse one: means, deviations and the threshold are those of all labelled rows, and the loss is the mean over all pairs.
Pairs are never formed. What a row adds to the loss and its derivatives is a smooth function of its score, so rows are summed at
nodes of the score, STEP apart, and the nodes are paired; six nodes interpolate each score, which leaves an error of about 1e-8.
Features of labelled rows are saved in blocks of up to about ``block_rows``; a round of Newton's method reads them twice, and only sums come to the driver.
Edge cases: null and empty texts have features of zero and get a score like others; without
labels of both kinds every score is 0.5; an id labelled twice counts with its lower label, and an id with several
texts with the least of their features, so that reruns agree; repeated rows and ties are
scored one by one and alike; null ids are never labelled; a very long text is measured whole; an empty table gives no rows; other columns are passed on, and a column of
the name of the score is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetweave.llm.common import arrow_batch, arrow_schema, saved
from sheetweave.llm.token_rules import base_counts
from sheetweave.llm.url_filter import BLOCK_BITS, block_count, bloom_blocks, bloom_probe

FEATURES = 17
#: Distance of the nodes of a score, and the nodes that interpolate it, from the last one before it.
STEP, NEAR = 0.125, range(-2, 4)
#: So many sums of blocks are added up by one task, or by the driver.
MERGED_BITS = 6
PACKED = "block long, good binary, bad binary"
SUMS = "block long, part long, first long, v binary"
UPPER, DIGITS, STOPS, SHOUTS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?"


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words, chars, symbols, dups, repeats = base_counts(text)
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    size = len(raw)
    count = lambda what: size - len(raw.translate(None, what))
    seen = Counter(words)
    top = seen.most_common(1)[0][1]
    octets = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = octets[octets > 0] / size
    lines = raw.count(b"\n") + 1
    return [
        math.log1p(n), chars / n, count(UPPER) / size, count(DIGITS) / size, symbols / n, count(SHOUTS) / n, count(STOPS) / n, dups / lines, repeats / n,
        len(seen) / n, top / n, sum(c for w, c in seen.items() if len(w) <= 3) / n, math.log(lines / n), float(-(p * np.log2(p)).sum()), 1 - int(octets[:128].sum()) / size,
        max(map(len, seen)) / 100, sum(c for w, c in seen.items() if w.isupper()) / n,
    ]


def feature_frame(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``f`` (array<double>) instead of the text; other columns pass."""
    others = [c for c in docs.columns if c != text_col]
    schema = docs.select(*others).schema.add("f", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            got = [features(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array(got, pa.list_(pa.float64()))], names=[*others, "f"])

    return docs.select(*others, text_col).mapInArrow(run, schema)


def spread(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised features, and their squares, within four deviations."""
    z = np.clip((x - mean) / sd, -4, 4)
    return np.hstack((z, z * z))


class Ranker:
    """Weights of the scores, and the threshold. Made from arrays it fits ``pairs`` drawn pairs of them; ``fit`` learns from all pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, steps: int = 30) -> None:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.known = bool(len(good) and len(bad))
        if not self.known:
            return
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-9
        z = spread(x, self.mean, self.sd)
        n = max(pairs, len(good), len(bad))
        i = np.arange(n)
        rng = np.random.default_rng(5)
        d = z[good[rng.permutation(len(good))[i % len(good)]]] - z[bad[rng.integers(0, len(bad), n)]]
        w = np.zeros(d.shape[1])
        for _ in range(steps):  # Newton's method
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = -(d * p[:, None]).mean(0) + ridge * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        self.cut = float(np.quantile(z @ w, len(bad) / len(y)))

    @classmethod
    def of(cls, mean: np.ndarray, sd: np.ndarray, w: np.ndarray, cut: float) -> Ranker:
        ranker = cls.__new__(cls)
        ranker.known, ranker.mean, ranker.sd, ranker.w, ranker.cut = True, mean, sd, w, cut
        return ranker

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(spread(x, self.mean, self.sd) @ self.w - self.cut, -30, 30)))


def nodes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last node before each score, and the weights of the nodes NEAR it (six rows)."""
    at = np.floor(s / STEP).astype(np.int64)
    u = s / STEP - at
    return at, np.stack([np.prod([(u - q) / (p - q) for q in NEAR if q != p], axis=0) for p in NEAR])


def node_sums(s: np.ndarray, z: np.ndarray) -> tuple[int, np.ndarray]:
    """The first node, and for each from there the number of rows and the sum of z."""
    order = np.argsort(s, kind="stable")
    at, weights = nodes(s[order])
    rows = np.column_stack((np.ones(len(s)), z))[order]
    starts = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
    out = np.zeros((at[-1] - at[0] + len(NEAR), rows.shape[1]))
    for k, weight in enumerate(weights):
        out[at[starts] - at[0] + k] += np.add.reduceat(rows * weight[:, None], starts)
    return int(at[0]) + NEAR[0], out


def curve_at(s: np.ndarray, first: int, curve: np.ndarray) -> np.ndarray:
    """A curve given at the nodes from first on, at the scores."""
    at, weights = nodes(s)
    return sum(w * curve[at - first + p] for p, w in zip(NEAR, weights, strict=True))


def added(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Matrices added up, each from its first row on."""
    low = min(first for first, _ in parts)
    out = np.zeros((max(first + len(m) for first, m in parts) - low, parts[0][1].shape[1]))
    for first, m in parts:
        out[first - low : first - low + len(m)] += m
    return low, out


def sums_of(rows: list[dict], width: int) -> dict[int, tuple[int, np.ndarray]]:
    """By part, what the rows hold, added up in the order of the blocks."""
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["block"]):
        by.setdefault(r["part"], []).append((r["first"], np.frombuffer(r["v"]).reshape(-1, width)))
    return {part: added(got) for part, got in by.items()}


def totals(packed: DataFrame, blocks: int, work: Callable, width: int) -> dict[int, tuple[int, np.ndarray]]:
    """What work makes of the better and worse rows of each block, (part, first row, matrix), added up by part.

    Blocks and the order of their rows and sums are fixed, so the sums don't depend on how rows are dealt.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                got = work(*(np.frombuffer(batch.column(c)[i].as_buffer()).reshape(-1, FEATURES) for c in (1, 2)))
                yield arrow_batch([(batch.column(0)[i].as_py(), part, first, m.tobytes()) for part, first, m in got], arrow_schema(SUMS))

    def merge(key, table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        got = sums_of(table.to_pylist(), width)
        return pa.Table.from_batches([arrow_batch([(key[0].as_py(), part, first, m.tobytes()) for part, (first, m) in got.items()], arrow_schema(SUMS))])

    sums = packed.mapInArrow(run, SUMS)
    while blocks > 1 << MERGED_BITS:
        sums = sums.withColumn("over", F.shiftright("block", MERGED_BITS)).groupBy("over").applyInArrow(merge, SUMS)
        blocks = -(-blocks >> MERGED_BITS)
    return sums_of([r.asDict() for r in sums.collect()], width)


def pack(rows: DataFrame, blocks: int) -> DataFrame:
    """doc_id, y and f as blocks by a hash of the id: the features of better and of worse rows, in their order."""

    def run(key, table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        f, y = np.array(table.column("f").to_pylist(), float), table.column("y").to_numpy()
        order = np.lexsort(f.T)
        sides = (f[order[y[order] == kind]].tobytes() for kind in (1, 0))
        return pa.Table.from_batches([arrow_batch([(key[0].as_py(), *sides)], arrow_schema(PACKED))])

    return rows.select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(blocks).cast("long")).alias("block"), "y", "f").groupBy("block").applyInArrow(run, PACKED)


def ordered(s: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the scores."""
    bits = (s + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def unordered(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array(bits, np.uint64).view(float))


def learn(packed: DataFrame, blocks: int, ridge: float = 1e-3, steps: int = 30) -> Ranker:
    """Newton's method on the mean loss of all pairs of a better and a worse row, and the exact quantile of all scores."""
    counted = totals(packed, blocks, lambda *sides: [(k, 0, np.append(len(x), x.sum(0))[None]) for k, x in enumerate(sides)], FEATURES + 1)
    number = [int(counted[k][1][0, 0]) if counted else 0 for k in range(2)]
    if not all(number):
        return Ranker(np.empty((0, FEATURES)), np.empty(0))
    n = sum(number)
    mean = (counted[0][1] + counted[1][1])[0, 1:] / n
    sd = np.sqrt(totals(packed, blocks, lambda *sides: [(0, 0, sum(((x - mean) ** 2).sum(0) for x in sides)[None])], FEATURES)[0][1][0] / n) + 1e-9

    def at_nodes(w: np.ndarray) -> tuple:
        """Loss, gradient, and what the second derivatives need."""

        def work(*sides: np.ndarray) -> list:
            zs = [spread(x, mean, sd) for x in sides]
            return [(k, *node_sums(z @ w, z)) for k, z in enumerate(zs) if len(z)]

        got = totals(packed, blocks, work, 2 * FEATURES + 1)
        (g, good), (b, bad) = ((first, m / c) for (first, m), c in zip((got[0], got[1]), number, strict=True))
        curves, part = [np.zeros_like(good), np.zeros_like(good), np.zeros_like(good)], 256
        for i in range(0, len(good), part):  # better nodes against all worse ones
            t = ((g + np.arange(i, min(i + part, len(good))))[:, None] - (b + np.arange(len(bad)))) * STEP
            p = 1 / (1 + np.exp(np.clip(t, -700, 700)))
            for curve, kernel in zip(curves, (np.logaddexp(0, -t), -p, p * (1 - p)), strict=True):
                curve[i : i + part] = kernel @ bad
        back = np.zeros(len(bad))
        for i in range(0, len(bad), part):
            t = ((g + np.arange(len(good)))[:, None] - (b + np.arange(i, min(i + part, len(bad))))) * STEP
            p = 1 / (1 + np.exp(np.clip(t, -700, 700)))
            back[i : i + part] = (p * (1 - p)).T @ good[:, 0]
        loss = good[:, 0] @ curves[0][:, 0] + ridge / 2 * w @ w
        grad = good[:, 1:].T @ curves[1][:, 0] - curves[1][:, 1:].T @ good[:, 0] + ridge * w
        cross = good[:, 1:].T @ curves[2][:, 1:]
        return loss, grad, cross, ((g, curves[2][:, 0]), (b, back))

    def curvature(w: np.ndarray, cross: np.ndarray, curves: tuple) -> np.ndarray:
        def work(*sides: np.ndarray) -> list:
            out = []
            for k, (x, curve) in enumerate(zip(sides, curves, strict=True)):
                z = spread(x, mean, sd)
                if len(z):
                    out.append((k, 0, (z * curve_at(z @ w, *curve)[:, None]).T @ z))
            return out

        got = totals(packed, blocks, work, 2 * FEATURES)
        return sum(got[k][1] / number[k] for k in range(2)) - cross - cross.T + ridge * np.eye(len(w))

    w = np.zeros(2 * FEATURES)
    loss, grad, *rest = at_nodes(w)
    for _ in range(steps):
        step = np.linalg.solve(curvature(w, *rest), grad)
        while np.abs(step).max() >= 1e-6:
            tried = at_nodes(w - step)
            if tried[0] <= loss + 1e-9:
                break
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
        loss, grad, *rest = tried

    low, high = threshold(packed, blocks, lambda x: spread(x, mean, sd) @ w, (number[1] - 1, number[1]))
    return Ranker.of(mean, sd, w, low + (high - low) * (1 - number[1] / n))


def threshold(packed: DataFrame, blocks: int, score_of: Callable, ranks: tuple[int, ...]) -> list[float]:
    """The scores of the given ranks of all rows, from 0 up: bits of the ordered scores are settled from the highest on, 11 a pass."""
    found, left = [0] * len(ranks), list(ranks)
    for shift, bits in ((53, 11), (42, 11), (31, 11), (20, 11), (9, 11), (0, 9)):

        def work(*sides: np.ndarray, shift: int = shift, bits: int = bits, found: tuple = tuple(found)) -> list:
            top = ordered(np.concatenate([score_of(x) for x in sides])) >> np.uint64(shift)
            low = (top & np.uint64((1 << bits) - 1)).astype(np.int64)
            return [(k, 0, np.bincount(low[top >> np.uint64(bits) == np.uint64(f)], minlength=1 << bits).astype(float)[:, None]) for k, f in enumerate(found)]

        got = totals(packed, blocks, work, 1)
        for k in range(len(ranks)):
            upto = np.cumsum(got[k][1][:, 0])
            digit = int(np.searchsorted(upto, left[k], side="right"))
            left[k] -= int(upto[digit - 1]) if digit else 0
            found[k] = found[k] << bits | digit
    return [unordered(f) for f in found]


def fit(docs: DataFrame, labels: DataFrame, *, block_rows: int = 8192, bloom_bytes: int = 32 << 20) -> Ranker:
    """labels: doc_id and quality (0 or 1), all of which are learned from.

    A Bloom filter of the labelled ids, of bloom_bytes at most, only spares the features of other documents: the join behind it is exact, and no text is shuffled.
    """
    key = F.col("doc_id").cast("string").alias("doc_id")  # ids of different types hash alike
    marked = saved(labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(key, "quality").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")))  # read three times
    n = marked.count()
    blocks = max(1, -(-n // block_rows))
    n_bloom = min(block_count(n), max(1, bloom_bytes // (BLOCK_BITS // 8 + 8)))
    asked = bloom_probe(docs.select(key, "text"), "doc_id", bloom_blocks(marked, "doc_id", n_bloom), n_bloom, max(bloom_bytes, BLOCK_BITS)).where("_maybe").drop("_maybe")
    rows = feature_frame(asked).groupBy("doc_id").agg(F.min("f").alias("f")).join(marked, "doc_id")
    return learn(saved(pack(rows, blocks)), blocks)


def score(docs: DataFrame, ranker: Ranker, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a column out_col (0 to 1)."""
    docs = docs.drop(out_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            x = np.array([features(t or "") for t in texts], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranker.score(x))], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))
