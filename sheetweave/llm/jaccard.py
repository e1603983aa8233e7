"""Near-duplicate documents: Jaccard join of word n-grams by a MinHash LSH forest.

A document is the set of its shingles, runs of five words (all its words, if it has fewer), after
lower-casing. Documents with the same set form a class and go on as one. Each of ``trees`` tries holds the classes
by sequences of MinHash values of 16 bits, sorted; a node is the run of classes that begin with the same values.
Classes are candidates where they share a prefix. The search begins at the depth where a tree set finds a pair
at the threshold with a chance of ``probe``, and what it finds is verified. The found pairs, by bands of
similarity, tell which bands the data have; while a band among them is found with less than the ``target``
recall, the prefixes are shortened to the longest that reaches it, and the nodes that have grown by another child
are searched again. Data whose pairs are all very similar so stay with deep prefixes and few candidates; a band
that holds k pairs is overlooked with a chance of (1 - probe)^k at most.

A pair belongs to the first round and tree where its prefixes match, so it is counted once; nodes with the same members are
compared once. Nodes are cut into blocks of bounded size, and every pair of blocks is a task of its own: the
64-bit shingles are intersected exactly (products of 0/1 matrices), and a task gives, per class, the number of links
and a spanning star of what hangs together, never the pairs. Components follow from the stars. Shingles and sets
are told apart by 64-bit hashes, and no other approximation enters a similarity.

Edge cases: null and empty texts have no shingles, link with nothing and are kept; repeated rows are copies of
each other even under one id (all that have the class's smallest id stay); a null id counts as larger than
every other, and a class without ids is kept; ties of similarity at the threshold are links; an empty table gives no rows; a text of any length is hashed whole, and blocks are cut by their
number of shingles; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.common import arrow_batch, arrow_schema, saved
from sheetweave.llm.components import components
from sheetweave.llm.packing import slices
from sheetweave.llm.url_filter import block_count, bloom_blocks, bloom_probe

WORDS, THRESHOLD = 5, 0.8
#: Bands of similarity, from the threshold to 1.
BANDS = 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def depth_for(threshold: float, trees: int, target: float, deepest: int = 16) -> int:
    """The longest prefix that finds a pair at the threshold with the target recall; an error if none does."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    if 1 - (1 - threshold) ** trees < target:
        raise ValueError(f"{trees} trees find a pair at {threshold} with a recall under {target} at any depth; use more trees")
    return 1


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values, scrambled."""
    x = (x ^ (x >> np.uint64(32))) * M1
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, end to end, and how many each text has."""
    import xxhash

    split = [t.lower().encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for s in split for w in s], np.uint64)
    n = len(h)
    roll = np.zeros(n, np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(n) - np.repeat(starts, sizes)
    room = np.repeat(sizes, sizes)
    for k in range(words):  # a text shorter than a window has one shingle of what it has
        ahead = np.arange(n) + k
        ok = place + k < room
        roll[ok] = mixed(roll[ok] * M2 + h[ahead[ok]] + np.uint64(k + 1))
    whole = (place + words <= room) | ((room < words) & (place == 0))
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), sizes)[whole], minlength=len(texts))).tolist()
    roll = mixed(roll[whole])
    sets = [np.unique(roll[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
    return np.concatenate(sets) if sets else roll, np.array([len(x) for x in sets], np.int64)


def signatures(values: np.ndarray, counts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Per text with shingles, in order: for each tree a sequence of ``depth`` MinHash values of 16 bits."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    rng = np.random.default_rng(8)
    x = mixed(values + np.uint64(1))
    out = np.zeros((len(starts), trees, depth), "<u2")
    if not len(starts):
        return out
    for t in range(trees):
        for k in range(depth):
            a, b = (np.uint64(v) for v in rng.integers(1, 2**63, 2, dtype=np.uint64))
            out[:, t, k] = mixed(np.minimum.reduceat((x ^ b) * (a | np.uint64(1)), starts)) >> np.uint64(48)
    return out


def set_hashes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set that isn't empty, as a signed number."""
    full = counts > 0
    if not len(values):
        return np.zeros(0, np.int64)
    sums = np.add.reduceat(mixed(values + np.uint64(3)), (np.cumsum(counts) - counts)[full])
    return mixed(sums * M2 + counts[full].astype(np.uint64)).view(np.int64)


SIGNED = "doc_id long, text_hash long, n long, rep long, sig binary"


def sign(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, a hash of the text, number of shingles, a hash of the set, and the sequences of all trees (null without shingles)."""
    def run(batches: Iterator) -> Iterator:
        schema = arrow_schema(SIGNED)
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 20):
                names, texts = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 2))
                v, c = shingles([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                sigs = iter(signatures(v, c, trees, depth))
                sets = iter(set_hashes(v, c).tolist())
                rows = [(d, t, int(n), next(sets) if n else None, next(sigs).tobytes() if n else None) for d, t, n in zip(names, texts, c, strict=True)]
                yield arrow_batch(rows, schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) text_hash").mapInArrow(run, SIGNED)


def overlaps(values: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, wide: int = 4096) -> np.ndarray:
    """Exact intersection sizes of the sets a (rows) with the sets b (columns); indexes of texts."""
    starts = np.cumsum(counts) - counts
    use = np.unique(np.concatenate((a, b)))
    owner = np.repeat(np.arange(len(use)), counts[use])
    v = np.concatenate([values[starts[i] : starts[i] + counts[i]] for i in use])
    _, col, df = np.unique(v, return_inverse=True, return_counts=True)
    shared = df[col] > 1
    owner, col = owner[shared], col[shared]
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(col):
        return out
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    ra, rb = np.searchsorted(use, a), np.searchsorted(use, b)
    for lo in range(0, int(col[-1]) + 1, wide):
        i, j = np.searchsorted(col, (lo, lo + wide))
        m = np.zeros((len(use), min(wide, int(col[-1]) + 1 - lo)), np.float32)
        m[owner[i:j], col[i:j] - lo] = 1
        out += m[ra] @ m[rb].T
    return out


def stars(n: int, rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """The smallest index reachable from each of n nodes."""
    root = np.arange(n)
    if not rows:
        return root
    r, c = np.concatenate(rows), np.concatenate(cols)
    while True:
        low = np.minimum(root[r], root[c])
        new = root.copy()
        np.minimum.at(new, root[r], low)
        np.minimum.at(new, root[c], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def fresh(sigs: np.ndarray, x: np.ndarray, y: np.ndarray, tree: int, depth: int, before: int, some: int = 10_000) -> np.ndarray:
    """Which pairs have this round and tree as their first: no earlier tree matches at depth, and none at the deeper one before (0: there was none)."""
    out = [np.zeros(0, bool)]
    for lo in range(0, len(x), some):
        common = np.logical_and.accumulate(sigs[x[lo : lo + some]] == sigs[y[lo : lo + some]], axis=2).sum(2)
        out.append((common[:, tree] >= depth) & (common[:, :tree] < depth).all(1) & ((common < before).all(1) | (before == 0)))
    return np.concatenate(out)


def compare(reps: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, blocks: np.ndarray, values: np.ndarray, counts: np.ndarray, tree: int, i: int, j: int, threshold: float, depth: int, before: int, tile: int = 512) -> list[tuple]:
    """(rep, links, root) of one pair of blocks, links weighing the sizes of classes; and (None, pairs, band) of the pairs found."""
    order = np.argsort(reps, kind="stable")
    side = [order[blocks[order] == i], order[blocks[order] == j]]
    links, rows, cols = np.zeros(len(reps), np.int64), [], []
    seen = np.zeros(BANDS, np.int64)
    place = np.empty(len(reps), np.int64)
    place[order] = np.arange(len(reps))
    for lo in range(0, len(side[0]), tile):
        for lo2 in range(lo if i == j else 0, len(side[1]), tile):
            a, b = side[0][lo : lo + tile], side[1][lo2 : lo2 + tile]
            inter = overlaps(values, counts, a, b).astype(np.float64)
            alike = inter / (counts[a][:, None] + counts[b][None, :] - inter)
            near = alike >= threshold
            if i == j and lo == lo2:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            alike = alike[x, y]
            x, y = a[x], b[y]
            new = fresh(sigs, x, y, tree, depth, before)
            x, y, alike = x[new], y[new], alike[new]
            if len(x):
                seen += np.bincount(np.minimum(BANDS - 1, ((alike - threshold) / max(1e-9, 1 - threshold) * BANDS).astype(int)), minlength=BANDS)
                np.add.at(links, x, sizes[y])
                np.add.at(links, y, sizes[x])
                rows.append(place[x])
                cols.append(place[y])
    root = stars(len(reps), rows, cols)
    return [(int(reps[k]), int(links[k]), int(reps[order[root[place[k]]]])) for k in np.flatnonzero(links)] + [(None, int(seen[k]), int(k)) for k in np.flatnonzero(seen)]


FOUND = "rep long, links long, root long"


def verify(tasks: DataFrame, threshold: float, trees: int, depth: int, before: int) -> DataFrame:
    """tasks: tree, i, j, group (long), block, rep, size, sig, shingles (binary), dealt and sorted by task."""
    def run(batches: Iterator) -> Iterator:
        schema, now, held = arrow_schema(FOUND), None, []

        def done() -> list[tuple]:
            if len(held) < 2:
                return []
            got = [np.frombuffer(r[4], "<u8") for r in held]
            cols = [np.array([r[k] for r in held]) for k in range(3)]
            sigs = np.stack([np.frombuffer(r[3], "<u2").reshape(trees, -1) for r in held])
            return compare(cols[1], cols[2], sigs, cols[0], np.concatenate(got), np.array([len(g) for g in got]), now[0], now[1], now[2], threshold, depth, before)

        out: list[tuple] = []
        for batch in batches:
            for tree, group, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (task := (tree, i, j, group)):
                    out += done()
                    now, held = task, []
                    if len(out) > 10_000:
                        yield arrow_batch(out, schema)
                        out = []
                held.append(row)
        out += done()
        if out:
            yield arrow_batch(out, schema)

    return tasks.select("tree", "group", "i", "j", "block", "rep", "size", "sig", "shingles").mapInArrow(run, FOUND)


def with_shingles(docs: DataFrame) -> DataFrame:
    """(rep, shingles) of every text that has some."""
    kind = "rep long, shingles binary"

    def run(batches: Iterator) -> Iterator:
        schema = arrow_schema(kind)
        for batch in batches:
            for lo, hi in slices(batch.column(0), 1 << 20):
                v, c = shingles([t or "" for t in batch.column(0).slice(lo, hi - lo).to_pylist()])
                c, sets = c[c > 0], set_hashes(v, c).tolist()
                if sets:
                    yield arrow_batch([(r, v[e - n : e].astype("<u8").tobytes()) for r, n, e in zip(sets, c, np.cumsum(c), strict=True)], schema)

    return docs.select("text").mapInArrow(run, kind)


def join_near(docs: DataFrame, **options: float) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest id reachable by links), n_links (documents linked directly, copies included), class_size (copies, itself included), kept (whether it is the one that stays)."""
    return near_rows(docs, **options).drop("text_hash", "stays")


def nodes_of(trie: DataFrame, depth: int, before: int) -> DataFrame:
    """(tree, group, m, total) of the nodes of a depth that have more than one child of the depth before (or class, in the first round); of nodes with the same members, one."""
    group = F.xxhash64(F.substring("seq", 1, 2 * depth))
    child = F.xxhash64(F.substring("seq", 1, 2 * before)) if before else F.col("rep")
    nodes = trie.groupBy("tree", group.alias("group")).agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min(child).alias("c1"), F.max(child).alias("c2"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2")).where("m > 1 and c1 <> c2")
    return nodes.groupBy("m", "x1", "x2").agg(F.min(F.struct("tree", "group", "total")).alias("g")).select("g.*", "m")


def members(trie: DataFrame, nodes: DataFrame, depth: int, block: int, block_shingles: int) -> DataFrame:
    """(tree, group, rep, blocks, block) of the classes below nodes."""
    n_blocks = F.greatest(F.ceil(F.col("m") / block), F.least(F.col("m"), F.ceil(F.col("total") / block_shingles))).cast("int").alias("blocks")
    keyed = trie.select("tree", F.xxhash64(F.substring("seq", 1, 2 * depth)).alias("group"), "rep")
    return keyed.join(nodes.select("tree", "group", n_blocks), ["tree", "group"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int"))


def near_rows(docs: DataFrame, *, threshold: float = THRESHOLD, trees: int = 24, target: float = 0.999, probe: float = 0.98, block: int = 256, block_shingles: int = 1 << 18) -> DataFrame:
    """As join_near, with text_hash and stays: by id and text, one document of each component stays, whether or not it has an id of its own."""
    least, deepest = depth_for(threshold, trees, target), depth_for(threshold, trees, min(probe, target))
    signed = saved(sign(docs, trees, deepest))
    reps = saved(signed.where("n > 0").groupBy("rep").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    sequences = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substr(F.col("sig"), t * (2 * deepest) + 1, F.lit(2 * deepest)))
    # the tries hold the classes that share a prefix of the shallowest depth; others have no candidates at any
    every = reps.select("rep", "n", F.posexplode(sequences).alias("tree", "seq")).withColumn("group", F.xxhash64(F.substring("seq", 1, 2 * least)))
    shared = every.groupBy("tree", "group").agg(F.count("*").alias("m")).where("m > 1").select("tree", "group")
    live = every.join(shared, ["tree", "group"]).select("rep", "n", "tree", "seq")
    trie = saved(live.repartitionByRange("tree", "seq", "rep").sortWithinPartitions("tree", "seq", "rep"))
    # a text of each of them is read again, once; the filter only saves work, the join is exact
    need = trie.select("rep").distinct().join(reps.select("rep", "first_id"), "rep").select(F.coalesce("first_id", F.lit(-1)).alias("_id"))
    n_bloom = block_count(-(-trie.count() // 2))  # a class is in two tries or more, as a rule; more keys only let more texts through
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), "text")
    text = bloom_probe(text, "_id", bloom_blocks(need, "_id", n_bloom), n_bloom).where("_maybe")
    load = saved(with_shingles(text).dropDuplicates(["rep"]).join(reps.select("rep", "size", "sig"), "rep"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j"))))
    found, bands, depth, before = None, np.zeros(BANDS, np.int64), deepest, 0
    while before != depth:
        wanted = members(trie, nodes_of(trie, depth, before), depth, block, block_shingles)
        tasks = wanted.join(load, "rep").select("*", pairs.alias("ij")).select("tree", "group", "ij.i", "ij.j", "block", "rep", "size", "sig", "shingles")
        got = saved(verify(tasks.repartition("tree", "group", "i", "j").sortWithinPartitions("tree", "group", "i", "j"), threshold, trees, depth, before))
        for r in got.where("rep is null").groupBy("root").agg(F.sum("links").alias("n")).collect():  # one row for each band
            bands[r["root"]] += r["n"]
        found = got if found is None else found.unionByName(got)
        before = depth
        if bands.any():  # the weakest band with pairs decides
            weakest = threshold + (1 - threshold) * int(np.flatnonzero(bands)[0]) / BANDS
            depth = min(depth, depth_for(weakest, trees, target))
    found = found.where("rep is not null")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select("rep", "root"))
    of_rep = reps.select("rep", "first", "size").join(links, "rep", "left").join(parts, F.col("rep") == F.col("id"), "left").select("rep", "first", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("part"))
    least = saved(of_rep.groupBy("part").agg(F.min("first").alias("least")))  # saved, so that the join can split a large part
    of_rep = of_rep.join(least, "part").select("rep", "least", "size", "links")
    out = signed.where("n > 0").join(of_rep, "rep").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("class_id"), (F.col("size") - 1 + F.col("links")).alias("n_links"), F.col("size").alias("class_size"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("stays"))
    alone = signed.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("stays"))
    return out.unionByName(alone).withColumn("kept", F.when(F.col("class_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False))))
