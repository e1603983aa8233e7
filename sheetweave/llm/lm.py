"""Language-model scores by deleted interpolation of word n-grams.

P3(w | u v) = l3 * c(u v w) / c(u v) + (1 - l3) * P2(w | v),  P2(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1),
with weights that depend on the frequency bucket of the context, u v or v: bucket b holds counts of b binary
digits. They are learned by expectation-maximisation on held-out counts in the deleted sense: every training
token is taken out of the counts before it is predicted, so an event has the counts c(u v w) - 1, c(u v) - 1,
c(v w) - 1, c(v) - 1, c(w) - 1 and N - 1. The weights of P2 come first, then those of P3 given P2. Events enter the EM
as a histogram of their bucket and two probabilities, rounded to half octaves (by at most 19 per cent each), whose
size is fixed; all training tokens are in it.

One pass makes chunks of some megabytes of text, each a run of the rows of a partition, so that repeated rows gather
nowhere. A chunk sends its distinct n-grams, as sorted hashes, with its training counts to nodes of the hash range;
what it sends is cut in at most ``2 ** fan`` parts. With more chunks than that, nodes come in levels, as in a butterfly
network: a node adds up what as many chunks or nodes sent for its part of the range, and sends that on, cut again, so
every task gets and sends a bounded number of messages and their number grows with the chunks (6 GB of text are a thousand chunks, one level). The last level has the
whole corpus's counts, and answers go back the same way. A chunk, met again with its answers, keeps the
counts of its distinct n-grams. No task holds more than about a chunk, and a frequent word is one number in
each message. Words have hashes of 64 bits, so that N, V and the base score are exact; those of pairs and triples are as wide as
the corpus needs for one to share its hash by accident once in 4,096 times, 40 bits at least and 64 at most.

Edge cases: null and empty texts are the end token alone; without training tokens counts are 0 and l0 is 1; an empty table gives no rows;
words of any length are hashed whole, and a very long text is a chunk of its own; repeated rows count and are scored one by one; a null doc_id counts as
an empty id; other columns are ignored. A lost executor's chunks are made again from the same rows, so docs should be a table or a plan that
gives its rows in the same order again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.common import arrow_batch, arrow_schema, crc_mod, saved
from sheetweave.llm.jaccard import M2, mixed

END, BEGIN = np.uint64(0xE9D), np.uint64(0xBE61)
BINS, ORDERS = 64, 3


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of all of them, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unplanes(b: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8")


def sorted_planes(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unsorted_planes(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b), dtype=np.uint64)


def tokens(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and the number of tokens of each text."""
    import xxhash

    split = [(t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")).lower().split() for t in texts]
    sizes = np.array([len(s) + 1 for s in split], np.int64)
    out = np.full(int(sizes.sum()), END, np.uint64)
    words = np.ones(len(out), bool)
    words[np.cumsum(sizes) - 1] = False
    out[words] = np.array([xxhash.xxh3_64_intdigest(w) for s in split for w in s], np.uint64)
    return out, sizes


def grams(h: np.ndarray, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """Keys of each token alone, of 64 bits, and with the one and the two before it, of width bits."""
    first = np.cumsum(sizes) - sizes
    one = np.empty_like(h)
    one[1:] = h[:-1]
    one[first] = BEGIN
    two = np.empty_like(one)
    two[1:] = one[:-1]
    two[first] = BEGIN
    pair = mixed(one * M2 + h + np.uint64(7))
    keys = mixed(h + np.uint64(11)), pair, mixed(mixed(two + np.uint64(5)) * M2 + pair)
    return [keys[0], *(k >> np.uint64(64 - width) for k in keys[1:])]


CHUNK = "chunk long, doc_ids array<long>, train array<boolean>, sizes array<long>, words binary, at binary"
MESSAGE = "src long, dst long, keys array<binary>, counts array<binary>"
ANSWER = "src long, dst long, counts array<binary>, n long, v long"
COUNTED = "doc_ids array<long>, train array<boolean>, sizes array<long>, words binary, at binary, counts array<binary>, n long, v long"


def chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """A row for each run of rows: a number of its own, ids, whether they are for training, numbers of tokens, distinct word hashes and each token's place among them."""
    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        schema, part, seq = arrow_schema(CHUNK), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def done():  # noqa: ANN202
            h, sizes = tokens([r[1] for r in held])
            words, at, times = np.unique(h, return_inverse=True, return_counts=True)
            order = np.lexsort((words, -digits(times)))  # frequent words first: small numbers for them, and runs of ascending hashes
            place = np.empty(len(words), np.uint64)
            place[order] = np.arange(len(words), dtype=np.uint64)
            return arrow_batch([(part << 20 | seq, [r[0] for r in held], [r[2] for r in held], sizes.tolist(), sorted_planes(words[order]), planes(place[at]))], schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = len(row[1] or "") + 16
                if held and size + more > chunk_bytes:
                    yield done()
                    held, size, seq = [], 0, seq + 1
                held.append(row)
                size += more
        if held:
            yield done()

    return rows.select("doc_id", "text", "train").mapInArrow(run, CHUNK)


def digits_of(bits: int, fan: int) -> list[int]:
    """bits, dealt to as few levels of at most fan bits as there can be."""
    levels = max(1, -(-bits // fan))
    return [bits // levels + (k < bits % levels) for k in range(levels)]


def cut(src: int, lists: list[tuple[np.ndarray, np.ndarray]], own: int, rest: int, left: int, more: int, width: int) -> list[tuple]:
    """The messages of src, a node or chunk with part ``own`` of the range and number ``rest`` of ``left`` bits: its sorted keys and counts, cut by the next ``more`` bits of the range."""
    used = own.bit_length() - 1  # own has a leading one
    lows = [(own << more) + d - (1 << used + more) for d in range(1 << more)]
    edges = [[*np.searchsorted(k, np.array([x << (w - used - more) for x in lows], np.uint64)).tolist(), len(k)] for (k, _), w in zip(lists, (64, width, width), strict=True)]
    out = []
    for d in range(1 << more):
        spans = [(e[d], e[d + 1]) for e in edges]
        if any(j > i for i, j in spans):
            dst = (((own << more) + d) << (left - more)) | (rest >> more)
            out.append((src, dst, [sorted_planes(k[i:j]) for (k, _), (i, j) in zip(lists, spans, strict=True)], [planes(c[i:j]) for (_, c), (i, j) in zip(lists, spans, strict=True)]))
    return out


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct keys, each list's places among them, and the sums over all lists."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.uint64)
    np.add.at(total, at, np.concatenate(counts))
    return distinct, np.split(at, np.cumsum([len(k) for k in keys])[:-1]), total


def sums(table) -> list[tuple]:  # noqa: ANN001
    """add_up of the messages of a node, by order."""
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    return [add_up([unsorted_planes(k[o]) for k in keys], [unplanes(c[o]) for c in counts]) for o in range(ORDERS)]


def joined(answers: list[tuple]) -> list[np.ndarray]:
    """By order, the counts of answers (src, counts) in the order of their part of the range."""
    answers = sorted(answers, key=lambda a: a[0])
    return [np.concatenate([unplanes(c[o]) for _, c in answers]) for o in range(ORDERS)]


def distinct_grams(words: bytes, at: bytes, sizes: list[int], width: int, orders: int = ORDERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order, the distinct keys of a chunk and each token's place among them."""
    h = unsorted_planes(words)[unplanes(at).astype(np.int64)]
    return [np.unique(k, return_inverse=True) for k in grams(h, np.array(sizes, np.int64), width)[:orders]]


def count(docs: DataFrame, train: Column, chunk_bytes: int = 6 << 20, fan: int = 10) -> tuple[DataFrame, int]:
    """A row for each chunk with the corpus's counts of its distinct n-grams, and one without that has N and V; and the width of keys."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    size, n_rows = (x or 0 for x in rows.agg(F.sum(F.octet_length("text")), F.count("*")).first())
    bits = max(0, math.ceil(math.log2(max(1, size / chunk_bytes))))
    width = min(64, max(40, bits + 12, math.ceil(math.log2(size / 4 + n_rows + 2)) + 12))
    made = chunks(rows, chunk_bytes).repartition("chunk")  # once, for what is sent and for what is met: both take all columns
    plan = digits_of(bits, fan)

    def emit(batches: Iterator) -> Iterator:
        schema = arrow_schema(MESSAGE)
        for batch in batches:
            for chunk, _, learn, sizes, words, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                learnt = np.repeat(np.array(learn, bool), sizes)
                lists = [(k, np.bincount(i[learnt], minlength=len(k)).astype(np.uint64)) for k, i in distinct_grams(words, at, sizes, width)]
                rest = int(mixed(np.array([chunk + 1], np.uint64))[0]) & ((1 << bits) - 1)
                got = cut(chunk, lists, 1, rest, bits, plan[0], width)
                for lo in range(0, len(got), 16):
                    yield arrow_batch(got[lo : lo + 16], schema)

    def send_on(left: int, more: int):  # noqa: ANN202
        def run(key, table):  # noqa: ANN001, ANN202
            import pyarrow as pa

            node = key[0].as_py()
            got = cut(node, [(k, total) for k, _, total in sums(table)], node >> left, node & ((1 << left) - 1), left, more, width)
            return pa.Table.from_batches([arrow_batch(got, arrow_schema(MESSAGE))])

        return run

    def reply(key, table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        by = sums(table)
        got = [(key[0].as_py(), src, [planes(total[at[i]]) for _, at, total in by], None, None) for i, src in enumerate(table.column("src").to_pylist())]
        got.append((key[0].as_py(), -1, None, int(by[0][2].sum()), int((by[0][2] > 0).sum())))
        return pa.Table.from_batches([arrow_batch(got, arrow_schema(ANSWER))])

    def totals(answers) -> tuple:  # noqa: ANN001
        return sum(answers.column("n").to_pylist()), sum(answers.column("v").to_pylist())

    def pass_back(key, messages, answers):  # noqa: ANN001, ANN202
        import pyarrow as pa

        if key[0].as_py() == -1:
            got = [(-1, -1, None, *totals(answers))]
        else:
            all_counts = joined(list(zip(answers.column("src").to_pylist(), answers.column("counts").to_pylist(), strict=True)))
            places = [at for _, at, _ in sums(messages)]
            got = [(key[0].as_py(), src, [planes(c[at[i]]) for c, at in zip(all_counts, places, strict=True)], None, None) for i, src in enumerate(messages.column("src").to_pylist())]
        return pa.Table.from_batches([arrow_batch(got, arrow_schema(ANSWER))])

    def meet(key, own, answers):  # noqa: ANN001, ANN202
        import pyarrow as pa

        if key[0].as_py() == -1:
            got = (None, None, None, None, None, None, *totals(answers))
        else:
            row = own.to_pylist()[0]
            c = joined(list(zip(answers.column("src").to_pylist(), answers.column("counts").to_pylist(), strict=True)))
            got = (*(row[n] for n in ("doc_ids", "train", "sizes", "words", "at")), [planes(x) for x in c], None, None)
        return pa.Table.from_batches([arrow_batch([got], arrow_schema(COUNTED))])

    levels, left = [made.mapInArrow(emit, MESSAGE)], bits
    for now, more in zip(plan, plan[1:], strict=False):
        left -= now
        levels.append(levels[-1].groupBy("dst").applyInArrow(send_on(left, more), MESSAGE))
    answers = levels.pop().groupBy("dst").applyInArrow(reply, ANSWER)
    while levels:
        answers = levels.pop().groupBy("dst").cogroup(answers.groupBy("dst")).applyInArrow(pass_back, ANSWER)
    return saved(made.groupBy("chunk").cogroup(answers.groupBy("dst")).applyInArrow(meet, COUNTED)), width


def documents_of(batch, width: int, orders: int = ORDERS) -> Iterator[tuple]:  # noqa: ANN001
    """(doc_id, train, [c1, c2, c3]) of the chunks of a batch: the counts of all tokens and of their n-grams."""
    for ids, train, sizes, words, at, counts in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
        c = [unplanes(x)[i] for x, (_, i) in zip(counts[:orders], distinct_grams(words, at, sizes, width, orders), strict=True)]
        lo = 0
        for doc_id, learnt, n in zip(ids, train, sizes, strict=True):
            yield doc_id, learnt, [x[lo : lo + n].astype(np.float64) for x in c]
            lo += n


def digits(x: np.ndarray) -> np.ndarray:
    """Binary digits of whole numbers; 0 has none."""
    return np.frexp(x.astype(np.float64))[1]


def binned(p: np.ndarray) -> np.ndarray:
    """0 for 0, else half octaves below 1."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = 1 + np.minimum(BINS - 2, np.floor(-2 * np.log2(np.minimum(p[some], 1.0))).astype(np.int64))
    return out


def contexts(c: list[np.ndarray]) -> list[np.ndarray]:
    """Counts of what comes before each token of a text: one token, two tokens. The begin occurs as often as the end."""
    return [np.concatenate((c[0][-1:], x[:-1])) for x in c[: len(c) - 1]]


def estimate(of: np.ndarray, context: np.ndarray, less: int) -> np.ndarray:
    return np.where(context > less, (of - less) / np.maximum(context - less, 1), 0.0)


def lower(c: list[np.ndarray], n: int, v: int, weights: np.ndarray, less: int) -> np.ndarray:
    """P2 of each token; with less = 1 each is taken out of the counts."""
    before = contexts(c)[0]
    w = weights[digits(np.maximum(before - less, 0))]
    return w[:, 0] * estimate(c[1], before, less) + w[:, 1] * (c[0] - less) / max(n - less, 1) + w[:, 2] / (v + 1)


def events(c: list[np.ndarray], n: int, v: int, weights: np.ndarray | None) -> np.ndarray:
    """Histogram cells of a training text's tokens with each taken out of the counts: of bigrams and unigrams, or, given P2's weights, of trigrams and P2."""
    k = 0 if weights is None else 1
    before = contexts(c)[k]
    below = (c[0] - 1) / max(n - 1, 1) if weights is None else lower(c, n, v, weights, 1)
    return (digits(np.maximum(before - 1, 0)) * BINS + binned(estimate(c[k + 1], before, 1))) * BINS + binned(below)


def learn_weights(cells: np.ndarray, times: np.ndarray, v: int | None, rounds: int = 60) -> np.ndarray:
    """By bucket, the weights of the estimate, of what is below it, and, with v, of the uniform estimate; by EM."""
    n = 3 if v is not None else 2
    out = np.tile(np.array([0.0] + [1 / (n - 1)] * (n - 1)), (65, 1))
    middle = np.concatenate(([0.0], 2.0 ** (-(np.arange(BINS - 1) + 0.5) / 2)))
    b, high, low = cells // (BINS * BINS), middle[cells // BINS % BINS], middle[cells % BINS]
    for bucket in [None, *np.unique(b)]:
        own = slice(None) if bucket is None else b == bucket
        if not len(times[own]):
            continue
        p = np.stack([high[own], low[own]] + ([np.full(len(low[own]), 1 / (v + 1))] if v is not None else []), 1)
        p, t = p[p.sum(1) > 0], times[own][p.sum(1) > 0]
        if not len(t):
            continue
        w = np.full(n, 1 / n)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = (share * t[:, None]).sum(0) / t.sum()
        w = np.maximum(w, 1e-6)
        if bucket is None:
            out[1:] = w / w.sum()
        else:
            out[bucket] = w / w.sum()
    out[0, 0] = 0.0  # an unseen context has no estimate
    out[0] /= out[0].sum()
    return out


def log10_probability(c: list[np.ndarray], n: int, v: int, two: np.ndarray, three: np.ndarray) -> float:
    before = contexts(c)[1]
    w = three[digits(before)]
    return float(np.log10(w[:, 0] * estimate(c[2], before, 0) + w[:, 1] * lower(c, n, v, two, 0)).sum())


def score(docs: DataFrame, train: Column, **options: int) -> DataFrame:
    """Per document: doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score."""
    counted, width = count(docs, train, **options)
    known = counted.where("counts is not null").select("doc_ids", "train", "sizes", "words", "at", "counts")
    totals = counted.where("counts is null").agg(F.sum("n"), F.sum("v")).first()
    n, v = totals[0] or 0, totals[1] or 0

    def learn(weights: np.ndarray | None) -> np.ndarray:
        def tally(batches: Iterator) -> Iterator:
            seen = np.zeros(65 * BINS * BINS, np.int64)
            for batch in batches:
                for _, learnt, c in documents_of(batch, width, 2 if weights is None else 3):
                    if learnt:
                        cells, times = np.unique(events(c, n, v, weights), return_counts=True)
                        seen[cells] += times
            at = np.flatnonzero(seen)
            if len(at):
                yield arrow_batch(list(zip(at.tolist(), seen[at].tolist(), strict=True)), arrow_schema("cell long, times long"))

        cells = known.mapInArrow(tally, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).orderBy("cell").collect()  # 266,240 at most
        return learn_weights(np.array([r["cell"] for r in cells], np.int64), np.array([r["times"] for r in cells], np.float64), v if weights is None else None)

    two = learn(None) if n else np.tile(np.array([0.0, 0.0, 1.0]), (65, 1))
    three = learn(two) if n else np.tile(np.array([0.0, 1.0]), (65, 1))
    kind = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator) -> Iterator:
        schema, floor = arrow_schema(kind), math.log10(n + v + 1)
        for batch in batches:
            rows = []
            for doc_id, learnt, c in documents_of(batch, width):
                base = float(np.log10(c[0] + 1).sum()) - len(c[0]) * floor
                rows.append((doc_id, learnt, len(c[0]), int((c[0] > 0).sum()), n, base, log10_probability(c, n, v, two, three)))
            if rows:
                yield arrow_batch(rows, schema)

    return known.mapInArrow(run, kind)


def held_out(modulus: int = 7, rest: int = 2) -> Column:
    return crc_mod(F.col("doc_id"), modulus) == rest
