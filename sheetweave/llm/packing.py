"""Order-preserving packing by dynamic programming.

Documents, each as its token ids and one end id, form runs in the order in which a partition holds them. A run
is cut into windows of at most ``window`` tokens at document ends, sentence ends or, inside sentences longer
than ``hard``, at fixed steps. A window costs its padding (none at a power of two), a cut its penalty, and
every window a small constant. For padded windows the cost splits into a term of the window's begin and one
of its end, so the best begin is the front of a monotone queue; the few windows of a power of two are looked
up by position. A run is closed and packed after ``run_tokens`` tokens, which bounds memory; each run loses
at most the padding of its last window.

Edge cases: null text is an empty document, which is its end id alone; very long documents are cut; repeated
rows and ids are packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from sheetweave.llm.common import arrow_batch, arrow_schema

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
#: In tokens of padding: what a cut within a document costs at a sentence's end, and elsewhere; what a window costs.
SENTENCE, INSIDE, EACH = 4.0, 24.0, 2.0


def windows(at: list[int], cost: list[float], window: int) -> list[int]:
    """The cheapest cuts. at: possible cuts, ascending, from 0 to the run's end; neighbours at most window apart. cost: penalty of each."""
    best, came = [0.0] * len(at), [0] * len(at)
    where = {p: i for i, p in enumerate(at)}
    powers = [1 << k for k in range(window.bit_length()) if window >> 4 <= 1 << k <= window]
    queue: deque[int] = deque([0])  # begins, by ascending best + position
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        low = best[i] + at[i] + window - p
        for n in powers:
            k = where.get(p - n)
            if k is not None and best[k] < low:
                low, i = best[k], k
        best[j], came[j] = low + cost[j] + EACH, i
        mine = best[j] + p
        while queue and best[queue[-1]] + at[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


def boundaries(docs: list[np.ndarray], ends_sentence: np.ndarray, hard: int) -> tuple[list[int], list[float]]:
    """Possible cuts of a run and their penalties. docs: ids with the end id."""
    at, cost, base = [0], [0.0], 0
    for ids in docs:
        inner = np.flatnonzero(ends_sentence[ids[:-1]]) + 1
        inner = inner[inner < len(ids)]
        marks = np.concatenate(([0], inner, [len(ids)]))
        if (wide := np.flatnonzero(np.diff(marks) > hard)).size:
            extra = np.concatenate([np.arange(marks[i] + hard, marks[i + 1], hard) for i in wide])
            places = np.concatenate((inner, extra))
            costs = np.concatenate((np.full(len(inner), SENTENCE), np.full(len(extra), INSIDE)))
            order = np.argsort(places, kind="stable")
            inner, costs = places[order], costs[order]
        else:
            costs = np.full(len(inner), SENTENCE)
        at += (inner + base).tolist()
        cost += costs.tolist()
        base += len(ids)
        at.append(base)
        cost.append(0.0)
    return at, cost


def pack_run(names: list, docs: list[np.ndarray], ends_sentence: np.ndarray, window: int, hard: int, first_sequence: int) -> tuple[list[tuple], int]:
    """Pieces of one run, and the next free sequence number."""
    cuts = windows(*boundaries(docs, ends_sentence, hard), window)
    out, seq, begin, base = [], 0, 0, 0
    for name, ids in zip(names, docs, strict=True):
        end, at = base + len(ids), base
        while at < end:
            stop = min(end, cuts[seq])
            out.append((name, at - base, stop - at, ids[at - base : stop - base].tobytes(), len(ids), first_sequence + seq, at - begin))
            at = stop
            if stop == cuts[seq]:
                begin, seq = stop, seq + 1
        base = end
    return out, first_sequence + seq


def sentence_ends(tokenizer) -> np.ndarray:  # noqa: ANN001
    """Which ids end a sentence: a line break, or a full stop, exclamation or question mark at the end."""
    out = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        out[i] = "Ċ" in token or token.rstrip("\"')»").endswith((".", "!", "?", "…"))
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 1024, end_id: int = 0, run_tokens: int = 1 << 20, hard: int = 128, slice_bytes: int = 4 << 20) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    There is no shuffle. Sequence numbers hold the partition's number in their upper bits, so they are unique,
    and a task that runs again gives the same ones.
    """
    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        from sheetweave.llm.tokens import byte_bpe

        bpe, names, held, tokens, seq = byte_bpe(tokenizer_path), [], [], 0, TaskContext.get().partitionId() << 36
        ends = sentence_ends(bpe.tok)
        schema = arrow_schema(SCHEMA)

        def flush(seq: int) -> tuple:
            rows, seq = pack_run(names, held, ends, window, hard, seq)
            return arrow_batch(rows, schema), seq

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts, slice_bytes):
                for name, text in zip(ids.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    x = bpe.ids(text or "")
                    names.append(name)
                    held.append(np.append(x, np.uint32(end_id)).astype("<u4"))
                    tokens += len(x) + 1
                    if tokens >= run_tokens:
                        out, seq = flush(seq)
                        yield out
                        names, held, tokens = [], [], 0
        if held:
            yield flush(seq)[0]

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def slices(texts, most: int) -> Iterator[tuple[int, int]]:  # noqa: ANN001
    """Row ranges of a string array of about ``most`` bytes each."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)).tolist()
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, bisect_left(upto, (upto[lo - 1] if lo else 0) + most))
        yield lo, hi
        lo = hi
