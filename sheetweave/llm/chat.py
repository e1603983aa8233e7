r"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. Control strings
in roles and texts are escaped by one more backslash between ``<`` and ``|``, which reading takes away again.
The rendered text is encoded once, with offsets; the spans of the assistant's texts are intersected with the
tokens' spans by binary search. The marks are tokens of their own, so no token crosses a span's border.

Rows are dealt by conversation, sorted and rendered as they stream by: a task holds one conversation, which
the format needs whole. Edge cases: null text or role is empty; turns with equal numbers go by role and text,
null numbers first; a null conv_id is a conversation of its own; an empty assistant text has no tokens and no
loss; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from sheetweave.llm.common import arrow_batch, arrow_schema
from sheetweave.llm.tokens import byte_bpe

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SCHEMA = "conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], target: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and where the target's texts lie in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == target:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span; starts and ends never fall, spans are sorted."""
    mask = np.zeros(len(starts), bool)
    for lo, hi in spans:
        if hi > lo:
            mask[np.searchsorted(ends, lo, "right") : np.searchsorted(starts, hi, "left")] = True
    return mask


class Encoder:
    """Token ids and offsets of a formatted text, the three marks being tokens of their own after the vocabulary's."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        base = byte_bpe(path)
        size = base.tok.get_vocab_size()
        ranks, marks = base.ranks, {t: size + i for i, t in enumerate((START, SEP, END))}
        self.bpe = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
        self.bytes = np.zeros(size + len(marks), np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in marks.items())]:
            self.bytes[i] = len(token)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts and ends in code points; a token within a character covers all of it."""
        ids = np.asarray(self.bpe.encode(text, allowed_special="all"), np.int32)
        if not len(ids):
            return ids, ids, ids
        upto = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        ends = np.cumsum(self.bytes[ids])
        return ids, (upto[ends - self.bytes[ids]] - 1).astype(np.int32), upto[ends - 1].astype(np.int32)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def format_chats(conversations: DataFrame, tokenizer_path: str, *, target: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, n_turns, formatted, token ids, their starts and ends in code points, and the loss mask."""
    def run(batches: Iterator) -> Iterator:
        enc, schema = encoder(tokenizer_path), arrow_schema(SCHEMA)

        def done(held: list):  # noqa: ANN202
            rows = []
            for conv_id, turns in held:
                text, spans = render(turns, target)
                ids, starts, ends = enc.encode(text)
                rows.append((conv_id, len(turns), text, ids, starts, ends, mask_of(starts, ends, spans)))
            return arrow_batch(rows, schema)

        held, size, now = [], 0, object()
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != now:
                    if size > 1 << 20:
                        yield done(held)
                        held, size = [], 0
                    held.append((conv_id, []))
                    now = conv_id
                held[-1][1].append((role or "", text or ""))
                size += len(text or "")
        if held:
            yield done(held)

    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def loss_text(formatted: str, starts: list[int], ends: list[int], mask: list[bool]) -> str:
    """All text under the mask, unescaped, run by run."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(mask, np.int8), [0]))))
    return "".join(unescape(formatted[starts[a] : ends[b - 1]]) for a, b in edge.reshape(-1, 2))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats' output, as lengths and digests."""
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for conv_id, text, starts, ends, mask in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                turns, loss = turns_of(text), loss_text(text, starts, ends, mask)
                rows.append((conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                yield arrow_batch(rows, arrow_schema(DIGEST))

    return formatted.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(run, DIGEST)
