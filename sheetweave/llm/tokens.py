"""Tokens of public vocabularies."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

@functools.cache
def load_json(path: str):  # noqa: ANN201
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def load_ranks(path: str):  # noqa: ANN201
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def load_pieces(path: str):  # noqa: ANN201
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids as ``tokenizers`` gives them for whole texts, without added special tokens.

    tiktoken encodes with the same vocabulary, taken from the same file as ranks, at several times the
    speed; texts that hold the string of a special token go to ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.tok = load_json(path)
        added, byte_of = self.tok.get_added_tokens_decoder(), _byte_of()
        self.special = [t.content for t in added.values()]
        self.ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in self.tok.get_vocab().items() if i not in added}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.bpe.encode_ordinary(text), "<u4")


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
