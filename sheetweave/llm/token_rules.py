"""Quality rules on text shape and tokenizer fertility.

Base rules: too few words, or more than half of the words in three-word windows that repeat. Fertility rules:
two public vocabularies are used. The byte-level one gives a text's characters per token and the entropy of
its tokens; the piece vocabulary, word by word, the share of tokens that fall back to bytes. Each is
held against a band for the text's script, or for its language where one is given; texts with fewer than
``least`` tokens are only held against the base rules. The bands leave room around prose: they catch shouting,
symbols and rows of cells, which cost many tokens, not what is merely unusual.

Edge cases: null and empty texts have no words, so they fail the base rules; a word of any length is encoded
whole, but only words up to 48 bytes are remembered; unknown or null languages use the script's band;
repeated rows are judged one by one; values at a band's edge are inside; an empty table gives no rows; other columns are ignored.
A wrong language brings the wrong band: the bands rely on ``lang_col``, and a null judges by script alone.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from sheetweave.llm.common import arrow_batch, arrow_schema

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: By script or language: least and most characters per token, most byte-fallback share, least and most token entropy in bits.
#: A language's lower bounds are 0.95 of the least of its good documents among the labels that are for training (ids whose
#: crc32 modulo 3 is not 1); the other labels only measure them. Prose in a language that the piece vocabulary knows has hardly
#: any byte fallback, so a share of one in twenty tells emoji, box drawing and broken encodings. Latin script, for other
#: languages, has the loosest bounds of the four; scripts that the vocabularies know less well take more tokens.
BANDS = {
    "latin": (1.95, 8.0, 0.10, 5.2, 13.0),
    "cyrillic": (1.2, 8.0, 0.25, 4.5, 13.0),
    "greek": (1.0, 8.0, 0.25, 4.5, 13.0),
    "arabic": (0.8, 8.0, 0.35, 4.0, 13.0),
    "cjk": (0.3, 4.0, 0.60, 4.0, 13.5),
    "other": (0.3, 8.0, 0.60, 2.5, 13.5),
    "en": (2.24, 8.0, 0.05, 5.27, 13.0),
    "de": (2.41, 8.0, 0.05, 5.56, 13.0),
    "fr": (2.01, 8.0, 0.05, 5.36, 13.0),
    "es": (2.18, 8.0, 0.05, 5.43, 13.0),
}
#: Code points from which a script's letters begin; the last script of a run holds up to the next.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x600, "arabic"), (0x780, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x2E80, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_per_token double, byte_share double, token_entropy double, script string, kept boolean"


def base_counts(text: str) -> tuple[list[bytes], int, int, int, int]:
    """Words, and word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = raw.split(b"\n")
    dups = 0
    if len(set(lines)) < len(lines):
        full = [x for x in lines if x.strip()]
        dups = len(full) - len(set(full))
    return words, len(text) - (len(raw) - len(raw.translate(None, SPACE))), len(raw) - len(raw.translate(None, SYMBOLS)), dups, repeated(words)


def repeated(words: list) -> int:
    """Words in a three-word window that is found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    n, until = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, until)
            until = i + 3
    return n


class Fertility:
    """Tokens of texts, and byte fallback of single words, which are remembered up to a bound."""

    def __init__(self, ranks_path: str, pieces_path: str, room: int = 200_000) -> None:
        from sheetweave.llm.tokens import load_pieces, load_ranks

        self.bpe, self.pieces, self.room = load_ranks(ranks_path), load_pieces(pieces_path), room
        self.is_byte = [self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())]
        self.cache: dict[bytes, int] = {}

    def tokens(self, text: str) -> np.ndarray:
        """How often each token occurs that does."""
        ids = np.asarray(self.bpe.encode_ordinary(text), np.uint32)
        ids.sort()
        return np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))) if len(ids) else np.zeros(0, int)

    def byte_share(self, words: list[bytes]) -> float:
        """The share of pieces that stand for single bytes; a word is cut on its own."""
        if len(self.cache) > self.room:
            self.cache.clear()
        got = list(map(self.cache.get, words))
        if None in got:
            where = [i for i, g in enumerate(got) if g is None]
            for i, p in zip(where, self.pieces.encode([words[i].decode("utf-8", "replace") for i in where], num_threads=1), strict=True):
                got[i] = len(p) + ((sum(map(self.is_byte.__getitem__, p)) if min(p, default=999) < 259 else 0) << 32)
                if len(words[i]) <= 48:
                    self.cache[words[i]] = got[i]
        total = sum(got)
        return (total >> 32) / (total & 0xFFFFFFFF) if total else 0.0


@functools.cache
def fertility(ranks_path: str, pieces_path: str) -> Fertility:
    """One for each worker process, so that words stay known from task to task."""
    return Fertility(ranks_path, pieces_path)


def entropy(counts: np.ndarray) -> float:
    n = counts.sum()
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0


def script_of(text: str) -> str:
    """The script of most characters past space and punctuation; that of ASCII letters if there are none."""
    if len(text.encode("utf-8", "surrogatepass")) <= 1.25 * len(text):
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    points = points[(points >= 0x100) | ((points | 0x20) - 97 < 26)]
    which = np.bincount(np.searchsorted([at for at, _ in SCRIPTS], points, side="right") - 1, minlength=len(SCRIPTS))
    sums = Counter()
    for (_, name), n in zip(SCRIPTS, which.tolist(), strict=True):
        sums[name] += n
    return max(sums, key=lambda k: (sums[k], k == "latin"))


def judge(docs: DataFrame, ranks_path: str, pieces_path: str, *, bands: dict[str, tuple] = BANDS, least: int = 50, least_words: int = 50, most_repeats: int = 50, lang_col: str = "lang") -> DataFrame:
    """Per document: the base counts, base_failed, chars_per_token, byte_share, token_entropy, script and kept."""
    def run(batches: Iterator) -> Iterator:
        from sheetweave.llm.packing import slices

        meter, schema = fertility(ranks_path, pieces_path), arrow_schema(SCHEMA)
        for batch in batches:
            for lo, hi in slices(batch.column(1), 2 << 20):
                part, rows = batch.slice(lo, hi - lo), []
                for doc_id, text, lang in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = text or ""
                    words, chars, symbols, dups, repeats = base_counts(text)
                    seen = meter.tokens(text)
                    n, share, bits = int(seen.sum()), meter.byte_share(words), entropy(seen)
                    per = len(text) / n if n else 0.0
                    script = script_of(text)
                    a, b, c, d, e = bands.get(lang) or bands[script]
                    failed = len(words) < least_words or 100 * repeats > most_repeats * len(words)
                    kept = not failed and (n < least or (a <= per <= b and share <= c and d <= bits <= e))
                    rows.append((doc_id, len(words), chars, symbols, dups, repeats, failed, per, share, bits, script, kept))
                yield arrow_batch(rows, schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", f"cast({lang_col} as string) lang").mapInArrow(run, SCHEMA)
