"""Byte-level words and hashes for the operators that run Python on the executors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

#: Texts are hashed together up to about so many characters, which bounds the arrays of one step.
PIECE = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: k -> a mask of the k lowest bytes.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class WordHash(dict):
    """word (bytes) -> 63-bit hash, remembered for up to ``most`` words at a time."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII blanks: bytes methods know only ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(texts: Sequence[str | None], most: int = PIECE) -> Iterator[list[str | None]]:
    """The texts in runs of about ``most`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text) if text else 0
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def split_words(texts: Sequence[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts as bytes, A-Z lower-cased; begin and length of every word in them; number of words by text)."""
    raw = [text.encode("utf-8", "surrogatepass").lower() if text else b"" for text in texts]
    joined = b" ".join(raw) + b" " * 9
    blank = _IS_BLANK[np.frombuffer(joined, dtype=np.uint8)]
    turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        turn = np.concatenate([[0], turn])
    start, length = turn[0::2], turn[1::2] - turn[0::2]
    ends = np.cumsum(np.fromiter((len(b) + 1 for b in raw), dtype=np.int64, count=len(raw)))
    return joined, start, length, np.diff(np.searchsorted(start, ends), prepend=0)


def codes_of(joined: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, mixed eight bytes at a time, all words abreast."""
    eight = np.ndarray(shape=(len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
    code = mix64(length.astype(np.uint64) * _SPREAD)
    rows, at, left = np.arange(len(start)), start, length
    while len(rows):
        part = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        code[rows] = mix64(code[rows] * _SPREAD ^ part)
        longer = left > 8
        rows, at, left = rows[longer], at[longer] + 8, left[longer] - 8
    return code


def word_codes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of words_of, in order; number of words by text), without a loop over words."""
    joined, start, length, count = split_words(texts)
    return codes_of(joined, start, length), count
