"""Multisets of hashed five-word shingles, on arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words in a shingle.
SHINGLE = 5
#: Words whose hashes a worker keeps at most.
CACHE_WORDS = 200_000
#: Bytes of text that are worked on at a time (one longer text is worked on alone).
CHUNK_BYTES = 2_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, split at ASCII white space."""
    return (text or "").lower().encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > CACHE_WORDS:
        _words.clear()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def elements(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts whose word hashes stand one after another: the elements of each text, sorted, and their numbers.

    An element is a shingle with the number of its occurrence in the text, so that sets of elements are multisets of
    shingles. A text of fewer words than a shingle has is one shingle; a text without words has none.
    """
    n = len(hashes)
    counts = np.where(lengths >= SHINGLE, lengths - SHINGLE + 1, np.minimum(lengths, 1))
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    roll = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        roll += padded[j : j + n] * _ODD[j]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    use = np.arange(n) - np.repeat(starts, lengths) < np.repeat(counts, lengths)
    h, doc = mix(roll[use]), doc[use]
    for d in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)):  # such a window would reach into the next text
        at = starts[d]
        part = hashes[at : at + lengths[d]]
        h[np.searchsorted(doc, d)] = mix(np.array([(part * _ODD[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))], np.uint64))[0]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    times = (np.arange(len(h)) - first).astype(np.uint64)
    return np.where(times > 0, mix(h + times * _ODD[0]), h), counts


def in_chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of CHUNK_BYTES or so."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
