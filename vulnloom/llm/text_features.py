"""Hashed features of many texts at once: code points, letter runs and character n-grams."""

from __future__ import annotations

import numpy as np
import xxhash

from vulnloom.llm.pretokens import LETTER, scanner

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * _BASE % (1 << 64)
    return out


# Characters of a word beyond this place share their factors with earlier ones.
_POWERS = _powers(64)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top bits after a mix, which hold what all lower bits decide."""
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _ODD
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _ODD
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def lowered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts in a row, each closed by a space, and the ends of the texts."""
    parts = [t.decode("utf-8").lower() for t in texts]
    joined = " ".join(parts) + " "
    ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64)) if parts else np.zeros(0, np.int64)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends


def letters(points: np.ndarray) -> np.ndarray:
    return scanner().classes[points] == LETTER


def word_features(points: np.ndarray, bits: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each letter run and of its first `prefix` letters, as two columns, and where the runs start."""
    is_letter = letters(points)
    previous = np.zeros(len(points), bool)
    previous[1:] = is_letter[:-1]
    starts = np.flatnonzero(is_letter & ~previous)
    if not len(starts):
        return np.zeros((0, 2), np.int64), starts
    at = np.flatnonzero(is_letter)
    own = points[at].astype(np.uint64) + np.uint64(1)
    first = np.searchsorted(at, starts)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    own *= _POWERS[place & 63]
    words = np.add.reduceat(own, first)
    own[place >= prefix] = 0
    heads = np.add.reduceat(own, first)
    return np.stack([_bucket(words, bits), _bucket(heads ^ np.uint64(0x5BD1E995), bits)], axis=1), starts


def char_ngrams(points: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter bigrams and trigrams of each text, and the texts they belong to.

    What is no letter counts as a space; an n-gram of the same text only, and with a letter in it.
    """
    is_letter = letters(points)
    clean = np.where(is_letter, points, 32).astype(np.uint64)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    found, owners = [], []
    for n in (2, 3):
        if len(clean) < n:
            continue
        hashes = np.full(len(clean) - n + 1, n, np.uint64)
        some = np.zeros(len(hashes), bool)
        for i in range(n):
            hashes = hashes * np.uint64(_BASE) + clean[i : i + len(hashes)]
            some |= is_letter[i : i + len(hashes)]
        keep = some & (owner[: len(hashes)] == owner[n - 1 :])
        found.append(_bucket(hashes[keep], bits))
        owners.append(owner[: len(hashes)][keep])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


_LONGEST = 1024
_WORD_POWERS = _powers(_LONGEST)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and the number of words up to the end of each.

    Words are what lies between ASCII white space. The hash of a word is a polynomial over hashes of
    its bytes; words beyond `_LONGEST` bytes are hashed whole.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    in_word = (joined != 32) & ((joined < 9) | (joined > 13))
    opens = in_word.copy()
    opens[1:] &= ~in_word[:-1]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(in_word)
    first = np.searchsorted(at, starts)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    hashes = np.add.reduceat(_BYTES[joined[at]] * _WORD_POWERS[place & (_LONGEST - 1)], first)
    for i in np.flatnonzero(lengths > _LONGEST):
        hashes[i] = xxhash.xxh64_intdigest(joined[starts[i] : starts[i] + lengths[i]].tobytes())
    return hashes, np.searchsorted(starts, ends)
