"""Character n-grams of whole texts as numpy arrays, many texts at once."""

from __future__ import annotations

import functools

import numpy as np

_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x8DA6B343], np.uint32)


@functools.cache
def _kinds(letters_only: bool) -> np.ndarray:
    """For each code point of the basic plane: is it part of a word?"""
    return np.array([(chr(c).isalpha() if letters_only else chr(c).isalnum()) for c in range(0x10000)])


def codes(texts: list[str], letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts in a row, each text between zeros and each run of
    characters that belong to no word as one zero; and where each text begins."""
    joined = "\0" + "\0\0".join([t.lower() for t in texts]) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _kinds(letters_only)[np.minimum(raw, 0xFFFF)]
    beyond = raw >= 0x10000
    if beyond.any():
        points, place = np.unique(raw[beyond], return_inverse=True)
        inside[beyond] = np.array([chr(c).isalpha() if letters_only else chr(c).isalnum() for c in points.tolist()])[place]
    lengths = np.array([len(t.lower()) for t in texts]) + 2
    begins = np.concatenate([[0], np.cumsum(lengths)])
    keep = inside | np.concatenate([[True], inside[:-1]])
    keep[begins[:-1]] = True
    new = np.cumsum(keep) - keep
    out = np.where(inside, raw, 0)[keep].astype(np.uint32)
    starts = np.append(new[begins[:-1]], len(out))
    return out, starts


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
        return h ^ (h >> np.uint32(15))


def grams(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each n-gram that lies in one word, a zero at either end included."""
    size = len(code) - n + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    zero = code == 0
    if n == 1:
        at = np.nonzero(~zero)[0]
    else:
        bad = zero[:size] & zero[n - 1:] if n == 2 else np.zeros(size, bool)
        for j in range(1, n - 1):
            bad |= zero[j: j + size]
        at = np.nonzero(~bad)[0]
    with np.errstate(over="ignore"):
        h = np.full(len(at), np.uint32(n) * np.uint32(0x01000193), np.uint32)
        for j in range(n):
            h = h + (code[at + j] + np.uint32(j * 7919 + 1)) * _MULTIPLY[j]
            h ^= h >> np.uint32(13)
    return at, mix(h)


def chunks(texts: list[str | None], most: int = 400_000):
    """(first row, texts) of at most about ``most`` characters, or one long text."""
    first, held, size = 0, [], 0
    for row, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > most:
            yield first, held
            first, held, size = row, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held
