"""Word and shingle hashes of whole texts."""

from __future__ import annotations

import hashlib

import numpy as np

SHORT = 48              # bytes of a word that is remembered
MEMO_WORDS = 500_000

_U = np.uint64
ODD = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
BITS = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as asked."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, held * _U(pow(base, size, 1 << 64))]))


POWERS = Powers()


class WordHashes(dict):
    """Lower-cased word, as bytes -> 64 bits of its BLAKE2 digest; short words are remembered, and a
    full table is emptied, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= SHORT:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


HASHES = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order: runs without white space, A-Z lower-cased."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and space and tab to carriage return
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


CHUNK = 8               # bytes of a word that is a number itself
SPACE = bytes(i in b"\t\n\v\f\r " for i in range(256))
KEPT = np.array([(1 << 8 * i) - 1 for i in range(CHUNK + 1)], np.uint64)


def word_keys(text: str) -> np.ndarray:
    """64 bits of each word, in order: words as in `word_hashes`.  Up to CHUNK bytes are mixed as one
    number, all of a text at once, which keeps different words apart; longer words, and those with a
    zero byte, take the digests of `word_hashes`."""
    data = text.encode("utf-8", "surrogatepass").lower()
    padded = data + b" " * CHUNK
    space = np.frombuffer(padded.translate(SPACE), bool, len(data) + 1)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    here = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[starts]
    keys = mix((here & KEPT[np.minimum(sizes, CHUNK)]) + _U(ODD))
    other = sizes > CHUNK
    if b"\0" in data:
        other |= [b"\0" in data[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
    long = np.flatnonzero(other)
    keys[long] = np.fromiter((HASHES[data[i:j]] for i, j in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return keys


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of the whole sequence, where it is shorter."""
    words = word_keys(text)
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total = mix(total + words[j:len(words) - k + 1 + j])
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]
