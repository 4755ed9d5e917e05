"""SHA-256 over many messages at once, with states that can be stored and resumed.

hashlib hides its inner state; a state here is 8 words of 32 bits, one column per message, which a
table can hold as 32 bytes. A digest as lowercase hex fills exactly one block of 64 bytes, so the state after any
number of digests is a whole number of blocks and needs no buffer.
"""

from __future__ import annotations

import numpy as np


def _root_bits(prime: int, degree: int) -> int:
    """First 32 bits of the fraction of the square or cube root of a prime."""
    target, low, high = prime << (32 * degree), 0, prime << 32
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**degree <= target else (low, middle - 1)
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], dtype="uint32")
_ROUND = np.array([_root_bits(p, 3) for p in _PRIMES[:64]], dtype="uint32")
_HEX = np.frombuffer(b"0123456789abcdef", dtype="uint8").astype("uint32")


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def start(n: int) -> np.ndarray:
    """States of ``n`` empty messages."""
    return np.repeat(START[:, None], n, axis=1)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block of 16 words (16, n) each."""
    w = [block[i] for i in range(16)]
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        small = _turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))
        large = _turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))
        w.append(w[i - 16] + small + w[i - 7] + large)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The block (16, n) that the hex text of digests (8, n) fills."""
    words = np.empty((16, digest.shape[1]), dtype="uint32")
    for half, shift in ((0, 16), (1, 0)):
        part = digest >> np.uint32(shift)
        text = _HEX[(part >> np.uint32(12)) & np.uint32(15)]
        for nibble in (8, 4, 0):
            text = (text << np.uint32(8)) | _HEX[(part >> np.uint32(nibble)) & np.uint32(15)]
        words[half::2] = text
    return words


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (8, n) of messages of a whole number of ``blocks`` each."""
    last = np.zeros((16, state.shape[1]), dtype="uint32")
    last[0] = 0x80000000
    bits = np.asarray(blocks, dtype="uint64") * np.uint64(512)
    last[14], last[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return compress(state, last)


def words_of(raw: np.ndarray) -> np.ndarray:
    """Bytes (n, 32) as words (8, n)."""
    return np.ascontiguousarray(raw).view(">u4").astype("uint32").reshape(-1, 8).T.copy()


def bytes_of(words: np.ndarray) -> np.ndarray:
    """Words (8, n) as bytes (n, 32)."""
    return np.ascontiguousarray(words.T).astype(">u4").view("uint8").reshape(-1, 32)
