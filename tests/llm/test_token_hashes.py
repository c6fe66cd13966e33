"""Hashes that tell tokens apart."""

import numpy as np
import pyarrow as pa

from siltstone.llm.arrays import blocks, token_hashes, words


def hashes(tokens):
    data = np.frombuffer(b" ".join(tokens), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    return token_hashes(data, ends - [len(t) for t in tokens], ends)


def test_tokens_that_collide_in_polynomials():
    for n in (10, 11, 12):  # Thue and Morse's words over two letters, and each other's opposite
        t = np.array([bin(i).count("1") % 2 for i in range(1 << n)], np.uint8)
        a, b = (97 + t).tobytes(), (98 - t).tobytes()
        x, y, z = hashes([a, b, a])
        assert x != y and x == z


def test_equal_tokens_only():
    rng = np.random.default_rng(1)
    tokens = [bytes(rng.integers(97, 99, rng.integers(1, 90)).astype(np.uint8)) for _ in range(20_000)] + [b"a" * k for k in range(1, 300)]
    found = hashes(tokens + tokens[::-1])
    by = {}
    for t, h in zip(tokens + tokens[::-1], found.tolist(), strict=True):
        assert by.setdefault(t, h) == h
    assert len(set(by.values())) == len(by)


def test_words_hash_alike_in_any_place():
    block = next(blocks(pa.array(["One two", "x ONE", "é one" + "y" * 100, "one"])))
    h = words(block).hashes
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 5
