"""No byte goes that is not repeated: texts that make polynomial hashes meet."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kvloom.llm import repeats
from test_copies import brute_repeats, check_repeats


def thue_morse(n: int) -> list[int]:
    return [bin(i).count("1") & 1 for i in range(n)]


def test_complementary_patterns_have_other_hashes():
    bits = np.array(thue_morse(4096))
    for pair in (b"ab", b"\x00\xff", b"aA"):
        x, y = (np.array([pair[b] for b in bits ^ flip], np.uint8) for flip in (0, 1))
        for width in (24, 62):
            # The complement occurs inside the pattern itself: the same strings, no more and no fewer hashes.
            texts = {x[i : i + width].tobytes() for i in range(len(x) - width + 1)} | {y[i : i + width].tobytes() for i in range(len(y) - width + 1)}
            assert len(np.unique(np.concatenate([repeats.hashes(x, width), repeats.hashes(y, width)]))) == len(texts)
        whole = [np.array([0]), np.array([2048])]
        assert (repeats.digests(x.tobytes(), *whole) != repeats.digests(y.tobytes(), *whole)).any()


@pytest.mark.parametrize("size", [0, 7, 8, 23, 24, 25, 61, 62, 63, 100, 1001])
def test_hashes_are_those_of_each_substring_alone(size):
    x = np.frombuffer(random.Random(size).randbytes(size), np.uint8)
    for width in (24, 62):
        own = [repeats.hashes(x[i : i + width], width)[0] for i in range(size - width + 1)]
        assert repeats.hashes(x, width).tolist() == own


def test_block_pairs_that_follow_thue_morse_stay(spark):
    """32 blocks of 64 bytes whose case follows the pattern, against its complement: nothing is repeated."""
    def text(flip: int) -> str:
        out = []
        for k, bit in enumerate(thue_morse(32)):
            letters = "".join(c.upper() if b ^ bit ^ flip else c for c, b in zip("abcdefgh", thue_morse(8), strict=True))
            out.append(letters + "the same fifty-two bytes stand in every block here."[:52].ljust(52, ".") + f"{k:04d}")
        return "".join(out)

    rows = [(1, text(0)), (2, text(1))]
    assert [len(t) for _, t in rows] == [2048, 2048] and all(v[1] == 0 for v in brute_repeats(rows).values())
    check_repeats(spark, rows)


def test_patterns_against_brute_force(spark):
    rnd = random.Random(5)
    pattern = "".join("ab"[b] for b in thue_morse(600))
    turned = pattern.translate(str.maketrans("ab", "ba"))
    rows = [(1, pattern), (2, turned), (3, pattern[7:300] + turned[:150])]
    for i in range(20):
        period = "".join(rnd.choices("ab", k=rnd.randint(1, 9)))
        rows.append((10 + i, (period * 90)[: rnd.randint(90, 260)] + "".join(rnd.choices("ab", k=60))))
    check_repeats(spark, rows)
    check_repeats(spark, rows, hot=1)
