"""Small fixtures of the training-data operators: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import pytest

WORDS = "the river runs past old stone houses and under a bridge where boats wait for evening light while people walk home from work along quiet streets".split()


def prose(seed: int, n: int) -> str:
    """``n`` words in an order that depends on ``seed``."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + (str(x % 7) if x % 5 == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with every awkward case that the contracts name."""
    base = prose(1, 400)
    words = base.split()
    near = " ".join([*words[:10], "changed", *words[11:]])
    rows = [
        (1, base, "en", "a", 5, 1),
        (2, near, "en", "a", 6, 2),
        (3, base, "en", "b", 7, 3),
        (4, None, None, None, None, None),
        (5, "", "en", "a", 0, 4),
        (6, " \t\n ", "en", "a", 3, 5),
        (7, "only four words here", "en", "c", 9, 6),
        (8, "Only FOUR words here", "en", "c", 9, 6),
        (9, prose(2, 30_000), "en", "c", 9, 7),
        (10, "çà et là, naïve 😀 text", "fr", "c", 9, 8),
        (11, "# * & | $ % < > 12 34", None, "c", 9, 9),
        (12, "\n".join(["same line again and again"] * 40), "en", "d", 9, 9),
        (12, "\n".join(["same line again and again"] * 40), "en", "d", 9, 9),
        (None, prose(3, 120), "en", "d", 9, 9),
        (14, "a\nb\rc\x0bd\x85e f " * 20, "en", "d", 9, 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _h long")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
