from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies int, _q_kept int, size string, _id int, _row int, _doc int, _mix_cut int, _mix_copy int, _salt int, _r_source int, _deal int"


def _clean(words: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(["river", "stone", "light", "garden", "window", "paper", "music", "winter"]) + str(r.randint(0, 60)) for _ in range(words)) + "."


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and extra columns whose names clash."""
    base = _clean(120, 1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", "en", "b"), (4, None, "en", "b"), (5, "", None, None), (6, "  \n\t ", "en", "a"),
        (7, "two words", "en", "c"), (8, _clean(30_000, 2), "en", "a"), (9, "x" * 50_000, "en", None), (10, _clean(40, 3), "fr", "b"), (10, _clean(40, 3), "fr", "b"), (None, _clean(60, 4), "en", "a"),
        (11, "dup line here\n" * 30, "en", "c"), (12, "Ünï çödé 漢字 \U0001f600 " * 30, None, "é"), (13, "it's a \u2019quote\u2019 don't <|endoftext|> \n\n end", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 7, 1, "clash", 1, 2, 3, 4, 5, 6, 7, 8) for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (8, 1, 0), (10, 1, 0), (11, 0, 1), (11, 0, 1), (None, 1, 0), (12, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
