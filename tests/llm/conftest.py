import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, key long, fp string, grp string, bucket string"


def words(n, seed):
    draw = random.Random(seed)
    return [f"w{draw.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make(spark):
    """documents with null and clashing extra columns."""

    def build(rows):
        full = [(i, t, "en", "src", None, 1, "x", None, "y") for i, t in rows]
        return spark.createDataFrame(full, DOC)

    return build


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    base = words(60, 1)
    return [
        (1, " ".join(base)),
        (2, "  ".join(base)),
        (3, " ".join(base[:30] + ["other"] + base[30:])),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one"),
        (8, " ".join(words(60_000, 2))),
        (9, " ".join(["same"] * 500)),
        (9, " ".join(["same"] * 500)),
        (None, " ".join(base)),
        (10, "ünïcode ÉÉ <|endoftext|> ▁ \x00 😀 " * 20),
        (11, " ".join(words(40, 3) + base[10:40])),
    ]
