import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from invented import words  # noqa: E402

EXTRA = ["key", "score", "weight", "license", "label", "n", "tokens", "topic", "tokens_", "good", "path", "words", "shard", "_host", "_verdica_key", "_row", "_doc", "_up", "_size", "_n", "id", "row", "bits", "block", "count", "x", "y", "a", "b"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with every kind of row that an operator must survive, and columns whose names may clash."""
    rng = random.Random(5)
    long_text = words(rng, 60_000)
    base = words(rng, 200)
    rows = [
        (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "  \n\t ", "de", None), (4, long_text, None, "s2"), (5, long_text, "en", "s2"),
        (6, base, "en", "s1"), (6, base, "en", "s1"), (7, base + " tail", "en", "s3"), (8, "one", "fr", "s1"), (9, "one", "fr", "s1"),
        (None, "no id here", "en", "s1"), (10, "é日本 ü x\u0085 \U0001f600 ***", "es", "s4"), (11, "...!!!", "xx", "s4"), (12, words(rng, 50), "en", "s1"),
    ]
    full = [(*r, None if r[1] is None else len(r[1]), *[f"x{i}" for i in range(len(EXTRA))]) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)).cache()


@pytest.fixture(scope="session")
def no_docs(awkward):
    return awkward.where("false")
