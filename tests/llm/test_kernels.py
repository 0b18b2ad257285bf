import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from verdica.llm import kernels as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab1 é.,\n日", max_size=30)), max_size=12)


def brute_words(text):
    return [w for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_grams_as_by_regular_expressions(texts, limit):
    seen = {}
    for start, raw, at in K.chunks(pa.array(texts, pa.string()), limit):
        h, rows = K.words(raw, at)
        g, gat, _ = K.grams(h, rows, 2)
        for i in range(len(at) - 1):
            mine, expected = h[rows[i] : rows[i + 1]], brute_words(texts[start + i])
            assert len(mine) == len(expected)
            for x, w in zip(mine.tolist(), expected):
                assert seen.setdefault(w, x) == x
            assert gat[i + 1] - gat[i] == max(0, len(expected) - 1)
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=8), min_size=1, max_size=5))
def test_occurrences(rows):
    flat = np.array([x for r in rows for x in r], np.uint64)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    expected = [r[:i].count(x) for r in rows for i, x in enumerate(r)]
    assert K.occurrences(flat, at).tolist() == expected


def test_chunks_cover_all_rows_once():
    texts = pa.array(["abc" * n for n in range(50)]).slice(3, 40)
    starts = [(s, len(at) - 1) for s, _, at in K.chunks(texts, 100)]
    assert [s for s, _ in starts] == np.concatenate([[0], np.cumsum([n for _, n in starts])[:-1]]).tolist()
    assert sum(n for _, n in starts) == 40
    assert list(K.chunks(pa.array([], pa.string()))) == []
