"""A text beyond the kernels' chunk is worked off in pieces, with the same result and in bounded room."""

import random
import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from verdica.llm import kernels as K
from verdica.llm import op3_string_tiling, op5_license_scan, op6_importance, op7_one_permutation, op8_token_files

from invented import words

TEXT = words(random.Random(21), 4000) + " Released under the MIT License. !!! é日本 ???\n" + "word, " * 400 + "a b c\n\n" + words(random.Random(22), 4000)


def parts():
    raw, at = K.view(pa.array([TEXT]))
    seeds = K.grams(*K.words(raw, at), 4)[0]
    encoder = op8_token_files._encoder(op8_token_files.TOKENIZER, op8_token_files.END)
    weights = np.random.default_rng(3).random(op6_importance.BUCKETS)
    words_found, rows = K.words(raw, at)
    return {
        "words": words_found,
        "places": np.concatenate([x[2] for x in K.gram_blocks(words_found, rows, 4)]),
        "seeds": np.concatenate([x[0] for x in K.gram_blocks(words_found, rows, 4)]) if len(seeds) else seeds,
        "same before": K.occurrences(words_found, rows),
        "features": np.array([sum(weights[b].sum() for b, _ in op6_importance.feature_blocks(raw, at))]).round(6),
        "minima": op7_one_permutation.bin_minima(words_found, rows, 4, 256)[0],
        "shingles": op7_one_permutation.bin_minima(words_found, rows, 4, 256)[1],
        "tokens": encoder.encode(raw, at)[0],
        "token counts": encoder.encode(raw, at)[1],
    }


def test_pieces_give_the_same(monkeypatch):
    whole = parts()
    for name, value in (("CHUNK_BYTES", 500), ("BLOCK", 100)):
        monkeypatch.setattr(K, name, value)
    monkeypatch.setattr(op8_token_files, "BATCH_BYTES", 700)
    for name, x in parts().items():
        assert x.shape == whole[name].shape and (x == whole[name]).all(), name


def test_a_run_longer_than_a_chunk_is_cut(monkeypatch):
    monkeypatch.setattr(K, "CHUNK_BYTES", 10)
    raw, at = K.view(pa.array(["ab " + "x" * 25 + " cd"]))
    apart, together = K.words(raw, at)[0], K.words(*K.view(pa.array(["ab xxxxxxxxxx xx"])))[0]
    assert len(apart) == 5 and apart[1] == apart[2] == together[1] and apart[0] == together[0]


MEASURE = """
import resource, sys
import numpy as np, pyarrow as pa
from verdica.llm import kernels as K, op3_string_tiling, op4_order_minhash, op5_license_scan, op6_importance, op7_one_permutation, op8_token_files
name, mb = sys.argv[1], int(sys.argv[2])
rng = np.random.default_rng(1)
vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(20000)]
line = " ".join(vocabulary[i] for i in rng.zipf(1.3, 200000) % 20000)
text = pa.array([(line + "\\n") * (mb * 1000000 // len(line))])
class Shared:
    def __init__(self, value):
        self.value = value
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
size = text.nbytes
batch = pa.RecordBatch.from_arrays([pa.array([1]), text], names=["doc_id", "text"])
if name == "op3":
    index = op3_string_tiling._index([(1, "one two three four five six"), (2, line[:400])], 4)
    list(op3_string_tiling._matcher(Shared(index), 4, 0.5)([batch]))
elif name == "op4":
    list(op4_order_minhash._sketcher(48, 4)([batch]))
elif name == "op5":
    t = op5_license_scan.Templates(op5_license_scan.TEMPLATES, np.ones(op5_license_scan.DIMENSIONS))
    op5_license_scan.scan_texts(text, t, 0.6)
    list(op5_license_scan._df_counter([batch.select(["text"])]))
elif name == "op6":
    for _, raw, at in K.chunks(text):
        for _ in op6_importance.feature_blocks(raw, at):
            pass
elif name == "op7":
    for _, raw, at in K.chunks(K.lower(text)):
        op7_one_permutation.bin_minima(*K.words(raw, at), 4, 256)
elif name == "op8":
    e = op8_token_files._encoder(op8_token_files.TOKENIZER, None)
    for _, raw, at in K.chunks(text):
        e.encode(raw, at)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / size)
"""


@pytest.mark.parametrize("name", ["op3", "op4", "op5", "op6", "op7", "op8"])
def test_memory_is_a_small_multiple_of_a_text(name):
    run = subprocess.run([sys.executable, "-c", MEASURE, name, "60"], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < 9
