import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdica.llm import kernels as K
from verdica.llm import op8_token_files as op

ENCODER = op.Encoder(op.TOKENIZER, op.END)
MULTI = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab'stde \n\t\r \u0085 　é日1.,!<|>\x1c", max_size=25), max_size=6))
def test_ids_are_those_of_the_whole_text(texts):
    raw, at = K.view(pa.array(texts, pa.string()))
    ids, count = ENCODER.encode(raw, at)
    expected = [ENCODER._bpe.encode_ordinary(t) + [op.END] for t in texts]
    assert count.tolist() == [len(x) for x in expected] and ids.tolist() == [y for x in expected for y in x]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(op, "CACHE", 3)
    e = op.Encoder(op.TOKENIZER, None)
    for t in ("a b c d e f", "g a h i", "a b"):
        raw, at = K.view(pa.array([t]))
        assert e.encode(raw, at)[0].tolist() == e._bpe.encode_ordinary(t)


@pytest.mark.parametrize("tokenizer", [op.TOKENIZER, MULTI])
def test_round_trip(spark, tmp_path, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    rows = op.write(docs, str(tmp_path / "out"), tokenizer).collect()
    corpus, texts = op.Corpus(str(tmp_path / "out")), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(corpus) == len(rows) == len(texts) and sorted(r["doc"] for r in rows) == list(range(len(rows)))
    decode = op.Encoder(tokenizer, op.END)._bpe
    whole = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "out").glob("*.bin"))])
    assert len(whole) == corpus.about["tokens"] == sum(r["tokens"] for r in rows)
    for r in rows:
        ids = corpus[r["doc"]]
        assert (ids == whole[r["start"] : r["start"] + r["tokens"]]).all() and ids[-1] == op.END
        assert decode.decode(ids[:-1].tolist()) == texts[r["doc_id"]]
    offsets = np.fromfile(next((tmp_path / "out").glob("*.idx")), "<i8")
    assert offsets[0] == 0 and (np.diff(offsets) > 0).all()
    with pytest.raises(IndexError):
        corpus[len(rows)]


def test_a_second_attempt_leaves_the_same_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    op.write(docs, str(tmp_path / "a")).count()
    files = {p.name: p.read_bytes() for p in (tmp_path / "a").iterdir()}
    op.write(docs, str(tmp_path / "a")).count()
    assert {p.name: p.read_bytes() for p in (tmp_path / "a").iterdir()} == files and len(files) == 3


def test_odd_rows(awkward, no_docs, tmp_path):
    rows = op.write(awkward, str(tmp_path / "x")).collect()
    assert len(rows) == awkward.count()
    n = {}
    for r in rows:
        n.setdefault(r["doc_id"], []).append(r["tokens"])
    assert n[1] == n[2] == [1] and n[6][0] == n[6][1] and len(n[None]) == 1
    assert op.write(no_docs, str(tmp_path / "y")).count() == 0 and len(op.Corpus(str(tmp_path / "y"))) == 0
    assert op.write(awkward, str(tmp_path / "z"), end=None).count() == len(rows)
