import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stowage.llm import packing
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(texts):
    model = Tokenizer.from_file(PATH)
    return [[*e.ids, 1] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_give_the_ids_of_whole_texts(documents):
    texts = [*ODD, *(r.text for r in documents.collect()), "a. b, c.. d., e ,. f", "x.y,z 3.5 a,b", "é. ü, ×. a÷b.", "don't. we'RE, 's."]
    encoder = packing.WordEncoder(open(PATH).read())
    got = encoder.ids([(t or "").encode() for t in texts])
    want = [np.array(ids[:-1], "<u2").tobytes() for ids in encoded(texts)]
    assert got == want
    # And once more from what is kept.
    assert encoder.ids([(t or "").encode() for t in texts]) == want


def check(df, length):
    rows = df.collect()
    want = sorted(((r.doc_id, e) for r, e in zip(rows, encoded([r.text for r in rows]), strict=True)), key=str)
    pieces = packing.pack(df, PATH, length).collect()
    sequences = {}
    for p in pieces:
        assert p.length == len(p.ids) > 0 and zlib.crc32(np.array(p.ids, "<u4")) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        size = sum(p.length for p in own)
        assert size <= length and size & (size - 1) == 0
    # Pieces of repeated rows can't be told apart, so compare each document's ids by place.
    got, need = {}, {}
    for p in pieces:
        for i, x in enumerate(p.ids):
            got.setdefault((p.doc_id, p.doc_tokens, p.start + i), []).append(x)
    for d, ids in want:
        for i, x in enumerate(ids):
            need.setdefault((d, len(ids), i), []).append(x)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in need.items()}


@pytest.mark.parametrize("length", [1, 64, 2048])
def test_odd_rows(odd, empty, length):
    check(odd if length > 1 else odd.filter("doc_id < 6"), length)
    assert packing.pack(empty, PATH).count() == 0


def test_documents(documents):
    check(documents, 2048)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        path = points[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bad_length(documents):
    with pytest.raises(ValueError):
        packing.pack(documents, PATH, 100)


def test_other_tokenizers_get_whole_texts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        made = json.load(f)
    assert packing.WordEncoder(json.dumps(made)).by_words
    made["normalizer"]["normalizers"].pop()
    other = json.dumps(made)
    encoder = packing.WordEncoder(other)
    texts = ["Some Words, and MORE.", "", "it's 3.14"]
    assert not encoder.by_words
    plain = Tokenizer.from_str(other)
    assert [np.frombuffer(x, encoder.width).tolist() for x in encoder.ids([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
