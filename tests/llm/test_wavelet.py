import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from orderscope.llm import wavelet as W
from orderscope.llm.common import tune
from orderscope.llm.queries import QUERIES

from ..conftest import SF_SMALL

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)  # as it comes


@pytest.mark.parametrize(("n", "levels"), [(0, 3), (1, 1), (7, 3), (511, 4), (512, 4), (5000, 6), (3000, 18)])
def test_access_rank_and_select(n, levels):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**levels, n) // rng.integers(1, 3)
    out = io.BytesIO()
    W.save(out, x.astype(np.uint32), levels, [3, None], np.array([n, n]))
    w, ids, ends = W.load(out.getvalue())
    assert w.all().tolist() == x.tolist() and ids == [3, None] and ends.tolist() == [n, n]
    for i in rng.integers(0, n, 20).tolist() if n else []:
        v = int(x[i])
        assert w.access(i) == v
        assert w.rank(v, i) == int((x[:i] == v).sum()) and w.rank(v) == int((x == v).sum())
        assert w.select(v, w.rank(v, i)) == i
    assert w.rank(2**levels) == 0
    with pytest.raises(IndexError):
        w.access(n)
    with pytest.raises(IndexError):
        w.select(0, n + 1)


def test_whole_text_ids(library):
    enc = W.TextEncoder(PATH)
    rng = random.Random(2)
    parts = ["a" * 300, " \n\t", "é漢字", "🙂👍🏽", "́", " ́", "é", "H̱", "123", "!!!", "it's", "IT'S", "\x00",
             "\x1c", "\x85", "　", "<|endoftext|>", "Σς", "İ", "ẞ", "ŉ", "가"]
    texts = [chr(a) + chr(b) for a in range(0, 0x180, 3) for b in range(0, 0x180, 7)]
    for _ in range(1500):
        texts.append("".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
                     + "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0xD7FF)])) for _ in range(5)))
    ids, n = enc.encode(texts)
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_query_on_all_documents(spark, library):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = sorted(QUERIES["op1_wavelet_tokens"](spark, SF_SMALL).collect())
    at = 0
    for (doc_id, text), r in zip(docs, got, strict=True):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shards_nulls_repeats_and_empty(spark):
    tune(spark)
    df = spark.createDataFrame([(5, "b c", 0), (2, None, 0), (None, "z", 0), (2, "", 0), (5, "a", 0)] * 400,
                               "doc_id long, text string, start int")
    manifest = W.write(df, PATH, end_id=2, shard_tokens=20)
    assert manifest.count() > 2
    rows = sorted(((r.start, r.doc_id, len(r.ids) // 4) for r in W.read(manifest).collect()))
    assert [r[1] for r in rows] == [None] * 400 + [2] * 800 + [5] * 800
    assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:], strict=False)) and rows[0][0] == 0
    empty = W.read(W.write(df.limit(0), PATH, end_id=2))
    assert empty.columns == ["doc_id", "start", "ids"] and empty.count() == 0


def test_strings_of_added_tokens_and_long_pieces(library):
    texts = ["a <|endoftext|> b", "<|startoftext|>A<|endoftext|>", "x<|ENDOFTEXT|>y", "<|endoftext|", "plain", "", "w" * 5000,
             "é <|endoftext|>\n É ﬁ", "ß" * 300 + " <|endoftext|>" * 3]
    ids, n = W.TextEncoder(PATH).encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert want[0] == [320, 49407, 321]


def test_a_file_with_another_normaliser_is_left_to_the_library(tmp_path):
    import json
    spec = json.load(open(PATH, encoding="utf-8"))
    assert W.TextEncoder(PATH).known
    spec["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    texts = ["Upper Case", "a  b", "plain"]
    got, encoder = Tokenizer.from_file(str(other)), W.TextEncoder(str(other))
    assert not encoder.known
    assert encoder.encode(texts)[0].tolist() == [i for t in texts for i in got.encode(t, add_special_tokens=False).ids]
