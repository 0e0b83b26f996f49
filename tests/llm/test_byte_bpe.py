import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from orderscope.llm import byte_bpe as B
from orderscope.llm.queries import QUERIES

from ..conftest import SF_SMALL

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return B.Vocabulary(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_finds_every_entry(vocab):
    assert sorted(vocab.hash.find(B._hashes(list(vocab.ranks))).tolist()) == list(range(len(vocab.ranks)))


def test_same_ids_as_the_library_on_odd_texts(vocab, library):
    rng = random.Random(5)
    parts = ["a" * 3000, "ab" * 500, " \n\t", "é漢字", "🙂👍🏽", "́", "1234567", "!!!", "it's", "\x00", "\x00a", "\x85",
             "　", "aaaa aaa ", "zqxj" * 9, "<|endoftext|>", "", "  ", "\r\n"]
    for _ in range(600):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        t += "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
                     for _ in range(8))
        got = np.frombuffer(vocab.encode([t])[0], "<u4")
        assert got.tolist() == library.encode_ordinary(t)
        assert vocab.decode(got) == t.encode()


def test_query_on_all_documents(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "a b", None)],
                               "doc_id long, text string, ids string")
    out = B.decode(B.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    rows = out.collect()
    assert sorted(bytes(r.decoded) for r in rows) == [b"", b"", b"a b", b"a b", b"a b"]
    assert B.encode(df.limit(0), PATH, P.PATTERN).count() == 0
