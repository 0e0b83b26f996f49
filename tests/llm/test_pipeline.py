import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from orderscope.llm import byte_bpe
from orderscope.llm.common import table, written

from ..conftest import SF_SMALL
from . import brute
from .test_decontaminate import expected


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns, seen = docs.columns, []
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF_SMALL), "test-stage")
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(seen[-1])
        assert docs.columns == (columns if name != C.STAGES[-1][0] else [*columns, "ids"])
    scored, ruled, single, clean, encoded = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    right = [labels[k] == (k in scored) for k in labels]
    assert np.mean(right) > 0.8, np.mean(right)  # some fifty trusted texts at this size
    assert set(ruled) <= set(scored) and all(r.n_chars == len(r.text) <= len(scored[k].text) for k, r in ruled.items())
    groups = brute.groups({k: r.text for k, r in ruled.items()})
    assert set(single) == {k for k, (_, g) in groups.items() if k == g} and len(single) < len(ruled)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    hits = dict(zip(single, expected([r.text for r in single.values()], items), strict=True))
    assert set(clean) == {k for k, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
    assert len(clean) < len(single)
    v = byte_bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert set(encoded) == set(clean)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text) for r in encoded.values())


def test_empty_and_odd_rows(spark):
    docs = table(spark, SF_SMALL, "documents")
    good = docs.where("n_chars > 800").limit(1)
    again = good.select("doc_id", "text", "lang", "source", "n_chars")
    odd = docs.sparkSession.createDataFrame([(None, None, None, None, None), (-1, "", "", "", 0)], docs.schema)
    given = written(again.union(again).union(odd), "odd")
    assert C.duplicates(spark, given, SF_SMALL).count() == 3
    assert C.rules(spark, odd, SF_SMALL).count() == 0
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0


def test_stages_keep_columns_with_their_own_names(spark):
    names = ["_score", "_rules", "_hits"]
    docs = written(table(spark, SF_SMALL, "documents").selectExpr("*", *[f"doc_id * {i + 1} as {c}" for i, c in enumerate(names)]), "clash")
    for stage in (C.classifier, C.rules, C.benchmark):
        rows = stage(spark, docs, SF_SMALL).collect()
        assert rows and all([r[c] for c in names] == [r.doc_id, 2 * r.doc_id, 3 * r.doc_id] for r in rows)
