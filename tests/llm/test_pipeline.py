"""The pipeline against a plain version of its stages, and the queries' registration."""

import hashlib
from collections import Counter
from functools import reduce
from operator import or_

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillstack.llm import byte_bpe, mixing, quality
from quillstack.llm.common import named
from quillstack.llm.oracles import ORACLES
from quillstack.llm.queries import QUERIES

from sample_docs import CLASH, SCHEMA, rows
from test_operators import brute_components, brute_fingerprint


def test_pipeline_equals_its_stages_done_plainly(spark, tmp_path):
    data = [(i, t, a, b, n) for i, t, a, b, n in rows(80) if i is not None]
    data = [*data[:-1], (200, "$$$ ### @@@ %%% " * 20, "en", "hot", 1), (201, "$#@ $#@ $#@ " * 30, "en", "s1", 1)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1) for i in range(80)] + [(200, 0), (201, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    forest = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    import numpy as np

    kept = [r for r in data if forest.scores(np.array([quality.statistics(r[1] or "")]))[0] >= quality.THRESHOLD]
    last = {}
    for r in kept:
        if r[0] >= last.get(r[1] or "", r)[0]:
            last[r[1] or ""] = r
    parts = {d: c for d, _, c in brute_components([(r[0], brute_fingerprint(r[1])) for r in last.values()])}
    single = [r for r in last.values() if parts[r[0]] == r[0]]
    words = mixing.mixed_words(mixing.plan_mix(spark.createDataFrame(single, SCHEMA))).collect()
    times = {w["doc_id"]: int(w["taken"] / w["size"] + 0.5) for w in words if w["size"]}
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    expected = Counter()
    for r in single:
        ids = enc.encode_ordinary(r[1] or "")
        if times.get(r[0]):
            expected[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += times[r[0]]
    assert Counter(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == expected


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows(), SCHEMA).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.where(reduce(or_, (named(c) != f"own {c}" for c in CLASH))).isEmpty() and not out.isEmpty()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES)
