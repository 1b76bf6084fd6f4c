"""The pipeline's decisions against plain Python, stage by stage."""

import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from larkspan.llm import mixing, queries, simhash
from larkspan.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        seen[name] = docs.collect()
    whole = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    good = {r["doc_id"] for r in seen["quality classifier"]}
    bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
    assert len(bad & good) <= 0.05 * len(bad) and len(good) > 0.7 * len(whole)
    prints = {i: simhash.fingerprint(whole[i]["text"].encode()) for i in sorted(good)}
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    kept = {r["doc_id"] for r in seen["simhash near-dedup"]}
    assert kept == {i for i, r in root.items() if i == r}
    leaked = {r["doc_id"] for r in queries.op2_benchmark_decontamination(spark, SF).collect()}
    clean = {r["doc_id"] for r in seen["benchmark decontamination"]}
    assert clean == kept - leaked
    mixed = Counter(r["doc_id"] for r in seen["source mixing"])
    sizes = mixing.mix(mixing.measured(table(spark, SF, "documents").where(F.col("doc_id").isin(list(clean)))))
    assert mixed == Counter({r["id"]: r["times"] for r in sizes.collect() if r["times"]})
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    for i, row in zip(sorted(mixed.elements()), got, strict=True):
        ids = np.array(tok.encode(whole[i]["text"], add_special_tokens=False).ids + [2], "<u4")
        assert row == (start, i, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_stages_on_awkward_rows(spark):
    from pyspark.sql.types import LongType, StringType, StructField

    docs = table(spark, SF, "documents")
    extra = [*docs.schema.fields, StructField("_bad_id", StringType()), StructField("_times", LongType()), StructField("_kept_id", StringType()), StructField("id", LongType()), StructField("fp", StringType())]
    long = "river stone meadow cloud " * 30_000
    good = docs.where("doc_id = 5").first()["text"]
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, long, None, "b"), (None, good, "en", "a"), (None, None, None, None), (5, good, "en", "a"), (5, good, "en", "a"), (6, good, "en", "c"), (7, "one", "en", "c")]
    schema = type(docs.schema)(extra)
    frame = spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, "y", 9, "z") for i, t, lang, source in rows], schema)
    now = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, SF), "awkward")
        assert now.columns == frame.columns
    seen = now.collect()
    assert {tuple(r) for r in seen} <= {tuple(r) for r in frame.collect()}
    ids = [r["doc_id"] for r in seen]
    assert 6 not in ids and len([i for i in ids if i is None]) <= 2
    last = corpus_pipeline.token_ids(spark, now, SF).collect()
    assert sorted(str(r["doc_id"]) for r in last) == sorted(map(str, ids))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), SF).count() == 0, name
