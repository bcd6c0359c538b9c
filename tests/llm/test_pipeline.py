"""The pipeline stage by stage against what each stage promises."""

import os
import sys

import corpus_pipeline
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from cases import words  # noqa: E402
from test_dedup import brute_groups, key  # noqa: E402

from roofline.llm._common import cut, shared_dir  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", None, None), (10**6 + 1, "12 34", None, "s", 5), (None, "the and the of", "en", "s", 14)],
                                  docs.schema)
    docs, home, seen = docs.unionByName(extra), shared_dir(spark), []
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf_dir), f"{home}/{name}")
        seen.append((name, docs, out))
        if name != "packing":
            assert out.columns == docs.columns
            assert out.where(F.length("text") != F.col("n_chars")).count() == 0
        docs = out
    rows = {name: ([tuple(r) for r in a.select("doc_id", "text").collect()],
                   [tuple(r) for r in b.select("doc_id", "text").collect()]) for name, a, b in seen[:-1]}

    before, after = rows["language_id"]
    assert {i for i, _ in before} - {i for i, _ in after} == {10**6, 10**6 + 1}

    before, after = rows["line_dedup"]
    holders = {}
    for i, t in after:
        for k in {key(x) for x in t.split("\n")} - {""}:
            holders.setdefault(k, set()).add(i)
    count = {}
    for i, t in before:
        for k in {key(x) for x in t.split("\n")} - {""}:
            count[k] = count.get(k, 0) + 1
    assert all(len(holders.get(k, ())) == 1 for k, n in count.items() if n >= 10)
    assert all(len(holders[k]) == n for k, n in count.items() if n < 10)

    before, after = rows["near_dedup"]
    groups = brute_groups(before, 5, 80)
    assert {i for i, _ in after} >= {c for _, _, c in groups} - {None}
    assert len(after) == len({c for _, _, c in groups})

    before, after = rows["substring_dedup"]
    first = {}
    for i, t in sorted(before, key=lambda r: (r[0] is None, r[0])):
        for p in range(len(words(t)) - 49):
            first.setdefault(tuple(words(t)[p:p + 50]), i)
    for i, t in after:
        gone = any(first[tuple(words(x)[p:p + 50])] != i for j, x in before if j == i for p in range(len(words(x)) - 49))
        assert gone or (i, t) in before


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0
