"""The pipeline against plain loops over the same documents, stage by stage."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import pytest
from awkward_rows import COLUMNS, rows, sentence
from test_corpus_operators import BENCH, bench_rows, classes_plainly, leaks_plainly, lines_plainly

from tessella.llm import bpe


def documents() -> list[tuple]:
    r = random.Random(12)
    seen: dict = {}
    for row in rows():
        if row[0] is not None and row[0] not in seen:
            seen[row[0]] = row
    more = [(1000 + k, f"{sentence(r, 25)}\nkeep off the grass please\n{sentence(r, 9)}", "en", f"s{k}", 5) for k in range(12)]
    return [*seen.values(), *more]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(documents(), COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench_rows(), BENCH).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline(spark, folder):
    data = [d for d in documents() if d[1] and any(c.isalpha() for c in d[1])]
    lines = {d[0]: x for d, x in zip(data, lines_plainly(data, 10, corpus_pipeline.COPY_SHARE), strict=True)}
    data = [(d[0], lines[d[0]][4] if lines[d[0]][3] else d[1], *d[2:]) for d in data]
    assert any(x[3] for x in lines.values())
    first = {d for d, name, *_ in classes_plainly(data) if d == name}
    assert len(first) < len(data)
    data = [d for d in data if d[0] in first]
    hits = {d: hit for d, _, hit, _ in leaks_plainly(data, bench_rows())}
    assert any(hits.values())
    data = [d for d in data if not hits[d[0]]]
    own = bpe.Codec(bpe.default_vocabulary())
    want = {d[0]: (n, hashlib.sha256(ids.encode()).hexdigest()) for d, (ids, n, _) in zip(data, own.batch([d[1] for d in data]), strict=True)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {x["doc_id"]: (x["n_tokens"], x["ids_sha256"]) for x in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_duplicates_keep_different_texts_of_one_id(spark):
    r = random.Random(31)
    a, b, c = (sentence(r, 60) for _ in range(3))
    data = [(5, a), (5, a), (5, b), (5, b + " end"), (6, a), (4, c), (5, c), (7, "."), (7, "."), (None, a), (8, ""), (8, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = [tuple(x) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len([x for x in got if x[1] in (b, b + " end")]) == 1
    assert sorted((x for x in got if x[1] not in (b, b + " end")), key=str) == sorted([(5, a), (4, c), (7, "."), (None, a), (8, "")], key=str)
