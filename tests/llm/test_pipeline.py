import os
from collections import defaultdict

import pytest

import corpus_pipeline as P
from touchline.llm import lines

DATA = "/root/testdata/sf0.01"


def test_stages_filter_and_pack(spark, docs, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame, some in ((docs, True), (nothing, False)):
        now = frame
        for name, stage in P.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path))
            assert after.columns == frame.columns, name
            after.write.mode("overwrite").parquet(str(tmp_path / f"{name}-{some}"))
            now = spark.read.parquet(str(tmp_path / f"{name}-{some}"))
        pieces = P.STAGES[-1][1](spark, now, str(tmp_path))
        assert pieces.count() >= now.count() and (pieces.count() > 0) == some
    kept = {r["doc_id"] for r in now.collect()} if some else set()
    assert not kept & {72, 73, 74, 75}


def test_run(spark, docs, corpus, tmp_path):
    long = max((r for r in corpus if r[0] is not None and r[0] < 20), key=lambda r: len(r[1].split()))
    words = long[1].split(" ")
    near = [(90 + i, " ".join(words[:k] + ["other"] + words[k + 1 :]), *long[2:]) for i, k in enumerate((40, 60))]
    docs.unionByName(spark.createDataFrame(near, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = P.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.collect()}
    assert {5, long[0]} <= ids and not ids & {70, 90, 91}  # near and exact copies are gone
    assert {60, 61} <= ids  # documents that share less than the similarity asked for keep what is only theirs
    assert P._left == set()  # and so are all scratch tables of the stages


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_line_dedup_loses_no_text(spark):
    """Every line is still there after the stage unless another one repeats it, and of those that repeat each other one stays."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    gone = {(r["doc_id"], r["line"]) for r in lines.removals(docs).collect()}
    kept = {r["doc_id"]: r["text"] for r in P.once(spark, docs, DATA).collect()}
    left = {}
    for r in docs.select("doc_id", "text").collect():
        left[r["doc_id"]] = [x for i, x in enumerate((r["text"] or "").split("\n")) if (r["doc_id"], i) not in gone]
        if lines.even("".join(left[r["doc_id"]])):
            assert kept[r["doc_id"]] == "\n".join(left[r["doc_id"]])
    there = {lines.even(x) for t in left.values() for x in t} - {""}
    sets = {x: {x[k : k + 7] for k in range(max(1, len(x) - 6))} for x in there}
    by_shingle = defaultdict(set)
    for x, s in sets.items():
        for k in s:
            by_shingle[k].add(x)
    lost = {lines.even(x) for d, t in ((r["doc_id"], r["text"] or "") for r in docs.collect()) for i, x in enumerate(t.split("\n")) if (d, i) in gone} - there
    assert gone and lost
    for x in lost:  # what is nowhere as it was is nearly repeated by a line that stays, at one or two removes
        s = {x[k : k + 7] for k in range(max(1, len(x) - 6))}
        near = set().union(*(by_shingle[k] for k in s))
        assert any(10 * len(s & sets[y]) >= 6 * len(s | sets[y]) for y in near), x
