import re

import corpus_pipeline
from busloom.llm import mixing, toxicity
from busloom.llm.queries import QUERIES
from pyspark.sql import functions as F

from . import cases
from .test_decontaminate import brute as brute_windows
from .test_mixing_and_sharding import slow_jump, water
from .test_simhash import brute_fp, classes
from .test_toxicity import labelled


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = labelled(150)
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in docs]
    rows += [(1000 + i, docs[i + 1][1], "en", "src0", 1) for i in range(0, 30, 3)]  # exact copies of clean ones
    rows += [(2000, docs[1][1] + " end", "en", "src9", 1)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    items = [(1, " ".join(docs[4][1].split()[5:25]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    start = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(start, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = [r for r in rows if model.score(r[1])[0] < 0.7]
    assert {r[0] for r in rows} - {r[0] for r in clean} >= {i for i, t in labels if t}
    fps = [brute_fp(r[1]) for r in clean]
    cls = classes(len(clean), [(i, j) for i in range(len(clean)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    one = {}
    for r, c in sorted(zip(clean, cls, strict=True), key=lambda x: x[0][0]):
        one.setdefault(c, r)
    bad = {r[0] for r in brute_windows([(r[0], r[1]) for r in one.values()], items) if r[5]}
    left = [r for r in one.values() if r[0] not in bad]
    assert bad and len(left) < len(clean) < len(rows)
    sizes = {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r[1]))
    target = water(sizes)

    d = start
    kept = []
    for i, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{sf}/out{i}"
        stage(spark, d, sf).write.parquet(path)
        d = spark.read.parquet(path)
        kept.append(d)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(kept[0]) == sorted(r[0] for r in clean)
    assert ids(kept[1]) == sorted(r[0] for r in one.values())
    assert ids(kept[2]) == sorted(r[0] for r in left)
    for k in kept[:4]:
        assert k.columns == start.columns
    taken = {r.source: r.n for r in kept[3].groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    assert set(ids(kept[3])) <= {r[0] for r in left}
    for s, t in target.items():
        assert abs(taken.get(s, 0) - t) <= 70, (s, taken.get(s), t)
    out = kept[4].withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).collect()
    assert sorted(r.doc_id for r in out) == ids(kept[3])
    assert all(r.shard == slow_jump(r.h % (1 << 64), 40) for r in out)
    assert cases.same_rows(corpus_pipeline.run(spark, sf).select("doc_id", "shard"), kept[4].select("doc_id", "shard"))


def test_stages_on_awkward_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(8, 1), (10, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "no such words anywhere in here at all today my friend")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for n, docs in enumerate((cases.documents(spark), cases.documents(spark, clash=True), cases.nothing(spark))):
        d = docs
        for i, (_name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{sf}/{n}-{i}"
            stage(spark, d, sf).write.parquet(path)
            d = spark.read.parquet(path)
            assert set(d.columns) >= set(docs.columns) and (i == 4 or d.columns == docs.columns)
        assert d.count() <= 3 * docs.count()


def test_slots_keep_the_order_of_the_mix(spark, tmp_path):
    sf = str(tmp_path)
    rows = [(i, cases.prose(i, 30), "en", f"src{i % 3}", 1) for i in range(400)]
    spark.createDataFrame(rows, cases.SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, sf).write.parquet(f"{sf}/mixed.parquet")
    mixed = spark.read.parquet(f"{sf}/mixed.parquet")
    got = corpus_pipeline.shard_documents(spark, mixed, sf).collect()
    due = {}
    for r in mixing.schedule(mixing.mix(docs)).collect():
        due.setdefault(r.doc_id, []).append(r.position)
    assert any(len(p) > 1 for p in due.values())
    for s in range(40):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        seen, at = {}, []
        for _, i in own:
            at.append(due[i][seen.setdefault(i, 0)])
            seen[i] += 1
        assert at == sorted(at)


def test_nothing_is_left_in_the_shared_folder(spark, tmp_path):
    from pathlib import Path

    from busloom.llm.common import shared_dir

    sf = str(tmp_path)
    cases.documents(spark).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(8, 1), (10, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "no such words anywhere in here at all today my friend")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    files = lambda: {p for p in Path(shared_dir(spark).removeprefix("file:")).rglob("part-*")}
    before = files()
    n = corpus_pipeline.run(spark, sf).count()
    assert n and all("4-sharding" in str(p) for p in files() - before)


def test_a_run_removes_its_own_files_only(spark, tmp_path):
    """Another query's checkpoints, made in between in another thread, stay; a failed run leaves nothing."""
    import threading

    import pytest
    from busloom.llm.common import checkpointed, own_files, written

    got = []
    with own_files(spark):
        mine = checkpointed(spark.range(10))
        t = threading.Thread(target=lambda: got.extend([checkpointed(spark.range(7)), written(spark.range(5))]))
        t.start()
        t.join()
        assert mine.count() == 10
    assert [x.count() for x in got] == [7, 5]
    with pytest.raises(Exception):  # noqa: B017
        mine.count()

    def fails(spark, docs, sf_dir):
        checkpointed(docs).count()
        raise RuntimeError("no")

    from pathlib import Path

    from busloom.llm.common import shared_dir

    cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    files = lambda: {p for p in Path(shared_dir(spark).removeprefix("file:")).rglob("part-*")}
    before, stages = files(), corpus_pipeline.STAGES
    corpus_pipeline.STAGES = [("all", lambda spark, docs, sf_dir: docs), ("fails", fails)]
    try:
        with pytest.raises(RuntimeError, match="no"):
            corpus_pipeline.run(spark, str(tmp_path))
    finally:
        corpus_pipeline.STAGES = stages
    assert files() == before


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Functions are shipped whole: the driver alone has the package on its path."""
    import os
    import subprocess
    import sys

    root, sf = os.path.dirname(os.path.abspath(corpus_pipeline.__file__)), "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
import __spark_entry__ as e
for q in ('op1_html_extraction', 'op2_benchmark_decontamination', 'op4_secret_scan', 'op5_toxicity', 'op6_simhash_dedup', 'op7_token_shards', 'op9_sharding', 'op10_nearest_neighbours'):
    assert e.queries()[q](spark, {sf!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=600)
