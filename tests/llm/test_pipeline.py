import zlib

import numpy as np
import pytest
from test_counts_mix_html_suffix import brute_positions
from test_decontaminate import brute_every_start as brute_leaks
from test_jaccard_join import brute as brute_components

import __spark_entry__ as entry_point
import corpus_pipeline
from pipelab.llm import quality_rules
from pipelab.llm.components import connected_components
from pipelab.llm.queries import END_ID, tokenizer_path


def test_all_are_registered():
    names = entry_point.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert after.columns == docs.columns
        sizes.append(after.count())
        docs = after
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5] > 0


def brute_run(rows, items):
    """doc_id, start, n_tokens, crc of the store that the stages after the classifier make of (id, text, source) rows."""
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    single = {d for d, _, low in brute_components([(d, t) for d, t, _ in rows], corpus_pipeline.WORDS, corpus_pipeline.SHARE) if d == low}
    rows = [r for r in rows if r[0] in single]
    leaked = {d for d, _ in brute_leaks([(d, t) for d, t, _ in rows], items)}
    rows = [r for r in rows if r[0] not in leaked]
    whole, text = Tokenizer.from_file(tokenizer_path()), {d: t for d, t, _ in rows}
    out, start = [], 0
    for _, d in sorted((p, d) for d, _, _, places in brute_positions(rows) for p in places):
        ids = whole.encode(text[d] or "", add_special_tokens=False).ids + [END_ID]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_run_equals_brute_force_in_rows_and_order(spark):
    sf = "/root/testdata/sf0.001"
    good = corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_run([tuple(r) for r in good.select("doc_id", "text", "source").collect()], items)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1])
    assert got == want and [r[0] for r in got] != sorted(r[0] for r in got)


def test_an_empty_table_passes_through(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_near_duplicates_decide_rows_of_null_and_repeated_ids(spark):
    words = [f"word{k}" for k in range(60)]
    near = words[:59] + ["other"]
    apart = [f"else{k}" for k in range(40)]
    rows = [
        (1, " ".join(words), "s"), (2, " ".join(near), "s"), (2, " ".join(apart), "s"), (None, " ".join(words), "s"),
        (None, " ".join(near), "s"), (None, "alone " * 3 + "here", "s"), (None, "", "s"), (None, None, "s"), (3, "", "s"), (3, "", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    want = [rows[0], rows[2], rows[5], rows[6], rows[7], rows[8]]
    assert got == sorted(want, key=str)


@pytest.fixture
def many_parts(spark):
    """Shuffles in 40 parts that stay as they are."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def tasks_of(spark, run):
    """Tasks that the driver kept note of while ``run`` went."""
    context, group = spark.sparkContext, f"tasks-{id(run)}"
    context.setJobGroup(group, "counted")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    return sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))


def test_the_fit_makes_few_tasks_however_many_parts_shuffles_have(spark, many_parts):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9 if k % 2 else 400, 20 + int(rng.integers(0, 40)))) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0 or k % 17 == 0)) for k in range(400)], "doc_id long, quality int")
    models = []
    n = tasks_of(spark, lambda: models.append(quality_rules.fit_rules(docs, labels)))
    assert n < 500 and models[0].rules


def test_components_of_a_short_list_make_few_tasks(spark, many_parts):
    edges = spark.createDataFrame([(k + 1, k) for k in range(100)], "a long, b long")
    got = {}
    n = tasks_of(spark, lambda: got.update((r["node"], r["component"]) for r in connected_components(edges).collect()))
    assert n < 200 and got == dict.fromkeys(range(101), 0)


def test_near_duplicates_make_few_tasks(spark, many_parts):
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(words[: 60 - k % 3] + [f"x{k // 9}"] * (k % 2))) for k in range(90)] + [(100 + k, f"else{k} " * 9) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = tasks_of(spark, lambda: corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert n < 2_750


def test_near_duplicates_ask_for_few_full_collections(spark):
    """Each asked for stops the driver, and close together they make its heap grow."""
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(words[: 60 - k % 3] + [f"x{k // 9}"] * (k % 2))) for k in range(90)] + [(100 + k, f"else{k} " * 9) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
    before = sum(b.getCollectionCount() for b in full)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").count()
    assert full and sum(b.getCollectionCount() for b in full) - before <= 4 and 50 < kept < 140


def test_components_of_short_and_long_lists_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))], "a long, b long")
    short = sorted(map(tuple, connected_components(edges).collect()))
    monkeypatch.setattr("pipelab.llm.components.SHORT_EDGES", 0)
    assert sorted(map(tuple, connected_components(edges).collect())) == short
