import random
from collections import Counter

import pytest

import corpus_pipeline
from panelyard.llm import decontaminate, quality, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "in", "ou", "st"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(14)) for i in range(5)]
    docs = [(i, text(rng.randint(20, 90))) for i in range(150)]
    docs += [(200 + i, " ".join(w + "$$$" for w in text(40).split())) for i in range(40)]
    docs += [(300 + i, docs[i][1]) for i in range(20)] + [(400 + i, text(20) + " " + items[i % 5][1] + ". " + text(5)) for i in range(10)]
    docs += [(500 + i, text(10) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + text(30)) for i in range(5)] + [(600, None), (601, "")]
    docs = [(i, t, "en", f"src{i % 7}", None if t is None else len(t)) for i, t in docs]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 300), 0) for i, *_ in docs if i % 2 == 0 and i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, items


def test_each_stage_does_its_work(spark, folder):
    d, docs, items = folder
    frame = spark.read.parquet(f"{d}/documents.parquet")
    seen = [frame]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(spark.createDataFrame(stage(spark, seen[-1], d).collect(), frame.schema))
        assert seen[-1].columns == frame.columns
    ids = [{r["doc_id"] for r in s.collect()} for s in seen]
    assert not any(200 <= i < 300 for i in ids[1]) and set(range(150)) <= ids[1]
    fps = {r["doc_id"]: simhash.fingerprint_of(r["text"]) for r in seen[1].collect()}
    groups = {}
    for i in sorted(fps):
        near = {groups[j] for j in groups if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4}
        first = min(near | {i})
        groups = {j: first if g in near else g for j, g in groups.items()} | {i: first}
    assert ids[2] == {i for i, g in groups.items() if i == g}
    index = decontaminate.build(items, 8, 0.1)
    assert ids[3] == {r["doc_id"] for r in seen[2].collect() if not decontaminate.regions(r["text"] or "", index, 8)} and not any(400 <= i < 500 for i in ids[3])
    texts = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    assert ids[4] == ids[3] and all("[SECRET]" in texts[i] and "24be" not in texts[i] for i in ids[4] if 500 <= i < 600)
    before = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert all(texts[i] == before[i] for i in ids[4] if not 500 <= i < 600)
    bins = corpus_pipeline.STAGES[-1][1](spark, seen[4], d).collect()
    assert Counter(r["doc_id"] for r in bins for _ in range(r["n_chars"])) == Counter(i for i, t in texts.items() for _ in t or "")


def test_run_gives_the_last_stage(spark, folder):
    d, docs, _ = folder
    rows = corpus_pipeline.run(spark, d).collect()
    assert rows and {"bin_id", "doc_id", "start", "n_chars"} <= set(rows[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, folder):
    d, _, _ = folder
    none = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, d)
    assert none.count() == 0


def test_held_out_fold_is_fixed(spark):
    import zlib

    rows = spark.range(50).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["h"] for r in rows.select("doc_id", quality.held_out(rows["doc_id"]).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_columns_of_inner_names_come_through(spark, folder):
    """Every stage returns columns whose names it uses itself, as they came."""
    d, docs, _ = folder
    inner = ["own_score", "leaking", "spans", "clean", "own", "one", "h", "rows", "row", "root", "fp", "_first", "_leaking", "_quality_score", "_secret_spans", "keys"]
    frame = spark.createDataFrame([(i, t, lang, src, n, *(f"{c}{i}" for c in inner)) for i, t, lang, src, n in docs], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in inner))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, frame, d).collect(), frame.schema)
        assert kept.columns == frame.columns and kept.count() > 0
        assert all(r[c] == f"{c}{r['doc_id']}" for r in kept.collect() for c in inner)
    assert corpus_pipeline.STAGES[-1][1](spark, frame, d).count() > 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from panelyard.llm import common

    conf = lambda **given: SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: given.get(k.replace(".", "_"), default)))
    assert common.shared_dir(conf(spark_master="spark://h:7077", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
    assert common.shared_dir(conf(spark_master="local[4]")).startswith("file:")
    with pytest.raises(ValueError):
        common.shared_dir(conf(spark_master="yarn"))
