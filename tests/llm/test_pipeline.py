import re

import corpus_pipeline
from tests.llm import fixtures
from tests.llm.test_dedup import components, removed
from tidemark.llm import quality


def write(spark, folder, texts, labels):
    docs = fixtures.documents(spark, texts)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept; the classifier's own scores say what the first one keeps."""
    texts = [(i, t) for i, t in fixtures.corpus() if i is not None]
    texts += [(1000 + i, fixtures.prose(2000 + i, 80).upper().replace(" ", "!! ")) for i in range(30)]
    docs = write(spark, str(tmp_path), texts, [(i, int(i < 1000), 0) for i, _ in texts])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "repeat_dedup", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, docs: corpus_pipeline.cut(stages[name](spark, docs, str(tmp_path)), name)
    ids = lambda df: {r.doc_id for r in df.collect()}

    first = run("quality", docs)
    assert ids(first) == {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted}
    text = dict(texts)
    second = run("exact_dedup", first)
    assert ids(second) == {max(i for i in ids(first) if (text[i] or "") == (text[k] or "")) for k in ids(first)}
    third = run("near_dedup", second)
    groups = components([(i, text[i]) for i in ids(second)], 5)
    assert ids(third) == {i for i, (_, c) in groups.items() if i == c}
    fourth = run("repeat_dedup", third)
    sizes = {i: n - gone for i, (n, gone, _, _) in removed([(i, text[i]) for i in ids(third)]).items()}
    for r in fourth.collect():
        assert sizes[r.doc_id] - 8 <= len((r.text or "").encode()) <= sizes[r.doc_id]  # bytes of characters that were cut through
    fifth = run("packing", fourth)
    assert ids(fifth) == ids(fourth)
    assert all(a.columns == docs.columns for a in (first, second, third, fourth))


def test_run_gives_the_last_stage(spark, tmp_path):
    texts = [(i, fixtures.prose(i, 40)) for i in range(20)]
    write(spark, str(tmp_path), texts, [(i, i % 2, 0) for i in range(20)])
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert not re.search("limit|sample", str(corpus_pipeline.ORACLE_SQL or ""))


def test_pipeline_of_no_documents(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
