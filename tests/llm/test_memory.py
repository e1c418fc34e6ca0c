import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from tidemark.llm import common, minhash, packing, quality, repeats
from tidemark.sources import tables

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def largest(session) -> int:
    rows = session.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    return max(r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect())


@pytest.mark.parametrize("kernel", [
    lambda b: [quality.text_features(data, ends) for _, data, ends in common.text_batches(b)],
    lambda b: list(minhash._signed(b, 5)),
    lambda b: sum(x.num_rows for x in repeats._anchored(b)),
], ids=["quality", "near_dedup", "repeat_dedup"])
def test_kernels_hold_little(kernel):
    texts = [fixtures.prose(k, 300) for k in range(100)] * 25
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    kernel(iter([batch.slice(0, 10)]))
    assert batch.nbytes > 3 << 20 and peak_mb(lambda: kernel(iter([batch]))) < 45


def test_plans_that_are_handed_on_get_bounded_batches(spark):
    for operator in ("packing", "quality"):
        session = spark.newSession()
        docs = fixtures.documents(session, [(i, fixtures.prose(i, 30)) for i in range(20)])
        assert largest(session) > 8 * tables.BATCH_BYTES
        if operator == "packing":
            packing.pack(docs)
        else:
            quality.drop_low_quality(docs, session.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))
        assert largest(session) < 2 * tables.BATCH_BYTES


def test_a_size_that_was_set_stays(spark):
    session = spark.newSession()
    session.conf.set(_BATCH, str(3 << 20))
    packing.pack(fixtures.documents(session, [(1, "a")]))
    assert session.conf.get(_BATCH) == str(3 << 20)


def test_word_cache_is_small_and_goes_with_the_next_kernel():
    path = pytest.importorskip("public_tokenizers").path(packing.VOCABULARY)
    own, r = packing.tokenizer(path, 100_000), random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(400_000)]
    for at in range(0, len(words), 20_000):
        own.encode([" ".join(words[at : at + 20_000])])
    assert len(own.cache) + len(own.cache.elder) <= 250_000
    assert packing.tokenizer(path) is own
    list(common.text_batches(iter([])))
    assert packing.tokenizer(path) is not own
    packing._tokenizers.clear()
