"""Memory of the packing stage's workers."""

import tracemalloc

import pyarrow as pa

from loudframe.llm import packing
from loudframe.llm.common import arrow_rows
from loudframe.llm.queries import tokenizer_path


def test_new_words_are_learnt_in_bounded_memory():
    """300,000 new words at once: the library's lists of ids are for a slice of them."""
    text = " ".join(f"{i:x}q{i * 7919 % 1000003:x}" for i in range(300_000))
    tokens = packing.Tokens(tokenizer_path())
    tracemalloc.start()
    ids = tokens.encode(pa.array([text]))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == tokens.own.encode(text, add_special_tokens=False).ids
    assert peak < 110e6


def test_batches_of_few_rows_are_for_the_jobs_inside_only(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    with arrow_rows(spark, 100):
        assert max(r.n for r in spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long").collect()) == 100
    assert spark.conf.get(name) == before


def test_tokenizing_hands_few_rows_to_a_worker(spark, monkeypatch):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat('some text ', id) AS text")
    seen = []
    monkeypatch.setattr(packing, "stored", lambda df, name: seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or df)
    packing.tokenized(docs, tokenizer_path())
    assert [int(n) for n in seen] == [packing.BATCH_ROWS]
