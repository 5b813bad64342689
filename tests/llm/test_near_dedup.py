"""Near duplicates of the pipeline through fingerprints, with the exact check behind them."""

import random

import numpy as np
import pyarrow as pa

from loudframe.llm import common, near_dedup, simhash
from loudframe.llm.common import split_words


def test_near_fingerprints_are_candidates_and_similarity_decides(spark, monkeypatch):
    """Without nearly all of the bands, every similar pair within three bits is still found; near fingerprints of other texts link nothing."""
    monkeypatch.setattr(near_dedup, "band_plan", lambda similarity: (1, 16))
    rng, rows = random.Random(4), []
    for i in range(60):  # five of about 400 shingles changed
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:200], f"n{i}", *base[201:]]))]
    for i in (60, 61):  # much the same counts of shingles, few of them the same
        rows.append((2 * i, " ".join(["a", "b", "c", "d", "e"] * 200 + [f"{i}x{k}" for k in range(100)])))
    fp = simhash.fingerprints_of(*split_words(pa.array([t for _, t in rows])), near_dedup.SHINGLE)
    bits = np.bitwise_count(fp[0:120:2] ^ fp[1:120:2])
    assert (bits <= simhash.RADIUS).sum() > 20
    assert np.bitwise_count(fp[120] ^ fp[121]) <= simhash.RADIUS
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {*range(0, 120, 2), 120, 122}
    assert not kept & {2 * int(i) + 1 for i in np.flatnonzero(bits <= simhash.RADIUS)}


def test_workers_get_texts_in_bounded_batches_and_release_memory(spark, monkeypatch):
    """Batches of whole texts have at most TEXT_ROWS rows in every step of the stage, and the session's bound is as before."""
    def bounded(make):
        def made(*args):
            run = make(*args)

            def checked(batches):
                def each():
                    for batch in batches:
                        assert batch.num_rows <= 1_000, batch.num_rows
                        yield batch
                return run(each())
            return checked
        return made

    for name in ("_band_keys", "_shingles", "_verified"):
        monkeypatch.setattr(near_dedup, name, bounded(getattr(near_dedup, name)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{base} x{i}") for i in range(1_300)] + [(1_300 + i, " ".join(f"u{i}v{k}" for k in range(20))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()}
    assert kept == {0, *range(1_300, 2_000)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_releasing_before_and_after_the_batches(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append("released"))
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    for got in common.releasing(iter)([batch, batch]):
        assert got is batch
        calls.append("batch")
    assert calls == ["released", "batch", "batch", "released"]
    monkeypatch.undo()
    common.release_memory()
