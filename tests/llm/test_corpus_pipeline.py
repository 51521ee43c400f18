"""The stages of the pipeline on awkward tables, and near-duplicates of very small sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeframe.llm import _common, near_dedup

GOOD = " ".join(f"{a}{b}" for a in ("stone", "river", "later", "green", "often", "wide") for b in ("ly", "ward", "ish", "ness", "less", "ful", "ing", "er", "ed", "est", "some", "like"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row0 string, verdict_id string, component_id string, kept boolean, size int, found array<int>"


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def _stages(spark, docs, folder):
    out, at = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, folder)
        path = f"{folder}/out-{_common.uuid.uuid4().hex}-{k}"
        at.write.parquet(path)
        at = spark.read.parquet(path)
        out.append(at)
    return out


def test_stages_on_nulls_repeats_and_clashing_names(spark, bench):
    words = GOOD.split()
    other = " ".join(words[::-1])
    rows = [(1, GOOD, "en", "s"), (2, GOOD, None, None), (2, GOOD, None, None), (None, other, "en", None), (None, None, None, None), (5, "", "en", "s"), (6, "x" * 200000 + " " + " ".join(words[::2] + words[1::2]), "de", "s"), (7, "short", "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "r", "v", "c", True, 3, [1]) for r in rows], SCHEMA)
    *filters, mixed = _stages(spark, docs, bench)
    assert all(f.columns == docs.columns for f in filters)
    ids = [sorted((r.doc_id if r.doc_id is not None else -1) for r in f.collect()) for f in filters]
    assert ids[0] in ([-1, 1, 2, 2, 6], [-1, 1, 2, 2])  # a text of one endless word may be an outlier, the others are not
    assert ids[1] == [x for x in ids[0] if x != 2] and ids[2] == ids[1] and ids[3] == ids[2]
    assert mixed.count() == len(ids[3]) and all(r.taken <= 3 * r.size for r in mixed.collect())


def test_stages_on_an_empty_table(spark, bench):
    docs = spark.createDataFrame([], SCHEMA)
    assert [f.count() for f in _stages(spark, docs, bench)] == [0] * 5


def test_a_cluster_without_a_shared_folder_fails():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="share"):
        _common.shared_dir(Session)


def test_tiny_sets_share_a_band_as_often_as_large_ones():
    rng, missed = np.random.default_rng(5), 0
    for _ in range(3000):
        items = rng.integers(0, 2**63, 5, dtype=np.uint64)
        missed += not (near_dedup.minmax_bands(np.sort(items)) == near_dedup.minmax_bands(np.sort(items[:4]))).any()
    assert missed <= 3
