"""Intermediate tables go when the scope they were made in ends."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from hookline.session import ensure_checkpoint_dir, in_this_scope, scratch_path, scratch_scope


def listing(spark):
    return {x for x in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")) if x.startswith("hookline-")}


def write(spark, name):
    path = scratch_path(spark, name)
    spark.range(3).write.parquet(path)
    return path


def test_scopes_drop_what_is_not_kept(spark):
    before = listing(spark)
    outside = write(spark, "outside")
    with scratch_scope(spark) as outer:
        kept = write(spark, "kept")
        write(spark, "gone")
        outer.keep(kept)
        with scratch_scope(spark) as inner:
            handed = write(spark, "handed")
            write(spark, "inner")
            inner.keep(handed)
        assert spark.read.parquet(handed).count() == 3
        with ThreadPoolExecutor(2) as pool:
            list(pool.map(in_this_scope(lambda i: write(spark, f"thread{i}")), range(4)))
    assert listing(spark) - before == {os.path.basename(p) for p in (outside, kept)}


def test_scope_ends_on_errors_too(spark):
    before = listing(spark)
    with pytest.raises(ValueError), scratch_scope(spark):
        write(spark, "lost")
        raise ValueError
    assert listing(spark) == before


def test_queries_leave_nothing(spark):
    import __spark_entry__ as entry
    before = listing(spark)
    for key in ("topk_tfidf_terms", "sink_thresholds", "src_merge_sources", "ml_surface_tfidf"):
        with scratch_scope(spark):
            assert entry.queries()[key](spark, "/root/testdata/sf0.001").count() > 0
    assert listing(spark) == before
