"""Publication of versions, and streams that decide each email once by what is published."""


import pytest
from pyspark.sql import functions as F

from hookline.operators.policy import policy_tiers
from hookline.plans.cv import PublishedScorer, train_and_save
from hookline.session import scratch_path
from hookline.sources.published import current, publish
from hookline.sources.tables import emails, table
from hookline.streaming.route import route_once, run_to_completion, stream_emails, with_arrival

SF001 = "/root/testdata/sf0.001"


def thresholds(spark, cal, block):
    return lambda folder: spark.createDataFrame([(cal, block)], "tau_cal double, tau_block double").write.parquet(f"{folder}/thresholds")


def test_readers_see_the_old_version_until_the_new_one_is_whole(spark):
    root = scratch_path(spark, "published")
    assert current(spark, root) is None
    first = publish(spark, root, thresholds(spark, 0.5, 0.6))
    assert current(spark, root) == first
    seen = []

    def slow(folder):
        thresholds(spark, 0.7, 0.8)(folder)
        seen.append(current(spark, root))   # a reader during the save
        assert spark.read.parquet(f"{seen[0]}/thresholds").first()["tau_cal"] == 0.5
    second = publish(spark, root, slow)
    assert seen == [first] and current(spark, root) == second

    def broken(folder):
        thresholds(spark, 0.1, 0.2)(folder)
        raise OSError("lost")
    with pytest.raises(OSError):
        publish(spark, root, broken)
    assert current(spark, root) == second
    assert spark.read.parquet(f"{second}/thresholds").first()["tau_cal"] == 0.7


def test_publishers_that_meet_take_different_numbers(spark):
    root = scratch_path(spark, "published")

    def meanwhile(folder):
        thresholds(spark, 0.1, 0.2)(folder)
        publish(spark, root, thresholds(spark, 0.3, 0.4))
    last = publish(spark, root, meanwhile)
    assert current(spark, root) == last


def test_redelivery_is_decided_once_and_new_thresholds_count_from_the_next_batch(spark, tmp_path):
    root, source, sink = scratch_path(spark, "published"), str(tmp_path / "in"), str(tmp_path / "out")
    publish(spark, root, thresholds(spark, 0.5, 0.9))

    def decide(batch):
        tau = spark.read.parquet(f"{current(spark, root)}/thresholds").first()
        return batch.select("email_id", "p", policy_tiers(F.col("p"), F.lit(tau["tau_cal"]), F.lit(tau["tau_block"])).alias("action"))

    def deliver(rows):
        spark.createDataFrame(rows, "email_id long, p double").coalesce(1).write.mode("append").parquet(source)
        stream = with_arrival(stream_emails(spark, source, "email_id long, p double"))
        q = route_once(spark, stream, decide, sink, checkpoint_dir=str(tmp_path / "ckpt"))
        q.awaitTermination()
        assert q.exception() is None
        return {r["email_id"]: r["action"] for r in spark.read.parquet(sink).collect()}, spark.read.parquet(sink).count()
    rows = [(i, i / 10) for i in range(10)]
    first, n = deliver(rows)
    assert n == 10 and first == {i: "BLOCK" if i == 9 else "MONITOR" if i >= 5 else "ALLOW" for i in range(10)}
    publish(spark, root, thresholds(spark, 0.2, 0.3))
    second, n = deliver([(3, 0.3), (9, 0.9), (20, 0.25), (21, 0.1), (21, 0.1)])   # 3 and 9 come again, 21 twice
    assert n == 12 and {k: second[k] for k in first} == first
    assert second[20] == "MONITOR" and second[21] == "ALLOW"


def test_mail_is_scored_from_a_model_folder_alike_in_batch_and_stream(spark):
    _, folder, tables = train_and_save(spark, SF001, 1)
    scorer = PublishedScorer(spark, folder, keep=("email_id", "y"))
    vec = table(spark, SF001, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    mail = emails(spark, SF001).select("email_id", "y", "raw_text").join(vec, "email_id", "left")
    batch = sorted(tuple(r) for r in scorer(mail).collect())
    assert len(batch) == tables["emails"].count()
    cols = scorer(mail).columns
    streamed = run_to_completion(spark, mail.union(mail.limit(5)), scorer, "test-fitted").select(*cols)
    assert sorted(tuple(r) for r in streamed.collect()) == batch
    bare = PublishedScorer(spark, folder)(mail.select("email_id", "raw_text").limit(3))
    assert bare.count() == 3 and "y" not in bare.columns
