"""Fitted agents: partition-independent fits, missing embeddings, reload, stateless scoring of raw mail."""

import json
from dataclasses import dataclass

import pytest

from pyspark.sql import functions as F

from hookline.functions.constants import CAL_SHARE
from hookline.operators.email_urls import score_with_prior
from hookline.operators.models import EmbeddingAgent, LinearAgent, SequenceAgent, StackedAgent, TfidfAgent
from hookline.operators.vocab import attach_sequences
from hookline.plans.cv import cross_validate, featurise, load_fold, score_agents
from hookline.sources import csv as C
from hookline.streaming.route import route, stream_emails


def _ids(spark, n=60):
    rows = [(i, i % 2, [2 + (i * 7 + j * (1 + i % 2)) % 40 for j in range(12)]) for i in range(n)]
    return spark.createDataFrame(rows, "email_id long, y int, ids array<int>")


def test_sequence_agent_does_not_depend_on_input_partitions(spark, tmp_path):
    d = _ids(spark)
    make = (lambda: SequenceAgent(dim=8, hidden=4, partitions=2))
    a, b = make().fit(d.repartition(1)), make().fit(d.repartition(5, "y"))
    sa, sb = ({r.email_id: r.p for r in m.score(d, "p").collect()} for m in (a, b))
    assert all(0 <= p <= 1 for p in sa.values())
    assert max(abs(sa[i] - sb[i]) for i in sa) < 1e-3
    a.save(str(tmp_path / "m"))
    again = SequenceAgent.load(spark, str(tmp_path / "m"))
    assert {r.email_id: r.p for r in again.score(d, "p").collect()} == sa


def test_prior_of_a_clean_fit_set_is_zero_and_no_embedding_is_defined(spark, tmp_path):
    d = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, None, 0), (3, [0.5, 1.0], 0)], "email_id int, embedding array<float>, y int")
    a = EmbeddingAgent().fit(d)
    assert a.prior == 0.0
    none = EmbeddingAgent().fit(d.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("y", F.col("email_id") % 2))
    none.save(str(tmp_path / "e"))
    again = EmbeddingAgent.load(spark, str(tmp_path / "e"))
    assert {round(r.p, 6) for r in again.score(d, "p").collect()} == {round(2 / 3, 6)}


def test_tfidf_agent_vocabulary_ties_and_reload(spark, tmp_path):
    rows = [(i, i % 2, ["common", f"odd{i % 7}" if i % 2 else f"even{i % 5}", f"rare{i}"]) for i in range(40)]
    d = spark.createDataFrame(rows, "email_id long, y int, terms array<string>")
    from hookline.operators.tfidf import fit_tfidf_vectors
    vocabs = [fit_tfidf_vectors(d.repartition(n), "terms", "v", k=20).stages[0].vocabulary for n in (1, 4)]
    assert vocabs[0] == vocabs[1] and vocabs[0][0] == "common" and vocabs[0][-1] == "rare14"
    a = TfidfAgent().fit(d)
    want = {r.email_id: r.p for r in a.score(d, "p").collect()}
    assert all(0 <= p <= 1 for p in want.values())
    a.save(str(tmp_path / "t"))
    again = TfidfAgent.load(spark, str(tmp_path / "t"))
    assert {r.email_id: r.p for r in again.score(d, "p").collect()} == want


def test_terms_are_made_in_the_row_and_never_kept(spark, monkeypatch, tmp_path):
    """Neither a cache nor a table holds term arrays; the model is that of the plain stages."""
    from conftest import SF001
    from pyspark.ml import Pipeline
    from hookline.operators.models import lr, positive_probability
    from hookline.operators.tfidf import fit_tfidf_vectors
    from hookline.plans import q_models
    rows = [(i, i % 2, ["common", "common", f"odd{i % 7}" if i % 2 else f"even{i % 5}", f"w{i % 3}"]) for i in range(60)]
    d = spark.createDataFrame(rows, "email_id long, y int, terms array<string>")
    stages = fit_tfidf_vectors(d, "terms", "features")
    x = stages.transform(d).withColumn("label", F.col("y").cast("double"))
    plain = positive_probability(Pipeline(stages=[lr(60)]).fit(x).transform(x), "p")

    def persist(self, *a):
        raise AssertionError(f"cached: {self.columns}")
    monkeypatch.setattr(type(d), "persist", persist)
    got = {r.email_id: r.p for r in TfidfAgent().fit(d).score(d, "p").collect()}
    assert got == pytest.approx({r.email_id: r.p for r in plain.collect()}, abs=1e-5)

    monkeypatch.setattr(q_models, "scratch_path", lambda _, name: str(tmp_path / name))
    assert q_models.ml_stacked_score(spark, SF001).count() == q_models.ml_surface_score(spark, SF001).count() > 0
    for at in (tmp_path / "stacked" / "rows", tmp_path / "surface"):
        kept = spark.read.parquet(str(at))
        assert "raw_text" in kept.columns and "array<string>" not in dict(kept.dtypes).values()


def test_strict_reader_rejects_and_tolerant_reader_skips_extra_fields(spark, tmp_path):
    import pytest
    good = ["1,2,3", "1,2", '1,"a,b",3', '1,"say ""x,y""",3', "1,,"]
    bad = ["2,2,3,4", "2,2,3,", "2,2,3,4,5", "2,2,3,,5", "2,2,3,,", "2,2,3,4,5,6", "2,2,3,,,6", "2,2,3,,,"]
    for i, line in enumerate([None, *bad]):
        p = tmp_path / f"f{i}.csv"
        p.write_text("\n".join(["a,b,c", *good, *([line] if line else [])]) + "\n")
        assert [r.a for r in C.read_csv_tolerant(spark, str(p)).collect()] == ["1"] * 5
        if line is None:
            assert [r.b for r in C.read_csv_strings(spark, str(p)).collect()] == ["2", "2", "a,b", 'say "x,y"', None]
        else:
            with pytest.raises(Exception, match="more than 3 fields"):
                C.read_csv_strings(spark, str(p)).select("b").collect()


def test_raw_mail_is_scored_in_stream_without_state(spark, tmp_path):
    rows = [(i, i % 2, f"hello number{i} please see http://host{i}.example.com/a?b={i} and reply") for i in range(30)]
    mail = spark.createDataFrame(rows, "email_id long, y int, raw_text string")
    vocab = spark.createDataFrame([("hello", 2), ("reply", 3)], "token string, token_id int")

    def scored(df):
        x = attach_sequences(featurise(df, ("email_id", "y")), vocab)
        return x.select("email_id", F.size(F.filter("ids", lambda i: i > 1)).alias("known"), "n_urls",
                        F.lit("ALLOW").alias("action"))
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    mail.repartition(2).write.parquet(source)
    once = [tuple(r) for r in scored(mail).orderBy("email_id").collect()]
    for expected in (30, 31):  # an email that is delivered again gives one more row
        q = route(spark, stream_emails(spark, source, mail.schema), scored, sink, str(tmp_path / "ckpt"))
        q.awaitTermination()
        assert not any(json.loads(p.json)["stateOperators"] if hasattr(p, "json") else p["stateOperators"]
                       for p in q.recentProgress)
        got = spark.read.parquet(sink)
        assert got.count() == expected
        assert [tuple(r) for r in got.distinct().select("email_id", "known", "n_urls", "action").orderBy("email_id").collect()] == once
        mail.where("email_id = 3").write.mode("append").parquet(source)


def test_stacked_agent_reload_scores_alike(spark, tmp_path):
    rows = [(i, i % 2, [float(i % 2), 0.3 * (i % 5)], ["common", f"odd{i % 7}" if i % 2 else f"even{i % 5}"], float(i % 2 + i % 3))
            for i in range(60)]
    d = spark.createDataFrame(rows, "email_id long, y int, embedding array<double>, terms array<string>, u double")
    a = StackedAgent(LinearAgent(["u"], scale=False).fit(d)).fit(d)
    s = a.score(d)
    assert s.columns == [*d.columns, "risk_score"]
    want = {r.email_id: r.risk_score for r in s.collect()}
    assert all(0 <= p <= 1 for p in want.values())
    assert min(want[i] for i in range(1, 60, 2)) > max(want[i] for i in range(0, 60, 2))
    a.save(str(tmp_path / "s"))
    assert {r.email_id: r.risk_score for r in StackedAgent.load(spark, str(tmp_path / "s")).score(d).collect()} == want


def test_vector_is_brought_to_the_width_of_the_model(spark):
    train = spark.createDataFrame([(float(i % 2), float(i % 3), float(i), i % 2) for i in range(30)], "a double, b double, c double, y int")
    d = spark.createDataFrame([(1, 1, 1.0, 2.0), (2, 0, 0.0, 0.0)], "email_id int, n_urls int, x double, z double")
    wide, narrow = LinearAgent(["a", "b", "c"]).fit(train), LinearAgent(["a"]).fit(train)
    got = {r.email_id: r.p_lexical for r in score_with_prior(wide, d, ["x", "z"]).collect()}
    want = wide.score(spark.createDataFrame([(1.0, 2.0, 0.0)], "a double, b double, c double"), "p").first().p
    assert got == {1: want, 2: 0.5}
    got = {r.email_id: r.p_lexical for r in score_with_prior(narrow, d, ["x", "z"]).collect()}
    assert got == {1: narrow.score(spark.createDataFrame([(1.0,)], "a double"), "p").first().p, 2: 0.5}


def test_feature_table_labels(spark, tmp_path):
    import pytest
    p = tmp_path / "f.csv"
    p.write_text("FILENAME,x,label\na,1,0\nb,2,1\n")
    assert [(r.x, r.y) for r in C.load_feature_table(spark, str(p)).collect()] == [(1.0, 0), (2.0, 1)]
    assert [r.y for r in C.load_feature_table(spark, str(p), positive_label=0).collect()] == [1, 0]
    p.write_text("FILENAME,x,label\na,1,0\nb,2,\n")
    with pytest.raises(Exception, match="no whole number"):
        C.load_feature_table(spark, str(p)).collect()


def test_cross_validation_counts_decisions_and_reload(spark, tmp_path):
    from conftest import SF001
    r = cross_validate(spark, SF001, k=2, save_dir=str(tmp_path / "cv"))
    ef = r["tables"]["emails"]
    rows = [x.asDict() for x in ef.select("email_id", "y", "fold", "cal_1", "cal_2").collect()]
    for f in (1, 2):   # test rows have no flag; floor(CAL_SHARE) of the rest calibrate
        train = [x for x in rows if x["fold"] != f]
        assert all(x[f"cal_{f}"] is None for x in rows if x["fold"] == f)
        assert sum(x[f"cal_{f}"] for x in train) == int(CAL_SHARE * len(train))
    m = {x["fold"]: x for x in r["fold_metrics"].collect()}
    dec = [x.asDict() for x in r["decided"].collect()]
    assert sorted(x["email_id"] for x in dec) == sorted(x["email_id"] for x in rows)
    assert all(0 <= x[c] <= 1 for x in dec for c in ("p_semantic", "p_textual", "p_lexical", "p_fused"))
    for f in (1, 2):
        mine = [x for x in dec if x["fold"] == f]
        assert m[f]["TP"] == sum(x["y"] == 1 and x["p_fused"] >= x["tau_cal"] for x in mine)
        assert m[f]["FP"] == sum(x["y"] == 0 and x["p_fused"] >= x["tau_cal"] for x in mine)
        assert m[f]["TP"] + m[f]["FP"] + m[f]["TN"] + m[f]["FN"] == len(mine)
    want = {x["email_id"]: x["p_fused"] for x in dec if x["fold"] == 2}
    again = score_agents(ef.where("fold = 2"), load_fold(spark, str(tmp_path / "cv"), 2))
    assert {x.email_id: x.p_fused for x in again.collect()} == want


def test_fold_run_query(spark):
    """One row a fold whose counts cover the fold's test rows and whose rates follow from them."""
    import __spark_entry__ as entry
    from conftest import SF001
    from hookline.operators.folds import stratified_folds
    from hookline.sources.tables import emails
    sizes = {(r["fold"], r["y"]): r["count"] for r in stratified_folds(emails(spark, SF001)).groupBy("fold", "y").count().collect()}
    got = {r["fold"]: r for r in entry.queries()["ml_fold_run"](spark, SF001).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for f, r in got.items():
        assert r["TP"] + r["FN"] == sizes[f, 1] and r["FP"] + r["TN"] == sizes[f, 0]
        n, flagged = sizes[f, 0] + sizes[f, 1], r["TP"] + r["FP"]
        assert r["accuracy"] == pytest.approx((r["TP"] + r["TN"]) / n, abs=1e-4)
        assert r["precision"] == pytest.approx(r["TP"] / flagged if flagged else 0, abs=1e-4)
        assert r["recall"] == pytest.approx(r["TP"] / sizes[f, 1], abs=1e-4) and 0 <= r["auc"] <= 1


def test_classes_that_differ_in_word_order_alone_are_learned(spark):
    import random
    rng = random.Random(9)

    def mail(i):
        ids = []
        for _ in range(12):
            a = rng.randrange(2, 22, 2)
            ids += [a, a + 1] if i % 2 else [a + 1, a]
        return i, i % 2, ids
    rows = [mail(i) for i in range(400)]
    d = spark.createDataFrame(rows, "email_id long, y int, ids array<int>")
    agent = SequenceAgent(dim=32, hidden=16).fit(d.where("email_id < 300"))
    got = agent.score(d.where("email_id >= 300"), "p").collect()
    assert sum((r.p >= 0.5) == (r.y == 1) for r in got) >= 0.9 * len(got)


def test_sequence_agent_fits_on_a_bounded_choice_of_rows(spark):
    rows = [(i, float(i % 2), [f"w{i}", f"w{i * 7 % 300}"]) for i in range(3000)]
    d = spark.createDataFrame(rows, "id long, label double, _words array<string>")
    pick = (lambda n, cap: sorted(r.id for r in SequenceAgent(max_rows=cap)._chosen(d.repartition(n)).collect()))
    few = pick(1, 500)
    assert 400 < len(few) < 600 and few == pick(5, 500)
    assert pick(2, 3000) == list(range(3000))


def _spying_agent(seen):
    """A small agent that would train on 10 rows if a query left the choice to it; notes (rows given, rows trained on)."""
    @dataclass
    class Spy(SequenceAgent):
        dim: int = 8
        hidden: int = 4
        max_iter: int = 5
        max_rows: int | None = 10

        def _chosen(self, train):
            rows = super()._chosen(train)
            seen.append((train.count(), rows.count()))
            return rows
    return Spy


def test_textual_score_trains_on_all_rows(spark, monkeypatch):
    from conftest import SF001
    from hookline.plans import q_models
    from hookline.sources.tables import emails
    seen = []
    monkeypatch.setattr(q_models, "SequenceAgent", _spying_agent(seen))
    n = emails(spark, SF001).count()
    assert n > 10 and q_models.ml_textual_score(spark, SF001).count() == n
    assert seen == [(n, n)]


def test_agents_of_a_fold_train_on_all_its_fit_rows(spark, monkeypatch):
    """What cross-validation and every query with a published model fit with."""
    from conftest import SF001
    from hookline.plans import cv
    seen = []
    monkeypatch.setattr(cv, "SequenceAgent", _spying_agent(seen))
    t = cv.feature_tables(spark, SF001)
    n = t["emails"].where(~F.col(cv.cal_flag(2))).count()
    cv.fit_agents(t, [2])
    assert n > 10 and seen == [(n, n)]


def test_a_fit_on_all_rows_has_more_tasks_for_more_rows(spark):
    rows = [(i, float(i % 2), [f"w{i}", f"w{i * 7 % 300}"]) for i in range(3000)]
    d = spark.createDataFrame(rows, "id long, label double, _words array<string>")
    a = SequenceAgent(max_rows=None)
    assert sorted(r.id for r in a._chosen(d).collect()) == list(range(3000))
    for n in (1, 68_000, 200_000, 1_200_000, 50_000_000):
        assert n / a._partitions(n) <= a.task_rows
    assert [a._partitions(n) for n in (0, 400, 100_000, 200_000)] == [SequenceAgent()._partitions(n) for n in (0, 400, 100_000, 200_000)]


def test_sequence_agent_trains_a_bounded_number_of_rows_a_task(spark, tmp_path):
    a = SequenceAgent()
    assert [a._partitions(n) for n in (0, 400, 4 * a.task_rows)] == [a.partitions] * 3
    for n in (100_000, 200_000, 1_200_000):
        assert min(n, a.max_rows) / a._partitions(n) <= a.task_rows
    assert a._partitions(1_200_000) == a._partitions(a.max_rows)
    d = _ids(spark, 120)
    small = SequenceAgent(dim=8, hidden=4, partitions=2, task_rows=20).fit(d.repartition(3))
    w2v, _ = small.model.stages
    assert w2v.getNumPartitions() == 6
    assert all(0 <= r.p <= 1 for r in small.score(d, "p").collect())
    small.save(str(tmp_path / "m"))
    again = SequenceAgent.load(spark, str(tmp_path / "m")).score(d, "p").collect()
    assert {r.email_id: r.p for r in again} == {r.email_id: r.p for r in small.score(d, "p").collect()}
