import pyarrow as pa
import uuid

from pyspark.sql import functions as F

from hookline.operators.vocab import encode_sequences, pad_to
from hookline.session import scratch_path
from hookline.sources import csv as C


def write_text(path, text):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-0.csv", "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def local(spark, name):
    p = scratch_path(spark, name)
    return p[len("file:"):] if p.startswith("file:") else p


def test_tolerant_reader_rules(spark):
    path = write_text(local(spark, "ragged"), 'a,b,c\n1,2,3\n1,2\n1,2,3,4\n1,2,3,4,5\n1,2,3,\n"q,\nx",,z\n')
    rows = [tuple(r) for r in C.read_csv_tolerant(spark, path).collect()]
    assert sorted(rows, key=str) == sorted([("1", "2", "3"), ("1", "2", None), ("q,\nx", None, "z")], key=str)


def test_schema_dispatch_and_missing_label(spark):
    a = write_text(local(spark, "a"), "Subject,Body,Label\nHi, there,1\n,only body,ham\nx,y,1.0\n")
    c = write_text(local(spark, "c"), "Email Text,Email Type\nwin money,Phishing Email\nhello,Safe Email\n")
    b = write_text(local(spark, "b"), "body\nplain text\n")
    odd = write_text(local(spark, "odd"), "message,verdict\nx,1\n")
    got = {(r["text"], r["y"]) for p in (a, c, b, odd) for r in C.load_one(spark, p).collect()}
    assert got == {("Hi  there", 1), ("only body", 0), ("win money", 1), ("hello", 0), ("plain text", 0)}


def test_merge_skips_missing_and_blank(spark):
    a = write_text(local(spark, "m"), "Email Text,Email Type\nThe and of,spam\nBuy now!!,spam\n")
    m = C.load_sources(spark, [a, a + "-missing-" + uuid.uuid4().hex]).collect()
    assert [(r["text"], r["y"]) for r in m] == [("buy now", 1)]


def test_feature_table_numeric_detection(spark):
    p = write_text(local(spark, "ft"), "FILENAME,URL,A,B,Title,C,label\nf,u,1,x,t,,1\ng,v,2.5,3,t,4,0\n")
    ft = C.load_feature_table(spark, p)
    assert ft.columns == ["A", "C", "y"]
    assert sorted(tuple(r) for r in ft.collect()) == [(1.0, 0.0, 1), (2.5, 4.0, 0)]


def test_encode_sequences(spark):
    vocab = spark.createDataFrame([("known", 5, 2), ("word", 3, 3)], "token string, freq long, token_id int")
    toks = spark.createDataFrame([(1, []), (2, ["known", "zzz", "word"]), (3, ["known"] * 300)],
                                 "doc_id long, tokens array<string>")
    got = {r["doc_id"]: r["ids"] for r in encode_sequences(toks, "doc_id", vocab).collect()}
    assert got[1] == [0] * 256
    assert got[2] == [2, 1, 3] + [0] * 253
    assert got[3] == [2] * 256
    assert spark.range(1).select(pad_to(F.array(F.lit(7)), 3).alias("x")).first()["x"] == [7, 0, 0]


def test_five_hundred_files_are_three_scans(spark, tmp_path):
    """Plan size follows layouts, not files; rows keep their file's source; odd files are left out."""
    from hookline.sources import csv as C
    paths = []
    for i in range(500):
        head, row = [("subject,body,label", f"s{i},text of mail {i},spam"), (" Email Text ,EMAIL TYPE", f'"mail {i}, quoted",ham'),
                     ("Body,Category,extra", f"only body {i},1,x\nlong row,1,x,y\nshort {i}")][i % 3]
        p = tmp_path / f"f{i}.csv"
        p.write_text(f"{head}\n{row}\n")
        paths.append(str(p))
    for name, text in (("odd.csv", "message,verdict\na,b\n"), ("empty.csv", ""), ("twice.csv", "body,BODY\na,b\n"), ("head.csv", "body,label")):
        (tmp_path / name).write_text(text)
        paths.append(str(tmp_path / name))
    folder = tmp_path / "source=many"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.csv").write_text(f"body,label\nin a folder {i},0\n")
    d = C.dispatch_files(spark, [*paths, str(folder), str(tmp_path / "missing.csv")])
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 4   # three layouts, and that of the folder
    got = {(r["source"], r["text"], r["y"]) for r in d.collect()}
    want = set()
    for i in range(500):
        want |= [{(f"f{i}.csv", f"s{i} text of mail {i}", 1)}, {(f"f{i}.csv", f"mail {i}, quoted", 0)},
                 {(f"f{i}.csv", f"only body {i}", 1)}][i % 3]   # a row without a label is dropped
    want |= {("many", f"in a folder {i}", 0) for i in range(3)}
    assert got == want
    assert C.dispatch_files(spark, [str(tmp_path / "missing.csv")]).count() == 0
    assert C.load_sources(spark, [str(tmp_path / "odd.csv")]).columns == ["text", "y", "source"]


def test_headers_by_a_spark_scan_equal_those_read_by_tasks(spark, tmp_path, monkeypatch):
    from hookline.sources import csv as C
    (tmp_path / "a.csv").write_text('x,"y z"\n1,2\n')
    uris = list(C.list_files(spark, [str(tmp_path / "a.csv")]))
    by_task = C.headers_of(spark, uris)
    monkeypatch.setattr(C, "_first_line", lambda batches: (pa.RecordBatch.from_arrays(
        [b.column("uri"), pa.nulls(b.num_rows, pa.string())], ["uri", "line"]) for b in batches))
    assert C.headers_of(spark, uris) == by_task == {uris[0]: ("x", "y z")}


def test_only_the_head_of_a_row_reaches_python(spark):
    from hookline.operators.vocab import attach_sequences
    vocab = spark.createDataFrame([("known", 5, 2)], "token string, freq long, token_id int")
    rows = spark.createDataFrame([(1, None, "kept"), (2, ["zzz"] + ["known"] * 999, None)], "doc_id long, tokens array<string>, other string")
    got = attach_sequences(rows, vocab, length=3)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, None, "kept", [0, 0, 0]), (2, ["zzz"] + ["known"] * 999, None, [1, 2, 2])]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "slice(tokens" in plan.split("ArrowEvalPython")[1].split("\n")[0]
