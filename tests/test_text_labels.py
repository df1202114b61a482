from pyspark.sql import functions as F

from hookline.functions.labels import label_v1_word, label_v2, url_label
from hookline.functions.text import clean_text, extract_urls, strip_ws, word_tokens

DEMO = ("Hello reader,\nthe parcel you ordered waits at our depot.\nPay the fee at:\n"
        "https://parcel-depot.example/pay?id=7\nRegards.")


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_clean_demo_email(spark):
    got = one(spark, clean_text(F.col("s")), "Notice: Parcel 42 waits! Pay: https://depot.example/pay?id=7")
    assert got == "notice parcel 42 waits pay httpsdepotexamplepayid7"


def test_clean_drops_short_and_stopwords(spark):
    assert one(spark, clean_text(F.col("s")), "A to be or x  The CAT\tsat") == "cat sat"
    assert one(spark, clean_text(F.col("s")), "") == ""


def test_extract_urls_order_case_and_punctuation(spark):
    got = one(spark, extract_urls(F.col("s")), "See HTTP://A.com/x, www.b.org and https://c.d/é?z=1")
    assert got == ["HTTP://A.com/x,", "www.b.org", "https://c.d/é?z=1"]


def test_urls_come_from_raw_text_not_cleaned_text(spark):
    # Cleaning removes "://" and "www." punctuation, so no URL survives it (the defect the build avoids).
    assert len(one(spark, extract_urls(F.col("s")), DEMO)) == 1
    assert one(spark, extract_urls(clean_text(F.col("s"))), DEMO) == []


def test_word_tokens_unicode(spark):
    assert one(spark, word_tokens(F.col("s")), "Éa b_c x 42 naïve") == ["éa", "b_c", "42", "naïve"]


def test_strip_unicode_whitespace(spark):
    assert one(spark, strip_ws(F.col("s")), "  ab c　\n") == "ab c"


LABELS_V2 = {"Phishing Email": 1, "Safe Email": 0, "phishing": 1, "spam": 1, "1": 1, "ham": 0, "safe": 0,
             "legit": 0, "0": 0, "legitimate": 0, " ham ": 0, "01": 1, "00": 0, "1.0": None, "-1": None,
             "true": None, "2": None, None: None}
LABELS_V1 = {"Phishing Email": "phishing", "Safe Email": "safe email", "spam": "phishing", "1": "phishing",
             "ham": "legit", "0": "legit", "legitimate": "legitimate", " ham ": " ham ", "01": "01"}


def test_label_truth_table_v2(spark):
    rows = spark.createDataFrame([(k,) for k in LABELS_V2], "raw string").select("raw", label_v2(F.col("raw")).alias("y")).collect()
    assert {r["raw"]: r["y"] for r in rows} == LABELS_V2


def test_label_rule_v1(spark):
    rows = spark.createDataFrame([(k,) for k in LABELS_V1], "raw string").select("raw", label_v1_word(F.col("raw")).alias("w")).collect()
    assert {r["raw"]: r["w"] for r in rows} == LABELS_V1


def test_url_labels(spark):
    vals = {"0": 0, "1": 1, "legit": 0, "Phishing": 1, "7": 7, "x": None}
    rows = spark.createDataFrame([(k,) for k in vals], "raw string").select("raw", url_label(F.col("raw")).alias("y")).collect()
    assert {r["raw"]: r["y"] for r in rows} == vals
