"""CSV corpora written from the driver's tables, for the CSV readers to read back.

Nothing here is made up: every row is an email of the ``emails`` view (or a
page of ``pages``); only the file layout and the label spelling vary, by fixed
rules of the email id, so the readers see every schema and label form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import FEATURES_54, parts_of
from ..session import scratch_path
from .csv import write_csv
from .tables import emails, table

# ---- fixed values: label spellings written to the CSV corpora ----
PHISH_SPELLINGS = ("Phishing Email", "spam", "1", "phishing", " SPAM ", "01")
LEGIT_SPELLINGS = ("Safe Email", "ham", "0", "legit", "safe", "legitimate", " ham ", "00")
INVALID_SPELLINGS = ("1.0", "-1", "true", "2", None, "unknown")

# Source number ranges of each file layout (sources are named src0 .. src19).
LAYOUTS = (("A", 0, 5), ("B", 6, 11), ("C", 12, 16), ("body", 17, 18), ("odd", 19, 19))


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (idx + 1).cast("int"))


def raw_label(email_id: Column, y: Column) -> Column:
    return (F.when(email_id % 10 == 9, _pick(INVALID_SPELLINGS, F.floor(email_id / 10) % len(INVALID_SPELLINGS)))
             .when(y == 1, _pick(PHISH_SPELLINGS, email_id % len(PHISH_SPELLINGS)))
             .otherwise(_pick(LEGIT_SPELLINGS, email_id % len(LEGIT_SPELLINGS))))


def source_number(source: Column) -> Column:
    return F.substring(source, 4, 8).try_cast("int")


def labelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emails(spark, sf_dir)
    subject = F.substring_index(F.col("raw_text"), "\n", 1)
    return e.select("email_id", "source", source_number(F.col("source")).alias("src_no"), "raw_text",
                    subject.alias("subject"),
                    F.col("raw_text").substr(F.length(subject) + 2, F.length("raw_text") + 1).alias("body"),
                    raw_label(F.col("email_id"), F.col("y")).alias("raw_label"))


def write_email_corpus(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """Write the labelled emails in five layouts, one folder per source; return (base, paths)."""
    base = scratch_path(spark, "email-corpus")
    p = labelled_parts(spark, sf_dir)
    in_range = (lambda lo, hi: F.col("src_no").between(lo, hi))
    sender = F.concat(F.lit("user"), F.col("email_id").cast("string"), F.lit("@example.org"))
    layouts = {
        "A": [sender.alias("sender"), F.lit("inbox@example.org").alias("receiver"), F.lit("2024-01-01").alias("date"),
              "subject", "body", F.lit("").alias("urls"), F.col("raw_label").alias("label")],
        "B": ["subject", "body", F.col("raw_label").alias("label")],
        "C": [F.col("raw_text").alias("Email Text"), F.col("raw_label").alias("Email Type")],
        "body": [F.col("raw_text").alias("Body"), F.col("raw_label").alias("Category")],
        "odd": [F.col("raw_text").alias("message"), F.col("raw_label").alias("verdict")],
    }
    paths = []
    for name, lo, hi in LAYOUTS:
        out = f"{base}/{name}"
        write_csv(p.where(in_range(lo, hi)).select("source", *layouts[name]), out, partition_by="source")
        paths += [f"{out}/source=src{i}" for i in range(lo, hi + 1)]
    return base, paths


def write_single_corpus(spark: SparkSession, sf_dir: str, text_header: str = "Email Text",
                        label_header: str = "Email Type") -> str:
    """All labelled emails in one two-column file with the given headers."""
    path = scratch_path(spark, "email-file")
    p = labelled_parts(spark, sf_dir)
    write_csv(p.select(F.col("raw_text").alias(text_header), F.col("raw_label").alias(label_header)), path)
    return path


def write_url_file(spark: SparkSession, sf_dir: str) -> str:
    """Pages as a URL CSV with word or number labels."""
    path = scratch_path(spark, "url-file")
    pages = table(spark, sf_dir, "pages")
    y = F.when(F.col("url").like("http://%") != ((F.col("page_id") % 10) == 0), 1).otherwise(0)
    word = F.when(F.col("page_id") % 4 == 0, F.when(y == 1, F.lit("phishing")).otherwise(F.lit("legit"))) \
            .otherwise(y.cast("string"))
    write_csv(pages.select(F.col("page_id").cast("string").alias("Index"), F.col("url").alias("URL"),
                           word.alias("Label")), path)
    return path


def write_ragged_file(spark: SparkSession, sf_dir: str) -> str:
    """Header ``a,b,c``; each page gives one line with 3, 2, 4 or 5 fields, or extra fields that are empty."""
    path = scratch_path(spark, "ragged")
    pages = table(spark, sf_dir, "pages").select("page_id")
    i = F.col("page_id").cast("string")
    r = F.col("page_id") % 5
    page_kind = F.floor(F.col("page_id") / 5) % 3
    line = (F.when(r == 0, F.concat_ws(",", i, F.lit("x"), F.lit("y")))
             .when(r == 1, F.concat_ws(",", i, F.lit("x")))
             .when(r == 2, F.concat_ws(",", i, F.lit("x"), F.lit("y"), F.lit("z")))
             .when(r == 3, F.concat_ws(",", i, F.lit("x"), F.lit("y"), F.lit("z"), F.lit("w")))
             .when(page_kind == 0, F.concat(i, F.lit(",x,y,")))
             .when(page_kind == 1, F.concat(i, F.lit(",x,y,,")))
             .otherwise(F.concat(i, F.lit(",x,y,,w"))))
    # one text column whose name is the header line, written as it stands: every part file begins with it
    plain = {"header": "true", "sep": "\u0001", "quote": "\u0000", "escapeQuotes": "false", "emptyValue": "",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    pages.select(line.alias("a,b,c")).write.mode("overwrite").options(**plain).csv(path)
    return path


def write_feature_table(spark: SparkSession, sf_dir: str) -> str:
    """Pages as a pre-computed URL feature table: metadata, numeric and one mixed column."""
    path = scratch_path(spark, "url-features")
    pages = table(spark, sf_dir, "pages")
    spec = {n: fn for n, fn, _ in FEATURES_54}
    p = pages.select("page_id", "url", "html", parts_of(F.col("url")).alias("p"))
    y = F.when(F.col("url").like("http://%") != ((F.col("page_id") % 10) == 0), 1).otherwise(0)
    title = F.regexp_extract(F.col("html"), "<title>([^<]*)</title>", 1)
    cols = [
        F.concat(F.col("page_id").cast("string"), F.lit(".txt")).alias("FILENAME"),
        F.col("url").alias("URL"),
        spec["url_len"](F.col("p")).cast("string").alias("URLLength"),
        F.col("p.host").alias("Domain"),
        spec["host_len"](F.col("p")).cast("string").alias("DomainLength"),
        spec["host_is_ip"](F.col("p")).cast("string").alias("IsDomainIP"),
        F.substring_index(F.col("p.nowww"), ".", -1).alias("TLD"),
        spec["n_subdomain"](F.col("p")).cast("string").alias("NoOfSubDomain"),
        spec["n_digit"](F.col("p")).cast("string").alias("NoOfDegitsInURL"),
        spec["n_equal"](F.col("p")).cast("string").alias("NoOfEqualsInURL"),
        spec["n_qmark"](F.col("p")).cast("string").alias("NoOfQMarkInURL"),
        spec["n_amp"](F.col("p")).cast("string").alias("NoOfAmpersandInURL"),
        spec["is_https"](F.col("p")).cast("string").alias("IsHTTPS"),
        (F.size(F.split(F.col("html"), "\n"))).cast("string").alias("LineOfCode"),
        F.when(F.col("page_id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.length("html").cast("string")).alias("LargestLineLength"),
        F.when(title != "", F.lit("1")).otherwise(F.lit("0")).alias("HasTitle"),
        title.alias("Title"),
        F.when(F.col("page_id") % 9 == 0, F.lit("yes")).otherwise(F.lit("1")).alias("Robots"),
        y.cast("string").alias("label"),
    ]
    write_csv(p.select(*cols), path)
    return path
