"""Catalog entries: CSV sources, header/label rules, projections and filters, source merge."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FEATURE_TABLE_DROP, LABEL_WORDS, LABEL_WORDS_V1, URL_LABEL_WORDS
from ..functions.labels import label_v1_word, label_v2, label_word_to_int, url_label
from ..functions.text import WS_RUN, clean_text, compose_text, strip_ws
from ..session import scratch_path
from ..sources import csv as C
from ..sources import fixtures as X
from ..sources.tables import table
from . import oracle_sql as O
from .registry import register


def _arr(values) -> str:
    return "[" + ", ".join("NULL" if v is None else O.lit(v) for v in values) + "]"


RAW_LABEL_SQL = (f"CASE WHEN email_id % 10 = 9 THEN {_arr(X.INVALID_SPELLINGS)}[(email_id // 10) % {len(X.INVALID_SPELLINGS)} + 1]"
                 f" WHEN y = 1 THEN {_arr(X.PHISH_SPELLINGS)}[email_id % {len(X.PHISH_SPELLINGS)} + 1]"
                 f" ELSE {_arr(X.LEGIT_SPELLINGS)}[email_id % {len(X.LEGIT_SPELLINGS)} + 1] END")
PARTS_CTE = O.EMAILS_CTE + f""",
parts AS (SELECT email_id, source, CAST(substr(source, 4, 8) AS INTEGER) AS src_no, raw_text,
                 split_part(raw_text, chr(10), 1) AS subject,
                 substr(raw_text, length(split_part(raw_text, chr(10), 1)) + 2) AS body,
                 {RAW_LABEL_SQL} AS raw_label
          FROM emails)"""


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {O.lit('^' + WS_RUN + '|' + WS_RUN + '$')}, '', 'g')"


def label_v2_sql(x: str) -> str:
    v = f"lower({strip_sql(x)})"
    cases = " ".join(f"WHEN {O.lit(k)} THEN {val}" for k, val in LABEL_WORDS.items())
    return (f"CAST(coalesce(CASE {v} {cases} END, CASE WHEN regexp_matches({v}, '^-?[0-9]+$') "
            f"AND TRY_CAST({v} AS BIGINT) IN (0, 1) THEN TRY_CAST({v} AS BIGINT) END) AS INTEGER)")


def label_v1_sql(x: str) -> str:
    cases = " ".join(f"WHEN {O.lit(k)} THEN {O.lit(val)}" for k, val in LABEL_WORDS_V1.items())
    return f"coalesce(CASE lower({x}) {cases} END, lower({x}))"


def layout_text_sql() -> str:
    return ("CASE WHEN src_no <= 11 THEN " + strip_sql("concat(subject, ' ', body)") +
            " ELSE raw_text END")


LAYOUT_SQL = "CASE WHEN src_no <= 5 THEN 'A' WHEN src_no <= 11 THEN 'B' WHEN src_no <= 16 THEN 'C' WHEN src_no <= 18 THEN 'body' END"
DISPATCH_CTE = PARTS_CTE + f""",
disp AS (SELECT source, {LAYOUT_SQL} AS layout, {layout_text_sql()} AS text, {label_v2_sql('raw_label')} AS y
         FROM parts WHERE src_no <= 18)"""


def _dispatched(spark, paths: list[str]) -> DataFrame:
    layout = F.element_at(F.split("file", "/"), -3)   # <layout>/source=<name>/<file>
    return C.dispatch_files(spark, paths).select("source", layout.alias("layout"), "text", "y")


def _corpus(spark, sf_dir):
    base, paths = X.write_email_corpus(spark, sf_dir)
    return base, paths


@register("src_email_csv", O.with_ctes(PARTS_CTE) + f"""
SELECT {O.clean_text_sql('raw_text')} AS text, {label_v2_sql('raw_label')} AS y FROM parts
WHERE {label_v2_sql('raw_label')} IS NOT NULL""")
def src_email_csv(spark, sf_dir):
    return C.load_email_file(spark, X.write_single_corpus(spark, sf_dir))


@register("src_url_csv", O.with_ctes(O.URLS_CTE) + "SELECT url, y FROM urls")
def src_url_csv(spark, sf_dir):
    return C.load_url_file(spark, X.write_url_file(spark, sf_dir))


@register("proj_url_label", O.with_ctes(O.URLS_CTE) + """
SELECT url_id, CASE WHEN url_id % 4 = 0 THEN CASE WHEN y = 1 THEN 'phishing' ELSE 'legit' END ELSE CAST(y AS VARCHAR) END AS label, y FROM urls""")
def proj_url_label(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    y = F.when(F.col("url").like("http://%") != ((F.col("page_id") % 10) == 0), 1).otherwise(0)
    word = F.when(F.col("page_id") % 4 == 0, F.when(y == 1, F.lit("phishing")).otherwise(F.lit("legit"))) \
            .otherwise(y.cast("string"))
    return pages.select(F.col("page_id").alias("url_id"), word.alias("label")) \
                .select("url_id", "label", url_label(F.col("label")).alias("y"))


@register("src_csv_tolerant", """SELECT CAST(page_id AS VARCHAR) AS a, 'x' AS b, CASE WHEN page_id % 5 = 0 THEN 'y' END AS c
FROM pages WHERE page_id % 5 IN (0, 1)""")
def src_csv_tolerant(spark, sf_dir):
    return C.read_csv_tolerant(spark, X.write_ragged_file(spark, sf_dir))


@register("src_schema_dispatch", O.with_ctes(DISPATCH_CTE) + "SELECT source, layout, text, y FROM disp WHERE y IS NOT NULL")
def src_schema_dispatch(spark, sf_dir):
    _, paths = _corpus(spark, sf_dir)
    return _dispatched(spark, paths)


@register("set_union_sources", O.with_ctes(DISPATCH_CTE) + "SELECT source, text, y FROM disp WHERE y IS NOT NULL")
def set_union_sources(spark, sf_dir):
    _, paths = _corpus(spark, sf_dir)
    return _dispatched(spark, paths).drop("layout")


@register("filt_dropna_any", O.with_ctes(DISPATCH_CTE) + "SELECT source, text, y FROM disp WHERE y IS NOT NULL AND text IS NOT NULL")
def filt_dropna_any(spark, sf_dir):
    _, paths = _corpus(spark, sf_dir)
    return _dispatched(spark, paths).drop("layout").dropna(how="any")


_MERGED_CTE = DISPATCH_CTE + f""",
merged AS (SELECT source, {O.clean_text_sql('text')} AS text, y FROM disp WHERE y IS NOT NULL AND text IS NOT NULL),
kept AS (SELECT * FROM merged WHERE {strip_sql('text')} <> '')"""


@register("src_merge_sources", O.with_ctes(_MERGED_CTE) + "SELECT source, text, y FROM kept")
def src_merge_sources(spark, sf_dir):
    base, paths = _corpus(spark, sf_dir)
    return C.load_sources(spark, paths + [f"{base}/missing-source"]).select("source", "text", "y")


@register("agg_class_counts", O.with_ctes(_MERGED_CTE) + """
SELECT source, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(y) AS BIGINT) AS n_phishing,
       CAST(sum(1 - y) AS BIGINT) AS n_legit FROM kept GROUP BY source""")
def agg_class_counts(spark, sf_dir):
    base, paths = _corpus(spark, sf_dir)
    m = C.load_sources(spark, paths)
    return m.groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                   F.sum("y").cast("bigint").alias("n_phishing"),
                                   F.sum(1 - F.col("y")).cast("bigint").alias("n_legit"))


@register("src_header_normalise", O.with_ctes(PARTS_CTE) + 'SELECT raw_text AS "email text", raw_label AS "email type" FROM parts')
def src_header_normalise(spark, sf_dir):
    path = X.write_single_corpus(spark, sf_dir, "  Email Text ", "EMAIL TYPE  ")
    return C.normalise_header(C.read_csv_strings(spark, path))


@register("src_column_discovery", O.with_ctes(PARTS_CTE) + "SELECT raw_text AS text, raw_label AS label FROM parts")
def src_column_discovery(spark, sf_dir):
    path = X.write_single_corpus(spark, sf_dir, "Message Body", "Spam Label Type")
    return C.select_text_label(C.normalise_header(C.read_csv_strings(spark, path)))


@register("proj_text_label", O.with_ctes(PARTS_CTE) + "SELECT raw_text AS text, raw_label AS label FROM parts")
def proj_text_label(spark, sf_dir):
    return C.select_text_label(C.normalise_header(C.read_csv_strings(spark, X.write_single_corpus(spark, sf_dir))))


@register("proj_compose_text", O.with_ctes(PARTS_CTE) + f"SELECT email_id, {strip_sql('concat(subject, chr(32), body)')} AS text FROM parts")
def proj_compose_text(spark, sf_dir):
    p = X.labelled_parts(spark, sf_dir)
    return p.select("email_id", compose_text(F.col("subject"), F.col("body")).alias("text"))


@register("proj_label_v1", O.with_ctes(PARTS_CTE) + f"SELECT email_id, raw_label, {label_v1_sql('raw_label')} AS label FROM parts")
def proj_label_v1(spark, sf_dir):
    p = X.labelled_parts(spark, sf_dir)
    return p.select("email_id", "raw_label", label_v1_word(F.col("raw_label")).alias("label"))


@register("proj_label_to_int", O.with_ctes(PARTS_CTE) + f"""
SELECT email_id, CASE {label_v1_sql('raw_label')} WHEN 'phishing' THEN 1 WHEN 'legit' THEN 0 END AS y FROM parts""")
def proj_label_to_int(spark, sf_dir):
    p = X.labelled_parts(spark, sf_dir)
    return p.select("email_id", label_word_to_int(label_v1_word(F.col("raw_label"))).alias("y"))


@register("filt_known_labels", O.with_ctes(PARTS_CTE) + f"""
SELECT email_id, {label_v1_sql('raw_label')} AS label, CASE {label_v1_sql('raw_label')} WHEN 'phishing' THEN 1 ELSE 0 END AS y
FROM parts WHERE {label_v1_sql('raw_label')} IN ('phishing', 'legit')""")
def filt_known_labels(spark, sf_dir):
    p = X.labelled_parts(spark, sf_dir).select("email_id", "raw_text", label_v1_word(F.col("raw_label")).alias("label"))
    kept = p.where(F.col("label").isin("phishing", "legit")).dropna()
    return kept.select("email_id", "label", label_word_to_int(F.col("label")).alias("y"))


@register("proj_label_v2", O.with_ctes(PARTS_CTE) + f"SELECT email_id, raw_label, {label_v2_sql('raw_label')} AS y FROM parts")
def proj_label_v2(spark, sf_dir):
    p = X.labelled_parts(spark, sf_dir)
    return p.select("email_id", "raw_label", label_v2(F.col("raw_label")).alias("y"))


@register("filt_dropna_subset", O.with_ctes(PARTS_CTE) + f"SELECT email_id, {label_v2_sql('raw_label')} AS y FROM parts WHERE {label_v2_sql('raw_label')} IS NOT NULL")
def filt_dropna_subset(spark, sf_dir):
    p = X.labelled_parts(spark, sf_dir)
    return p.select("email_id", label_v2(F.col("raw_label")).alias("y")).dropna(subset=["y"])


@register("proj_missing_label_default", O.with_ctes(PARTS_CTE) + "SELECT raw_text AS text, 0 AS y FROM parts")
def proj_missing_label_default(spark, sf_dir):
    path = scratch_path(spark, "body-only")
    C.write_csv(X.labelled_parts(spark, sf_dir).select(F.col("raw_text").alias("Body")), path)
    return C.load_one(spark, path).select("text", F.col("y").cast("int").alias("y"))


@register("filt_nonempty_text", f"""SELECT doc_id, {O.clean_text_sql('text')} AS clean_text FROM documents
WHERE {strip_sql(O.clean_text_sql('text'))} <> ''""")
def filt_nonempty_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("clean_text"))
    return d.where(strip_ws(F.col("clean_text")) != "")


# ---- the pre-computed URL feature table ----

def _feature_sql_parts():
    f = O.url_features_54_sql("url")
    p = O.url_parts("url")
    y = "CASE WHEN (url LIKE 'http://%') <> (page_id % 10 = 0) THEN 1 ELSE 0 END"
    title = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    return {
        "URLLength": f["url_len"], "DomainLength": f["host_len"], "IsDomainIP": f["host_is_ip"],
        "NoOfSubDomain": f["n_subdomain"], "NoOfDegitsInURL": f["n_digit"], "NoOfEqualsInURL": f["n_equal"],
        "NoOfQMarkInURL": f["n_qmark"], "NoOfAmpersandInURL": f["n_amp"], "IsHTTPS": f["is_https"],
        "LineOfCode": "len(string_split(html, chr(10)))",
        "LargestLineLength": "CASE WHEN page_id % 7 = 0 THEN NULL ELSE length(html) END",
        "HasTitle": f"CASE WHEN {title} <> '' THEN 1 ELSE 0 END",
    }, y, p, title


def _feature_table_sql() -> str:
    cols, y, _, _ = _feature_sql_parts()
    sel = ", ".join(f"coalesce(CAST({e} AS DOUBLE), 0.0) AS {n}" for n, e in cols.items())
    return f"SELECT {sel}, {y} AS y FROM pages"


@register("src_feature_table", _feature_table_sql())
def src_feature_table(spark, sf_dir):
    return C.load_feature_table(spark, X.write_feature_table(spark, sf_dir))


@register("proj_coerce_fill0", """SELECT CAST(page_id AS VARCHAR) || '.txt' AS file,
  coalesce(CAST(CASE WHEN page_id % 7 = 0 THEN NULL ELSE length(html) END AS DOUBLE), 0.0) AS largest_line,
  CASE WHEN page_id % 9 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS robots FROM pages""")
def proj_coerce_fill0(spark, sf_dir):
    raw = C.read_csv_strings(spark, X.write_feature_table(spark, sf_dir))
    fill = (lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    return raw.select(F.col("FILENAME").alias("file"), fill("LargestLineLength").alias("largest_line"),
                      fill("Robots").alias("robots"))


def _non_numeric_sql() -> str:
    cols, y, p, title = _feature_sql_parts()
    strs = {n: f"CAST({e} AS VARCHAR)" for n, e in cols.items()}
    strs["Robots"] = "CASE WHEN page_id % 9 = 0 THEN 'yes' ELSE '1' END"
    strs["label"] = f"CAST({y} AS VARCHAR)"
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in strs.items()) + " FROM pages"


@register("filt_non_numeric_columns", _non_numeric_sql())
def filt_non_numeric_columns(spark, sf_dir):
    raw = C.read_csv_strings(spark, X.write_feature_table(spark, sf_dir))
    return raw.drop(*[c for c in raw.columns if c.lower() in FEATURE_TABLE_DROP])
