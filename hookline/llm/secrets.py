"""Secret scans with multipart credential linking (operator 6), DataFrame functions only.

Base kinds are matches of one pattern each. Weak kinds (account names, bare
key-like strings, endpoints) prove nothing alone: such a span is reported only
when a complementary part lies in its scope, within SCOPE code points of the
same document: names and endpoints need a secret near, bare keys need an
identifier or an endpoint. Parts meet in an interval join on (row, bin) that
keeps the weak side (semi join), so no list of pairs is made; a weak span that
overlaps a base span adds nothing and is dropped.

Positions come from the pieces between matches: their lengths, summed in order,
give starts and ends in code points.

Rows: a null text is empty. Every row is reported on, also repeated ones and
those with a null ``doc_id``. Other columns are ignored by the scan and kept by
``drop_secrets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, materialise, numbered, with_columns_of

SCOPE = 200
BIN = 256
_VALUE = "[\"']?\\x20*[:=]\\x20*[\"']?"

#: kind -> (role, pattern, group whose length counts, least length, cheap test or None)
BASE = {
    "assign": ("secret", f"(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": ("name", "AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("secret", "[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "name": ("name", "(?i:access_?key_?id|client_?id|account|user_?name|user|login)"
                     f"{_VALUE}([A-Za-z0-9_.@-]+)", 1, 3),
    "key": ("secret", "(?:(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]{0,39}[0-9])(?=[a-z0-9+/]{0,39}[A-Z])"
                      "(?=[A-Z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_-])"
                      "|(?<![A-Za-z0-9])(?:sk|ghp|gho|glpat|xox[abp])[-_][A-Za-z0-9_-]{16,})", 0, 18),
    "endpoint": ("place", "(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\\x00-\\x20\"'<>)]+"
                          "|(?<![a-z0-9.-])[a-z0-9.-]+\\.amazonaws\\.com", 0, 6),
}
KINDS = [*BASE, *WEAK]


def _may(kind: str, text: Column) -> Column:
    """A cheap necessary condition for a match of the kind."""
    if kind in ("assign", "name"):
        return text.contains("=") | text.contains(":")
    if kind == "access":
        return text.contains("AKIA")
    if kind == "endpoint":
        return text.contains("://") | text.contains(".amazonaws.com")
    return text.rlike("[0-9A-Za-z+/_-]{18,}")


def _spans_of_rows(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (row, doc_id), and per match (row, kind, order, role, start, end)."""
    text = F.coalesce("text", F.lit(""))
    d = d.select("row", "doc_id", text.alias("text"))
    d = d.select("row", "doc_id", "text", *[_may(k, F.col("text")).alias(f"may_{k}") for k in KINDS])
    none = F.array().cast("array<string>")
    for k, (_, pattern, group, _) in (BASE | WEAK).items():
        d = d.withColumn(f"m_{k}", F.when(F.col(f"may_{k}"), F.expr(
            f"regexp_extract_all(text, {_lit(pattern)}, 0)")).otherwise(none))
    def lengths(c):
        return F.transform(c, lambda x: F.length(x))
    cols = []
    for k, (_, pattern, group, _) in (BASE | WEAK).items():
        some = F.size(f"m_{k}") > 0
        empty = F.array().cast("array<int>")
        cols += [F.when(some, lengths(F.col(f"m_{k}"))).otherwise(empty).alias(f"len_{k}"),
                 F.when(some, lengths(F.split("text", pattern, -1))).otherwise(empty).alias(f"gap_{k}")]
        if group:
            cols.append(F.when(some, lengths(F.expr(f"regexp_extract_all(text, {_lit(pattern)}, {group})")))
                        .otherwise(empty).alias(f"val_{k}"))
    rows = materialise(d.select("row", "doc_id", *cols), "secret-rows")
    parts = None
    for i, (k, (role, _, group, least)) in enumerate((BASE | WEAK).items()):
        z = rows.where(F.size(f"len_{k}") > 0).select(
            "row", F.posexplode(F.arrays_zip(F.col(f"gap_{k}").alias("gap"), F.col(f"len_{k}").alias("len"),
                                             F.col(f"val_{k}" if group else f"len_{k}").alias("val"))).alias("at", "x"))
        before = Window.partitionBy("row").orderBy("at")
        z = z.select("row", "at", F.col("x.gap").alias("gap"), F.col("x.len").alias("len"), F.col("x.val").alias("val"))
        z = z.withColumn("end", F.sum(F.col("gap").cast("long") + F.coalesce("len", F.lit(0))).over(before))
        z = z.where(F.col("len").isNotNull() & (F.col("val") >= least)).select(
            "row", F.lit(k).alias("kind"), F.lit(i).alias("order"), F.lit(role).alias("role"),
            (F.col("end") - F.col("len")).alias("start"), "end")
        parts = z if parts is None else parts.unionByName(z)
    return rows.select("row", "doc_id"), materialise(parts, "secret-parts")


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _binned(parts: DataFrame, reach: int) -> DataFrame:
    return parts.withColumn("bin", F.explode(F.sequence(
        F.floor((F.col("start") - reach) / BIN), F.floor((F.col("end") + reach) / BIN))))


def linked(parts: DataFrame) -> DataFrame:
    """Base parts, and weak parts with a complementary part in their scope."""
    is_base = F.col("kind").isin(*BASE)
    base, weak = parts.where(is_base), parts.where(~is_base)
    w, b, p = _binned(weak, 0).alias("w"), _binned(base, 0).alias("b"), _binned(parts, 0).alias("p")
    same = (F.col("w.row") == F.col("b.row")) & (F.col("w.bin") == F.col("b.bin"))
    inside = w.join(b, same & (F.col("w.start") < F.col("b.end")) & (F.col("b.start") < F.col("w.end")),
                    "left_semi").select("row", "kind", "start", "end")
    weak = weak.join(inside.distinct(), ["row", "kind", "start", "end"], "left_anti")
    w = _binned(weak, SCOPE).alias("w")
    same = (F.col("w.row") == F.col("p.row")) & (F.col("w.bin") == F.col("p.bin"))
    near = ((F.col("p.start") <= F.col("w.end") + SCOPE) & (F.col("w.start") <= F.col("p.end") + SCOPE)
            & ((F.col("p.start") >= F.col("w.end")) | (F.col("w.start") >= F.col("p.end"))))
    fits = (((F.col("w.role") == "secret") & F.col("p.role").isin("name", "place"))
            | ((F.col("w.role") != "secret") & (F.col("p.role") == "secret")))
    hit = w.join(p, same & near & fits, "left_semi").drop("bin").distinct()
    return base.unionByName(hit.select(*base.columns))


def scan(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, spans array<struct<start, order, end, kind>>) per row, spans in order; weak
    kinds only when linked. ``row`` names a column that numbers the rows, if there is one."""
    d = with_columns_of(docs, {"doc_id": "long", "text": "string"} | ({row: "long"} if row else {}))
    d = d.withColumnRenamed(row, "row") if row else d.withColumn("row", F.monotonically_increasing_id())
    rows, parts = _spans_of_rows(d)
    found = linked(parts).groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", "order", "end", "kind"))).alias("spans"))
    return rows.join(found, "row", "left").withColumn("spans", F.coalesce("spans", F.expr(
        "cast(array() as array<struct<start:bigint,order:int,end:bigint,kind:string>>)")))


def op6(docs: DataFrame) -> DataFrame:
    """Contract of op6_secrets."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    def of(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    s = scan(docs)
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return s.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                    joined(F.col("spans")).alias("spans"))


def drop_secrets(docs: DataFrame) -> DataFrame:
    """The rows in which the scan finds nothing, all columns as they were."""
    d = numbered(docs, "secret-docs")
    found = scan(d, ROW).where(F.size("spans") > 0).select(F.col("row").alias(ROW))
    return d.join(found, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
