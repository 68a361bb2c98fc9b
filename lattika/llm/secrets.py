"""Secret scans over an incremental blob ledger, with Spark expressions alone.

A blob is the content of one or more paths or historical versions, addressed by the SHA-256 of its text. The ledger holds, for each
blob, the rule versions that have scanned it and their spans. A scan takes only pairs of blob and rule version that the ledger lacks,
each blob once however many paths hold it, and joins the findings back to all paths.

Null text is the empty blob. Spans are code points, end exclusive. Matches of one rule don't overlap; spans of different rules may. Repeated rows and
copies get equal findings. Columns of the input other than those named aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, cut, join_hot, work_dir


@dataclass(frozen=True)
class Rule:
    """A pattern, tried leftmost and without overlaps; matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    #: A plain string that each match has, for a cheap first look.
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the three base kinds.
KEYWORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
BASE = (
    Rule("assign", 1, rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=18, hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
MORE = (Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),)
RULES = (*BASE, *MORE)

SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """A rule's spans in a text, an array of (start, end).

    The pattern parts the text into gaps and matches, whose lengths add up to the positions.
    """
    empty = F.array().cast(SPANS)
    pattern = F.lit(rule.pattern)
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    pieces = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    if rule.group:
        pieces = F.zip_with(pieces, F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda p, g: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), (F.length(g) >= rule.least).alias("ok")))
    else:
        pieces = F.transform(pieces, lambda p: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), (p["size"] >= rule.least).alias("ok")))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + p["gap"]
        b = a + p["size"]
        return F.struct(b.alias("at"), F.when(p["ok"], F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        return F.aggregate(b, F.struct(acc["at"].alias("at"), empty.alias("out")), step, lambda one: F.struct(one["at"].alias("at"), F.concat(acc["out"], F.array(one["out"])).alias("out")))

    def cumulate(p: Column) -> Column:  # in blocks of about the root of their number, as each step copies what its block has so far
        width = F.ceil(F.sqrt(F.size(p))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / width).cast("int")), lambda i: F.slice(p, i * width + 1, width))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), block, lambda acc: F.flatten(acc["out"]))

    test = text.rlike(rule.pattern)
    if rule.hint:
        test = text.contains(rule.hint) & test
    return F.when(test, F.transform(F.array(pieces), cumulate)[0]).otherwise(empty)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob_id, rule_version, spans) for the blobs of ``versions`` (text) and the rules that ``ledger`` has no row for.

    Append them to the ledger. A blob's text moves once, after copies in one place have become one.
    """
    rows = versions.select(blob_id(F.col("text")).alias("blob_id"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        done = ledger.filter(F.col("rule_version").isin([r.key for r in rules])).groupBy("blob_id").agg(F.collect_set("rule_version").alias("done"))
        rows = rows.join(done, "blob_id", "left").filter(F.coalesce(F.size("done"), F.lit(0)) < len(rules))
        blobs = rows.groupBy("blob_id").agg(F.first("text").alias("text"), F.first("done").alias("done"))
        seen = lambda r: F.coalesce(F.array_contains("done", r.key), F.lit(False))
    else:
        blobs = rows.groupBy("blob_id").agg(F.first("text").alias("text"))
        seen = lambda r: F.lit(False)
    scans = F.array(*[F.struct(F.lit(r.key).alias("rule_version"), F.when(~seen(r), spans(F.col("text"), r)).alias("spans")) for r in rules])
    return blobs.select("blob_id", F.explode(scans).alias("s")).filter("s.spans is not null").select("blob_id", "s.rule_version", "s.spans")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The key columns of ``versions`` (all but text; one named found ends in an underscore) and found: an array of (start, kind order, end, kind) sorted by start and kind order.

    ``ledger`` has a row for each blob of ``versions`` and each rule; blobs without spans need not be there, and a pair that two writers appended counts once.
    """
    kind, order = F.col("rule_version"), F.lit(0)
    for i, r in enumerate(rules):
        order = F.when(kind == r.key, i).otherwise(order)
    hits = ledger.filter(kind.isin([r.key for r in rules]) & (F.size("spans") > 0)).withColumn("_k", order)
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("_k").alias("order"), s["end"].alias("end"), F.substring_index(kind, "@", 1).alias("kind")))
    per_blob = cut(hits.groupBy(F.col("blob_id").alias("_own")).agg(F.array_sort(F.flatten(F.collect_set(each))).alias("found")))
    versions = aside(versions, ["found"])
    rows = cut(versions.select(blob_id(F.col("text")).alias("_own"), F.struct(*[c for c in versions.columns if c != "text"]).alias("_row")))
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return join_hot(rows, "_own", per_blob).select("_row.*", F.coalesce("found", empty).alias("found"))


def update_ledger(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the pairs of blob and rule version that the ledger in ``folder`` (a URI; Parquet, made where it is missing) lacks, appends them, and returns the whole ledger."""
    spark = versions.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    old = spark.read.parquet(folder) if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None
    scan_unseen(versions, old, rules).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def secret_digest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of ``docs`` (doc_id, text), by way of the ledger in ``folder`` (by default a new one)."""
    versions = docs.select("doc_id", "text")
    rows = findings(versions, update_ledger(versions, folder or work_dir(docs.sparkSession, "ledger")))
    line = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def _sql_spans(rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    ok = f"length(regexp_extract_all(t, '{p}', {rule.group})[i]) >= {rule.least}"
    return f"""list_transform(list_filter(range(1, len(m_{rule.kind}) + 1), lambda i: {ok}),
      lambda i: [list_sum(list_transform(g_{rule.kind}[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m_{rule.kind}[1:i - 1], lambda x: length(x))), 0)::BIGINT,
        list_sum(list_transform(g_{rule.kind}[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(m_{rule.kind}[1:i], lambda x: length(x)))::BIGINT])"""


def digest_sql() -> str:
    """DuckDB SQL for secret_digest over documents."""
    parts = ", ".join(f"regexp_extract_all(t, '{p}', 0) AS m_{r.kind}, string_split_regex(t, '{p}') AS g_{r.kind}" for r in RULES for p in [r.pattern.replace("'", "''")])
    all_spans = " UNION ALL ".join(f"SELECT k, {i} AS o, '{r.kind}' AS kind, unnest(s_{r.kind}) AS s FROM found" for i, r in enumerate(RULES))
    joined = lambda least: f"coalesce(string_agg(kind || ':' || s[1] || ':' || s[2], ',' ORDER BY s[1], o) FILTER (WHERE o < {least}), '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT k, t, {parts} FROM docs),
found AS (SELECT k, {", ".join(f"{_sql_spans(r)} AS s_{r.kind}" for r in RULES)} FROM parts),
spans AS ({all_spans}),
per AS (SELECT k, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, {joined(len(BASE))} AS base, {joined(len(RULES))} AS spans FROM spans GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (k)
"""
