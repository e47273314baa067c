"""Secrets in texts, found once per content and rule version: an incremental ledger of scanned blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger says which rule versions have read
which blob. A scan takes the distinct blobs, runs on each only the rules that have not read it, appends what they
found, and joins the findings of the asked rules back to all paths. A new version of a rule reads every blob
again, the other rules none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost matches, none overlapping, are findings if ``group`` has ``min_chars`` characters.

    ``needle`` is a text that every match contains; texts without it are not searched.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 1
    needle: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns of the base kinds, in the order in which spans with the same start are listed.
BASE_RULES = (
    Rule(
        "assign", 1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, min_chars=8,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", min_chars=16, needle="AKIA"),
    # Runs of at least 32 are the long ones among all runs.
    Rule("hex", 1, r"[0-9a-f]{32,}", min_chars=32),
)
#: Further well-known token forms. Repeated groups would use the stack of the thread once per repetition, and a part
#: without a bound that may begin anywhere in a long run is read again from every place: neither stands here.
MORE_RULES = (
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needle="PRIVATE KEY-----"),
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needle="eyJ"),
    Rule("github", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", needle="gh"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needle="xox"),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}", needle="AIza"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<start:long,rank:int,kind:string,rule:string,end:long>>"


def _matches(text: Column, rule: Rule) -> Column:
    """The gaps and matches of a text in turn: (gap length, match length, whether it counts); null without a match."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    found = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("match"), part.alias("part")),
        lambda x: F.struct(
            x["gap"].cast("long").alias("gap"), x["match"].cast("long").alias("match"),
            (x["part"] >= rule.min_chars).alias("good"),
        ),
    )
    there = text.rlike(rule.pattern)
    if rule.needle:
        there = text.contains(rule.needle) & there
    return F.when(there, found)


class SecretLedger:
    """The ledger under one folder. ``scan`` may run again and again, with more paths and newer rules."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame | None:
        """``(blob, rules, spans)``: which rules have read the blob in one scan, and what they found."""
        try:
            return self.spark.read.schema(f"blob string, rules array<string>, spans {SPAN}").parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _unread(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """``(blob, text, read)`` of distinct blobs that some rule has not read."""
        blobs = versions.groupBy("blob").agg(F.any_value("text").alias("text"))
        ledger = self.rows()
        if ledger is None:
            return blobs.withColumn("read", F.array().cast("array<string>"))
        read = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("read"))
        wanted = F.array(*[F.lit(r.key) for r in rules])
        return (
            blobs.join(read, "blob", "left")
            .withColumn("read", F.coalesce("read", F.array().cast("array<string>")))
            .where(F.size(F.array_except(wanted, F.col("read"))) > 0)
        )

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``versions (…, text)`` with ``blob`` and ``spans``, all that the rules find in each text.

        Null texts are empty ones. ``spans`` is sorted by start, then by the order of the rules; it is empty where
        nothing was found. Rows stay as they are, however often a text repeats. Column names ``blob`` and ``spans``
        of the input are replaced.
        """
        versions = versions.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2("text", 256))
        unread = self._unread(versions.select("blob", "text"), rules)
        text, read = F.col("text"), F.col("read")
        found = [
            F.when(~F.array_contains(read, rule.key), _matches(text, rule)).alias(f"_{i}")
            for i, rule in enumerate(rules)
        ]
        pending = F.array_except(F.array(*[F.lit(r.key) for r in rules]), read)
        scanned = stored(unread.select("blob", pending.alias("rules"), *found), "scanned")
        spans = self._spans(scanned, rules)
        (
            scanned.select("blob", "rules").join(spans, "blob", "left")
            .select("blob", "rules", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
            .write.mode("append").parquet(self.folder)
        )
        wanted = [r.key for r in rules]
        findings = (
            self.rows().where(F.size("spans") > 0)
            .select("blob", F.filter("spans", lambda s: s["rule"].isin(wanted)).alias("spans"))
            .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        )
        return versions.drop("spans").join(findings, "blob", "left").withColumn(
            "spans", F.coalesce("spans", F.array().cast(SPAN))
        )

    def _spans(self, scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """``(blob, spans)``: starts are the lengths of all gaps and matches before, summed in order."""
        each = [
            scanned.where(F.col(f"_{i}").isNotNull()).select(
                "blob", F.lit(i).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"),
                F.posexplode(f"_{i}").alias("k", "x"),
            )
            for i, rule in enumerate(rules)
        ]
        pieces = reduce(DataFrame.unionByName, each).select(
            "blob", "rank", "kind", "rule", "k", F.col("x.match").alias("match"), F.col("x.good").alias("good"),
            (F.col("x.gap") + F.coalesce("x.match", F.lit(0))).alias("length"),
        )
        by_blob = Window.partitionBy("blob", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        until = F.sum("length").over(by_blob)
        return (
            pieces.withColumn("end", until).where("good")
            .groupBy("blob")
            .agg(
                F.collect_list(
                    F.struct(
                        (F.col("end") - F.col("match")).alias("start"), F.col("rank"), F.col("kind"), F.col("rule"),
                        F.col("end"),
                    )
                ).alias("spans")
            )
        )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def secret_digest(scanned: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, the hash of the base spans and all spans as text."""
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*[r.kind for r in BASE_RULES])
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return scanned.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
