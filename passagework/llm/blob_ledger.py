"""Secret scanning over a ledger of content-addressed blobs, with DataFrame functions only.

Every historical version of a path is a blob, named by the SHA-256 of its text. The ledger is a folder of
three Parquet tables, each batch appended in a folder of its own: ``scanned`` (blob, rule, version),
``findings`` (blob, rule, version, start, end) and ``commits``, which names the finished batches. A scan reads
the text of those blobs only that lack a (rule, version) pair, one copy of each, and appends what it finds
(where all missing rules have hints, texts without a hint stay where they are);
findings are then joined back to all paths. Batches that are not in ``commits`` (a scan that died) are not
read, so a scan can be run again.

Rules are regular expressions. The text between matches and the matches themselves give all positions by
running sums of lengths, so several matches of a text need no loop. Positions are code points, ends exclusive;
matches are leftmost and do not overlap within a rule; a match that fails its length check is dropped and not
tried again.

Defined cases: null is the empty text; blobs without findings are in the ledger as scanned; repeated rows of
a path are repeated in the result; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of group ``group`` (0: the whole match); ``hint`` is a cheap test that a text may match."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None


#: The base rules. Runs shorter than the least length of access and hex are left out by the pattern itself.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}+", 0, 24),
)
#: What the scan adds to the base rules.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("web_token", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", hint="eyJ"),
    Rule("service_token", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", hint="_"),
)
RULES = (*BASE_RULES, *MORE_RULES)
FINDING = "blob string, rule string, version int, start long, end long"
PAIR = "blob string, rule string, version int"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def pieces(text: Column, rule: Rule) -> Column:
    """(gap before the match, length of the match, whether it counts) of each match, in order."""
    p = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    checked = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    return F.transform(
        F.arrays_zip(whole.alias("m"), checked.alias("c"), gaps.alias("g")),
        lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["c"]) >= rule.least).alias("counts")),
    )


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        """Rows of the committed batches."""
        done = self._commits()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(os.path.join(self.path, name, b) for b in done))

    def _commits(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, "commits"))
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        return sorted({r["batch"] for r in self.spark.read.schema("batch string").parquet(os.path.join(self.path, "commits")).collect()})

    def scanned(self) -> DataFrame:
        return self._read("scanned", PAIR)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDING)

    def scan(self, versions: DataFrame, text: str = "text", key: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
        """Scan the unseen pairs of ``versions``; returns (``key``, ``blob``) of every version, for joins.

        ``key`` only spreads the texts over tasks when one copy of a blob is chosen; it may hold nulls.
        """
        batch = uuid.uuid4().hex
        at = lambda name: os.path.join(self.path, name, batch)
        named = versions.select(*key, blob_of(versions[text]).alias("blob"))
        named.write.parquet(at("paths"))
        named = self.spark.read.schema(named.schema).parquet(at("paths"))
        asked = self.spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")
        one = named.groupBy("blob").agg(F.min(F.struct(*key)).alias("one"))
        known = self.scanned().join(F.broadcast(asked), ["rule", "version"]).groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
        open_rules = F.array_except(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules)), F.coalesce("seen", F.array()))
        todo = one.join(known, "blob", "left").select("blob", "one", open_rules.alias("open")).where(F.size("open") > 0)
        todo.write.parquet(at("todo"))
        todo = self.spark.read.schema(todo.schema).parquet(at("todo"))

        texts = versions.select(F.struct(*key).alias("one"), F.coalesce(versions[text], F.lit("")).alias("t"))
        # a text that shows no hint of any rule that is open for some blob need not be moved; at most one row for each rule
        open_ = {(r["rule"], r["version"]) for r in todo.select(F.inline("open")).distinct().collect()}
        hints = [r.hint for r in rules if (r.name, r.version) in open_]
        if hints and None not in hints:
            texts = texts.where(reduce(lambda a, b: a | b, (F.contains(F.col("t"), F.lit(h)) for h in hints)))
        texts = texts.withColumn("blob", blob_of(F.col("t")))
        same = (texts["one"].eqNullSafe(todo["one"])) & (texts["blob"] == todo["blob"])
        fresh = texts.join(todo.hint("shuffle_hash"), same).select(todo["blob"], "open", "t")
        self._matches(fresh, rules).write.parquet(at("findings"))
        todo.select("blob", F.inline("open")).write.parquet(at("scanned"))
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(os.path.join(self.path, "commits"))
        return named

    @staticmethod
    def _matches(fresh: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        def of(rule: Rule) -> Column:
            wanted = F.exists("open", lambda o: (o["rule"] == rule.name) & (o["version"] == rule.version))
            may = F.contains(F.col("t"), F.lit(rule.hint)) if rule.hint else F.lit(True)
            found = F.when(wanted & may & F.col("t").rlike(rule.pattern), pieces(F.col("t"), rule))
            return F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), found.alias("found"))

        each = fresh.select("blob", F.explode(F.array(*map(of, rules))).alias("r")).where(F.col("r.found").isNotNull())
        matches = each.select("blob", "r.rule", "r.version", F.posexplode("r.found").alias("n", "x")).distinct()
        so_far = Window.partitionBy("blob", "rule", "version").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        placed = matches.withColumn("end", F.sum((F.col("x.gap") + F.col("x.size")).cast("long")).over(so_far))
        return placed.where("x.counts").select("blob", "rule", "version", (F.col("end") - F.col("x.size")).alias("start"), "end")


def joined(spans: Column) -> Column:
    """``rule:start:end`` of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(paths: DataFrame, findings: DataFrame, key: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """A row for each version: counts of the base rules, hashed base positions and all spans, by start, then rule as listed."""
    base = [r.name for r in BASE_RULES]
    order = reduce(lambda c, r: c.when(F.col("rule") == r[1].name, r[0]), enumerate(rules[1:], 1), F.when(F.col("rule") == rules[0].name, 0))
    asked = findings.where(reduce(lambda a, b: a | b, ((F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules)))
    spans = F.sort_array(F.collect_list(F.struct("start", order.alias("k"), "rule", "end")))
    blobs = asked.groupBy("blob").agg(*(F.count_if(F.col("rule") == r).alias(f"n_{r}") for r in base), spans.alias("s"))
    blobs = blobs.select("blob", *(f"n_{r}" for r in base), joined(F.filter("s", lambda s: s["rule"].isin(*base))).alias("base"), joined(F.col("s")).alias("spans"))
    return paths.join(blobs, "blob", "left").select(
        *key,
        *(F.coalesce(f"n_{r}", F.lit(0).cast("long")).alias(f"n_{r}") for r in base),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
