"""Secret scans over a ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content.  The ledger
is a folder of Parquet tables, one per run: what rules, in what version, have been
run on which blob, and what they found.  A run scans only blobs for which some
(blob, rule version) pair is missing, with the missing rules only, appends what it
found, and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts
from .spans import Span


@dataclass(frozen=True)
class Rule:
    """A pattern with a name and a version; ``accept`` drops failing matches, without another try.

    ``hints`` are lower-case texts of which a matching text holds one at least.
    """

    kind: str
    version: int
    pattern: re.Pattern
    accept: Callable[[re.Match], bool] = bool
    hints: tuple[str, ...] = ()

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules.  A run of the class is maximal, so a least length may stand in the pattern.
BASE = (
    Rule(
        "assign", 1,
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        lambda m: len(m[2]) >= 8, ("passw", "secret", "token", "api"),
    ),
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]{12,}"), hints=("akia",)),
    Rule("hex", 1, re.compile(r"[0-9a-f]{32,}")),
)

#: Rules that come on top: private key blocks, prefixed service tokens, signed web tokens.
FURTHER = (
    Rule("key_block", 1, re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), hints=("private key",)),
    Rule("service_token", 1, re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"), hints=("gh", "xox", "sk_live_")),
    Rule("web_token", 1, re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), hints=("eyj",)),
)

RULES = BASE + FURTHER
LEDGER = "blob binary, pairs array<string>, findings array<struct<kind:string,version:int,start:int,end:int>>"


def scan_text(text: str, rules: Iterable[Rule]) -> list[tuple[Rule, Span]]:
    """Leftmost matches that do not overlap within a rule, in code points, end exclusive."""
    low, found = text.lower(), []
    for rule in rules:
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        found += [(rule, (rule.kind, m.start(), m.end())) for m in rule.pattern.finditer(text) if rule.accept(m)]
    return found


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All runs of a ledger; a ledger that has no run yet is empty."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Add ``pairs``, the rule versions that the ledger lacks for a blob; blobs that lack none go."""
    done = ledger.select("blob", F.explode("pairs").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("done"))
    wanted = F.array(*[F.lit(r.pair) for r in rules])
    lacking = F.when(F.col("done").isNull(), wanted).otherwise(F.array_except(wanted, "done"))
    return blobs.join(done, "blob", "left").withColumn("pairs", lacking).drop("done").where(F.size("pairs") > 0)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, findings) of every row of ``versions`` (path long, text), findings by the current rules.

    A null text is an empty one.  Rows that hold the same content, be they other paths,
    earlier versions or repeated rows, share one scan.  Paths may be null or repeated; a
    blob is read from its smallest path, and rows of null paths are scanned among
    themselves.  Other columns are ignored.  An empty table gives an empty result and an
    empty run.  A run that fails leaves no rows, because its table is committed as a whole.
    """
    spark = versions.sparkSession
    by_pair = {r.pair: r for r in rules}
    versions = versions.select(F.col("path").cast("long").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    addressed = versions.select("path", F.unhex(F.sha2("text", 256)).alias("blob"))
    lacking = unseen(addressed.groupBy("blob").agg(F.min("path").alias("path")), read_ledger(spark, ledger), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            pairs = part.column(2).to_pylist()
            found = [
                [{"kind": r.kind, "version": r.version, "start": s[1], "end": s[2]} for r, s in scan_text(t, [by_pair[p] for p in own])]
                for t, own in zip(texts(part.column(1)), pairs)
            ]
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, kinds)], names=["blob", "pairs", "findings"])

    # A path may have several versions, so the content must be the one that lacks a scan.
    addressed_texts = versions.withColumn("content", F.unhex(F.sha2("text", 256)))
    same = addressed_texts["path"].eqNullSafe(lacking["path"]) & (addressed_texts["content"] == lacking["blob"])
    first = addressed_texts.join(lacking.hint("shuffle_hash"), same).select("blob", "text", "pairs")
    first.mapInArrow(run, LEDGER).write.parquet(f"{ledger.rstrip('/')}/run-{uuid.uuid4().hex}")

    current = F.array(*[F.lit(r.pair) for r in rules])
    findings = (
        read_ledger(spark, ledger).select("blob", F.explode("findings").alias("f"))
        .where(F.array_contains(current, F.concat_ws("@", "f.kind", F.col("f.version").cast("string"))))
        .groupBy("blob").agg(F.collect_set("f").alias("findings"))
    )
    return addressed.join(findings, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast("array<struct<kind:string,version:int,start:int,end:int>>")).alias("findings"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, the digest of the base spans and all spans, from the rows of ``scan``."""
    order = F.array(*[F.lit(r.kind) for r in RULES])
    base = F.array(*[F.lit(r.kind) for r in BASE])
    ordered = F.array_sort(F.transform(
        "findings", lambda f: F.struct(f["start"].alias("start"), F.array_position(order, f["kind"]).alias("place"), f["end"].alias("end"), f["kind"].alias("kind"))
    ))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("ordered", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("path", ordered.alias("ordered")).select(
        F.col("path").alias("doc_id"), *[count(r.kind) for r in BASE],
        F.sha2(text(F.filter("ordered", lambda s: F.array_contains(base, s["kind"]))), 256).alias("base_sha256"),
        text(F.col("ordered")).alias("spans"),
    )
