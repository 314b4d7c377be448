"""Secret scans with an incremental blob ledger. DataFrame functions only.

A blob is the content of one version of a document, named by its SHA-256. The ledger, a Parquet
table in the shared folder that only grows, has one row per scanned blob and run: a map from
rule version (``kind@version``) to the spans found. A scan looks up which pairs of blob and rule
version the ledger lacks, runs only those rules over only those blobs, appends what it found,
and joins the findings back to every row that holds the blob. A rule that changes gets a new
version and is the only one run again; old findings stay for the record.

Spans are code-point ranges, end exclusive; matches of one kind are leftmost and do not overlap.
They come from splitting the text at the matches: the lengths of gaps and matches add up to the
positions. A blob that many rows hold does not gather them: such blobs are few, and what was found in
them goes to the rows.

Odd cases: a null text is the empty text and has no spans; ids may be null or repeat, every row
gets its row; an empty table gives an empty result and leaves an empty ledger; further columns
are ignored. A text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwelltrace.llm.common import join_by_key, scratch, staged, whole_text


@dataclass(frozen=True)
class SecretRule:
    """A pattern; a match counts if ``group`` of it has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: str = "1"

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three kinds that every scan reports, in reporting order.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1,
        least=6,
    ),
    # A run is matched whole, so asking for its length in the pattern drops the same matches.
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+"),
    SecretRule(
        "url_password",
        r"(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s/:@]{1,256}:[^\s/@]{1,256}@",
    ),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    SecretRule("service_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
)

_LEDGER = "blob string, findings map<string, array<struct<start: bigint, end: bigint>>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty if it was never written."""
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def _pieces(text: Column, rule: SecretRule) -> Column:
    """For each match: length of the gap before it, of the match, and of the group that counts."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counting = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    return F.zip_with(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("match")),
        counting,
        lambda pair, group: F.struct(
            F.length(pair["gap"]).alias("gap"),
            F.length(pair["match"]).alias("match"),
            F.length(group).alias("group"),
        ),
    )


def scan_blobs(blobs: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """Columns ``blob, findings`` for blobs with a column ``todo``, the rule versions to run."""
    text = F.col("text")
    found = []
    for rule in rules:
        due = F.array_contains("todo", rule.key) & text.rlike(rule.pattern)
        match = F.struct(
            F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), _pieces(text, rule).alias("pieces")
        )
        found.append(F.when(due, match))
    scanned = blobs.select("blob", "todo", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"))
    one = scanned.select("blob", "todo", F.explode_outer("found").alias("f"))
    each = one.select("blob", "todo", "f.rule", "f.least", F.posexplode_outer("f.pieces").alias("nth", "p")).filter(
        F.col("rule").isNull() | F.col("p.match").isNotNull()  # the gap after the last match has none
    )
    before = Window.partitionBy("blob", "rule").orderBy("nth")
    end = F.sum(F.col("p.gap") + F.col("p.match")).over(before)
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("p.match"))
    counts = F.col("rule").isNotNull() & (F.col("p.group") >= F.col("least"))
    per_blob = spans.groupBy("blob").agg(
        F.first("todo").alias("todo"),
        F.array_sort(F.collect_list(F.when(counts, F.struct("rule", "start", "end")))).alias("all"),
    )
    findings = F.transform(
        "todo",
        lambda key: F.struct(
            key,
            F.transform(
                F.filter("all", lambda s: s["rule"] == key),
                lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")),
            ),
        ),
    )
    return per_blob.select("blob", F.map_from_entries(findings).alias("findings"))


def update_ledger(docs: DataFrame, ledger_path: str, rules: Sequence[SecretRule]) -> None:
    """Scan what the ledger lacks for these documents, and append it."""
    keys = F.array(*[F.lit(rule.key) for rule in rules])
    seen = (
        read_ledger(docs.sparkSession, ledger_path)
        .select("blob", F.explode(F.map_keys("findings")).alias("rule"))
        .groupBy("blob")
        .agg(F.collect_set("rule").alias("seen"))  # as many as there are rule versions
    )
    text = whole_text()
    # Grouping on the content scans one copy only, and copies collapse where they are read.
    blobs = docs.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    due = (
        blobs.join(seen, "blob", "left")
        .withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
        .filter(F.size("todo") > 0)
    )
    scan_blobs(due, rules).write.mode("append").option("compression", "zstd").parquet(ledger_path)


def _spans_of(rule: SecretRule, place: int) -> Column:
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return F.transform(
        F.coalesce(F.col("findings")[rule.key], none),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")
        ),
    )


def scan_secrets(
    docs: DataFrame, rules: Sequence[SecretRule] = (*BASE_RULES, *MORE_RULES), *, ledger_path: str | None = None
) -> DataFrame:
    """One row per document: ``doc_id, blob`` and ``found``, an array of (start, place, kind, end)
    in order, where ``place`` is the rule's place in ``rules``."""
    if len({rule.kind for rule in rules}) < len(rules):
        raise ValueError("rules of one scan must have different kinds")
    ledger_path = ledger_path or scratch(docs.sparkSession, "blob-ledger")
    update_ledger(docs, ledger_path, rules)
    spark = docs.sparkSession
    ledger = read_ledger(spark, ledger_path)
    per_rule = [_spans_of(rule, place) for place, rule in enumerate(rules)]
    found = (
        ledger.select("blob", F.concat(*per_rule).alias("part"))
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("part")))).alias("found"))
    )
    found = staged(found, "found-secrets")
    paths = staged(docs.select("doc_id", F.sha2(whole_text().cast("binary"), 256).alias("blob")), "blob-paths")
    return join_by_key(paths, found, ["blob"]).select("doc_id", "blob", "found")


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds, and all spans as text."""
    spans = F.col("found")
    base = F.filter(spans, lambda s: s["place"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(rule.kind) for rule in BASE_RULES],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )
