"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every file is named by the SHA-256 of its content.  The ledger remembers which pairs of blob
and rule version have been scanned, with the spans found; a scan looks only at pairs it doesn't hold yet, and
findings are joined back to all paths that carry a blob.  Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; a match stays if ``group`` has ``least`` characters or more.

    A changed rule gets a new ``version``, so that its pairs with old blobs count as not scanned.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns of the contract.  Runs of one class are maximal, so their least length may stand in the pattern.
RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)


def address(content: Column) -> Column:
    """The name of a blob; a null content is the empty one."""
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def _starts(pieces: Column, matches: Column) -> Column:
    """Where each match begins: the pieces between matches and the matches alternate."""
    step = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(
        F.slice(step, 1, F.size(matches)),
        begin,
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["size"]).alias("at"),
            F.concat(
                a["spans"],
                F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["size"]).alias("end"))),
            ).alias("spans"),
        ),
        lambda a: a["spans"],
    )


def find(text: Column, matches: Column, rule: Rule) -> Column:
    """Spans of ``rule`` in ``text`` by code points, end exclusive; ``matches`` are the pattern's matches."""
    spans = _starts(F.split(text, rule.pattern, -1), matches)
    if rule.group:
        held = F.zip_with(spans, matches, lambda s, m: F.struct(s.alias("span"), F.length(F.regexp_extract(m, rule.pattern, rule.group)).alias("n")))
        spans = F.transform(F.filter(held, lambda x: x["n"] >= rule.least), lambda x: x["span"])
    elif rule.least > 1:
        spans = F.filter(spans, lambda s: s["end"] - s["start"] >= rule.least)
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(SPANS))


class BlobLedger:
    """The scanned pairs below ``path``, a folder that all executors reach; one sub-folder for each scan.

    A table ``blob, rule, spans`` with a row for every scanned pair, ``rule`` being kind and version.  A scan that
    is repeated finds its pairs and adds nothing.  An empty table of versions adds an empty batch.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def pairs(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"blob string, rule string, spans {SPANS}, batch int").parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def scan(self, versions: DataFrame, rules: Sequence[Rule] = RULES, content: str = "content") -> int:
        """Scan what is new in ``versions`` and return the number of the batch.

        Copies of a blob are folded inside each task before the shuffle, so a much copied blob is one row there.
        """
        text = F.coalesce(F.col(content), F.lit(""))
        blobs = versions.select(address(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
        held, batch = self.pairs(), 0
        if held is None:
            blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
        else:
            batch = (held.agg(F.max("batch")).first()[0] or 0) + 1
            seen = held.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
            blobs = blobs.filter(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), "seen")) > 0)
        found = blobs.select(
            "blob", "text",
            *[F.when(~F.array_contains("seen", r.key), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"m{i}") for i, r in enumerate(rules)],
        )
        rows = found.select(
            "blob",
            F.inline(
                F.filter(
                    F.array(*[F.struct(F.lit(r.key).alias("rule"), F.when(F.col(f"m{i}").isNotNull(), find(F.col("text"), F.col(f"m{i}"), r)).alias("spans")) for i, r in enumerate(rules)]),
                    lambda x: x["spans"].isNotNull(),
                )
            ),
        )
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return batch

    def findings(self, versions: DataFrame, rules: Sequence[Rule] = RULES, content: str = "content") -> DataFrame:
        """All rows of ``versions`` with ``findings``: array of start, kind's place in ``rules``, end; sorted, empty if clean.

        The other columns stay as they are; a column named ``findings`` is replaced.
        """
        place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
        pairs = self.pairs().filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
        each = pairs.select("blob", F.col("rule"), "spans", place[F.col("rule")].alias("kind"))
        held = each.groupBy(F.col("blob").alias("_ledger_blob")).agg(
            F.array_sort(
                F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("kind").alias("kind"), s["end"].alias("end")))))
            ).alias("_ledger_found")
        )
        kept = [c for c in versions.columns if c.lower() != "findings"]
        none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        return versions.withColumn("_ledger_key", address(F.col(content))).join(held, F.col("_ledger_key") == F.col("_ledger_blob"), "left").select(
            *kept, F.coalesce("_ledger_found", none).alias("findings")
        )


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every found span replaced by ``mark``; overlapping spans become one mark.  Null stays null."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = F.aggregate(
        findings,
        begin,
        lambda a, f: F.when(f["start"] >= a["at"], F.struct(f["end"].alias("at"), F.concat(a["out"], text.substr(a["at"] + 1, f["start"] - a["at"]), F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], f["end"]).alias("at"), a["out"].alias("out"))
        ),
    )
    rest = F.concat(end["out"], text.substr(end["at"] + 1, F.length(text)))
    return F.when(text.isNull() | (F.size(findings) == 0), text).otherwise(rest)
