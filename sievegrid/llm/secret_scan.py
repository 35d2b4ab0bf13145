"""Secret scans with an incremental ledger of blobs, in DataFrame expressions only.

Every version of every path is addressed by its content: the blob is the SHA-256 of the text.
The ledger, a Parquet folder that each scan appends to, says which rules have seen which blobs, and
what they found.  A rule goes by its name and version, so a scan reads only blobs that are new, or old
blobs for rules that are new or changed; all the rest comes from the ledger.  A blob's entry is
written in one piece with its findings, so a scan that breaks off leaves nothing half seen.
Findings then go back to all paths by a join on the blob.

Copies meet as partial aggregates, one text a task, so a blob that a third of the paths hold
is no burden.  Matches are leftmost and don't overlap; a match counts if the rule's group has
``least`` code points.  Places count code points, the end is exclusive; they are running sums over
a text's gaps and matches, so work grows with the matches.

Null texts count as empty; null and repeated ids are carried through, a row each; long texts are whole;
an empty table gives an empty result; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

BROADCAST_BLOBS = 1 << 17  # 64 hexadecimal digits each: 8 MB


def either_case(words: str) -> str:
    """A pattern's small letters in either case; spelt out, as engines fold case differently."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() and c.isascii() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """``group`` of a match of ``pattern`` has to have ``least`` code points; a text without ``anchor`` has no match."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    anchor: str = ""
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# fixed values: the three kinds that every scan reports
BASE = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a run of fewer is no match, and holds none
)
# kinds beyond them, by the public formats of such keys
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", anchor="PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}", anchor="gh"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", anchor="xox"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", anchor="eyJ"),
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[^\x20\x09-\x0D/@:]+@", anchor="://"),
)
RULES = BASE + MORE
_ENTRY = "blob string, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"


class Ledger:
    """The folder of entries (blob, rules that have seen it, what they found)."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or store.new_path(spark, "secret-ledger")

    def entries(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(_ENTRY).parquet(self.path)

    def append(self, entries: DataFrame) -> None:
        entries.write.mode("append").parquet(self.path)


def _pieces(text: Column, rule: Rule) -> Column:
    """The gap before each match of the rule, the match, and whether it counts; the text's end last."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    cut = F.arrays_zip(F.split(text, rule.pattern).alias("gap"), whole.alias("whole"), value.alias("value"))
    # fields by place: what arrays_zip calls them depends on the expressions
    sizes = F.transform(
        cut.cast("array<struct<gap:string,whole:string,value:string>>"),
        lambda x: F.struct(F.lit(rule.key).alias("rule"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["whole"]).alias("size"), (F.char_length(x["value"]) >= rule.least).alias("counts")),
    )
    some = text.rlike(rule.pattern)
    if rule.anchor:
        some = F.when(text.contains(rule.anchor), some).otherwise(False)
    return F.when(some, sizes).otherwise(F.array().cast("array<struct<rule:string,gap:int,size:int,counts:boolean>>"))


def scan_texts(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger entries of (blob, text, pending); ``pending`` lists the keys of the rules to apply."""
    pieces = F.flatten(F.array(*(F.when(F.array_contains("pending", r.key), _pieces(F.col("text"), r)).otherwise(F.array()) for r in rules)))
    rows = texts.select("blob", "pending", F.posexplode_outer(pieces).alias("at", "x")).select("blob", "pending", "at", "x.*")
    # a group is one rule in one text; the texts are dealt by blob already, so nothing shuffles here
    so_far = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.coalesce("size", F.lit(0))).over(so_far))
    span = F.when(F.col("counts"), F.struct("rule", (F.col("end") - F.col("size")).alias("start"), "end"))
    return rows.groupBy("blob").agg(F.first("pending").alias("rules"), F.collect_list(span).alias("spans"))


def _pending(blobs: DataFrame, entries: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, pending): the blobs that some rule hasn't seen."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    seen = entries.join(blobs, "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    pending = F.when(F.col("seen").isNull(), keys).otherwise(F.array_except(keys, "seen"))
    return blobs.join(seen, "blob", "left").select("blob", pending.alias("pending")).where(F.size("pending") > 0)


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """All columns of ``versions`` but the text, with ``blob`` and ``secrets``, the findings of ``rules``.

    ``secrets`` is an array of (start, rank, kind, end), ordered; ``rank`` is the rule's place in
    ``rules``.  Blobs and rules that the ledger hasn't met are scanned and added to it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blob = F.sha2(text, 256).alias("blob")
    keys = [r.key for r in rules]
    entries = ledger.entries()
    contents = versions.select(blob, text.alias("text"))
    if entries is None:
        texts = contents.dropDuplicates(["blob"]).withColumn("pending", F.array(*map(F.lit, keys)))
        ledger.append(scan_texts(texts, rules))
    else:
        pending = store.keep(_pending(versions.select(blob).distinct(), entries, rules), "pending-blobs")
        count = pending.count()
        if count:
            if count <= BROADCAST_BLOBS:
                contents = contents.join(F.broadcast(pending.select("blob")), "blob", "left_semi")
            texts = contents.dropDuplicates(["blob"]).join(pending.hint("merge"), "blob")
            ledger.append(scan_texts(texts, rules))
        store.drop(pending)
    held = ledger.entries().where(F.size("spans") > 0).select("blob", F.filter("spans", lambda s: s["rule"].isin(keys)).alias("spans")).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ranks, names = F.array(*map(F.lit, keys)), F.array(*(F.lit(r.name) for r in rules))
    rank = lambda s: F.array_position(ranks, s["rule"]).cast("int")
    # a blob that two scans met at once has its findings twice
    spans = F.array_distinct(F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), F.get(names, rank(s) - 1).alias("kind"), s["end"].alias("end")))))
    # a table, so that both sides of the join shuffle as they are and a blob of many paths can be split
    held = store.keep(held.select(F.col("blob").alias("sg_blob"), spans.alias("secrets")), "secrets")
    # extra columns may be called blob or secrets
    own = [c for c in versions.columns if c not in (text_col, "blob", "secrets")]
    paths = versions.select(*own, blob)
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    joined = paths.join(held, paths["blob"] == held["sg_blob"], "left")
    return joined.select(*(paths[c] for c in own), paths["blob"], F.coalesce(held["secrets"], nothing).alias("secrets"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
