"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds a row for
each blob and rule version ever scanned, findings or none; only pairs it lacks are scanned, each blob
once however many paths hold it, and the findings are joined back to all paths. The ledger is a
Parquet table in a shared folder and only grows by appending. Two writers at once may both append a blob; a
blob's rows of one rule version are alike, and one of them is read.

Nulls count as empty texts (a blob like any other, without findings); a null id is a path like any other;
texts are whole, whatever their length; repeated rows each get their row; other columns are
not read (``redact`` keeps them). An empty table scans nothing and returns no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import cut, forget, new_table, trim, with_group, written

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_either_case = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"""({_either_case})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are greedy, so a run of 24 or more is the same match as one of any length
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Derived from the rules, so that every blob is scanned again when one of them changes.
RULE_VERSION = "base-" + hashlib.sha256(repr((KINDS, ASSIGN.pattern, ACCESS.pattern, HEX.pattern, LEAST_VALUE, LEAST_ACCESS)).encode()).hexdigest()[:12]
#: Up to so many blobs with findings, they are broadcast to be redacted; beyond, texts are shuffled to them.
BROADCAST_BLOBS = 100_000


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every secret in the text, in order; code points, end exclusive."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


FINDINGS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
LEDGER = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for whole in batches:
        for i in range(0, whole.num_rows, 512):
            batch = whole.slice(i, 512)
            found = [find(t) if t else [] for t in batch.column(1).to_pylist()]
            spans = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x) for x in found]
            counts = [pa.array([sum(k == kind for _, k, _ in x) for x in found], pa.int64()) for kind in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([RULE_VERSION] * len(found)), *counts, pa.array([hashlib.sha256(s.encode()).hexdigest() for s in spans]), pa.array(spans)], [c.split()[0] for c in LEDGER.split(", ")])
    trim()


class BlobLedger:
    """The table of scanned blobs at ``path``, which need not exist yet."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path) if self.exists else self.spark.createDataFrame([], LEDGER)

    def known(self) -> DataFrame:
        """What the ledger has of the rules as they are, a row for each blob."""
        return self.rows().where(F.col("rule_version") == RULE_VERSION).drop("rule_version").dropDuplicates(["blob"])

    def add(self, versions: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Scan what the ledger lacks and append it; returns path, blob and place of every row of ``versions``."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = versions.select(F.col(id_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), F.xxhash64(F.col(id_col)).alias("place"), text.alias("content"))
        paths = written(blobs.drop("content"), "paths")
        # The place of a blob that is read for it: only digests are shuffled to find it.
        unseen = paths.groupBy("blob").agg(F.min("place").alias("place"))
        if self.exists:
            unseen = unseen.join(self.rows().where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
        fresh = blobs.select("blob", "place", "content").join(unseen.hint("shuffle_hash"), ["blob", "place"], "left_semi")
        # Repeated rows of one path share blob and place.
        fresh.select("blob", "content").mapInArrow(_scan, LEDGER).dropDuplicates(["blob"]).write.mode("append").parquet(self.path)
        self.exists = True
        return paths

    def scan(self, versions: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Add ``versions`` and return id, blob and findings of every row of them."""
        paths = self.add(versions, id_col, text_col).drop("place")
        known = self.known().join(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("rows")), "blob")
        return with_group(paths, cut(known), "blob", FINDINGS, F.xxhash64("path")).withColumnRenamed("path", id_col)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, blob (hex) of every row; a new ledger if none is named."""
    ledger = BlobLedger(docs.sparkSession, ledger_path or new_table(docs.sparkSession, "ledger"))
    return ledger.scan(docs, id_col, text_col).select(id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.lower(F.hex("blob")).alias("blob"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", ledger_path: str | None = None) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]`` and the character count set anew where that changed.

    Rows without findings are as they were; no row is dropped.
    """
    ledger = BlobLedger(docs.sparkSession, ledger_path or new_table(docs.sparkSession, "ledger"))
    ledger.add(docs, id_col, text_col)
    found = ledger.known().where(F.col("spans") != "").select("blob", "spans")

    @F.pandas_udf("string")
    def without(texts, spans):
        return texts.combine(spans, lambda t, s: t if not s else _cut(t, s))

    # The row is kept as one column, so that no name of its own can clash.
    keyed = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"))
    if found.count() <= BROADCAST_BLOBS:
        found = F.broadcast(found)
    joined = keyed.join(found, "blob", "left")
    changed, old = F.col("spans").isNotNull(), F.col("row").getField(text_col)
    new = F.when(changed, without(old, F.col("spans"))).otherwise(old)
    joined = joined.select("row", changed.alias("changed"), new.alias("text"))
    values = {text_col: F.col("text"), count_col: F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("row").getField(count_col))}
    return joined.select([(values[c] if c in values else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _cut(text: str, spans: str) -> str:
    """The text with the union of the spans replaced, overlapping ones by one mark."""
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
