"""Secret scans over an incremental blob ledger.

Texts are content-addressed by SHA-256. The ledger is a folder of entries, one for each pair of a blob and a version of the
rules. A blob that it already holds under the present version isn't scanned again; every other blob is scanned once, however
many rows carry it, and its entry is written before findings are joined back to all rows by content address.
"""

from __future__ import annotations

import re

from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm.common import cut, hot_keys, map_rows, row_tie, spread_join, text_or_empty, texts_of
from wiretally.session import exists

#: To be raised with every change of the rules below.
RULE_VERSION = 2

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
).finditer
# A match that is long enough starts where the run starts, so the lengths can stand in the pattern.
ACCESS = re.compile("AKIA[A-Z0-9]{14,}").finditer
HEX = re.compile("[0-9a-f]{16,}").finditer
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]++-----END [A-Z ]*PRIVATE KEY-----)?").finditer
# Each run of word characters is entered once, at its start, and left at its first eyJ that eight more follow: an atomic group,
# so that a run of many eyJ isn't tried from every one of them.
JWT = re.compile(
    r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ[A-Za-z0-9_-]{8}))(?P<all>[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
).finditer
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}").finditer
#: Base kinds first, in the order that breaks ties between spans of one start.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "jwt", "github")


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every finding, in order; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS(text)]
    found += [(m.start(), 2, m.end()) for m in HEX(text)]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 3, m.end()) for m in PEM(text)]
    if "eyJ" in text:
        found += [(m.start("all"), 4, m.end()) for m in JWT(text)]
    if "gh" in text:
        found += [(m.start(), 5, m.end()) for m in GITHUB(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def spell(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in found)


def read_spans(spans: str) -> list[tuple[int, str, int]]:
    parts = (s.split(":") for s in spans.split(",") if s)
    return [(int(a), kind, int(b)) for kind, a, b in parts]


def blob_address(text_col: str = "text"):
    return F.sha2(text_or_empty(text_col), 256)


LEDGER = "blob string, rule_version int, n_assign long, n_access long, n_hex long, base_spans string, spans string"


class Ledger:
    """Entries in a folder of the shared file system. Each scan adds a folder of its own; one without Spark's mark of success, left
    by a run that died, isn't read. A blob that two runs scan at the same time has two equal entries, of which one is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        """Those of the present rules, one for each blob."""
        held = self.spark.createDataFrame([], LEDGER)
        if exists(self.spark, self.path):
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            parts = [str(f.getPath()) for f in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
            if parts := sorted(p for p in parts if exists(self.spark, f"{p}/_SUCCESS")):
                held = self.spark.read.schema(LEDGER).parquet(*parts)
        held = held.where(F.col("rule_version") == RULE_VERSION)
        return held.dropDuplicates(["blob"])

    def add(self, entries: DataFrame) -> None:
        entries.write.parquet(f"{self.path}/{uuid4().hex}")


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The ledger's new entries: one for each distinct text that it lacks under RULE_VERSION."""
    blobs = docs.select(blob_address(text_col).alias("blob"), text_or_empty(text_col).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")

    def make():
        def rows(batch):
            for blob, text in zip(batch.column("blob").to_pylist(), texts_of(batch), strict=True):
                found = find_secrets(text)
                base = [f for f in found if f[1] in BASE]
                n = [sum(f[1] == k for f in base) for k in BASE]
                yield (blob, RULE_VERSION, *n, spell(base), spell(found)), 64 * len(found)

        return rows

    schema = pa.schema(
        [("blob", pa.string()), ("rule_version", pa.int32())]
        + [(f"n_{k}", pa.int64()) for k in BASE]
        + [("base_spans", pa.string()), ("spans", pa.string())]
    )
    return map_rows(blobs, make, LEDGER, schema)


def scan_into(ledger: Ledger, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Scans what the ledger lacks, adds it, and returns the ledger's entries."""
    held = ledger.entries()
    ledger.add(scan_blobs(docs, None if held.isEmpty() else held, text_col))
    return ledger.entries()


def scan_documents(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row's whole text, scanning only texts that the ledger lacks.

    Returns doc_id, blob, n_assign, n_access, n_hex, base_spans and spans (kind:start:end, comma-joined), one
    row for each input row, repeated rows and ids included. A null text counts as empty and has no
    findings. Further columns are ignored; an empty table gives an empty table. Many copies of a text are one
    blob: the first of each task goes on to be scanned, and only rows of blobs with findings are joined, very frequent ones
    spread over many tasks.
    """
    found = scan_into(ledger, docs, text_col).where("spans <> ''").drop("rule_version")
    paths = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), blob_address(text_col).alias("blob"), row_tie().alias("_tie")))
    hot = hot_keys(paths.groupBy("blob").agg(F.count("*").alias("n")), "blob")
    out = spread_join(paths, found, "blob", "left", hot, F.col("_tie"))
    none = {"n_assign": 0, "n_access": 0, "n_hex": 0, "base_spans": "", "spans": ""}
    return out.select("doc_id", "blob", *(F.coalesce(F.col(c), F.lit(x)).alias(c) for c, x in none.items()))


def redact(text: str, spans: str) -> str:
    """The text with every finding replaced by its kind in brackets; of overlapping findings the first counts."""
    out, at = [], 0
    for a, kind, b in read_spans(spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, ledger: Ledger, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every finding in text_col replaced by its kind in brackets; all rows and columns stay.

    length_col, if there is one, follows the new length in code points of rows that changed. A null text stays null. Many rows
    of one text are spread over many tasks.
    """
    entries = scan_into(ledger, docs, text_col).where("spans <> ''").select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    blob = blob_address(text_col).alias("_blob")
    counts = cut(docs.groupBy(blob).agg(F.count("*").alias("n")).where("n > 1"))
    rows = docs.select(blob, row_tie().alias("_tie"), F.struct("*").alias("_row"))

    @F.pandas_udf("string")
    def blank(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else redact(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    out = spread_join(rows, entries, "_blob", "left", hot_keys(counts, "_blob"), F.col("_tie"))
    out = out.withColumn("_new", blank(F.col("_row")[text_col], F.col("_spans")))
    row = F.col("_row").withField(text_col, F.col("_new"))
    if length_col in docs.columns:
        old = F.col("_row")[length_col]
        kind = docs.schema[length_col].dataType
        row = row.withField(length_col, F.when(F.col("_spans").isNotNull(), F.length("_new").cast(kind)).otherwise(old))
    return out.select(row.alias("_row")).select("_row.*")
