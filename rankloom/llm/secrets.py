"""Secret scans with an incremental blob ledger (operator 8)."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, small_batches, text_or_empty

#: Rules of the base, in order; matches under the least length are dropped.
BASE = ["assign", "access", "hex"]
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run of capitals and digits is taken whole, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Further rules. Public formats of common credentials.
MORE = {
    "private_key": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"), "PRIVATE KEY"),
    "github": (re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), "gh"),
    "slack": (re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
    "jwt": (re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"), "eyJ"),
    "google_key": (re.compile(r"\bAIza[0-9A-Za-z_-]{35}"), "AIza"),
    "url_login": (re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]{3,}@"), "://"),
}
KINDS = [*BASE, *MORE]

#: Goes up whenever a rule changes; a blob is scanned once for each version.
RULE_VERSION = "1.1"

_LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, "kind:start:end") of all findings, in code points, sorted."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in _HEX.finditer(text)]
    for rank, (kind, (pattern, hint)) in enumerate(MORE.items(), len(BASE)):
        if hint in text:
            out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text)]
    return sorted(out)


def _scan(version: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob, text in zip(batch["blob"], batch["text"], strict=True):
                spans = find(text)
                base = [s for s in spans if s[1] < len(BASE)]
                counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                out.append((blob, version, *counts, hashlib.sha256(",".join(s[2] for s in base).encode()).hexdigest(), ",".join(s[2] for s in spans)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _LEDGER.split(", ")])

    return scan


class BlobLedger:
    """Scanned (blob, rule version) pairs with their findings, as a Parquet table.

    ``path`` lies in a store that all machines share; new scans are appended, so a scan
    that dies half-way leaves no rows (Spark commits a write at its end) and is repeated.
    Its folders are the rule versions and, below, the blobs' first hex digits, so a scan
    reads one version's rows only and a repair can go digit by digit.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(f"{_LEDGER}, digit string").parquet(self.path).drop("digit")
        return self.spark.createDataFrame([], _LEDGER)

    def scan(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", version: str = RULE_VERSION) -> DataFrame:
        """Scans the blobs of ``docs`` not yet in the ledger under ``version``, appends
        them, and returns every row's findings, joined by its blob.

        A blob is the SHA-256 of a whole text (null: empty). Returns (key, blob, n_assign,
        n_access, n_hex, base_sha256, spans); repeated rows each get theirs, no rows: no
        rows. Only hashes are shuffled for all rows; texts go to the join that picks one
        row for each unseen blob, by key and blob, so a text that a third of all rows hold
        is scanned once and not gathered. Other columns are ignored.
        """
        small_batches(self.spark)
        rows = docs.select(F.col(key).alias("_key"), text_or_empty(docs, text).alias("text")).withColumn("blob", F.sha2("text", 256))
        paths = cut(rows.select("_key", "blob"))
        seen = self.rows().filter(F.col("rule_version") == version).select("blob")
        unseen = paths.groupBy("blob").agg(F.min("_key").alias("_first")).join(seen, "blob", "left_anti")
        unseen = cut(unseen.select(F.col("blob").alias("_blob"), "_first"))
        picked = rows.join(unseen.hint("shuffle_hash"), F.col("_key").eqNullSafe(F.col("_first")) & (F.col("blob") == F.col("_blob")), "left_semi")
        found = picked.select("blob", "text").mapInPandas(_scan(version), _LEDGER)
        # Rows equal in key and text were picked together; their findings are the same.
        found.dropDuplicates(["blob"]).withColumn("digit", F.substring("blob", 1, 1)).write.mode("append").partitionBy("rule_version", "digit").parquet(self.path)
        known = self.rows().filter(F.col("rule_version") == version).drop("rule_version").dropDuplicates(["blob"])
        known = cut(known.join(paths.select("blob").distinct(), "blob", "left_semi"))
        return paths.join(known, "blob").select(F.col("_key").alias(key), "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = BlobLedger(spark, f"{checkpoint_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    return ledger.scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


#: The patterns for DuckDB, whose (?i) would take letters beyond ASCII for A-Z.
_SQL_PATTERNS = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    **{kind: pattern.pattern for kind, (pattern, _) in MORE.items()},
}
_SQL_LEAST = {"assign": "length(regexp_extract(m, '{p}', 2)) >= 12", "access": "length(m) >= 18", "hex": "length(m) >= 16"}


def _sql() -> str:
    """DuckDB: matches and what lies between them give the places."""
    kinds = []
    for rank, kind in enumerate(KINDS):
        p = _SQL_PATTERNS[kind].replace("'", "''")
        least = _SQL_LEAST.get(kind, "true").replace("{p}", p)
        kinds.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, before + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, m, {least} AS ok
  FROM (SELECT doc_id, m, i, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS before
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(string_split_regex(text, '{p}')[:-2]) AS part, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM t))""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(kinds)}),
g AS (SELECT doc_id, rank, s, kind || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT AS span FROM f WHERE ok),
o AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM g GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN o USING (doc_id)
"""


SQL = _sql()
