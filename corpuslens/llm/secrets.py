"""Secret scans with an incremental blob ledger (SQL functions only).

Every version of a document is addressed by the SHA-256 of its text (its blob).
A ledger table holds one row per (blob, rule set version) that was scanned, with
the findings. A run scans only pairs that the ledger doesn't have, appends them,
and joins findings back to every path that holds the blob.

Cases: null text is the empty blob; equal texts are scanned once and reported
for each row; repeated rows stay repeated; several rows of one path are its
versions; other columns are ignored and kept, whatever their names; an empty table gives an empty result and ledger entries for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import spans as S
from corpuslens.llm.common import filled, materialise, read, unused

ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Rules beyond the base ones: PEM private keys and JSON web tokens.
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
BASE = ("assign", "access", "hex")
RULES_VERSION = "rules-1"
SALTS = 16


def scan(text: Column) -> Column:
    """Findings of all rules in one text; ``assign``, ``access``, ``hex`` are the base."""
    return F.concat(
        S.find(text, ASSIGN, "assign", 0, lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 8),
        S.find(text, ACCESS, "access", 1, lambda v: F.length(v) >= 16),
        S.find(text, HEX, "hex", 2),
        S.find(text, PEM, "pem", 3),
        S.find(text, JWT, "jwt", 4),
    )


def addresses(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__path, __blob): the content address of every version; written once."""
    return materialise(versions.select(F.col(path_col).alias("__path"), F.sha2(filled(text_col), 256).alias("__blob")), "secret-paths")


def ledger_scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules_version: str = RULES_VERSION,
    path_col: str = "doc_id",
    text_col: str = "text",
    paths: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, one row per path with its blob).

    ``ledger`` has (blob, rules_version, findings). One row of each unseen blob
    carries the text to the scan: the choice among equal texts is by smallest
    path, and only ids are shuffled to make it. ``paths``: the versions' addresses, if known.
    """
    paths = addresses(versions, path_col, text_col) if paths is None else paths
    first = paths.groupBy("__blob").agg(F.min("__path").alias("__path"))
    if ledger is not None:
        seen = ledger.filter(F.col("rules_version") == rules_version).select(F.col("blob").alias("__blob")).distinct()
        first = first.join(seen, "__blob", "left_anti")
    texts = versions.select(F.col(path_col).alias("__path"), filled(text_col).alias("__text"))
    # Rows are streamed past a hash table of the chosen ids: texts are neither sorted nor aggregated.
    chosen = (
        texts.join(first.hint("shuffle_hash"), texts["__path"].eqNullSafe(first["__path"]))
        .filter(F.sha2("__text", 256) == F.col("__blob"))
        .select("__blob", "__text")
    )
    # The findings are filtered to the non-empty only for the join back; the ledger keeps all blobs.
    new = (
        chosen.select(F.col("__blob").alias("blob"), F.lit(rules_version).alias("rules_version"), scan(F.col("__text")).alias("findings"))
        .dropDuplicates(["blob"])
    )
    return materialise(new, "secret-ledger"), paths


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules_version: str = RULES_VERSION) -> DataFrame:
    """One row per row of ``paths``: __path, __blob, findings. A blob that very many paths
    share is dealt over SALTS keys."""
    found = (
        ledger.filter((F.col("rules_version") == rules_version) & (F.size("findings") > 0))
        .dropDuplicates(["blob"])
        .select(F.col("blob").alias("__blob"), "findings", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    )
    salted = paths.withColumn("__salt", F.pmod(F.xxhash64("__path"), F.lit(SALTS)).cast("int"))
    joined = salted.join(found, ["__blob", "__salt"], "left")
    return joined.select("__path", "__blob", F.coalesce("findings", F.expr(S.EMPTY)).alias("findings"))


def redacted(text: Column, findings: Column) -> Column:
    """``text`` with every finding replaced by ``[SECRET]``; overlapping findings merge."""
    return S.replaced(text, findings, lambda s: F.lit("[SECRET]"))


def redact(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text; rows without findings are untouched.

    Findings are per blob, so rows join on the blob of their own text; only texts with a finding change.
    """
    blob, salt, own = (unused(x, docs.columns) for x in ("__blob", "__salt", "__findings"))
    ledger, _ = ledger_scan(docs, path_col=path_col, text_col=text_col)
    found = (
        ledger.filter(F.size("findings") > 0)
        .select(F.col("blob").alias(blob), F.col("findings").alias(own), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    )
    rows = docs.withColumn(blob, F.sha2(filled(text_col), 256)).withColumn(salt, F.pmod(F.xxhash64(path_col), F.lit(SALTS)).cast("int"))
    out = rows.join(found.hint("shuffle_hash"), [blob, salt], "left")
    clean = F.when(F.col(own).isNotNull(), redacted(F.col(text_col), F.col(own))).otherwise(F.col(text_col))
    return out.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two runs: the ledger of the older half (by doc_id) is there when all versions come, so only blobs new to it are scanned."""
    docs = read(spark, sf_dir, "documents")
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    middle = ((ends["low"] or 0) + (ends["high"] or 0)) // 2
    paths = addresses(docs)
    earlier, _ = ledger_scan(docs.filter(F.col("doc_id") <= middle), paths=paths.filter(F.col("__path") <= middle))
    new, _ = ledger_scan(docs, earlier, paths=paths)
    rows = findings_by_path(paths, earlier.unionByName(new))
    base = F.filter("findings", lambda s: s["ord"] < len(BASE))
    return rows.select(
        F.col("__path").alias("doc_id"),
        *(S.count_kind(base, k).alias(f"n_{k}") for k in BASE),
        F.sha2(S.joined(base), 256).alias("base_sha256"),
        S.joined(F.col("findings")).alias("spans"),
        F.col("__blob").alias("blob"),
    )
