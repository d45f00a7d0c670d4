"""Line scanners: leaked identifiers and credentials, and risky research idioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label and pattern of structural leaks.
LEAKS = [
    ("broker account id", r"\bDU[A-Z]?\d{6,}\b"),
    ("contract id", r"(?i)\b\d{8,9}\b.*conid"),
    ("slack bot token", r"xoxb-[A-Za-z0-9-]{8,}"),
    ("slack webhook", r"https://hooks\.slack\.com/services/\S+"),
    ("telegram bot token", r"\bbot\d{6,}:[A-Za-z0-9_-]{20,}"),
]
#: A credential key with its value, and values that are placeholders.
CREDENTIAL = r"""(?i)\b(tws_userid|tws_password|password|passwd|api[_-]?key|secret[_-]?key|access[_-]?token)\b\s*[=:]\s*["']?([^\s"'#]+)"""
PLACEHOLDER = r"(?i)^(your[_-]|xxx|<|\$\{|changeme|example|placeholder|paper[_-]|dummy|redacted|none|true|false|\d+$|.{0,2}$)"

#: Id, severity and patterns of risky idioms.
IDIOMS = [
    ("A1_hardcoded_sqrt_252", "minor", [r"\bsqrt\s*\(\s*252\s*\)"]),
    ("A2_filter_then_annualise", "minor", [r"\[[a-zA-Z_]+\s*!=\s*0(?:\.0)?\s*\]\s*\.", r"rets\s*\[\s*rets\s*!=\s*0", r"returns\s*\[\s*returns\s*!=\s*0"]),
    ("B1_pos_times_ret_no_shift", "major", [r"(?<!\.shift\(1\)\s)\bpositions?\s*\*\s*(?:bar_)?returns?\b", r"(?<!\.shift\(1\)\.fillna\(0\.0\)\s)\bpos\s*\*\s*(?:bar_)?ret(?:s|urns)?\b"]),
    ("B4_expanding_close", "minor", [r"\.expanding\([^)]*\)\.std\(\)", r"\.expanding\([^)]*\)\.mean\(\)", r"close\.expanding\("]),
    ("B5_ffill_after_reindex", "major", [r"\.reindex\([^)]*\)\.ffill\(", r"\.ffill\(\)\.reindex\("]),
    ("G1_local_sharpe_no_kwarg", "minor", [r"def\s+(_?\w*sharpe)\s*\(\s*[^,)]+\s*\):", r"def\s+(_?\w*sharpe)\s*\(\s*[^,)]+\s*\)\s*->"]),
    ("C4_global_zscore", "minor", [r"\([^)]*\.mean\(\)\s*\)\s*/\s*[^)]*\.std\(\)", r"\(\s*\w+\s*-\s*\w+\.mean\(\)\)\s*/\s*\w+\.std\(\)"]),
]
_SHARPE_CALL = ("A3_periods_per_year_default", "major")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_i", "line")).select(key, (F.col("_i") + 1).alias("line_no"), "line")


def _marks(hits: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, what) for hit, what in hits]))


def leak_scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line and leak it shows: label and excerpt. All patterns are tried in one pass over the lines."""
    line = F.col("line")
    value = F.regexp_extract(line, CREDENTIAL, 2)
    name = F.regexp_extract(line, CREDENTIAL, 1)
    hits = [(line.rlike(p), F.lit(label)) for label, p in LEAKS]
    hits.append((line.rlike(CREDENTIAL) & ~value.rlike(PLACEHOLDER), F.concat(F.lit("credential value ("), name, F.lit(")"))))
    return lines(df, key, text).select(key, "line_no", F.explode(_marks(hits)).alias("label"), F.substring(F.trim(line), 1, 120).alias("excerpt"))


def idiom_scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line and risky idiom, one at most of each; blank and comment lines are left out."""
    line = F.col("line")
    call = line.rlike(r"\bsharpe\s*\(") & ~line.contains("periods_per_year") & ~line.rlike(r"def\s+\w*sharpe") & ~line.contains("from ") & ~line.contains("import")
    hits = [(F.exists(F.array(*map(F.lit, ps)), lambda p: F.regexp_like(line, p)), F.struct(F.lit(i).alias("pattern_id"), F.lit(s).alias("severity"))) for i, s, ps in IDIOMS]
    hits.append((call, F.struct(F.lit(_SHARPE_CALL[0]).alias("pattern_id"), F.lit(_SHARPE_CALL[1]).alias("severity"))))
    bare = F.trim(line)
    kept = lines(df, key, text).where((bare != "") & ~bare.startswith("#"))
    return kept.select(key, "line_no", F.explode(_marks(hits)).alias("m"), F.substring(bare, 1, 200).alias("excerpt")).select(key, "line_no", "m.pattern_id", "m.severity", "excerpt")


def counts_by(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count("*").alias("n"))
