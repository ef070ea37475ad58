"""Findings tables over any text column.

Each operator is one narrow pass: findings are computed as an array next to the
text and exploded, so only the few rows with findings leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pii, secrets
from ..functions.text import has_text


def explode_values(table: DataFrame, keys: list[str], values: Column, name: str) -> DataFrame:
    """``keys``, 0-based ``ordinal`` and one value per row.

    The outer form plus a filter keeps the optimizer from computing the array
    a second time to test whether it is empty.
    """
    return table.select(*keys, F.posexplode_outer(values).alias("ordinal", name)).where(
        F.col("ordinal").isNotNull()
    )


def explode_nonempty(table: DataFrame, keys: list[str], values: Column, name: str) -> DataFrame:
    """Rows whose array has values, the array kept whole and made once."""
    boxed = F.filter(F.array(values), lambda v: F.size(v) > 0)
    return table.select(*keys, F.explode_outer(boxed).alias(name)).where(F.col(name).isNotNull())


def pii_findings(table: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    found = explode_values(table, keys, pii.detect_pii(F.col(text)), "found")
    return found.select(*keys, "ordinal", "found.type", "found.value")


def secret_findings(
    table: DataFrame, keys: list[str], text: str = "text", label: str = "label"
) -> DataFrame:
    """Secret findings of ``text`` rows; blank texts are skipped."""
    scan = F.when(has_text(F.col(text)), secrets.scan_text(F.col(text), F.col(label)))
    found = table.select(*keys, F.explode_outer(scan).alias("found"))
    return found.where(F.col("found").isNotNull()).select(*keys, "found.*")


def scan_files(files: DataFrame) -> DataFrame:
    """Scan each file once: ``path, n_findings, lines`` of the files that hit.

    Contents never cross a shuffle; only these thin rows are joined to events.
    The hits come out of a generator, so the test for any hits is not pushed
    below it and made by scanning a second time.
    """
    lines = secrets.lines_sql("h", "path")
    summary = (
        f"transform(filter(array({secrets.hits_sql('content')}), h -> size(h) > 0), "
        f"h -> named_struct('n_findings', aggregate(h, 0, (a, x) -> a + x.n), 'lines', {lines}))"
    )
    scanned = files.select("path", F.explode_outer(F.expr(summary)).alias("found"))
    return scanned.where(F.col("found").isNotNull()).select("path", "found.*")


def scan_versions(versions: DataFrame) -> DataFrame:
    """``path, valid_from, n_findings, lines`` of every version of every file, clean ones too.

    ``versions`` has ``path, valid_from, content``; a clean version ends what the one before it held.
    """
    hits = F.expr(f"array({secrets.hits_sql('content')})")
    once = versions.select("path", "valid_from", F.explode_outer(hits).alias("h"))
    return once.selectExpr(
        "path", "valid_from", "coalesce(aggregate(h, 0, (a, x) -> a + x.n), 0) AS n_findings",
        f"coalesce({secrets.lines_sql('h', 'path')}, cast(array() AS array<string>)) AS lines",
    )


def redact(findings: DataFrame, value: str = "value") -> DataFrame:
    """Replace a raw value by its mask and its digest."""
    return findings.withColumns(
        {
            "masked": secrets.mask(F.col(value)),
            "value_sha256": F.sha2(F.col(value), 256),
        }
    ).drop(value)
