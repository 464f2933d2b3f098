"""Writers of results: exports of a match run, registered files, summaries and workbooks."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header each, all values quoted where they need it; the committer makes it whole or not at all."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def export_match(clusters: DataFrame, canonical: DataFrame, rows: DataFrame, decisions: DataFrame, path: str, *, columns: Sequence[str], excluded: Sequence[str] = (), allow_unresolved: bool = False, settled: DataFrame | None = None) -> dict[str, int]:
    """Writes canonical, clean, original and audit of a run below a path and gives their row counts.

    canonical is one row a cluster with a column a field, clean has every input row with its cluster, original the
    rows as they came, audit the decisions. Pairs that wait for review stop the export unless they are allowed.
    """
    open_pairs = decisions.where("decision = 'possible_match'")
    if settled is not None:
        open_pairs = open_pairs.join(settled.select("left", "right"), ["left", "right"], "left_anti")
    if not allow_unresolved and not open_pairs.isEmpty():
        raise ValueError("pairs wait for review")
    shown = [c for c in columns if c not in excluded]
    wide = canonical.where(F.col("column_name").isin(*shown)).groupBy("cluster_id", "survivor_row_id").pivot("column_name", shown).agg(F.first("value"))
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.array_join(F.array_sort(F.collect_list("row_id")), ";").alias("source_row_ids"))
    frames = {
        "canonical": wide.join(sizes, "cluster_id").select("cluster_id", *shown, "member_count", "source_row_ids"), "clean": rows.join(clusters.select("row_id", "cluster_id"), "row_id").select("row_id", "cluster_id", *shown),
        "original": rows.select("row_id", *shown), "audit": decisions.select("decision_id", "left", "right", "decision", "score", "reason"),
    }
    counts = {}
    for name, df in frames.items():
        write_csv(df, f"{path}/{name}")
        counts[name] = df.sparkSession.read.option("header", True).csv(f"{path}/{name}").count()
    return counts


def export_entry(kind: str, path: str, content: bytes, row_count: int, *, final: bool = True) -> dict:
    """Registry entry of an exported file."""
    return {"kind": kind, "path": path, "sha256": hashlib.sha256(content).hexdigest(), "row_count": row_count, "is_final": final}


def overwrite_job(df: DataFrame, path: str, job_id: str) -> None:
    """Replaces the rows of one job in a table partitioned by job, and no others."""
    df.withColumn("job_id", F.lit(job_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def filled_columns(df: DataFrame) -> list[str]:
    """The columns that hold any value; empty ones are left out of a workbook."""
    row = df.agg(*[F.max((F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "").cast("int")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c]]


def photo_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, position, url): one row per address in a column of addresses."""
    return df.select(key, F.posexplode(F.split(F.trim(column), r"\s+")).alias("position", "url")).where("url LIKE 'http%'")


def summary(df: DataFrame, figures: Sequence[str]) -> DataFrame:
    """(column_name, filled, numbers, least, middle, mean, most, total) of columns of numbers as text or numbers."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in figures])).alias("e")
    x = df.select(cells).select("e.column_name", "e.v", F.col("e.v").try_cast("double").alias("x"))
    return x.groupBy("column_name").agg(
        F.count_if(F.coalesce("v", F.lit("")) != "").alias("filled"), F.count("x").alias("numbers"), F.min("x").alias("least"), F.percentile_approx("x", 0.5, 100000).alias("middle"), F.avg("x").alias("mean"), F.max("x").alias("most"), F.sum("x").alias("total"),
    )


def breakdown(df: DataFrame, by: str, top: int = 10, average: str | None = None) -> DataFrame:
    """(value, n, share, average) of the most frequent values of a column, ties by value; share of all filled rows."""
    filled = df.where(F.coalesce(F.col(by).cast("string"), F.lit("")) != "")
    total = filled.count()
    mean = F.avg(F.col(average).try_cast("double")) if average else F.lit(None).cast("double")
    g = filled.groupBy(F.col(by).cast("string").alias("value")).agg(F.count("*").alias("n"), mean.alias("average"))
    return g.select("value", "n", (F.col("n") / F.lit(total)).alias("share"), "average").orderBy(F.desc("n"), "value").limit(top)


_SHEET = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def workbook(sheets: Mapping[str, tuple[Sequence[str], Sequence[Sequence[object]]]]) -> bytes:
    """An XLSX file of small sheets (name -> header, rows); numbers stay numbers, all else is text. For reports that a person reads, not for whole tables."""

    def cell(value: object, r: int, k: int) -> str:
        ref = f"{_letters(k)}{r}"
        if value is None or value == "":
            return ""
        if isinstance(value, int | float) and not isinstance(value, bool):
            return f'<c r="{ref}"><v>{value}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value)[:32000])}</t></is></c>'

    out = io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, (head, rows) in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(v, r, c) for c, v in enumerate(row))}</row>' for r, row in enumerate([head, *rows], 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", _SHEET.format(body))
    return out.getvalue()
