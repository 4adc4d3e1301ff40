"""Sinks: snapshots and their retention, title history, CSV and TSV, workbooks, sitemaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.functions import scoring, text
from seamark.operators.sitemap import chunked, sitemap_entries

#: Fixed value: days that a snapshot is kept.
KEPT_DAYS = 30


def save_snapshot(pages: DataFrame, folder: str, name: str, saved_at: int) -> str:
    """Writes a crawl under its day and a safe name; returns the path. A day's folder is the unit of retention."""
    day = pd.Timestamp(saved_at, unit="s", tz="UTC").strftime("%Y-%m-%d")
    path = f"{folder}/saved_day={day}/{saved_at}_{text.safe_file_name(name)}"
    pages.withColumn("saved_at", F.lit(saved_at).cast("long")).write.mode("overwrite").parquet(path)
    return path


def is_kept(saved_at: Column, now: Column | None = None, days: int = KEPT_DAYS) -> Column:
    """Whether a snapshot saved at that second is kept."""
    return saved_at >= (now if now is not None else F.unix_timestamp()) - F.lit(days * 86_400)


def expired_days(spark: SparkSession, folder: str, now: int, days: int = KEPT_DAYS) -> list[str]:
    """Day folders that hold only snapshots past their time."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    limit = pd.Timestamp(now - days * 86_400, unit="s", tz="UTC").strftime("%Y-%m-%d")
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(str(p) for p in found if p.getName().startswith("saved_day=") and p.getName()[10:] < limit)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append_title_history(pages: DataFrame, path: str, crawl: str, saved_at: int, seed: str) -> None:
    """Appends a JSON line a page: when, which crawl, title and description."""
    title_history(pages, crawl, saved_at, seed).write.mode("append").json(path)


def title_history(pages: DataFrame, crawl: str, saved_at: int, seed: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return pages.filter(F.coalesce("url", F.lit("")) != "").select(
        text.iso_time(F.lit(saved_at)).alias("ts"), F.lit(crawl).alias("crawl"), F.lit(seed).alias("seed"), "url", blank("title"), blank("meta_description")
    )


def as_cells(df: DataFrame) -> DataFrame:
    """Every column as text: yes and no, lists joined, records as JSON, null as empty."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "boolean":
            return text.yes_no(c)
        if kind == "array<string>":
            return F.coalesce(F.array_join(c, ", "), F.lit(""))
        if kind.startswith(("array", "struct", "map")):
            return F.coalesce(F.to_json(c), F.lit(""))
        return F.coalesce(c.cast("string"), F.lit(""))

    return df.select(*(cell(n, k).alias(n) for n, k in df.dtypes))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """All cells quoted, with a header, Windows line ends; ``sep`` may be a tab."""
    as_cells(df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("sep", sep).option("lineSep", "\r\n").csv(path)


def all_pages(pages: DataFrame) -> DataFrame:
    """Pages with issues joined and their score, for export."""
    return pages.select("url", "status_code", "title", "title_len", "meta_description", "h1", "word_count", "canonical", "depth", "response_time", F.array_join("issues", "; ").alias("issues"), scoring.page_score(F.col("issues")).alias("score"))


def write_workbook(sheets: dict[str, DataFrame], path: str, most: int = 1_048_575) -> list[str]:
    """One sheet a frame: a spreadsheet file where a writer is installed and the sheets fit into one, else a CSV folder a sheet."""
    names = text.safe_sheet_names(list(sheets))
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        openpyxl = None
    if openpyxl and all(df.limit(most + 1).count() <= most for df in sheets.values()):
        with pd.ExcelWriter(path + ".xlsx") as w:
            for n, df in zip(names, sheets.values(), strict=True):
                as_cells(df).toPandas().to_excel(w, sheet_name=n, index=False)
        return [path + ".xlsx"]
    out = []
    for n, df in zip(names, sheets.values(), strict=True):
        out.append(f"{path}/{text.safe_file_name(n)}")
        write_csv(df, out[-1])
    return out


def union_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports of the same columns under one another, each with its label."""
    out = None
    for label, df in reports.items():
        rows = df.select(F.lit(label).alias("report"), "*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


SITEMAP_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def sitemap_files(pages: DataFrame, seq: str) -> DataFrame:
    """``chunk, urls, xml``: sitemap files of at most 50 000 addresses each (a file's own limit bounds what is gathered)."""
    entries = chunked(sitemap_entries(pages, seq))
    line = F.concat(F.lit("<url><loc>"), text.xml_escape(F.col("url")), F.lit("</loc>"), F.when(F.col("lastmod") != "", F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    rows = entries.groupBy("chunk").agg(F.count(F.lit(1)).alias("urls"), F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return rows.select("chunk", "urls", F.concat(F.lit(SITEMAP_HEAD + "\n"), body, F.lit("\n</urlset>")).alias("xml"))


def sitemap_index(root: str, chunks: int) -> str:
    """Index of several sitemap files."""
    inner = "\n".join(f"<sitemap><loc>{root.rstrip('/')}/sitemap-{i}.xml</loc></sitemap>" for i in range(1, chunks + 1))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n{inner}\n</sitemapindex>'


def write_sitemaps(files: DataFrame, path: str) -> None:
    """Each file written by the task that holds it, as ``chunk=N`` text."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["chunk", "xml"]].rename(columns={"xml": "value"})

    files.select("chunk", "xml").mapInPandas(lines, "chunk int, value string").write.mode("overwrite").partitionBy("chunk").text(path)
