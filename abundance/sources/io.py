"""Sources and sinks (survey IDs S1-S5).

Reads keep text as text (no schema inference: an ISO timestamp with an
offset must stay local text, trap T1), apply caller-listed missing-value
sentinels (T2), clean the names, then cast with ``try_cast`` so a bad
cell becomes NULL instead of failing the job.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundance.functions.columns import col
from abundance.operators.clean import clean_names, snake_case


def _apply_sentinels(df: DataFrame, sentinels: Sequence[str], blank_as: str | None,
                     text_cols: Sequence[str]) -> DataFrame:
    sent = [s for s in sentinels if s is not None]
    exprs = {}
    for c in text_cols:
        e = F.when(col(c).isin(sent), F.lit(None)).otherwise(col(c)) if sent else col(c)
        if blank_as is not None:
            e = F.coalesce(e, F.lit(blank_as))
        exprs[c] = e
    return df.withColumns(exprs) if exprs else df


def _files_by_header(spark: SparkSession, path: str | Sequence[str], sep: str) -> list[list[str]]:
    """The files under ``path`` grouped by their header line: one header-less
    read that keeps the first line of each file (its start of block 0); one
    row per file is collected."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").select("file", "value", F.monotonically_increasing_id().alias("i")).groupBy("file").agg(
        F.min_by("value", "i").alias("header"))
    groups: dict[str, list[str]] = {}
    for r in sorted(map(tuple, first.collect())):
        groups.setdefault(r[1].strip("\ufeff\r"), []).append(unquote(r[0]))
    return list(groups.values()) or [[path] if isinstance(path, str) else list(path)]


def read_survey_csv(spark: SparkSession, path: str | Sequence[str], types: dict[str, str] | None = None,
                    sentinels: Sequence[str] = ("NA",), blank_as: str | None = None,
                    clean: bool = True, sep: str = ",") -> DataFrame:
    """CSV with a header, every column read as text, names cleaned,
    sentinel text (``NA``, ``NIL`` ...) -> NULL, then typed by ``types``
    ({clean_name: spark type}) with ``try_cast``.

    Blank cells are NULL (Spark's reader); ``blank_as=''`` gives R's
    ``read.csv`` behaviour for text columns (blank text = empty string).
    Files are split and read in parallel by Spark. Files whose headers
    differ (another column order, or other columns) are read apart and
    stacked by name.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("mode", "PERMISSIVE")
    parts = [reader.csv(files) for files in _files_by_header(spark, path, sep)]
    parts = [clean_names(p) if clean else p for p in parts]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    types = {snake_case(k) if clean else k: v for k, v in (types or {}).items()}
    text_cols = [c for c in df.columns if types.get(c, "string") == "string"]
    df = _apply_sentinels(df, sentinels, None, df.columns)
    df = df.withColumns({c: col(c).try_cast(t) for c, t in types.items() if c in df.columns and t != "string"})
    if blank_as is not None:
        df = df.withColumns({c: F.coalesce(col(c), F.lit(blank_as)) for c in text_cols})
    return df


def _numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value, __file, __n, __more): the lines of text files; ``__n`` counts
    the lines of a file's first block from 0 (null in later blocks) and
    ``__more`` tells that the file goes on after its first block. A block's
    lines come to one task in their order, whatever the number of tasks."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("__more"))

    def number(batches):
        import numpy as np
        import pyarrow as pa

        file, n = None, 0
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            codes = b.column(1).dictionary_encode()
            index, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            key = np.where(at == 0, index, -1)                       # blocks beyond the first: -1
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
            out = np.zeros(len(key), np.int64)
            for s, e in zip(starts, [*starts[1:], len(key)]):
                name = names[key[s]] if key[s] >= 0 else None
                if name != file:
                    file, n = name, 0
                out[s:e] = np.arange(n, n + e - s)
                n += e - s
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, mask=at != 0), b.column(3)], names=["value", "__file", "__n", "__more"])

    return lines.mapInArrow(number, "value string, __file string, __n long, __more boolean")


def read_tsv_with_preamble(spark: SparkSession, path: str | Sequence[str], skip: int = 4,
                           clean: bool = True, sep: str = "\t") -> DataFrame:
    """Tab-delimited exports with ``skip`` preamble lines, all text.

    Files are split and read line by line, in parallel. A task numbers the
    lines of each file's first block as it reads them, so a line's number
    depends on its file alone and not on how tasks were made; the header is
    the first line after the preamble that is not blank. One row per file, its
    header and that number, reaches the driver. Blank lines are skipped; CRLF
    and LF line ends both work. Files with different headers are stacked by
    name. The preamble must lie within a file's first block
    (``spark.sql.files.maxPartitionBytes``); it is an error if it does not.
    """
    lines = _numbered_lines(spark, path)
    heads = (lines.where("__n is not null").groupBy("__file").agg(
        F.max("__n").alias("last"), F.min_by("value", F.when((F.col("__n") >= skip) & (F.length("value") > 0), F.col("__n"))).alias("__header"),
        F.min(F.when((F.col("__n") >= skip) & (F.length("value") > 0), F.col("__n"))).alias("__head"), F.max("__more").alias("more")).collect())
    if any(r["more"] and r["__head"] is None for r in heads):
        raise ValueError(f"{path}: a preamble is longer than a file block")
    heads = [r for r in heads if r["__head"] is not None]
    if not heads:
        raise ValueError(f"{path}: no header line after {skip} preamble lines")
    known = spark.createDataFrame([(r["__file"], r["__head"], r["__header"]) for r in heads], "__file string, __head long, __header string")
    body = (lines.join(F.broadcast(known), "__file")                                          # one row per file
            .where((F.length("value") > 0) & (F.col("__n").isNull() | (F.col("__n") > F.col("__head"))))
            .select("__header", F.split(F.col("value"), sep).alias("__cells")))
    parts = []
    for h in sorted({r["__header"] for r in heads}):
        names = h.split(sep)
        sel = body.where(F.col("__header") == h).select(*[F.get(F.col("__cells"), F.lit(i)).alias(n) for i, n in enumerate(names)])
        parts.append(clean_names(sel) if clean else sel)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class Campaign:
    """Campaign-parameterised paths, so one workflow serves any campaign.

    ``raw("count")`` -> ``<root>/raw/<name>_count.csv``; tidy tables live
    in one Parquet dataset per table, partitioned by ``campaign``, so many
    campaigns run in one job and one campaign is overwritten alone.
    """
    name: str
    root: str

    def raw(self, what: str, ext: str = "csv") -> str:
        return posixpath.join(self.root, "raw", f"{self.name}_{what}.{ext}")

    def tidy(self, table: str) -> str:
        return posixpath.join(self.root, "tidy", table)


def save_table(df: DataFrame, campaign: Campaign, table: str) -> str:
    """S3: write a tidy table, replacing only this campaign's partition."""
    out = campaign.tidy(table)
    (df.withColumn("campaign", F.lit(campaign.name)).write
       .option("partitionOverwriteMode", "dynamic").mode("overwrite")
       .partitionBy("campaign").parquet(out))
    return out


def load_table(spark: SparkSession, campaign: Campaign, table: str, all_campaigns: bool = False) -> DataFrame:
    """S3: read a tidy table; the campaign filter prunes partitions."""
    df = spark.read.parquet(campaign.tidy(table))
    return df if all_campaigns else df.where(F.col("campaign") == campaign.name).drop("campaign")


def write_csv(df: DataFrame, path: str, drop: Sequence[str] = (), single_file: bool = False) -> str:
    """CSV results with a header, dropping columns first. ``single_file``
    is for small report tables only (one writer task)."""
    out = df.drop(*drop)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def z_order(lon: str, lat: str, bits: int = 16) -> Column:
    """Place of a point on a Z-shaped curve over the globe: the bits of its
    longitude and latitude cells in turn, so near points have near values."""
    def spread(c, low, span):
        cell = F.floor((F.col(c).cast("double") - low) / span * F.lit(float(1 << bits)))
        v = F.greatest(F.least(cell, F.lit((1 << bits) - 1)), F.lit(0)).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))          # the usual bit spreading
        return v

    return spread(lon, -180.0, 360.0).bitwiseOR(F.shiftleft(spread(lat, -90.0, 180.0), 1))


def save_points(df: DataFrame, path: str, lon: str, lat: str, group_bytes: int = 16 << 20, files: int | None = None) -> str:
    """Write a point table so that an extent filter (``clean.within_bbox``)
    reads little: rows are range-partitioned and sorted along ``z_order``, and
    Parquet's minima and maxima of longitude and latitude then let a reader
    skip row groups outside the extent. Points without a place come first."""
    z = z_order(lon, lat)
    laid = df.withColumn("__z", z)
    laid = laid.repartitionByRange(files, "__z") if files else laid.repartitionByRange("__z")
    (laid.sortWithinPartitions("__z").drop("__z").write.mode("overwrite")
     .option("parquet.block.size", group_bytes).option("parquet.page.size", min(group_bytes, 1 << 20)).parquet(path))
    return path


def write_tsv_with_preamble(df: DataFrame, path: str, preamble: Sequence[str] = ("", "", "", ""), sep: str = "\t") -> str:
    """Tab-delimited files as an annotation tool exports them: each file has
    the preamble lines, a header and its rows (missing: empty)."""
    head = "\n".join([*preamble, sep.join(df.columns)])
    cells = F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("")) for c in df.columns])
    rows = df.select(cells.alias("value"))

    def with_head(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head], b.schema.field(0).type)], schema=b.schema)
                first = False
            yield b

    rows.mapInArrow(with_head, "value string").write.mode("overwrite").text(path)
    return path
