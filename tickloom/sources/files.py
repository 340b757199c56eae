"""File sources and sinks besides Parquet: CSV, JSON, text reports, tick archives, settings, caches."""

from __future__ import annotations

import hashlib
import json
import lzma
import struct
import tomllib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.functions.columns import finite, to_float
from tickloom.shipping import ship

#: A record of a tick archive, big-endian: offset, ask, bid, ask volume, bid volume.
RECORD = np.dtype([("offset", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_vol", ">f4"), ("bid_vol", ">f4")])


def price_scale(instrument: Column) -> Column:
    """Units of an archive's integer prices: thousandths for metals and yen pairs, else hundred-thousandths."""
    return F.when(instrument.startswith("XAU") | instrument.startswith("XAG") | instrument.contains("JPY"), 1_000.0).otherwise(100_000.0)


def read_archives(files: DataFrame, scale: float = 1_000.0) -> DataFrame:
    """Ticks of hourly archives: files has hour_ms and content (LZMA); empty content gives none."""

    ship(files.sparkSession)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                raw = np.frombuffer(lzma.decompress(row.content), RECORD) if row.content else np.zeros(0, RECORD)
                yield pd.DataFrame({"hour_ms": row.hour_ms, "seq": np.arange(len(raw), dtype=np.int64), "time_ms": row.hour_ms + raw["offset"].astype(np.int64), "ask": raw["ask"] / scale, "bid": raw["bid"] / scale, "ask_vol": raw["ask_vol"].astype(float), "bid_vol": raw["bid_vol"].astype(float)})

    return files.select("hour_ms", "content").mapInPandas(decode, "hour_ms long, seq long, time_ms long, ask double, bid double, ask_vol double, bid_vol double")


def write_archives(ticks: DataFrame, scale: float = 1_000.0) -> DataFrame:
    """hour_ms and content of the archives that read_archives() reads."""

    ship(ticks.sparkSession)

    def encode(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["time_ms", "seq"])
        raw = np.zeros(len(df), RECORD)
        raw["offset"] = df.time_ms - df.hour_ms
        for c in ("ask", "bid"):
            raw[c] = np.floor(df[c] * scale + 0.5)
        for c in ("ask_vol", "bid_vol"):
            raw[c] = df[c]
        return pd.DataFrame({"hour_ms": [df.hour_ms.iloc[0]], "content": [lzma.compress(raw.tobytes())]})

    hour = (F.floor(F.col("time_ms") / 3_600_000) * 3_600_000).cast("long")
    return ticks.withColumn("hour_ms", hour).select("hour_ms", "seq", "time_ms", "ask", "bid", "ask_vol", "bid_vol").groupBy("hour_ms").applyInPandas(encode, "hour_ms long, content binary")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives below a folder, the hour taken from names like .../2024/00/05/13h_ticks.bi5 (months from 0)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*h_ticks.bi5").option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.regexp_extract("path", r"(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$", k).cast("int")
    hour = F.unix_timestamp(F.make_timestamp(part(1), part(2) + 1, part(3), part(4), F.lit(0), F.lit(0), F.lit("UTC"))) * 1000
    return files.select(hour.alias("hour_ms"), "content")


def read_bars_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bars of a CSV, one for each time (the first line of equal times), times as UTC."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    first = F.row_number().over(Window.partitionBy("time").orderBy(F.monotonically_increasing_id()))
    return df.withColumn("_f", first).filter("_f = 1").drop("_f")


def monthly_rows(lines: DataFrame, column: str) -> DataFrame:
    """Rows whose label is a month like 2024M05."""
    return lines.filter(F.col(column).rlike(r"^\d{4}M\d{2}$"))


#: Numbers of a report line, in order.  Fixed values: their names.
REPORT_COLUMNS = ("trades", "win_rate", "edge", "pf", "kelly", "max_dd", "n_eff", "se", "t", "sharpe", "ci_lo", "ci_hi")
_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|nan|inf|-inf)"


def parse_reports(lines: DataFrame) -> DataFrame:
    """source, part (foldN, pooled_oof, holdout) and its numbers from report lines (source, line_no, value); the last
    line of a part counts."""
    pattern = r"^\s*(fold\d+|pooled_oof|holdout)\b[:\s]+" + r"\s+".join([_NUMBER] * len(REPORT_COLUMNS))
    got = lines.withColumn("part", F.regexp_extract("value", pattern, 1)).filter("part != ''")
    got = got.withColumns({c: to_float(F.regexp_extract("value", pattern, k + 2)) for k, c in enumerate(REPORT_COLUMNS)})
    last = F.row_number().over(Window.partitionBy("source", "part").orderBy(F.col("line_no").desc()))
    return got.withColumn("_l", last).filter("_l = 1").select("source", "part", *REPORT_COLUMNS)


def parse_verdicts(lines: DataFrame) -> DataFrame:
    """source and verdict (yes, no) from lines like `EDGE: yes (...)`."""
    return lines.withColumn("verdict", F.lower(F.regexp_extract("value", r"EDGE:\s*(yes|no|YES|NO)", 1))).filter("verdict != ''").select("source", "verdict")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Nested settings and metrics, one JSON object a file."""
    return spark.read.option("multiLine", True).json(path)


def sanitised(df: DataFrame) -> DataFrame:
    """Doubles that aren't finite as null, as JSON asks."""
    return df.withColumns({c: finite(F.col(c), None) for c, t in df.dtypes if t in ("double", "float")})


def write_parquet(df: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """Sorted ZSTD Parquet; the range partitions make the files disjoint."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    sanitised(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """Rows added to a manifest: CSV files of one folder."""
    df.write.mode("append").option("header", True).csv(path)


def parameter_key(**parameters) -> str:
    """A name that the parameters decide, for tables kept between runs."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def kept(spark: SparkSession, path: str, make, **parameters) -> DataFrame:
    """The table under the parameters' key, made if it isn't there yet."""
    target = f"{path}/{parameter_key(**parameters)}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        make().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def settings(path: str, overrides: dict | None = None) -> dict:
    """Flat settings from a sectioned file, `section.key` or bare keys overridden."""
    with Path(path).open("rb") as f:
        data = tomllib.load(f)
    flat = {}
    for section, values in data.items():
        flat |= {k: v for k, v in values.items()} if isinstance(values, dict) else {section: values}
    return flat | {k.rpartition(".")[2]: v for k, v in (overrides or {}).items()}


def normaliser_row(stats: DataFrame, path: str) -> None:
    """Statistics of a normaliser as a one-row table beside the model."""
    stats.write.mode("overwrite").parquet(path)


def pack_record(offset: int, ask: int, bid: int, ask_vol: float, bid_vol: float) -> bytes:
    """One archive record; what tests build archives from."""
    return struct.pack(">IIIff", offset, ask, bid, ask_vol, bid_vol)
