"""Delimited text: sniffing, reading, numeric inference, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNIFF_LINES, SNIFF_BYTES = 20, 64 * 1024
DELIMITERS = [",", ";", "\t"]
# Byte order marks.
MARKS = [(b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")]
# Encodings tried when a file isn't UTF-8.
ENCODINGS = "gb18030 shift_jis big5 euc-kr windows-1252".split()


def sniff_delimiter(sample: str) -> str:
    """The delimiter that splits the first lines into the most fields, outside quotes; ties go to the comma."""
    best, most = ",", 0
    lines = sample[:SNIFF_BYTES].splitlines()[:SNIFF_LINES]
    for d in DELIMITERS:
        count = 0
        for line in lines:
            quoted = False
            for ch in line:
                quoted ^= ch == '"'
                count += ch == d and not quoted
        if count > most:
            best, most = d, count
    return best


def detect_encoding(head: bytes) -> str:
    """By its mark; else UTF-8 if it is that; else the encoding whose reading has the most letters of a script and no controls."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    try:
        head[: len(head) - len(head) % 4 or len(head)].decode("utf-8", "strict")
        return "UTF-8"
    except UnicodeDecodeError as e:
        if e.start >= len(head) - 4 and e.reason == "unexpected end of data":
            return "UTF-8"

    def score(name: str) -> float:
        text = head.decode(name, "replace")
        wide = sum(0x3040 <= ord(c) <= 0x30FF or 0x4E00 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7A3 or c.isascii() for c in text)
        bad = sum(c == "�" or ord(c) < 9 or 0xE000 <= ord(c) <= 0xF8FF for c in text)
        return (wide - 5 * bad) / max(1, len(text))

    return max(ENCODINGS, key=lambda n: (score(n), -ENCODINGS.index(n)))


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of the first file: Spark reads them, so any store will do."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").limit(1)
    first = files.first()
    if first is None:
        return b""
    rows = spark.read.format("binaryFile").load(first["path"]).select(F.substring("content", 1, SNIFF_BYTES).alias("c")).first()
    return bytes(rows["c"])


def read_delimited(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """CSV of whatever delimiter and encoding; RFC quotes, any line ends, text columns; rows without a value are dropped."""
    head = _head(spark, path)
    encoding = detect_encoding(head)
    sep = sniff_delimiter(head.decode(encoding, "replace").lstrip("﻿"))
    df = spark.read.csv(path, sep=sep, header=header, encoding=encoding, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return df.dropna("all")


def numeric(c: Column) -> Column:
    """The number of a plain decimal; text with leading zeros, signs of plus or exponents stays text (null)."""
    return F.when(c.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$"), c.try_cast("double"))


def infer_numbers(df: DataFrame) -> DataFrame:
    """Text columns of which every filled cell is a plain decimal become numbers."""
    names = [c for c, kind in df.dtypes if kind == "string"]
    if not names:
        return df
    plain = df.agg(*(F.coalesce(F.bool_and(F.when(F.col(c) != "", numeric(F.col(c)).isNotNull())), F.lit(False)).alias(c) for c in names)).first()
    return df.withColumns({c: numeric(F.col(c)) for c in names if plain[c]})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def tsv_rows(df: DataFrame) -> Column:
    """A row as clipboard text: tab-separated, cells with tabs, line ends or quotes quoted."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[\t\n\r"]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws("\t", *(cell(c) for c in df.columns))
