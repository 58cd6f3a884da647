"""Passages: sentence context and packing of paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lumenfold.functions.text import is_heading, sentences, text_lines
from lumenfold.session import small_batches

MIN_BYTES, TARGET_BYTES, MAX_BYTES, MIN_LETTERS = 320, 1400, 2400, 20

#: Between two sentences: the blank stays with the first.
_SENTENCE = re.compile(r"(?<=[.?!] )(?=[A-Z])")


def sentence_context(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, seq, sentence, context): each sentence with the one before and the one after.

    A document's sentences are one array, so the neighbours are slices of it; no window or shuffle.
    """
    s = docs.select(key, sentences(F.col(text)).alias("s"))
    rows = F.transform("s", lambda x, i: F.struct(i.alias("seq"), x.alias("sentence"), F.array_join(F.slice("s", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " ").alias("context")))
    return s.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def _pack(paragraphs: list[str], least: int, target: int, most: int) -> list[str]:
    """Paragraphs packed in order into passages.

    A passage is closed before a paragraph when it has ``least`` bytes or the paragraph would take it over ``target``, unless it ends in
    a heading, which stays with what follows. One over ``most`` is cut at sentence ends into pieces of about
    ``target``; passages of fewer than MIN_LETTERS letters and digits go.
    """
    made: list[str] = []
    text, size, heading = [], 0, False
    for p in paragraphs:
        n = len(p.encode())
        if text and not heading and (size >= least or size + n > target):
            made += _cut("".join(text), target, most)
            text, size = [], 0
        if text:
            text.append(": " if heading else " ")
            size += len(text[-1])
        text.append(p)
        size += n
        heading = len(p) < 80 and not p.endswith((".", ",", ";", ":"))
    made += _cut("".join(text), target, most)
    return [t for t in made if sum(map(str.isalnum, t)) >= MIN_LETTERS]


def _cut(text: str, target: int, most: int) -> list[str]:
    if len(text.encode()) <= most:
        return [text]
    pieces, piece, size = [], [], 0
    for sentence in _SENTENCE.split(text):
        n = len(sentence.encode())
        if piece and size + n > target:
            pieces.append("".join(piece).strip())
            piece, size = [], 0
        piece.append(sentence)
        size += n
    return [*pieces, "".join(piece).strip()]


def passages(docs: DataFrame, key: str, text: str = "text", least: int = MIN_BYTES, target: int = TARGET_BYTES, most: int = MAX_BYTES) -> DataFrame:
    """(key, seq, passage): the lines of each text packed into passages, one text at a time in small batches, whatever a partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array((_pack(x.as_py() or [], least, target, most) for x in batch["lines"]), pa.list_(pa.string()))
            yield pa.record_batch([batch["key"], packed], ["key", "packed"])

    small_batches(docs.sparkSession)
    lines = docs.select(F.col(key).alias("key"), text_lines(F.col(text)).alias("lines"))
    made = lines.mapInArrow(run, StructType([StructField("key", lines.schema["key"].dataType), StructField("packed", ArrayType(StringType()))]))
    return made.select(F.col("key").alias(key), F.posexplode("packed").alias("seq", "passage"))


def headings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, seq, line, heading): each line with the nearest heading at or before it."""
    from pyspark.sql import Window as W

    lines = docs.select(F.col(key), F.xxhash64(key, text).alias("_t"), F.posexplode(F.split(text, "\n")).alias("seq", "line"))
    so_far = W.partitionBy(key, "_t").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(F.when(is_heading(F.col("line")), F.col("line")), ignorenulls=True).over(so_far)).drop("_t")


def leading_text(chunks: DataFrame, owner: str, seq: str, text: str, budget: int) -> DataFrame:
    """The first passages of each owner whose lengths stay within ``budget`` characters."""
    from pyspark.sql import Window as W

    upto = F.sum(F.char_length(text)).over(W.partitionBy(owner).orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    return chunks.withColumn("_upto", upto).filter(F.col("_upto") <= budget).drop("_upto")
