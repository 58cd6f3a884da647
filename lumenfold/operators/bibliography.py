"""Reference lists in texts: the heading, the entries under it as rows, and their authors and years.

A list is cut into lines once, and entries are running counts of the lines that begin one: a numbered list's by their
markers, an author-year list's by what a line looks like beside the line before it. Both readings are made, and each
document's own counts decide between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.session import checkpoint

# Bounds of a list and of its entries, and words that are no surnames.
MAX_ENTRIES, MAX_ENTRY, MIN_LETTERS, MAX_AUTHORS = 1000, 2000, 12, 220
NO_NAMES = "et al and in press the".split()
PARTICLES = "van von de da di du le la del der".split()

_YEAR = r"(?<![\p{L}\p{N}])(?:19|20)[0-9]{2}[a-z]?(?![\p{L}\p{N}])"
_MARKER = r"^(?:\[([0-9]{1,4})\]|\(([0-9]{1,4})\)|([0-9]{1,4})(?=[.:\s]|$))"


def below_heading(text: Column) -> Column:
    """What stands below the heading of the reference list; null without one.

    The heading is ``references``, else ``bibliography``, a word of its own on a line with at most six other signs before it, none of them a letter.
    """

    def cut(word: str) -> Column:
        line = rf"(?i)(?<![^\r\n])[^\p{{L}}\r\n]{{0,6}}{word}(?=[^\S\r\n]{{0,3}}(?:[\r\n]|$))"
        return F.get(F.split(text, line, 2), F.lit(1))

    return F.coalesce(cut("references"), cut("bibliography"))


def collapse(c: Column) -> Column:
    """Blanks and control signs drawn together, soft hyphens left out, trimmed."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\xad"), F.lit("")), r"(?U)[\s\p{Cntrl}]+", " "))


def surname(piece: Column) -> Column:
    """The last word of an author that is no initials, folded; null where that is no name."""
    words = F.transform(F.split(piece, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    initials = lambda w: F.regexp_replace(w, r"[^\p{L}]", "").rlike(r"^\p{Lu}{1,3}$")
    words = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(NO_NAMES) & ~initials(w))
    last = F.try_element_at(words, F.lit(-1))
    return F.when(last.rlike(r"^\p{Lu}[\p{L}'’-]+$"), F.lower(last))


def author_year(entry: Column) -> Column:
    """(first, second, year) of an entry that begins with its authors: surnames folded, the second where there is one; null without name or year."""
    at = F.regexp_instr(entry, F.lit(_YEAR))
    authors = F.split(F.substr(entry, F.lit(1), at - 1), r"\(", 2)[0]
    names = F.filter(F.transform(F.split(F.regexp_replace(authors, " & | and ", ","), ","), surname), lambda n: n.isNotNull())
    # a year further in than the authors' bound is the title's or the text's
    there = (at > 0) & (at <= MAX_AUTHORS + 1) & (F.size(names) > 0)
    return F.when(there, F.struct(F.get(names, F.lit(0)).alias("first"), F.get(names, F.lit(1)).alias("second"), F.regexp_substr(entry, F.lit(_YEAR)).alias("year")))


def _begins(line: Column, indent: Column, before: Column, indent_before: Column) -> Column:
    """A line that looks like an entry's first: a capital or particle, a comma or stop early on, a comma or year; outdented, or behind a finished line."""
    word = F.regexp_extract(line, r"^(\S+)", 1)
    looks = (word.rlike(r"^\p{Lu}") | word.isin(PARTICLES)) & F.substring(line, 1, 60).rlike("[,.]") & (line.contains(",") | line.rlike(_YEAR))
    return looks & F.when(indent == indent_before, before.rlike(r"[.)/]$|[0-9]$")).otherwise(indent < indent_before)


def list_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, seq, line, indent) of the lines under each document's heading that aren't blank."""
    # exploding null gives no rows, so the heading is looked for once
    lines = docs.select(key, F.posexplode(F.split(below_heading(F.col(text)), "[\r\n]")).alias("seq", "raw"))
    return lines.select(key, "seq", collapse(F.col("raw")).alias("line"), F.char_length(F.regexp_extract("raw", r"(?U)^(\s*)", 1)).alias("indent")).filter("line <> ''")


def _entries(lines: DataFrame, key: str, part: str) -> DataFrame:
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), " ")
    return lines.groupBy(key, part).agg(whole.alias("text"), F.min("seq").alias("seq"))


def _enough(entry: Column) -> Column:
    return F.char_length(F.regexp_replace(entry, r"[^\p{L}]", "")) >= MIN_LETTERS


def reference_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number, text, first, second, year, doi) of the entries of each document's reference list.

    A numbered list has its own numbers (of a number that comes twice the first entry, 1 to 1000); an author-year list is numbered in order. It is
    read as the latter if it has at least three such entries and its numbers are under three, run in sequence for less than half, or are less
    than half as many. An entry has at least twelve letters, and is cut at 2 000 with an ellipsis. Documents without a heading have no rows; a
    heading inside running text, or a list without one, isn't looked for. ``key`` names a row: texts of one key are read as one.
    """
    order = W.partitionBy(key).orderBy("seq")
    lines = checkpoint(list_lines(docs, key, text))  # both readings start from the lists' lines alone
    mark = F.regexp_extract("line", _MARKER, 0)
    number = F.when(mark != "", F.regexp_replace(mark, "[^0-9]", "").cast("int"))
    lines = lines.withColumn("number", F.when(number.between(1, MAX_ENTRIES), number)).withColumn("begins", _begins(F.col("line"), F.col("indent"), F.lag("line").over(order), F.lag("indent").over(order)))
    lines = lines.withColumn("part", F.count("number").over(order)).withColumn("group", F.count_if(F.coalesce("begins", F.lit(False))).over(order))

    numbered = _entries(lines.filter("part > 0"), key, "part")
    numbered = numbered.withColumn("number", F.regexp_extract("text", r"^\D?([0-9]+)", 1).cast("int")).filter(_enough(F.col("text")))
    numbered = numbered.groupBy(key, "number").agg(F.min_by("text", "seq").alias("text"))

    # a piece without an author and year was part of the entry above it
    pieces = _entries(lines, key, "group")
    pieces = _entries(pieces.withColumn("own", author_year(F.col("text")).isNotNull() | F.lag("seq").over(order).isNull()).withColumn("group", F.count_if("own").over(order)).withColumnRenamed("text", "line"), key, "group")
    named = pieces.filter(author_year(F.col("text")).isNotNull() & _enough(F.col("text"))).withColumn("number", F.row_number().over(order)).filter(F.col("number") <= MAX_ENTRIES)

    # the longest run of successive numbers: number minus place is one value within a run
    runs = numbered.withColumn("run", F.col("number") - F.row_number().over(W.partitionBy(key).orderBy("number"))).groupBy(key, "run").count()
    sizes = runs.groupBy(key).agg(F.sum("count").alias("n"), F.max("count").alias("longest"))
    counts = named.groupBy(key).agg(F.count("*").alias("u")).join(sizes, key, "full")
    by_name = (F.col("u") >= 3) & ((F.coalesce("n", F.lit(0)) < 3) | (F.col("longest") * 2 < F.col("n")) | (F.col("u") > F.col("n") * 2))
    choice = counts.select(key, F.coalesce(by_name, F.lit(False)).alias("by_name"))
    both = numbered.select(key, "number", "text", F.lit(False).alias("by_name")).unionByName(named.select(key, "number", "text", F.lit(True).alias("by_name")))
    cut = F.when(F.char_length("text") >= MAX_ENTRY, F.concat(F.rtrim(F.substring("text", 1, MAX_ENTRY)), F.lit("…"))).otherwise(F.col("text"))
    told = author_year(F.regexp_replace("text", _MARKER + r"[.:]?\s*", ""))
    return both.join(choice, [key, "by_name"], "left_semi").select(key, "number", cut.alias("text"), told["first"].alias("first"), told["second"].alias("second"), told["year"].alias("year"), tx.doi(F.col("text")).alias("doi"))
