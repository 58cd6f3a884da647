"""Sources of a research library: references, work records, attachments, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.text import abstract_text, html_to_text

#: Rows with text of these kinds can be read without another engine.
TEXT_KINDS = "txt md csv tsv json xml html log py".split()

WORK = (
    "id string, doi string, title string, publication_year int, cited_by_count bigint, type string, language string, is_retracted boolean,"
    " abstract_inverted_index map<string, array<int>>,"
    " authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, institutions: array<struct<id: string, display_name: string>>>>,"
    " primary_location struct<source: struct<id: string, display_name: string>>,"
    " topics array<struct<id: string, display_name: string, score: double>>, keywords array<struct<id: string, display_name: string>>,"
    " grants array<struct<funder: string, funder_display_name: string>>, referenced_works array<string>"
)


def works(json: DataFrame, column: str = "json") -> dict[str, DataFrame]:
    """Work records (JSON text) as relational tables: source, people, topics, keywords, grants and cites."""
    w = json.select(F.from_json(column, WORK).alias("w")).select("w.*").filter("id is not null")
    many = lambda c, *fields: w.select(F.col("id").alias("source"), F.posexplode(c).alias("seq", "x")).select("source", "seq", *(F.col(f"x.{f}").alias(n) for f, n in fields))
    people = w.select(F.col("id").alias("source"), F.posexplode("authorships").alias("seq", "x"))
    return {
        "source": w.select("id", F.lower(F.regexp_replace("doi", r"^https?://(dx\.)?doi\.org/", "")).alias("doi"), "title", F.col("publication_year").alias("year"), F.col("cited_by_count").alias("citations"), "type", "language", F.coalesce("is_retracted", F.lit(False)).alias("retracted"), F.when(F.col("abstract_inverted_index").isNotNull(), abstract_text(F.col("abstract_inverted_index"))).alias("abstract"), F.col("primary_location.source.id").alias("venue_id"), F.col("primary_location.source.display_name").alias("venue")),
        "people": people.select("source", "seq", F.col("x.author.id").alias("person"), F.col("x.author.display_name").alias("name"), F.col("x.author.orcid").alias("orcid")),
        "institutions": people.select("source", F.explode("x.institutions").alias("i")).select("source", F.col("i.id").alias("institution"), F.col("i.display_name").alias("name")).distinct(),
        "topics": many("topics", ("id", "topic"), ("display_name", "name"), ("score", "score")),
        "keywords": many("keywords", ("id", "keyword"), ("display_name", "name")),
        "grants": many("grants", ("funder", "funder"), ("funder_display_name", "name")),
        "cites": w.select(F.col("id").alias("source"), F.posexplode("referenced_works").alias("seq", "cited")),
    }


def parse_ris(df: DataFrame, column: str = "text") -> DataFrame:
    """(title, authors, year, doi, url) of each record of RIS text."""
    records = df.select(F.explode(F.split(column, r"(?m)^ER  ?-.*$")).alias("r"))
    tag = lambda names: F.trim(F.regexp_extract("r", rf"(?m)^(?:{names})  ?- (.*)$", 1))
    some = lambda c: F.when(c != "", c)
    out = records.select(
        some(tag("TI|T1")).alias("title"),
        F.transform(F.regexp_extract_all("r", F.lit(r"(?m)^(?:AU|A1)  ?- (.*)$"), F.lit(1)), lambda a: F.trim(a)).alias("authors"),
        F.regexp_extract(tag("PY|Y1"), r"(\d{4})", 1).try_cast("int").alias("year"),
        some(F.lower(F.regexp_replace(tag("DO"), r"^https?://(dx\.)?doi\.org/", ""))).alias("doi"),
        some(tag("UR")).alias("url"),
    )
    return out.filter("title is not null or doi is not null")


def parse_bibtex(df: DataFrame, column: str = "text") -> DataFrame:
    """(key, kind, title, authors, year, doi, url) of each entry of BibTeX text."""
    entries = df.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)(@\w+\s*\{.*?)(?=\n\s*@\w+\s*\{|\z)"), F.lit(1))).alias("e"))
    value = lambda name: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?is)\b{name}\s*=\s*(\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}|\"[^\"]*\"|\d+)", 1), r'^[{"]|[}"]$|[{}]', ""))
    some = lambda c: F.when(c != "", c)
    return entries.select(
        F.regexp_extract("e", r"@\w+\s*\{\s*([^,\s]+)", 1).alias("key"),
        F.lower(F.regexp_extract("e", r"@(\w+)", 1)).alias("kind"),
        some(F.regexp_replace(value("title"), r"\s+", " ")).alias("title"),
        F.filter(F.transform(F.split(value("author"), r"(?i)\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "").alias("authors"),
        F.regexp_extract(value("year"), r"(\d{4})", 1).try_cast("int").alias("year"),
        some(F.lower(value("doi"))).alias("doi"),
        some(value("url")).alias("url"),
    )


def bibtex(title: Column, authors: Column, year: Column, doi: Column) -> Column:
    """A BibTeX entry; its key is the first author's family name and the year."""
    family = F.lower(F.regexp_replace(F.split(F.coalesce(F.try_element_at(authors, F.lit(1)), F.lit("anon")), ",")[0], r"[^\p{L}]", ""))
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {name} = {{"), c.cast("string"), F.lit("},\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("@article{"), family, F.coalesce(year.cast("string"), F.lit("")), F.lit(",\n"), line("title", title), line("author", F.array_join(authors, " and ")), line("year", year), line("doi", doi), F.lit("}"))


def apa(title: Column, authors: Column, year: Column, venue: Column) -> Column:
    """An APA reference of authors written Family, Given."""

    def name(a: Column) -> Column:
        given = F.regexp_replace(F.trim(F.coalesce(F.try_element_at(F.split(a, ","), F.lit(2)), F.lit(""))), r"(\p{L})[^\s-]*\.?", "$1.")
        return F.concat_ws(", ", F.trim(F.split(a, ",")[0]), F.when(given != "", given))

    names = F.transform(authors, name)
    n = F.size(names)
    joined = F.when(n <= 1, F.array_join(names, "")).when(n <= 20, F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", & "), F.try_element_at(names, F.lit(-1)))).otherwise(F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", … "), F.try_element_at(names, F.lit(-1))))
    return F.concat(joined, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("). "), title, F.lit("."), F.when(venue.isNotNull(), F.concat(F.lit(" "), venue, F.lit("."))).otherwise(F.lit("")))


# Folders that a walk doesn't enter.
SKIPPED = ".git .svn node_modules __pycache__ .venv".split()


def folder(spark: SparkSession, path: str, most: int = 50_000, depth: int = 32) -> DataFrame:
    """(path, name, size, modified, truncated) of the files under a folder, without their contents.

    Hidden files, SKIPPED folders and what is over ``depth`` folders down are left out; ``truncated`` says whether there are more than ``most``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    below = F.regexp_replace("path", r"^.*?\Q" + path.split("://")[-1].rstrip("/") + r"\E/", "")
    rest = F.split(below, "/")
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), rest.alias("_rest"))
    files = files.filter(~F.col("name").startswith(".") & ~F.arrays_overlap("_rest", F.array(*map(F.lit, SKIPPED))) & (F.size("_rest") <= depth + 1)).drop("_rest")
    listed = files.orderBy("path").limit(most + 1)
    place = F.row_number().over(W.orderBy("path"))  # of at most ``most`` + 1 rows
    return listed.select("*", (F.count("*").over(W.partitionBy()) > most).alias("truncated"), place.alias("_place")).filter(F.col("_place") <= most).drop("_place")


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text) of text attachments; pages as plain text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = F.decode("content", "UTF-8")
    return files.select("path", kind.alias("kind"), F.when(kind.isin("html", "htm"), html_to_text(text)).otherwise(text).alias("text")).filter(F.col("kind").isin([*TEXT_KINDS, "htm"]))
