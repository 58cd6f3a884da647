from pyspark.sql import functions as F

from lumenfold.sources import delimited, library
from lumenfold.streaming import ingest


def test_sniffing():
    assert delimited.sniff_delimiter("a;b;c\n1;2;3") == ";"
    assert delimited.sniff_delimiter("a\tb\n1\t2") == "\t"
    assert delimited.sniff_delimiter('"a;b;c",d\n') == ","
    assert delimited.sniff_delimiter("plain") == ","
    assert delimited.detect_encoding("﻿a".encode("utf-8")) == "UTF-8"
    assert delimited.detect_encoding("a,ü".encode("utf-16-le").join([b"\xff\xfe", b""])) == "UTF-16LE"
    assert delimited.detect_encoding("供应商数据,中文内容".encode("gb18030")) == "gb18030"


def test_read_and_write(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿code;name;n\r\n007;"x;""y""";1.5\r\n;;\r\n012;z;2\r\n'.encode())
    df = delimited.infer_numbers(delimited.read_delimited(spark, str(tmp_path / "a.csv")))
    assert dict(df.dtypes) == {"code": "string", "name": "string", "n": "double"}
    assert [tuple(r) for r in df.orderBy("code").collect()] == [("007", 'x;"y"', 1.5), ("012", "z", 2.0)]
    delimited.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').count() == 2
    tsv = spark.createDataFrame([("a\tb", 'q"')], "x string, y string").select(delimited.tsv_rows(spark.createDataFrame([("", "")], "x string, y string")))
    assert tsv.first()[0] == '"a\tb"\t"q"""'


def test_references(spark):
    ris = "TY  - JOUR\nTI  - A Title\nAU  - Doe, Jane\nAU  - Roe, R.\nPY  - 2020/01\nDO  - https://doi.org/10.1/X\nER  - \nTY  - JOUR\nAU  - none\nER  - \n"
    r = library.parse_ris(spark.createDataFrame([(ris,)], "text string")).collect()
    assert [(x.title, x.authors, x.year, x.doi) for x in r] == [("A Title", ["Doe, Jane", "Roe, R."], 2020, "10.1/x")]
    bib = '@article{doe20,\n title = {The {DNA} of\n Things},\n author = "Doe, Jane and Roe, R.",\n year = 2020,\n doi={10.1/X}\n}\n\n@book{k2, title={Two}}'
    b = library.parse_bibtex(spark.createDataFrame([(bib,)], "text string")).orderBy("key").collect()
    assert [(x.key, x.kind, x.title, x.authors, x.year, x.doi) for x in b] == [("doe20", "article", "The DNA of Things", ["Doe, Jane", "Roe, R."], 2020, "10.1/x"), ("k2", "book", "Two", [], None, None)]
    df = spark.createDataFrame([("T", ["Doe, Jane Mary", "Roe, R."], 2020, "10.1/x", "J")], "t string, a array<string>, y int, d string, v string")
    assert df.select(library.apa(F.col("t"), F.col("a"), F.col("y"), F.col("v"))).first()[0] == "Doe, J. M., & Roe, R. (2020). T. J."
    assert df.select(library.bibtex(F.col("t"), F.col("a"), F.col("y"), F.col("d"))).first()[0].startswith("@article{doe2020,\n  title = {T}")


def test_works(spark):
    json = '{"id": "W1", "doi": "https://doi.org/10.1/A", "title": "T", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"id": "A1", "display_name": "Jane"}, "institutions": [{"id": "I1", "display_name": "U"}]}], "topics": [{"id": "T1", "display_name": "x", "score": 0.5}], "referenced_works": ["W2", "W3"]}'
    made = library.works(spark.createDataFrame([(json,), ("broken",), (None,)], "json string"))
    s = made["source"].first()
    assert (s.id, s.doi, s.year, s.abstract, s.retracted) == ("W1", "10.1/a", 2020, "a b", False)
    assert made["people"].first().person == "A1" and made["cites"].count() == 2 and made["topics"].first().score == 0.5 and made["grants"].count() == 0


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("<p>Hi</p>")
    (tmp_path / "sub" / "b.bin").write_bytes(b"12345")
    files = {r["name"]: r["size"] for r in library.folder(spark, str(tmp_path)).collect()}
    assert files == {"a.html": 9, "b.bin": 5}
    assert [(r.kind, r.text) for r in library.attachments(spark, str(tmp_path)).collect()] == [("html", "\nHi\n")]


def test_streamed_upserts_equal_a_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    incoming, target = str(tmp_path / "in"), str(tmp_path / "table")
    events.repartition(4).write.parquet(incoming)
    stream = ingest.tail(spark, incoming, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema), 1)
    ingest.run_to_end(ingest.upsert_batches(stream, "user_id", "event_id", target, str(tmp_path / "cp")))
    got = {r.user_id: r.event_id for r in spark.read.parquet(target).collect()}
    assert got == {r.user_id: r.e for r in events.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}


def test_streamed_windows_equal_a_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    made = lambda df: ingest.windowed(df, "ts", "1 day", ["event_type"], {"n": F.count("*")}, late="30 days")
    stream = made(ingest.tail(spark, str(tmp_path / "in"), schema, 1))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    ingest.run_to_end(q)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, made(events).collect()))
    assert ingest.sessions(events, "ts", "1 hour", ["user_id"], {"n": F.count("*")}).agg(F.sum("n")).first()[0] == events.count()
