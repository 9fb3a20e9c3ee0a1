import gzip

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom.functions.text import citation_numbers, cut_words, normalise, spaced, stem, stems_of, strip, unquote, words
from ragloom.sources.articles import parse_articles, scan_articles, write_articles


@pytest.mark.parametrize("raw, want", [(" \t a b  ﻿", "a b"), ("", ""), (" \n ", ""), ("x\ry", "x\ry")])
def test_strip(one, raw, want):
    assert one(strip(F.col("s")), s=raw) == want


@pytest.mark.parametrize("raw, want", [("\"a'", "a"), ('""a"', '"a'), ("'", ""), ("a", "a")])
def test_unquote_drops_one_mark_each_side(one, raw, want):
    assert one(unquote(F.col("s")), s=raw) == want


def test_normalise(one):
    assert one(normalise(F.col("s")), s="﻿﻿a\r\nb\rc") == "﻿a\nb\rc"


@pytest.mark.parametrize("w, want", [
    ("queries", "query"), ("eies", "eie"), ("movies", "movy"), ("houses", "house"), ("toes", "toe"), ("cats", "cat"),
    ("bus", "bus"), ("class", "class"), ("s", ""), ("limit", "limit"),
])
def test_stem(one, w, want):
    assert one(stem(F.col("s")), s=w) == want


def test_words_split_on_anything_but_letters_and_digits(one):
    assert one(words(F.col("s")), s="--UNABLE_TO_LOCK row-lock, Élan 3x!") == ["unable", "to", "lock", "row", "lock", "élan", "3x"]


def test_citation_numbers(one):
    assert one(citation_numbers(F.col("s")), s="a [2] [0][99] [x] [123456789012345678901]") == [2, 0, 99, None]


def parse(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    return [tuple(r)[1:] for r in parse_articles(rows).orderBy("i").collect()]


def test_headers(spark):
    got = parse(
        spark,
        "﻿---\r\ntitle: \"A: b'\r\ncategory:\r\nsource_url: http://x/y:z\r\nnoise\r\n---\r\n\r\n body \r\n",
        "no header\n---\n",
        "---\ntitle: one\ntitle: two\n---",
        "---\n---\nbody",
        "---\n\n---\nbody",
        "---\n: v\n title : 'q'\n---extra\nrest",
        "",
    )
    assert got == [
        ("A: b", "", "http://x/y:z", "body"),
        ("Untitled", None, None, "no header\n---"),
        ("two", None, None, ""),
        ("Untitled", None, None, "---\n---\nbody"),
        ("Untitled", None, None, "body"),
        ("q", None, None, "extra\nrest"),
        ("Untitled", None, None, ""),
    ]


def test_empty_title_is_kept(spark):
    assert parse(spark, "---\ntitle:\n---\nx")[0][0] == ""


def test_scan(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_articles(spark, str(tmp_path))
    (tmp_path / "b.md").write_text("two\nlines")
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.md").write_text("deeper")
    got = scan_articles(spark, str(tmp_path)).orderBy("path").collect()
    assert [r["raw"] for r in got] == ["one", "two\nlines"]


def test_many_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(400):
        (tmp_path / f"{i}.md").write_text(f"---\ntitle: T{i}\n---\nb{i}\n")
    monkeypatch.setattr("ragloom.sources.articles.READ_TASKS", 2)
    files = scan_articles(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted((r["title"], r["body"]) for r in parse_articles(files).collect()) == sorted((f"T{i}", f"b{i}") for i in range(400))


def test_articles_are_written_one_a_file_and_read_back(spark, tmp_path):
    """No process and no settings a file; what a repeated task leaves behind is not scanned."""
    texts = [f"---\ntitle: T{i}\n---\nä{i}\r\n" for i in range(60)] + [None, "", "\n"]
    to = tmp_path / "articles"
    write_articles(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), f"file://{to}")
    (to / ".part-00000-0-1").write_text("an attempt that was cut off")
    got = scan_articles(spark, str(to), "*.txt")
    assert "binaryFile" in got._jdf.queryExecution().toString()
    assert sorted(r["raw"] for r in got.collect()) == sorted((t or "") + "\n" for t in texts)
    assert not list(to.glob("*.crc")) and len(list(to.glob("*.txt"))) == len(texts)
    write_articles(spark.createDataFrame([], "t string"), str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        scan_articles(spark, str(tmp_path / "none"), "*.txt")


def test_compressed_articles_are_still_read(spark, tmp_path):
    (tmp_path / "a.md.gz").write_bytes(gzip.compress("zipped é".encode()))
    for pattern in ("*.md.gz", "*"):
        assert [r["raw"] for r in scan_articles(spark, str(tmp_path), pattern).collect()] == ["zipped é"]


def test_words_and_stems_of_a_task_are_those_of_spark(spark):
    """What tasks take apart and stem as whole arrays is what the columns give."""
    texts = ["", " ", "Row-locks, rows!", "ies eies aies bies es aes ees oes bes s us ss bs ß", "ÉTÉS İs ΟΔΟΣ 日本 x1s\u00a0ys", "\n--\n", "é", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = rows.select("i", words(F.col("t")).alias("w"), F.transform(words(F.col("t")), stem).alias("s"), spaced(F.col("t")).alias("one")).orderBy("i").collect()
    cut = cut_words(pa.array([r["one"] for r in got], pa.string())).to_pylist()
    assert [c or [] for c in cut] == [r["w"] or [] for r in got]
    assert [stems_of(pa.array(r["w"], pa.string())).to_pylist() for r in got if r["w"]] == [r["s"] for r in got if r["w"]]


def test_a_scan_reads_no_file_before_it_is_used(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "empty.md").write_text("")
    sc = spark.sparkContext
    sc.setJobGroup("scan", "")
    try:
        files = scan_articles(spark, str(tmp_path))
        with pytest.raises(FileNotFoundError):
            scan_articles(spark, str(tmp_path), "empty.*")
        assert not sc.statusTracker().getJobIdsForGroup("scan")
        assert [r["raw"] for r in files.collect()] == ["x"]
        assert sc.statusTracker().getJobIdsForGroup("scan")
    finally:
        sc.setJobGroup("", "")
