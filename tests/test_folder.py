import os

import pytest
from pyspark.sql import functions as F

from ravelin.sources import folder


def put(root, name, text, at):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, ns=(at * 10**9, at * 10**9))


@pytest.fixture
def docs(spark, tmp_path):
    folder.register(spark)
    root = tmp_path / "docs"
    for k in range(12):
        put(root, f"d{k % 3}/page{k:02d}.{'md' if k % 2 else 'html'}", f"text {k} " * (k + 1), 1000 + k)
    put(root, "_hidden/x.md", "no", 1)
    put(root, ".git/x.md", "no", 1)
    put(root, "other.txt", "other", 999)
    return root


def rows(df):
    return sorted((r.path, r.extension, r.bytes, r.modified, bytes(r.content).decode()) for r in df.collect())


def test_batch_reads_what_is_there(spark, docs, tmp_path):
    df = spark.read.format("ravelin_folder").option("glob", "*.md,*.html").load(str(docs))
    got = rows(df)
    assert [g[0] for g in got] == sorted(f"d{k % 3}/page{k:02d}.{'md' if k % 2 else 'html'}" for k in range(12))
    assert all(g[4] == (docs / g[0]).read_text() and g[2] == len(g[4]) and g[3] % 10**6 == 0 for g in got)
    assert spark.read.format("ravelin_folder").load("file://" + str(docs)).count() == 13
    assert rows(spark.read.format("ravelin_folder").load(str(tmp_path / "none"))) == []
    # The same files as by the source it stands beside.
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,html}").load(str(docs))
    assert sorted(bytes(r.content) for r in plain.collect() if "hidden" not in r.path) == sorted(g[4].encode() for g in got)


def test_partitions_are_even(spark, docs):
    files = folder.listed(str(docs), ["*"])
    parts = folder.dealt(files, 150)
    sizes = [sum(f[1] for f in p.files) for p in parts]
    assert sorted(f for p in parts for f in p.files) == files and len(parts) > 3 and max(sizes) <= 150 + max(f[1] for f in files)
    df = spark.read.format("ravelin_folder").option("split_bytes", 150).load(str(docs))
    assert df.rdd.getNumPartitions() == len(parts)


def test_conditions_reach_the_source(spark, docs):
    df = spark.read.format("ravelin_folder").load(str(docs))
    some = df.where((F.col("extension") == "md") & F.col("path").startswith("d1/") & (F.col("bytes") > 20) & F.col("content").isNotNull())
    got = [g[0] for g in rows(some)]
    assert got == [f"d1/page{k:02d}.md" for k in (7,)] or got == [f"d1/page{k:02d}.md" for k in range(12) if k % 3 == 1 and k % 2 and k > 2]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "extension" not in plan.split("Filter")[1].split("\n")[0] if "Filter" in plan else True
    # A file that the conditions leave out is not opened: it may not even be readable.
    os.chmod(docs / "other.txt", 0)
    reader = folder.FolderReader(str(docs), ["*"], 1 << 20)
    left = list(reader.pushFilters([folder.ds.Not(folder.ds.EqualTo(("extension",), "txt")), folder.ds.EqualTo(("content",), b"x"), folder.ds.IsNotNull(("path",))]))
    assert [type(f).__name__ for f in left] == ["EqualTo"]
    assert all(f[0] != "other.txt" for p in reader.partitions() for f in p.files)
    os.chmod(docs / "other.txt", 0o644)


def test_a_stream_equals_the_batch_and_goes_on_from_its_offset(spark, docs, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.format("ravelin_folder").option("files_per_batch", 5).load(str(docs))
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).start()
        try:
            query.processAllAvailable()
            return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        finally:
            query.stop()

    assert run() == [5, 5, 3]
    batch = spark.read.format("ravelin_folder").load(str(docs))
    assert rows(spark.read.parquet(out)) == rows(batch)
    put(docs, "d0/new.md", "new", 2000)
    put(docs, "d0/page00.html", "changed", 2001)
    assert run() == [2]
    got = rows(spark.read.parquet(out))
    assert len(got) == 15 and [g[4] for g in got if g[0] == "d0/page00.html"] in (["changed", "text 0 "], ["text 0 ", "changed"])
    assert run() == []
