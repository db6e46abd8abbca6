import zipfile

from pyspark.sql import functions as F

from ledgerlens.sources.collections import Collection, collections
from ledgerlens.sources.files import load_documents
from ledgerlens.streaming import ingest


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("Grüße\n".encode() + b"\xff")
    (tmp_path / "sub" / "b.tsv").write_text("x\ty\n1\t2")
    (tmp_path / "c.html").write_text("<p>Hi &amp; bye</p><script>x</script>")
    (tmp_path / "d.bin").write_bytes(b"\0")
    (tmp_path / "e.json").write_text("{bad")
    (tmp_path / "empty.md").write_text("")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    docs, bad = load_documents(spark, str(tmp_path))
    got = {r["filename"]: r["content"] for r in docs.collect()}
    assert got["b.tsv"] == "x | y\n1 | 2" and got["c.html"] == "Hi & bye" and got["f.docx"].startswith("Title\na | b") and got["a.txt"].startswith("Grüße") and "empty.md" not in got
    assert {r["file_type"] for r in bad.collect()} == {".bin", ".json"}


def test_collection(spark):
    c = Collection(spark, "t1")
    c.drop()
    rows = spark.createDataFrame([("1", "d", {"k": "a"}), ("2", "d", {"k": "b"}), ("2", "d", {"k": "b"}), (None, "d", None)], "chunk_id string, doc_id string, metadata map<string,string>")
    c.add(rows)
    c.add(rows)
    assert c.count() == 2 and "t1" in collections(spark)
    assert [r["chunk_id"] for r in c.filter({"k": {"$ne": "a"}}).collect()] == ["2"] and c.get(["1"]).count() == 1
    c.delete(spark.createDataFrame([("1",), ("9",)], "chunk_id string"))
    assert c.count() == 1
    c.drop()
    assert c.count() == 0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("1", "d", "revenue up 5%", "2024-01-01 00:00:00"), ("2", "d", "EBITDA", "2024-01-01 00:30:00"), ("2", "d", "EBITDA", "2024-01-01 00:30:00")], "chunk_id string, doc_id string, content string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    s = ingest.once_within(ingest.read_landing(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " ")), "chunk_id", "created_at")
    ingest.index_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r["entity_key"], r["chunk_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("revenue", "1"), ("5%", "1"), ("ebitda", "2")}
    st = ingest.read_landing(spark, str(tmp_path / "in"), "chunk_id string, doc_id string, content string, created_at timestamp").withColumn("v", F.lit(1.0))
    q = ingest.windowed_counts(st, "created_at", "doc_id", "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["n"] for r in spark.table("w").collect()] == [3]
