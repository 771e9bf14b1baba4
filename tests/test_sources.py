import io
import json
import os
import zipfile

from foliant.sources import readers
from foliant.streaming import log


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p><w:p/></w:body></w:document>')
    return out.getvalue()


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\xff")
    (tmp_path / "b.html").write_text("<title>T</title><p> x <script>no</script></p>")
    (tmp_path / "c.csv").write_text('a,"b\nc"\n')
    (tmp_path / "d.docx").write_bytes(docx("hi"))
    (tmp_path / "e.bin").write_bytes(b"?")
    (tmp_path / "f.docx").write_bytes(b"broken")
    got = {r.filename: (r.text, r.error) for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("one\ntwo", None) and got["b.html"][0] == "T\nx" and got["c.csv"][0] == "a | b\nc" and got["d.docx"][0] == "hi"
    assert got["e.bin"] == (None, "unsupported") and got["f.docx"][1].startswith("BadZipFile")


def test_stream(spark, tmp_path):
    rows = [{"ts": f"2020-01-01T0{h}:00:00", "event": "file_started", "path": "p"} for h in (1, 1, 2)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n{bad\n")
    q = log.hourly_counts(log.event_stream(spark, str(tmp_path / "in")).where("ts is not null")).writeStream.format("memory").queryName("hc").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert sorted(r.n for r in spark.sql("select n from hc").collect()) == [1, 2]
    finally:
        q.stop()


def test_stream_pairs_the_last_start(spark, tmp_path):
    """The stream gives what the batch operator gives on the same events, starts of hours before and of earlier batches included."""
    import json
    import random

    from pyspark.sql import functions as F

    from foliant.operators import events as batch

    (tmp_path / "in").mkdir()
    rng = random.Random(1)
    rows = [("file_started", "2024-01-01T10:00:00", "p"), ("file_started", "2024-01-01T10:05:00", "p"), ("file_completed", "2024-01-01T10:10:00", "p"), ("file_error", "2024-01-03T10:20:00", "p"), ("file_completed", "2024-01-01T00:00:00", "lonely"), ("file_read", "2024-01-01T10:06:00", "p")]
    rows += sorted(((rng.choice(["file_started", "file_completed", "file_error"]), f"2024-02-{rng.randrange(1, 28):02d}T{rng.randrange(24):02d}:{rng.randrange(60):02d}:{k % 60:02d}", f"q{rng.randrange(6)}") for k in range(120)), key=lambda r: r[1])
    for k in range(0, len(rows), 20):
        (tmp_path / "in" / f"{k:03d}.json").write_text("\n".join(json.dumps({"event": e, "ts": at, "path": p}) for e, at, p in rows[k : k + 20]))
        os.utime(tmp_path / "in" / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    one = spark.readStream.schema("ts string, event string, path string").option("maxFilesPerTrigger", 2).json(str(tmp_path / "in")).withColumn("ts", F.try_to_timestamp("ts"))
    q = log.paired(one).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    got = sorted((r.path, r.ts, r.event, r.seconds) for r in spark.table("pairs").collect())
    lines = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line long, event string, at string, path string").withColumn("ts", F.to_timestamp("at"))
    assert got == sorted((r.path, r.ts, r.event, r.seconds) for r in batch.durations(lines).collect()) and len(got) > 50
    assert {(r[2], r[3]) for r in got if r[0] == "p"} == {("file_completed", 300.0), ("file_error", 173700.0)}


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "b.html").write_text("<p>two")
    q = log.folder_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("folder").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.filename, r.text) for r in spark.table("folder").collect()} == {("a.txt", "one"), ("b.html", "two")}
