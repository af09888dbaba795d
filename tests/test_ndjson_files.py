import os

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from colloquy.sources import frames, ndjson_files
from colloquy.sources.ndjson_files import NdjsonFiles, Span, lines_of


@pytest.mark.parametrize("size, block", [(1, 3), (3, 5), (7, 64), (1000, 2)])
def test_every_line_is_read_once_wherever_a_file_is_cut(tmp_path, monkeypatch, size, block):
    monkeypatch.setattr(ndjson_files, "BLOCK", block)
    lines = ["", "a", "é" * 9, "", "x" * 40, "日本", ""]
    path = tmp_path / "f.ndjson"
    path.write_bytes("\n".join(lines).encode() + b"\nunfinished")
    whole = path.stat().st_size
    found = [r for a in range(0, whole, size) for r in lines_of(fs.LocalFileSystem(), Span(str(path), a, min(a + size, whole)))]
    assert [r[2] for r in found] == lines and [path.read_bytes()[r[1] :].split(b"\n")[0].decode() for r in found] == lines


def test_a_growing_file_as_a_stream_with_rejects(spark, tmp_path):
    spark.dataSource.register(NdjsonFiles)
    log = tmp_path / "in"
    log.mkdir()
    parts = ['{"message":{"content":"a"}}\n{"message":{"con', 'tent":"é"}}\noops\n\n', '{"done":true} y\n{"done":true,"eval_count":3}\n{"done":']
    for k, part in enumerate(parts):
        with open(log / "model.ndjson", "a") as f:
            f.write(part)
        source = spark.readStream.format("ndjson_files").load(str(log))
        for name, rows in zip(("good", "bad"), frames.ndjson_chunks(source), strict=True):
            rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-checkpoint").trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination()
        if k == 0:
            assert spark.read.parquet(f"{tmp_path}/good").count() == 1
    good = spark.read.parquet(f"{tmp_path}/good").orderBy("position").collect()
    assert [(r.chunk.message and r.chunk.message.content, r.chunk.eval_count) for r in good] == [("a", None), ("é", None), (None, 3)]
    assert sorted(r.line for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == ["oops", '{"done":true} y']


def test_written_lines_are_read_again(spark, tmp_path):
    spark.dataSource.register(NdjsonFiles)
    schema = "k long, line string"
    for part in ([(1, '{"a":1}'), (2, None)], [(3, '{"a":"é"}'), (4, "no json")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").select("line")
        stream.writeStream.format("ndjson_files").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    read = lambda: sorted(r.line for r in spark.read.format("ndjson_files").load(f"{tmp_path}/out").collect())
    assert read() == ["no json", '{"a":"é"}', '{"a":1}']
    # A batch whose commit was lost runs again, in its own place.
    (tmp_path / "checkpoint/commits/1").unlink()
    (tmp_path / "checkpoint/commits/.1.crc").unlink(missing_ok=True)
    stream.writeStream.format("ndjson_files").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert read() == ["no json", '{"a":"é"}', '{"a":1}'] and not [f for f in os.listdir(tmp_path / "out") if f.startswith(".")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(NdjsonFiles)
    bad = spark.range(20, numPartitions=2).select(F.when(F.col("id") < 15, F.lit("x")).otherwise(F.raise_error(F.lit("broken"))).alias("line"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("ndjson_files").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("ndjson_files").load(str(tmp_path / "out")).count() == 0
    spark.range(3).select(F.col("id").cast("string").alias("line")).write.format("ndjson_files").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("ndjson_files").load(str(tmp_path / "out")).count() == 3
