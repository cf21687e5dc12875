"""Documents as files: one each, under their own names, once, whatever fails."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from cuewright.sources import io, ledger, sink


def found(path):
    return {os.path.relpath(f"{d}/{f}", path): open(f"{d}/{f}", "rb").read() for d, _, names in os.walk(path) for f in names if not f.startswith((".", "_")) and "/_" not in f"{d}/"}


@pytest.fixture
def rendered(spark):
    return spark.createDataFrame([(i, f"{i}\n00:00:01,000 --> 00:00:02,000\nş{i}\n\n") for i in range(40)] + [(40, ""), (41, None)], "doc_id bigint, text string").repartition(5)


def test_one_file_a_document(spark, rendered, tmp_path):
    names = spark.createDataFrame([(3, "a/b/three"), (4, "four x")], "doc_id bigint, name string")
    io.write_text_files(rendered, str(tmp_path / "out"), "srt", names)
    got = found(tmp_path / "out")
    want = {f"{ {3: 'a/b/three', 4: 'four x'}.get(i, i) }.srt": f"{i}\n00:00:01,000 --> 00:00:02,000\nş{i}\n\n".encode() for i in range(40)} | {"40.srt": b"", "41.srt": b""}
    assert got == want
    listed = sink.committed_files(spark, str(tmp_path / "out")).collect()
    assert {r.name: r.bytes for r in listed} == {k: len(v) for k, v in want.items()}
    assert not (tmp_path / "out" / "_writing").exists()
    back = io.read_files(spark, str(tmp_path / "out"), "*.srt").groupBy("format").count().collect()
    assert {r.format: r["count"] for r in back} == {"srt": 40}  # Spark's reader of whole files skips empty ones
    with pytest.raises(Exception, match="already written"):
        io.write_text_files(rendered, str(tmp_path / "out"), "srt")


def test_a_repeated_task_leaves_each_file_once(spark, tmp_path):
    """Two attempts of one task write; only the one whose message comes counts."""
    writer, rows = sink.Writer(f"file://{tmp_path}/out"), [{"name": f"{i}.vtt", "text": f"t{i}"} for i in range(5)]
    first = writer.write(iter(rows))
    with pytest.raises(RuntimeError):
        writer.write(broken(rows))
    second = writer.write(iter(rows))
    writer.commit([second, None])
    assert found(tmp_path / "out") == {f"{i}.vtt": f"t{i}".encode() for i in range(5)}
    manifest = json.loads((tmp_path / "out" / "_manifest.json").read_text())
    assert manifest == {"parts": [second.part], "files": 5, "bytes": 10} and first.part != second.part
    assert sink.committed_files(spark, f"file://{tmp_path}/out").count() == 5


def broken(rows):
    yield from rows[:3]
    raise RuntimeError("lost")


def test_an_aborted_job_leaves_nothing(spark, rendered, tmp_path):
    bad = rendered.select(F.when(F.col("doc_id") == 17, F.lit("../x")).otherwise(F.col("doc_id").cast("string")).alias("name"), "text")
    with pytest.raises(Exception, match="not a file name"):
        sink.write_files(bad, str(tmp_path / "out"))
    # Tasks that still run when the job fails stop at their next file.
    for _ in range(50):
        if not found(tmp_path / "out"):
            break
        time.sleep(0.2)
    assert found(tmp_path / "out") == {} and not (tmp_path / "out" / "_manifest.json").exists()
    # A later job writes there as if nothing had been.
    io.write_text_files(rendered, str(tmp_path / "out"), "vtt")
    assert len(found(tmp_path / "out")) == 42


def test_a_task_stops_after_the_abort(tmp_path):
    """A task that goes on after its job was aborted leaves no file."""
    writer = sink.Writer(str(tmp_path / "out"))

    def rows():
        yield {"name": "a.srt", "text": "a"}
        writer.abort([])
        yield {"name": "b.srt", "text": "b"}

    with pytest.raises(RuntimeError, match="aborted"):
        writer.write(rows())
    assert found(tmp_path / "out") == {}


def test_names_twice_are_an_error(spark, rendered, tmp_path):
    with pytest.raises(ValueError, match="one document"):
        sink.write_files(rendered.select(F.lit("same.srt").alias("name"), "text"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    sink.write_files(rendered.limit(0).select(F.lit("same.srt").alias("name"), "text"), str(tmp_path / "empty"))
    assert sink.committed_files(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("name", [None, "", "/a", "a/../b", "a//b", "_manifest.json", "./a"])
def test_names_below_the_folder_only(name):
    with pytest.raises(ValueError, match="file name"):
        sink.checked(name)


# Files read once


def put(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (at, at))


CUE_TEXT = "1\n00:00:01,000 --> 00:00:02,000\n{}\n"


@pytest.mark.parametrize("listed", [10_000, 0])
def test_a_second_run_reads_what_is_new(spark, tmp_path, monkeypatch, listed):
    """New and changed files are taken, others aren't opened; a batch that failed is taken again."""
    monkeypatch.setattr(ledger, "LISTED", listed)
    source, own = tmp_path / "in", ledger.Collection(spark, f"file://{tmp_path}/own")
    texts = lambda: sorted(r.text for r in own.parsed().cues.collect())
    for i in range(4):
        put(source / f"d{i % 2}" / f"{i}.srt", CUE_TEXT.format(i), 1_000_000_000)
    put(source / "no.txt", "nothing", 1_000_000_000)
    put(source / "utf16.srt", CUE_TEXT.format("ş").encode("utf-16"), 1_000_000_000)
    assert own.parsed().cues.count() == 0 and own.ingest(str(source)) == 0
    assert texts() == ["0", "1", "2", "3", "ş"] and own.ledger().count() == 6
    assert [os.path.basename(r.path) for r in own.rejects().collect()] == ["no.txt"]
    assert own.ingest(str(source)) is None and own.committed() == 1

    put(source / "d0" / "0.srt", CUE_TEXT.format("zero"), 1_100_000_000)
    put(source / "late.vtt", "WEBVTT\n\n00:01.000 --> 00:02.000\nlate\n", 1_100_000_000)
    # Files that are known can't be opened any more, which nobody notices.
    opened = spark.sparkContext.accumulator(0)
    old = ledger.recognised

    def counting(df):
        opened.add(df.count())
        return old(df)

    monkeypatch.setattr(ledger, "recognised", counting)
    # The parse of the first try fails after the texts are written: the ledger stays as it was.
    parse = ledger.parse_files
    monkeypatch.setattr(ledger, "parse_files", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        own.ingest(str(source))
    monkeypatch.setattr(ledger, "parse_files", parse)
    assert own.committed() == 1 and texts() == ["0", "1", "2", "3", "ş"]
    assert own.ingest(str(source)) == 1 and opened.value == 4
    assert texts() == ["1", "2", "3", "late", "zero", "ş"] and own.ledger().count() == 7
    assert {os.path.basename(r.path): r.batch for r in own.ledger().collect()} == {"0.srt": 1, "late.vtt": 1, "1.srt": 0, "2.srt": 0, "3.srt": 0, "no.txt": 0, "utf16.srt": 0}
    assert own.files().count() == 7 and own.ingest(str(source)) is None


def test_old_files_are_not_opened(spark, tmp_path, monkeypatch):
    """The scan for many new files skips the content of files older than all of them."""
    monkeypatch.setattr(ledger, "LISTED", 0)
    source, own = tmp_path / "in", ledger.Collection(spark, str(tmp_path / "own"))
    put(source / "old.srt", CUE_TEXT.format("old"), 1_000_000_000)
    put(source / "new.srt", CUE_TEXT.format("new"), 1_100_000_000)
    files = own.below(str(source))
    new = own.listing(files).where("path like '%new.srt'")
    plan = own.contents(files, new)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(modificationTime), GreaterThanOrEqual(modificationTime" in plan
    assert [os.path.basename(r.path) for r in own.contents(files, new).collect()] == ["new.srt"]
