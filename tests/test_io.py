from pyspark.sql import functions as F

from lexmill.operators.bpe import Tokenizer, encode
from lexmill.operators.html_blocks import html_blocks
from lexmill.sources import readers, sinks
from lexmill.streaming import twins


def test_readers_and_sinks(spark, tmp_path):
    pages = tmp_path / "pages" / "sub"
    pages.mkdir(parents=True)
    (pages / "a.html").write_bytes(b"<p>x\xff</p>")
    (pages / "b.txt").write_text("no")
    assert [r.html for r in readers.html_files(spark, str(tmp_path / "pages")).collect()] == ["<p>x</p>"]
    (tmp_path / "docs.txt").write_bytes(b"one<|endoftext|>two\r\nlines<|endoftext|>")
    assert {r.text for r in readers.delimited(spark, str(tmp_path / "docs.txt")).collect()} == {"one", "two\r\nlines"}
    assert readers.text_files(spark, str(tmp_path / "docs.txt")).first().text == "one<|endoftext|>two\nlines<|endoftext|>"
    cuts = readers.chunk_boundaries(str(tmp_path / "docs.txt"), 3, b"<|endoftext|>")
    assert cuts[0] == 0 and cuts[-1] == 39 and all((tmp_path / "docs.txt").read_bytes()[c:].startswith(b"<|endoftext|>") for c in cuts[1:-1])
    sinks.jsonl(spark.createDataFrame([("t", "s")], "text string, source string"), str(tmp_path / "j"))
    assert readers.jsonl(spark, str(tmp_path / "j")).first().text == "t"
    t = Tokenizer({i: bytes([i]) for i in range(256)}, [], ["<|endoftext|>"])
    sinks.tokenizer(spark, t, str(tmp_path / "tok"))
    assert readers.tokenizer(spark, str(tmp_path / "tok")).vocab == t.vocab
    (tmp_path / "x.bin").write_bytes((258).to_bytes(2, "little") + (7).to_bytes(2, "little"))
    assert readers.token_files(spark, str(tmp_path / "x.bin")).first().tokens == [258, 7]
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    sinks.tokens(encode(docs, t), str(tmp_path / "ids"))
    assert spark.read.parquet(str(tmp_path / "ids")).first().ids == [97, 98]


def test_html_blocks():
    page = "<html><head><title>t</title></head><body><h1>Moby</h1><p>Call me\n  Ishmael.<ul><li>Novel<li>Whale</ul><script>x</script>End"
    assert html_blocks(page) == "Moby\n\nCall me Ishmael.\n\n  • Novel\n  • Whale\n\nEnd"
    assert html_blocks("") == "" and html_blocks(None) is None


def test_streams_equal_batches(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = twins.stream(spark, sf, docs.schema, name="documents.parquet")
    twins.run_once(twins.accepted(twins.masked(source)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(twins.accepted(twins.masked(docs)).select(got.columns)).isEmpty() and got.count() == twins.accepted(twins.masked(docs)).count()
    timed = twins.stream(spark, sf, docs.schema, name="documents.parquet").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    twins.run_once(twins.deduplicated(timed, "at"), str(tmp_path / "dedup"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "dedup")).count() == docs.select("text").distinct().count()
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert twins.event_windows(events).agg(F.sum("n")).first()[0] == events.count() == twins.event_sessions(events).agg(F.sum("n")).first()[0]
