import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import bpe
from weftline.sources import files, warc

TEXT = " ".join(["low"] * 5 + ["lower"] * 2 + ["widest"] * 3 + ["newest"] * 6)


def test_merges_golden_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(TEXT,)], "text string")
    vocab, merges = bpe.train(df, 257 + 6)
    assert merges == [(b"s", b"t"), (b"e", b"st"), (b"o", b"w"), (b"l", b"ow"), (b"w", b"est"), (b"n", b"e")]
    best = bpe.best_pair(bpe.pair_counts(bpe.pretoken_counts(df))).first()
    assert (bytes.fromhex(best["left"]), bytes.fromhex(best["right"])) == (b"s", b"t")
    files.save_tokenizer(vocab, merges, str(tmp_path))
    assert files.load_tokenizer(str(tmp_path)) == (vocab, merges)
    t = bpe.Tokenizer(vocab, merges, ("<|endoftext|>",))
    texts = ["", "newest low", "naïve 😀\n\n x", "a<|endoftext|>b", None]
    enc = bpe.decode(bpe.encode(spark.createDataFrame([(x,) for x in texts], "text string"), t), t)
    assert [r["decoded"] for r in enc.collect()] == texts
    assert t.encode("a<|endoftext|>")[-1] == 256 and bpe.longest_token(vocab)[1] == b"<|endoftext|>"


def test_merging_stops_when_no_pair_is_left():
    assert bpe.merge_words({b"ab": 2}, 10) == [(b"a", b"b")]
    assert bpe.merge_words({}, 3) == []


def test_merges_count_rare_words_of_large_texts(spark):
    """Over a million pre-tokens, where single words are a smaller share than one in a million."""
    rng = random.Random(4)
    rare = ["".join(rng.choice("aabcé") for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([("low" + " low" * 39_999,)] * 30 + [(" ".join(rare),), ("",), (None,)], "text string")
    counts = {r["tok"].encode(): r["n"] for r in bpe.pretoken_counts(df).collect()}
    assert sum(counts.values()) > 1_200_000
    want = bpe.merge_words(counts, 40)
    assert len(want) == 40 and bpe.train(df, 257 + 40)[1] == want
    assert bpe.train(df, 257 + 40, max_words=0, top=50)[1] == want


def record(kind, uri, body, http=True):
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" if http else b"") + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    return head + block + b"\r\n\r\n"


def test_warc_source(spark, tmp_path):
    for k in range(3):
        with gzip.open(tmp_path / f"part-{k}.warc.gz", "wb") as f:
            f.write(record("warcinfo", "", b"software: x", False) + record("response", f"http://x/{k}", b"<p>\xff body") + record("request", "http://x", b"GET /", False))
    (tmp_path / "bad.warc.gz").write_bytes(b"no gzip")
    got = warc.read_warc(spark, str(tmp_path), files_per_task=2).collect()
    assert sorted(r["target_uri"] for r in got) == ["http://x/0", "http://x/1", "http://x/2"] and bytes(got[0]["payload"]) == b"<p>\xff body"
    assert warc.read_warc(spark, str(tmp_path), None).count() == 9


def test_wet_text(spark, tmp_path):
    (tmp_path / "a.wet").write_text("WARC/1.0\r\nWARC-Type: conversion\r\nX-Y: a: b\r\n\r\nfirst\r\n\r\nsecond\r\nWARC/1.0\r\nWARC-Type: conversion\r\n\r\nother\r\n")
    got = {r["text"]: r["headers"] for r in warc.read_wet_text(spark, str(tmp_path / "a.wet")).collect()}
    assert set(got) == {"first\nsecond", "other"} and got["first\nsecond"]["X-Y"] == "a: b"


def test_shards_delimited_and_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, [7, 8]), (0, 0, [65535]), (1, 0, [])], "shard int, pos int, ids array<int>")
    out = {r["shard"]: r for r in files.write_token_shards(df, str(tmp_path / "s")).collect()}
    assert out[0]["n_tokens"] == 3 and list(np.fromfile(out[0]["file"], "<u2")) == [65535, 7, 8]
    assert sorted(r["ids"] for r in files.read_token_shards(spark, str(tmp_path / "s")).collect()) == [[65535, 7, 8]]  # the engine lists no empty files
    assert files.concat_shards([r["file"] for r in out.values()], str(tmp_path / "all.bin")) == 6
    (tmp_path / "c.txt").write_text("one\ntwo<|endoftext|>three<|endoftext|>\n")
    assert sorted(r["text"].strip() for r in files.read_delimited(spark, str(tmp_path / "c.txt")).collect()) == ["one\ntwo", "three"]
    (tmp_path / "x.jsonl").write_text(json.dumps({"a": 1}) + "\n\n" + json.dumps({"a": 2}) + "\n")
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").agg(F.sum("a")).first()[0] == 3
    (tmp_path / "t.txt").write_bytes(b"a\r\nb\xff")
    assert files.read_text_files(spark, str(tmp_path / "t.txt"), "ignore").first()["text"] == "a\nb"


def test_wet_marks_and_headers(spark, tmp_path):
    (tmp_path / "a.wet").write_text("WARC/1.0\r\nX: 1\r\nX: 2\r\n\r\nthe mark WARC/1.0 inside a line\r\nend\r\n\r\nWARC/1.0\r\nX: 3\r\n\r\nother\r\n")
    got = {r["text"]: r["headers"]["X"] for r in warc.read_wet_text(spark, str(tmp_path / "a.wet")).collect()}
    assert got == {"the mark WARC/1.0 inside a line\nend": "2", "other": "3"}


def test_damaged_warcs_are_reported(spark, tmp_path):
    whole = record("response", "http://x/1", b"<p>one") + record("response", "http://x/2", b"<p>two")
    (tmp_path / "a.warc").write_bytes(whole[:-20])
    assert warc.read_warc(spark, str(tmp_path)).count() == 1
    got = {r["warc_type"]: r for r in warc.read_warc(spark, str(tmp_path), on_error="report").collect()}
    assert got["damaged"]["pos"] == 1 and b"cut off" in bytes(got["damaged"]["payload"])
    far = warc.read_warc_anywhere(spark, str(tmp_path), on_error="report").collect()
    assert sorted((r["warc_type"], r["pos"]) for r in far) == [("damaged", 1), ("response", 0)] and far[0]["headers"]
    with pytest.raises(Exception):
        warc.read_warc(spark, str(tmp_path), on_error="raise").count()


def test_warcs_in_one(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.warc").write_bytes(record("response", f"http://x/{k}", b"<p>body"))
    (tmp_path / "3.warc").write_bytes(b"WARC/1.0\r\nContent-Length: 90\r\n\r\nshort")
    out = str(tmp_path / "all.warc.gz")
    assert warc.concat_warcs([str(p) for p in tmp_path.iterdir()] + [out], out) == (3, 1)
    assert sorted(r["target_uri"] for r in warc.read_warc(spark, out).collect()) == [f"http://x/{k}" for k in range(3)]
    assert warc.concat_warcs([str(tmp_path / f"{k}.warc") for k in range(3)], out, most=2) == (2, 0)


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a"\n')
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    for name, skip_blank in (("x.jsonl", False), ("bad.jsonl", True), ("bad.jsonl", False)):
        with pytest.raises(Exception):
            files.read_jsonl(spark, str(tmp_path / name), "a int", skip_blank).collect()


def test_other_sources_and_sinks(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.array([1, 70000], np.uint32))
    assert files.read_token_arrays(spark, str(tmp_path / "t.npy")).first()["ids"] == [1, 70000]
    (tmp_path / "a.out").write_text("one\ntwo\n")
    (tmp_path / "b.err").write_text("no\n")
    assert [(r["pos"], r["line"]) for r in files.read_logs(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "one"), (1, "two")]
    df = spark.createDataFrame([("7", None, "so 7", 1.0)], "t string, a string, f string, reward double")
    files.write_results(df, str(tmp_path / "r"), "t", "a", "f", ["reward"])
    assert spark.read.json(str(tmp_path / "r")).columns == ["answer", "full answer", "ground_truth", "metrics"]
    for k in (1, 2):
        files.append_metrics(df.select("reward"), str(tmp_path / "m"), k)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).collect())) == [(1, "reward", 1.0), (2, "reward", 1.0)]
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["f"] == "so 7"
    files.write_summary(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1
    texts = spark.createDataFrame([("/a/x", "1"), ("/b/x", "2"), ("/b/y", "3")], "path string, text string")
    files.write_surviving(texts, texts.filter("text <> '3'"), str(tmp_path / "v"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "v")).select("name", "text").collect()] == [("x", "2")]


def test_corpus_to_ordered_shards(spark, tmp_path):
    vocab, merges = bpe.train(spark.createDataFrame([("ab ab abc",)], "text string"), 260)
    t = bpe.Tokenizer(vocab, merges)
    docs = spark.createDataFrame([(i, f"ab{i}") for i in range(20)] + [(99, None)], "doc_id long, text string")
    out = files.write_corpus_shards(docs, t, str(tmp_path / "s"), 3).collect()
    files.concat_shards([r["file"] for r in out], str(tmp_path / "all.bin"))
    assert t.decode(np.fromfile(tmp_path / "all.bin", "<u2").tolist()) == "".join(f"ab{i}" for i in range(20))
