"""Token files: round trips, damage, the tokenizer's own ids, and the query against a plain loop."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from mediaframe.llm import queries, token_files
from mediaframe.llm.common import shared_dir
from mediaframe.llm.token_files import Mixer, read_shard, write_shard

SPECIAL = "<|endoftext|>"


def draw(kind, n, rng):
    if kind == "one":
        return np.full(n, 7)
    if kind == "spread":
        return rng.integers(0, 50_257, n)
    if kind == "cycle":
        return np.arange(n) % 97 * 500
    return np.minimum(rng.zipf(1.3, n), 50_256)  # skewed


@pytest.mark.parametrize("kind", ["one", "spread", "cycle", "skewed"])
@pytest.mark.parametrize("n", [1, 2, 511, 513, 5000, 20_000])
def test_round_trip(kind, n):
    ids = draw(kind, n, np.random.default_rng(n)).astype(np.uint32)
    raw = write_shard([None, -3], np.array([n - n // 2, n // 2]), ids, 4, 9)
    partition, shard, keys, lengths, got = read_shard(raw + b"\n")
    assert (partition, shard, keys, lengths.tolist()) == (4, 9, [None, -3], [n - n // 2, n // 2]) and (got == ids).all()


def test_blocks_are_adaptive_and_small(monkeypatch):
    monkeypatch.setattr(token_files, "LANES", 4)
    rng = np.random.default_rng(1)
    follow = rng.integers(0, 50_000, 400)
    cycle = follow[np.arange(30_000) % 400].astype(np.uint32)  # orders 1 and 2 tell what follows
    skewed = draw("skewed", 30_000, rng).astype(np.uint32)
    bits = lambda ids: len(write_shard([1], np.array([len(ids)]), ids, 0, 0)) * 8 / len(ids)
    counts = np.unique(skewed, return_counts=True)[1] / 30_000
    assert bits(cycle) < 2.5 < -(counts * np.log2(counts)).sum() and bits(skewed) < 1.15 * -(counts * np.log2(counts)).sum() + 1


def test_intervals_share_the_total():
    rng = np.random.default_rng(2)
    sizes = np.array([70, 200, 1])
    model = Mixer(sizes)
    for _ in range(300):
        model.predict(3)
        total = model.total + model.w1 + model.w2
        for i, n in enumerate(sizes):
            at = np.array([np.minimum(r, sizes - 1) for r in range(n)])
            edges = [model.interval(x, 3) for x in at]
            assert edges[0][0][i] == 0 and all(a[0][i] + a[1][i] == b[0][i] for a, b in zip(edges, edges[1:], strict=False)) and edges[-1][0][i] + edges[-1][1][i] == total[i]
        v = np.array([rng.integers(t) for t in total])
        x = model.find(v, 3)
        start, width, _ = model.interval(x, 3)
        assert ((start <= v) & (v < start + width)).all()
        model.update(np.minimum(rng.zipf(1.5, 3) - 1, sizes - 1), 3)


def test_damage_is_found():
    ids = draw("skewed", 3000, np.random.default_rng(5)).astype(np.uint32)
    raw = write_shard([1], np.array([3000]), ids, 0, 0)
    rng = random.Random(1)
    for at in [0, 9, 30, 45, len(raw) - 1, *(rng.randrange(len(raw)) for _ in range(60))]:
        bad = bytearray(raw)
        bad[at] ^= 1 << rng.randrange(8)
        try:
            assert (read_shard(bytes(bad))[4] == ids).all()  # partition, shard and a last word's spare bits are no part of the ids
        except ValueError:
            pass
    for cut in (0, 10, 50, len(raw) // 2):
        with pytest.raises(ValueError, match="token file"):
            read_shard(raw[:cut])


def texts():
    rng = random.Random(3)
    parts = ["ab", "The", "'s", " 's", " ", "  ", "   ", "\n", "\n\n", "\t", " ", " ", "\x1c", "é", "中文", "123", "!", "?!", "<|", SPECIAL, "don't", "😀", "\0"]
    return ["", " ", "  a", "a ", "a  b", "a \n b", "a\n b", f"x{SPECIAL} y", f"x {SPECIAL}y", *("".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(500)), *(" ".join(rng.choices(parts, k=20)) for _ in range(100))]


def test_encoder_is_the_tokenizer():
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    enc = token_files.ByteEncoder(token_files.default_tokenizer(), most=50)
    for _ in range(2):
        for a in range(0, len(texts()), 40):
            part = texts()[a : a + 40]
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(part)] == [tok.encode(t, add_special_tokens=False).ids for t in part]


def test_encoder_cuts_as_the_tokenizer_does(monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 40)  # chunks end within texts, too
    monkeypatch.setattr(token_files.ByteEncoder, "LONGEST", 12)
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    enc = token_files.ByteEncoder(token_files.default_tokenizer(), most=30)
    rng = random.Random(8)
    parts = ["a", "Word", " ", " ", " ", "  ", "\n", "\r\n", "\x0b", "\x85", "\u2028", "\u3000", "'", "'ll", "'LL", "×", "÷", "ñ", "Ö", "ŉ", "ſ", "ǅ", "ɿ", "ʀ", "Ж", "ѿ", "҂", "²", "٣", "7", "...", "\x7f", "\x1f", "e\u0301", "\ufeff", "😀"]
    made = [None, "", *("".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(400)), *(" ".join(rng.choices(parts, k=30)) for _ in range(100)), "x" * 300, "é'" * 200]
    for a in range(0, len(made), 30):
        part = made[a : a + 30]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(part)] == [tok.encode(t or "", add_special_tokens=False).ids for t in part]
    assert all(len(s) <= 12 for s in [*enc.known, *enc.old])


def test_encoder_of_other_tokenizers(tmp_path):
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=True)])
    tok.save(str(tmp_path / "t.json"))
    part = ["a 123 b", "", None, "x12y 2024, it's 7", *texts()[:60]]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.ByteEncoder(str(tmp_path / "t.json")).encode(part)] == [tok.encode(t or "", add_special_tokens=False).ids for t in part]


def test_frequent_words_are_learned_once():
    enc, asked = token_files.ByteEncoder(token_files.default_tokenizer(), most=40), []
    learn = enc.learn
    enc.learn = lambda strings: asked.extend(strings) or learn(strings)
    for i in range(12):
        enc.encode([" ".join(f"the of {w}, {w}. {w}!" for w in ("".join(random.Random(i * 30 + j).choices("abcdefgh", k=9)) for j in range(20)))])
    assert sum("the" in s for s in asked) <= 2 and sum(" of" in s for s in asked) == 1  # full stores keep them
    assert len(asked) <= 12 * 20 + 10  # a word and what follows it are known apart


def test_steps_are_shared_by_many_blocks(monkeypatch):
    steps, update = [], Mixer.update
    monkeypatch.setattr(Mixer, "update", lambda self, x, m: steps.append(m) or update(self, x, m))
    ids = draw("skewed", 300_000, np.random.default_rng(6)).astype(np.uint32)
    raw = write_shard([1], np.array([len(ids)]), ids, 0, 0)
    assert len(steps) <= 128 and sum(steps) == len(ids)  # an array operation costs about the same for one rank or a thousand
    assert (read_shard(raw)[4] == ids).all() and len(steps) <= 256


def test_counts_of_large_shards_are_scaled(monkeypatch):
    monkeypatch.setattr(token_files, "SCALE", 1000)
    ids = np.concatenate([np.full(20_000, 3), np.arange(5000) * 400, draw("spread", 5000, np.random.default_rng(7))]).astype(np.uint32)
    assert (read_shard(write_shard([1], np.array([len(ids)]), ids, 0, 0))[4] == ids).all()


def expected(rows):
    """doc_id, start, n_tokens, crc of rows in order."""
    tok, out, at = Tokenizer.from_file(token_files.default_tokenizer()), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files(spark):
    rows = [(i * 7 % 101 - 20, t) for i, t in enumerate(texts()[:100])] + [(200, "word " * 60_000), (201, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(5)  # start clashes with a column of the result
    for shard, partitions in ((1 << 22, None), (50, 3), (3000, 7)):
        path = shared_dir(spark, "token-files-test")
        token_files.write_files(df, path, shard=shard, partitions=partitions)
        out = token_files.starts(token_files.checksums(token_files.read_files(spark, path)))
        assert sorted(tuple(r) for r in out.select("key", "start", "n_tokens", "ids_crc32").collect()) == sorted(expected(rows))
    whole = token_files.read_files(spark, path).orderBy("partition", "shard", "place").collect()
    assert [r.key for r in whole] == sorted(i for i, _ in rows)


def test_cases(spark):
    schema = "doc_id long, text string"
    rows = [(None, "b"), (None, None), (5, "same"), (5, "same"), (5, "other"), (4, "")]
    path = shared_dir(spark, "token-files-test")
    token_files.write_files(spark.createDataFrame(rows, schema), path)
    out = token_files.starts(token_files.checksums(token_files.read_files(spark, path))).orderBy("start").collect()
    want = expected(rows)
    assert [r.key for r in out] == [r[0] for r in want] and sorted((r.n_tokens, r.ids_crc32) for r in out) == sorted(r[2:] for r in want)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False)) and out[0].start == 0
    path = shared_dir(spark, "token-files-test")
    token_files.write_files(spark.createDataFrame([], schema), path)
    assert token_files.starts(token_files.checksums(token_files.read_files(spark, path))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_token_files"](spark, sf).orderBy("start").collect()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert [tuple(r) for r in got] == expected(rows)
