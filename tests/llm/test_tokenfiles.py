import random
import zlib

import numpy as np
import pytest

from quarrylake.llm import kernel, tokenfiles

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def tricky(n=400, seed=2):
    rng = random.Random(seed)
    bits = [" ", " ", "  ", "\n", "\n\n", "\t", " ", "　", " ", "\x85", "\r\n", "a", "the", "The", "été", "ß", "×", "÷", "'s", "'", "'ll", "don't", ".", ",", "!?", "12", "3", "ü", "Жук", "日本", "😀", "é", "<|endoftext|>", "--", "_", "\x00", "\x1c", "À", "à", "É"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


def plain(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    return [x.ids + [0] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_encode_like_whole_texts():
    import pyarrow as pa

    texts = tricky(3000)
    coder = tokenfiles.Encoder(PATH)
    for _ in range(2):  # the second time from the table
        data, offsets = kernel.string_buffers(pa.array(texts))
        ids, counts = tokenfiles.with_ends(*coder.encode(data, offsets))
        assert np.split(ids, np.cumsum(counts)[:-1])[7].tolist() == plain(texts[7:8])[0]
        assert ids.tolist() == sum(plain(texts), [])


def test_pieces_alike_by_hash(monkeypatch):
    import pyarrow as pa

    from .test_kernel import twins

    texts = [*twins(), "abc def", "abd def", "x <|endoftext|> y", "<|endoftext|", "ab<|endoftext|>ab", ""]
    for same in (False, True):
        if same:
            monkeypatch.setattr(kernel, "span_hashes", lambda data, starts, ends, *_: np.full(len(starts), 9, np.uint64))
        coder = tokenfiles.Encoder(PATH)
        for _ in range(2):
            ids, _ = tokenfiles.with_ends(*coder.encode(*kernel.string_buffers(pa.array(texts))))
            assert ids.tolist() == sum(plain(texts), [])
    assert 50256 in ids.tolist()
    text_only = tokenfiles.Encoder(PATH, special=False)
    assert 50256 not in text_only.encode(*kernel.string_buffers(pa.array(texts)))[0].tolist()


def test_coding_round_trip():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 2, 3, 4, 5, 0, 1000])
    values = (rng.integers(0, 1 << 32, counts.sum(), dtype=np.uint64) >> rng.integers(0, 32, counts.sum()).astype(np.uint64)).astype(np.uint32)
    control, data, n_control, n_data = tokenfiles.encode(values, counts)
    assert (n_control.sum(), n_data.sum()) == (len(control), len(data))
    assert (tokenfiles.decode(control, data, counts) == values).all()
    ids, n, out = tokenfiles.unpack(tokenfiles.pack(np.arange(8), counts, control.tobytes(), data.tobytes()))
    assert ids.tolist() == list(range(8)) and (n == counts).all() and (out == values).all()


def test_files_match_plain_encoding(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 2000)
    texts = [*tricky(120), None, "", "word " * 5000]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i * 3, t, 9) for i, t in rows], "doc_id long, text string, shard long").repartition(4)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.token_files(df, PATH).collect()}
    want, start = {}, 0
    for i, ids in enumerate(plain(texts)):
        want[i * 3] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_empty_table_and_null_ids(spark):
    assert tokenfiles.token_files(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    odd = spark.createDataFrame([(None, "b"), (4, "a"), (4, "a")], "doc_id long, text string")
    assert sorted((r.start, r.doc_id) for r in tokenfiles.token_files(odd, PATH).collect()) == [(0, None), (2, 4), (4, 4)]


def test_rows_of_one_id_fill_several_shards(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 2000)
    monkeypatch.setattr(tokenfiles, "BLOCK_TOKENS", 50)
    same = spark.createDataFrame([(None if i % 2 else 8, f"text number {i} of one id") for i in range(300)], "doc_id long, text string").repartition(3)
    got = sorted(tokenfiles.token_files(same, PATH).collect(), key=lambda r: r.start)
    assert len({r.shard for r in got}) > 2 and len({(r.shard, r.block) for r in got}) > 20
    assert [r.doc_id for r in got] == [None] * 150 + [8] * 150
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
