import re

import numpy as np
import pyarrow as pa

from quarrylake.llm import kernel


def twins(n=1024):
    """Two words that polynomial hashes modulo a power of two can't tell apart (Thue-Morse and its complement)."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_in_pieces(monkeypatch):
    texts = ["", "a bc", None, " x ", "é" * 40 + " b", "\tlong" * 30, "z"]
    data, offsets = kernel.string_buffers(pa.array(texts))
    want = kernel.word_spans(data, offsets, kernel.SPACED)
    words = [w.encode() for t in texts for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    assert [bytes(data[a:b]) for a, b in zip(*want[:2], strict=True)] == words
    for size in (1, 3, 7):
        monkeypatch.setattr(kernel, "SLICE_BYTES", size)
        for got, x in zip(kernel.word_spans(data, offsets, kernel.SPACED), want, strict=True):
            assert (got == x).all()


def test_hashes_and_bytes_tell_words_apart():
    one, two = twins()
    texts = [one, two, one.upper(), "a" * 300, "a" * 301, "ab", "b", "ab\0", "x" * 8, "x" * 9]
    data, offsets = kernel.string_buffers(pa.array(texts))
    h = kernel.span_hashes(data, offsets[:-1], offsets[1:], kernel.SPACED)
    assert h[0] == h[2] and len(set(h.tolist())) == len(texts) - 1
    eights = kernel.lanes(data, kernel.SPACED)
    for i in range(len(texts)):
        same = kernel.equal_spans(eights, np.repeat(offsets[i], len(texts)), np.repeat(offsets[i + 1], len(texts)), eights, offsets[:-1], offsets[1:])
        assert [bool(x) for x in same] == [t.lower() == texts[i].lower() for t in texts]
