"""The quicker ways through words give what the plain ways give."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from shutterlake.llm import common, lang_id, packing, sp_bpe


ODD = ["a", "Be", " ", "  ", "\n", "\t", "'", "'s", "!", "?!", "<|endoftext|>", "<|", "<s>", "12", "é", "²", "½", "中", "\U0001f600", "\x1c", "\x85", "\u00a0", "\u3000", " word", "\r\n", "\x00", "▁", "▁▁", "the", "ing"]


def odd_texts(n, seed=3):
    r = random.Random(seed)
    return ["", " ", "\n", *["".join(r.choice(ODD) for _ in range(r.randint(0, 16))) for _ in range(n)]]


def test_part_ids_equal_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PARTS", 50)  # most parts are learned again and again
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, own, texts = Tokenizer.from_file(path), packing.PartTokenizer(path, 0), odd_texts(6000)
    for i in range(0, len(texts), 100):
        raw, at = own.encode(pa.array(texts[i : i + 100]))
        got = [bytes(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == [np.array([*e.ids, 0], "<u4").tobytes() for e in whole.encode_batch(texts[i : i + 100], add_special_tokens=False)]
    assert len(own.known.young) + len(own.known.old) < 2000


def test_part_pieces_equal_those_of_the_library(monkeypatch):
    monkeypatch.setattr(sp_bpe, "CACHE_PARTS", 50)
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own, texts = sentencepiece.SentencePieceProcessor(model_file=path), sp_bpe.PrefixTableBpe(path), odd_texts(6000, 5)
    for i in range(0, len(texts), 100):
        n, ids, shown = own.digests(pa.array(texts[i : i + 100]))
        want = [lib.encode(t) for t in texts[i : i + 100]]
        assert n.tolist() == [len(w) for w in want]
        assert ids == [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in want]
        assert shown == [hashlib.sha256(lib.decode(w).encode()).hexdigest() for w in want]
    parts, _ = own.parts(pa.array(texts))
    for p in parts.dictionary.to_pylist():  # the prefix table gives what the definition gives
        p = p.decode().replace(" ", "▁")
        assert own.split(p) == own.merge(p)


def test_memory_lets_go_and_keeps_what_is_used():
    calls, m = [], common.Memory(4, 3)
    f = lambda new: calls.extend(new) or [k * 2 for k in new]
    for k in range(50):
        assert m.all([b"a", b"%d" % k, b"longer"], f) == [b"aa", b"%d%d" % (k, k), b"longerlonger"]
    assert calls.count(b"a") == 1 and calls.count(b"longer") == 50 and len(m.young) + len(m.old) <= 8


def test_language_sample_is_the_least_hashes(spark, monkeypatch):
    rows = [(f"{lang} text {i % 400}", lang) for lang in ("x", "y") for i in range(900)] + [("x text 1", "x")] * 500 + [(None, "x"), ("z", None), ("long" * 20, "x")]
    seen = {}
    monkeypatch.setattr(lang_id, "fit", lambda texts, labels: seen.update(got=list(zip(labels, texts, strict=True))))
    lang_id.train(spark.createDataFrame(rows, "text string, lang string"), sample_docs=30, sample_chars=40)
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame(rows, "t string, l string").selectExpr("t", "xxhash64(t) AS h").collect()}
    for lang in ("x", "y"):
        want = sorted({t for t, k in rows if k == lang and t and len(t) <= 40}, key=hashes.get)[:30]
        assert [t for k, t in seen["got"] if k == lang] == want
