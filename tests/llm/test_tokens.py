import numpy as np
import pytest
from tokenizers import Tokenizer

from mnemora.llm import tokens

PATH = tokens.DEFAULT_TOKENIZER
TEXTS = [
    None, "", " ", "\n\n \t", "a", "aaaaaaa" * 900, "ab" * 1500, "Hello, it's we'LL!  <|endoftext|> x", "我们" * 700, "สวัสดี ครับ", "é" * 80, "\U0001f680🚀👨‍👩‍👧", "x y　z\r\n", "12345 67.8 ½ ²",
    "the the the the", "Привет, мир", "नमस्ते", "ﾊﾛｰ",
]


@pytest.fixture(scope="module")
def wanted():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_ids_are_the_tokenizers(spark, wanted):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)] + [(3, TEXTS[3], "again")], "doc_id long, text string, ids string")
    rows = tokens.encode(df, path=PATH).collect()
    assert len(rows) == len(TEXTS) + 1
    assert all(r.ids == wanted[r.doc_id] for r in rows)
    counts = {r.doc_id: r.tokens for r in tokens.count(df, path=PATH).collect()}
    assert counts == {i: len(w) for i, w in enumerate(wanted)}
    assert tokens.encode(df.limit(0), path=PATH).count() == 0


def test_round_trip_and_forgetting(monkeypatch, wanted):
    monkeypatch.setattr(tokens, "SEEN_MOST", 5)
    enc = tokens.Encoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(b, np.int32).tolist() for b in enc.encode(TEXTS)] == wanted
    t = Tokenizer.from_file(PATH)
    assert t.decode(np.frombuffer(enc.encode([TEXTS[7]])[0], np.int32).tolist(), skip_special_tokens=False) == TEXTS[7]


def test_merges_of_random_bytes():
    rng = np.random.default_rng(0)
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    enc = tokens.Encoder(PATH)
    texts = ["".join(chr(c) for c in rng.choice([97, 98, 101, 116, 104, 32, 0x4E00, 0x4E01, 0x3042, 233], 200)) for _ in range(50)]
    assert [np.frombuffer(b, np.int32).tolist() for b in enc.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
