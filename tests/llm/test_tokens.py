import numpy as np
from tokenizers import Tokenizer

from tallymark.llm.tokens import encoder, tokenizer_path


def test_added_tokens_are_the_library_s():
    fresh = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ["end <|endoftext|> start", "<|endoftext|>", "a<|endoftext|>b  c\n <|endoftext|>", "<|endoftext", "É <|endoftext|><|endoftext|> .", "plain words, no marks"]
    rng = np.random.default_rng(6)
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "\n", "word", ".", "é", "<|"], rng.integers(0, 12))) for _ in range(500)]
    e = encoder("byte_bpe_50k.json")
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in fresh.encode_batch(texts, add_special_tokens=False)]
    assert 50256 in np.frombuffer(e.encode(texts[:1])[0], "<u4")


def test_other_vocabularies_get_whole_texts(tmp_path):
    from tokenizers import models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "w.json"))
    assert np.frombuffer(encoder(str(tmp_path / "w.json")).encode(["a b c", None])[0], "<u4").tolist() == [0, 1, 2]
    assert encoder("byte_bpe_50k.json").cuttable


def test_memos_are_bounded(monkeypatch):
    from tallymark.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 500)
    monkeypatch.setattr(tokens, "STEP", 100)
    e = tokens.Encoder("byte_bpe_50k.json")
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 7)) + "," * (k % 2) for k in range(300)) for _ in range(20)]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in want]
        assert all(len(m) <= 500 + 4 * 100 for m in (e.known, e.older))  # a step adds its chunks, and their words without marks


def test_cuts_at_every_kind_of_white_space(monkeypatch):
    from tallymark.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 50)
    monkeypatch.setattr(tokens, "STEP", 20)
    e = tokens.Encoder("byte_bpe_50k.json")
    rng = np.random.default_rng(7)
    parts = [" ", " ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\u3000", "\xa0", "\u200b", "word", "Été", "don't", "'s", ".", "...", "?!", "3.5", "日本", "🙂", "x" * 40, "x" * 40 + ","]
    texts = ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(2000)]
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_distinct_chunks_of_a_block_are_looked_up_once(monkeypatch):
    import pyarrow as pa

    from tallymark.llm import tokens

    e = tokens.Encoder("byte_bpe_50k.json")
    seen = []
    step = e._step
    monkeypatch.setattr(e, "_step", lambda chunks: seen.extend(chunks) or step(chunks))
    texts = ["a b c &&& word&&& word$,", None, "", "c  b a", " b", "b ", "a\tb c", "<|endoftext|> b c"] * 50
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert e.encode(pa.array(["x", *texts], pa.string()).slice(1)) == want == e.encode(pa.array(texts, pa.large_string())) == e.encode(texts)
    assert len(seen) == 3 * len(set(seen))
    assert e.encode([]) == [] and e.encode([None, ""]) == [b"", b""]
