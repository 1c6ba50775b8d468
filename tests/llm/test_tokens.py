import base64
import random
import time

import pytest
from fixtures import documents

from tidewheel.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load_tokenizer(tokens.tokenizer_path())


def whole(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk,overlap", [(50, 8), (64, 4), (200, 40), (7, 2)])
def test_chunks_give_the_same_count(tokenizer, chunk, overlap):
    rng = random.Random(chunk)
    pieces = ["word", "  two", "\n\n", " don't", "12345", " é", "漢字", "😀😀", "<|endoftext|>", "<|endof", "!!!", " " * 9, "a" * 120, "\t", " ", "x y z", "'ll", " ʼs"]
    for _ in range(150):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 120)))
        assert tokens.count_in_chunks(tokenizer, text, chunk, overlap) == whole(tokenizer, text), repr(text)
    for text in ("", "a", "a" * 3000, " " * 3000, "ab " * 2000, "　".join("ab" for _ in range(900))):
        assert tokens.count_in_chunks(tokenizer, text, chunk, overlap) == whole(tokenizer, text)


def test_pieces_give_the_same_count(tokenizer, monkeypatch):
    """Texts are counted by pieces, each of which is encoded once; what is remembered is bounded."""
    monkeypatch.setattr(tokens, "KNOWN", 40)
    rng = random.Random(4)
    parts = ["word", " ", "  ", "\n", " \n ", "\t ", "don't", " 's", "'ll", "12 345", " é", "漢 字", "😀 ", "<|endoftext|>", " <|endof", "!!! ?", "a" * 50, "\u00a0 ", " \u3000", "\x1c ", " \x85", "ʼs", "\r\n"]
    counts = tokens._Counts(tokenizer)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(20)] + ["", " ", "a b", " a b "]
        assert counts.of(texts) == [whole(tokenizer, t) for t in texts]
    assert len(counts.known) < 5000

    encoded = []
    counts = tokens._Counts(tokenizer)
    counts.tokenizer = type("T", (), {"encode_batch_fast": lambda self, texts, **k: (encoded.extend(texts), tokenizer.encode_batch_fast(texts, **k))[1]})()
    assert counts.of(["some words " * 50 + "end"] * 9) == [whole(tokenizer, "some words " * 50 + "end")] * 9
    assert sorted(encoded) == [" end", " some", " words", "some"]


def test_every_stable_place_begins_a_piece(tokenizer):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Z", "é", "ж", "漢", "가", "か", "7", "٣", "'", "'s", "’", "!", "。", "_", " ", "  ", "\n", "\t", "\u00a0", "😀", "ʼ"]) for _ in range(rng.randrange(2, 12)))
        begins = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        assert all(p in begins for p in range(1, len(text)) if tokens.stable(text, p)), repr(text)


def test_time_is_in_proportion_without_blanks(tokenizer):
    rng = random.Random(2)
    texts = {
        "base64": base64.b64encode(rng.randbytes(300_000)).decode(),
        "han": "".join(chr(rng.randrange(0x4E00, 0x9FA5)) if rng.random() < 0.95 else "。" for _ in range(400_000)),
        "code": "".join(rng.choice(["if(a)", "{b=", "c+1;}", "x1y2", "for(;;)"]) for _ in range(90_000)),
        "one piece": "z" * 400_000,
        "added": "<|endoftext|>" * 30_000,
    }
    for name, text in texts.items():
        begin = time.process_time()
        want = whole(tokenizer, text)
        middle = time.process_time()
        got = tokens.count_in_chunks(tokenizer, text)
        assert got == want, name
        assert time.process_time() - middle < 3 * (middle - begin) + 1, name


def test_query(spark, tmp_path, tokenizer):
    rows = documents(spark, tmp_path, [(300, "<|endoftext|> inside", "en", "s", 1), (301, ("naïve text, " * 5000) + "z" * 40_000, "en", "s", 1)])
    got = sorted((tuple(r) for r in tokens.op4_token_counts(spark, str(tmp_path)).collect()), key=repr)
    want = [(d, len((t or "").encode()), whole(tokenizer, t or ""), whole(tokenizer, t or "") > 1024) for d, t, *_ in rows]
    assert got == sorted(want, key=repr)


def test_columns(spark):
    df = spark.createDataFrame([("a b", 7, "keep")], "text string, n_tokens long, other string")
    row = tokens.count_tokens(df, path=tokens.tokenizer_path()).first()
    assert (row["n_tokens"], row["other"]) == (2, "keep")
    assert tokens.count_tokens(df.limit(0), path=tokens.tokenizer_path()).count() == 0
