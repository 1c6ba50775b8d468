import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewheel.llm import alignment
from tidewheel.llm.tokens import tokenizer_path

A, B = tokenizer_path(alignment.TOKENIZER_A), tokenizer_path(alignment.TOKENIZER_B)


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of, extra = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            byte_of[chr(extra)] = b
            extra += 1
    found, count = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a, b = a_side.encode(f" {text}", add_special_tokens=False).ids, b_side.encode(text)
        a_bytes = [bytes(byte_of[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != f" {text}".encode() or b"".join(b_bytes) != f" {text}".encode():
            found.append((doc_id, 0, 0, [], []))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for k, x in enumerate(a_bytes):
            at += len(x)
            ends_a[at] = k
        at = 0
        for k, x in enumerate(b_bytes):
            at += len(x)
            ends_b[at] = k
        common = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a[e]], b[ends_b[e]]) for e in common]
        count.update(links)
        groups, i, j = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, a[i : ends_a[e] + 1])) + "|" + ",".join(map(str, b[j : ends_b[e] + 1])))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        found.append((doc_id, len(a), len(b), groups, links))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    rows = [(d, na, nb, len(g), len(li), sum(count[p] == best[p[1]] for p in li), sum(count[p] for p in li), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, li in found]
    return sorted(rows, key=repr), count, best


def corpus():
    rng = random.Random(7)
    words = ["the", "Straße", "naïve", "don't", "12,345.67", "x=y;", "日本語テキスト", "😀😀", " ", "ﬁne", "<s>", "<|endoftext|>", "<0x41>", "▁under", "é", "é", "  ", "\n\n", "\t", "foo_bar", "ANTIDISESTABLISHMENT", "на", "берегу"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "   lead"), (204, "a"), (205, "\x00\x01"), (206, "tail  "), (7, rows[7][1]), (7, rows[7][1]), (None, "no id"), (207, "﻿mark"), (208, "ｆｕｌｌ")]
    rows += [(300 + i, "the the the the") for i in range(60)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, tmp_path, monkeypatch, small):
    if small:  # many blocks, frames and tasks a bucket, and several levels of merges
        for name, value in (("BLOCK_BYTES", 900), ("FRAME", 7), ("TASK_BYTES", 300), ("FAN", 2), ("BUCKETS", 4)):
            monkeypatch.setattr(alignment, name, value)
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, count, best = brute(rows)
    got = alignment.op11_token_alignment(spark, str(tmp_path))
    assert got.columns == names and sorted(map(tuple, got.collect()), key=repr) == want
    if small:
        pairs = alignment.pair_counts(spark.read.parquet(f"{tmp_path}/documents.parquet"), a_path=A, b_path=B).collect()
        assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs} == {(x, y): (n, n == best[y]) for (x, y), n in count.items()}


def test_merge_of_runs(monkeypatch):
    """Runs of a few records a frame, with pairs that go on from frame to frame and from run to run."""
    monkeypatch.setattr(alignment, "FRAME", 3)
    rng = random.Random(4)
    for _ in range(60):
        runs, total = [], Counter()
        for _ in range(rng.randrange(1, 7)):
            keys = np.sort(np.array([rng.randrange(6) << 16 | rng.randrange(4) for _ in range(rng.randrange(0, 25))], np.int64))
            counts = np.array([rng.randrange(1, 9) for _ in keys], np.uint32)
            for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
                total[k] += n
            runs.append(alignment._run(keys, np.arange(len(keys), dtype=np.uint32), counts))
        merged = [(k, n) for keys, counts in alignment._merge(runs) for k, n in zip(keys.tolist(), counts.tolist(), strict=True)]
        assert merged == sorted(total.items())
        best = {}
        for k, n in total.items():
            best[k >> 16] = max(best.get(k >> 16, 0), n)
        found = [x for keys, counts, top in alignment._bests(alignment._merge(runs)) for x in zip(keys.tolist(), counts.tolist(), top.tolist(), strict=True)]
        assert found == [(k, n, n == best[k >> 16]) for k, n in sorted(total.items())]


def test_pieces_are_remembered_within_bounds(monkeypatch):
    """A block is the same whether pieces are known, forgotten again and again, or never cut."""
    texts, made = [t for _, t in corpus() if t], []
    for known, cut in ((1 << 19, True), (3, True), (1 << 19, False)):
        monkeypatch.setattr(alignment, "KNOWN", known)
        sides = alignment._Sides(A, B)
        sides.cuttable = cut
        block = alignment._Block(alignment._Known(sides), 0)
        for i in range(0, len(texts), 5):
            block.add(list(range(i, i + 5)), texts[i : i + 5])
        made.append((block.rows, sorted(np.concatenate(block.records).tolist())))
    assert made[0] == made[1] == made[2]


def test_very_long_texts(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice([*(t for _, t in corpus() if t), "word", "and", "more", " two"]) for _ in range(4000))
    rows = [(1, text), (2, "x" * 50_000), (3, "日本" * 20_000), (4, " " * 5000), (5, "a b " * 9000)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), a_path=A, b_path=B)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)[0]


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, a_path=A, b_path=B).count() == 0
    odd = spark.createDataFrame([("x", 5, "one two", "k")], "n_a string, doc_id long, text string, kind string")
    assert [tuple(r) for r in alignment.align(odd, a_path=A, b_path=B).collect()] == brute([(5, "one two")])[0]
