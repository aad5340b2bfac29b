"""Token counts and token files against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from holdline.llm import pieces, queries, token_blocks, token_counts
from tokenizers import Tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    " ", " ", "  ", "\n", " \n", "\t", ".", ",", "!", "|", "a", "B", "Word", "é", "É", "İ", "́", "ß", "ﬁ", "中",
    "1", "23", "'s", "'ll", "<|endoftext|>", "<|", "|>", "\x1c", "J", "̌", "…", "😀", "K", "ς", "Σ", "\r\n", "\x85",
    "_", "-", "x" * 60, " ", " ",
]


def whole(path, texts):
    found = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in found]


def test_pieces_give_what_whole_texts_give():
    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(8000)]
    assert pieces.count_all(BYTES, texts) == [len(x) // 4 for x in whole(BYTES, texts)]
    assert pieces.ids_all(WORDS, texts) == whole(WORDS, texts)
    # Each with the other's purpose.
    assert pieces.ids_all(BYTES, texts) == whole(BYTES, texts)
    assert pieces.count_all(WORDS, texts) == [len(x) // 4 for x in whole(WORDS, texts)]


def test_words_cut_at_their_borders():
    rng = random.Random(12)
    marks = ["'s", "'S", "'t", "'re", "'", "''", ".", ",", "|", "||", "-", "<", "<<|", "\t", "\n", " ", " ", "7", "42", "”", "—", "§", "©"]
    letters = ["a", "Zq", "é", "É", "ß", "ÿ", "Þ", "Ø", "œ", "ª", "²", "µ", "\x7f", "\x00", "\xa0", "\xad", "×", "÷", "ẞ"]
    texts = ["".join(rng.choice(rng.choice((marks, letters))) for _ in range(rng.randrange(16))) for _ in range(8000)]
    assert pieces.ids_all(WORDS, texts) == whole(WORDS, texts)
    every = [f"{chr(c)} a{chr(c)}b 's{chr(c)}t" for c in range(0x2100) if not 0xD800 <= c < 0xE000]
    assert pieces.ids_all(WORDS, every) == whole(WORDS, every)
    assert sum(pieces.atoms(t) is not None for t in every) > 170


def test_one_very_long_word():
    texts = ["x" * 300_000, "é" * 100_000, "!" * 100_000, "1" * 100_000, "ab'" * 50_000]
    assert pieces.ids_all(WORDS, texts) == whole(WORDS, texts)
    assert pieces.count_all(BYTES, texts[3:]) == [len(x) // 4 for x in whole(BYTES, texts[3:])]


def test_other_rules_are_encoded_whole(tmp_path):
    from tokenizers import normalizers

    changed = Tokenizer.from_file(BYTES)
    changed.normalizer = normalizers.Strip()
    path = str(tmp_path / "changed.json")
    changed.save(path)
    assert [pieces.kind(p) for p in (BYTES, WORDS, path)] == ["spaced", "bare", "whole"]
    texts = ["  a b  ", "", " c d"]
    assert pieces.ids_all(path, texts) == whole(path, texts)
    assert pieces.count_all(path, texts) == [len(x) // 4 for x in whole(path, texts)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 20)
    texts = [f"some words, more{i} words. {i} Words" for i in range(300)]
    got = [x for i in range(0, 300, 7) for x in pieces.ids_all(WORDS, texts[i : i + 7])]
    assert got == whole(WORDS, texts)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("top", [1, 2, 50, 49408, 2**32 - 1])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::50] = top - 1  # exceptions
    data = token_blocks.pack(ids)
    assert (token_blocks.unpack(data) == ids).all()
    for block in range(-(-n // 128)):
        assert (token_blocks.unpack(data, block) == ids[block * 128 : block * 128 + 128]).all()


def test_blocks_are_smaller_with_exceptions_apart():
    ids = np.full(128, 5, np.uint32)
    ids[7] = 1 << 30
    assert len(token_blocks.pack(ids)) < 50


def test_op4(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op4_token_counts(spark, sf_dir).collect()}
    sizes = [len(x) // 4 for x in whole(BYTES, [texts[i] or "" for i in texts])]
    assert len(got) == len(texts)
    for i, n in zip(texts, sizes):
        assert got[i]["n_tokens"] == n and got[i]["over_limit"] == (n > 1024)
        assert got[i]["n_bytes"] == len((texts[i] or "").encode())


ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "x " * 30_000), (5, None), (6, "  \n ")]


def odd_rows(spark):
    # Other columns, of names that operators use inside.
    rows = [(i, t, "z", 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, content string, n_tokens int")


def test_cache_is_used_and_added_to(spark, folder):
    docs = odd_rows(spark)
    first = token_counts.count_tokens(docs, BYTES, folder).collect()
    assert len(first) == len(ODD)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in first) == sorted(
        (i or 0, len(x) // 4) for (i, _), x in zip(ODD, whole(BYTES, [t or "" for _, t in ODD]))
    )
    stored = spark.read.parquet(folder)
    assert stored.count() == 4  # distinct texts
    # What is stored is believed, so a wrong count comes back: it was not encoded again.
    wrong = stored.selectExpr("content", "n_tokens + 1000 AS n_tokens", "tokenizer")
    wrong.write.parquet(folder + "2")
    again = token_counts.count_tokens(docs, BYTES, folder + "2").collect()
    assert min(r["n_tokens"] for r in again) == 1000
    assert spark.read.parquet(folder + "2").count() == 4
    # Another tokenizer's counts are apart.
    other = token_counts.count_tokens(docs, WORDS, folder + "2").collect()
    assert max(r["n_tokens"] for r in other) == 30_000
    assert token_counts.count_tokens(docs.limit(0), BYTES, folder + "3").count() == 0


def expected_files(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    out, start = [], 0
    for (i, t), ids in zip(rows, whole(WORDS, [t or "" for _, t in rows])):
        ids += np.array([1], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_op8(spark, sf_dir, texts):
    got = [tuple(r) for r in queries.op8_token_blocks(spark, sf_dir).orderBy("start").collect()]
    assert got == expected_files(list(texts.items()))


def test_op8_odd_rows_and_small_segments(spark, folder, monkeypatch):
    monkeypatch.setattr(token_blocks, "SEGMENT_IDS", 3)
    token_blocks.write_tokens(odd_rows(spark), WORDS, folder)
    got = [tuple(r) for r in token_blocks.read_documents(spark, folder).orderBy("start").collect()]
    assert got == expected_files(ODD)
    token_blocks.write_tokens(odd_rows(spark).limit(0), WORDS, folder + "2")
    assert token_blocks.read_documents(spark, folder + "2").count() == 0


def test_a_worker_holds_one_tokenizer_and_the_pieces_of_few_texts(monkeypatch):
    import tokenizers

    made, held, values = [], [], pieces.Memo.values

    class Counted:
        @staticmethod
        def from_file(path):
            made.append(path)
            return Tokenizer.from_file(path)

    def counted(self, texts, of_atoms=[]):
        held.append(len(texts) + len(of_atoms))
        return values(self, texts, of_atoms)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(pieces.Memo, "values", counted)
    pieces.load.cache_clear()
    pieces._memo.cache_clear()
    texts = [f"Some WORDS{i}, 中文 {i}" if i % 3 else f"Plain Words{i}'s" for i in range(500)]
    assert pieces.ids_all(WORDS, texts) == whole(WORDS, texts)
    assert made == [WORDS] and max(held) <= 64
    # Its rules are set back.
    assert [np.array(pieces.load(WORDS).encode(t).ids, "<u4").tobytes() for t in texts] == whole(WORDS, texts)
