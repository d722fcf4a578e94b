import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import DOCS, LONG, clashing, docs, empty
from tokenizers import Tokenizer

from rasterlake.llm import pieces, token_counts

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "  ", "<|endoftext|> a<|startoftext|>b <|endoftext|>", "Ça été ΑΣ Σ İstanbul ﬁ ½ ² ٣ 漢字かな 🙂👍🏽 á ȩ́", "don't I'll WE'VE _x_ a__b",
    "\x1c\x1d\x85\xa0　x", "a" * 5000, "!" * 3000, "▁ x ▁", "\n\n  \n x\t\ty", "x\x00y", "<s> </s> <unk> <0x41>", LONG, "ab" * 40_000,
]
ANY = st.text(alphabet=st.one_of(st.sampled_from("abcdeiost   ▁ETA.,;'\n\t é"), st.characters(exclude_categories=("Cs",), max_codepoint=0x2FFF)), max_size=50)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def texts(spark):
    return [*ODD, *[r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]]


def test_counts_are_the_librarys(library, texts):
    count = token_counts.counter(WORDS).count
    assert [count(t) for t in texts] == [len(e.ids) for e in library[0].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=500, deadline=None)
@given(ANY)
def test_counts_of_any_text(text):
    assert token_counts.counter(WORDS).count(text) == len(Tokenizer_().encode(text, add_special_tokens=False).ids)


def Tokenizer_(kept=[]):
    if not kept:
        kept.append(Tokenizer.from_file(WORDS))
    return kept[0]


def test_proved_strings_are_single_tokens(library):
    alone = sorted(token_counts.counter(WORDS).merges.alone)
    sample = [w for w in alone if token_counts.pre_tokens(w) == [w]]
    assert len(sample) > 20_000
    assert all(len(e.ids) == 1 for e in library[0].encode_batch(sample, add_special_tokens=False))


def test_both_ways_of_merging_agree():
    merges = token_counts.counter(WORDS).merges
    for word in ("international", "ththereernd" * 5, "aaaaaaaa" * 9, "é漢" * 30):
        parts = [merges.signs[b] for b in word.encode()]
        parts[-1] += merges.end
        assert merges._short(parts[:]) == merges._long(parts[:])


def test_count_table(spark):
    got = token_counts.count_tokens(clashing(spark), WORDS, 2048)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = {r.doc_id: tuple(r)[1:] for r in got.filter("doc_id is not null").collect()}
    assert rows[3] == (0, 0, False) and rows[4] == (0, 0, False) and rows[6][2] and rows[6][0] == len(LONG)
    assert got.count() == len(DOCS) and token_counts.count_tokens(empty(spark), WORDS, 9).count() == 0


def test_pieces_are_the_librarys(library, texts):
    codec = pieces.codec(PIECES)
    for text, want in zip(texts, library[1].encode(texts, num_threads=1)):
        ids = codec.encode(text)
        assert ids.tolist() == want
        assert codec.decode(ids) == text.replace("▁", " ") == library[1].decode(want)


@settings(max_examples=500, deadline=None)
@given(ANY)
def test_pieces_of_any_text(text):
    codec = pieces.codec(PIECES)
    ids = codec.encode(text)
    assert ids.tolist() == Pieces_().encode(text) and codec.decode(ids) == text.replace("▁", " ")


def Pieces_(kept=[]):
    if not kept:
        kept.append(sentencepiece.SentencePieceProcessor(model_file=PIECES))
    return kept[0]


def test_unigram_rule_finds_the_best_sum():
    codec = pieces.Codec(PIECES, "unigram")
    for text in ("▁there", "▁banana", "hello"):
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(end):
                piece = codec.ids.get(text[begin:end])
                if piece is not None:
                    best[end] = max(best[end], best[begin] + codec.score[piece])
        ids = codec._best_unigram(text)
        assert "".join(codec.names[i] for i in ids) == text and sum(codec.score[i] for i in ids) == best[-1]


def test_codec_table(spark):
    rows = clashing(spark).drop("score")
    encoded = pieces.encode(rows, PIECES)
    got = {r.doc_id: r for r in encoded.filter("doc_id is not null").collect()}
    assert got[3].ids == [] and got[4].n_tokens == 0 and got[6].round_trip
    back = {r.doc_id: r.text for r in pieces.decode(encoded.select("doc_id", "ids"), PIECES).filter("doc_id is not null").collect()}
    assert back == {i: t or "" for i, t, _, _ in DOCS if i is not None}
    assert pieces.encode(empty(spark), PIECES).count() == 0
    assert np.array_equal(pieces.codec(PIECES).encode("a b"), pieces.codec(PIECES).encode("a b"))
    assert pieces.encode(docs(spark), PIECES).count() == len(DOCS)
