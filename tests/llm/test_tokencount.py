import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD, frame, real
from tokenizers import Tokenizer, models, pre_tokenizers

from parchmill.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def exact():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    vocabulary = [("<unk>", 0.0)] + [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    made = Tokenizer(models.Unigram(vocabulary, 0, True))
    made.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return made


def check(docs, exact):
    rows = docs.collect()
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, PATH).collect()}
    assert got == {r.doc_id: len(exact.encode(r.text or "").ids) for r in rows}


def test_documents(spark, exact):
    check(real(spark, 300), exact)


def test_odd_texts(spark, exact):
    check(frame(spark, [*ODD, " lead", "a  b   c ", "▁mark", "漢漢漢 ሴስ", "tab\tand\nline"]), exact)
    assert tokencount.count_tokens(frame(spark, ["a"]).limit(0), PATH).collect() == []


def test_ties_and_unknowns():
    vocabulary = [("▁", -1.0), ("▁a", -3.0), ("a", -2.0), ("ab", -4.0), ("b", -2.0), ("▁ab", -5.0), ("c", -1.0)]
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, False))
    exact.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    ours = tokencount.Unigram([("<unk>", 0.0), *vocabulary])
    import itertools

    for n in range(1, 7):
        for word in map("".join, itertools.product("abcz", repeat=n)):
            assert ours.count("▁" + word)[0] == len(exact.encode(word).ids), word
