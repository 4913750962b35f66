"""Long words, odd letters and repeated texts in language identification."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskframe.llm import language_id as L

PIECES = ["a", "b", "ab", "ba", "aba", "abab", "▁", "▁a", "é"]


def test_long_words_equal_the_plain_recursion():
    table, rng = L.PieceTable(PIECES), random.Random(3)
    rows = L._rows(np.random.default_rng(1).random((len(PIECES), 3)))
    words = ["▁" + "".join(rng.choice("abéx") for _ in range(n)) for n in (1, 2, 39, 40, 41, 255, 256, 257, 300, 511, 512, 600)]

    def logs(word):
        """One position after the other, in logarithms."""
        alpha = [np.zeros(3)]
        for end in range(1, len(word) + 1):
            terms = [alpha[end - n] + np.log(rows[PIECES.index(word[end - n:end])])
                     for n in range(1, min(end, table.longest) + 1) if word[end - n:end] in PIECES]
            if word[end - 1] not in PIECES:
                terms.append(alpha[end - 1] + np.log(L.UNKNOWN))
            alpha.append(np.logaddexp.reduce(terms))
        return alpha[-1]

    got = L.forward_long(words, table, rows) - np.array([len(w) for w in words])[:, None] * np.log(L.SCALE)
    assert np.allclose(got, [logs(w) for w in words], rtol=1e-10)
    model = L.LanguageModel(["x", "y", "z"], PIECES, rows[:-2]).open()
    assert np.allclose(model.log_probs([w[1:] for w in words]), got, rtol=1e-10)


@pytest.mark.parametrize("text, words", [("½ ² ① Ⅷ", []), ("a½b ²c", ["a", "b", "c"]), ("x_y 3z", ["x", "y", "z"]),
                                         ("日本語, ÉA", ["日本語", "éa"]), ("ª", ["ª"]), ("", [])])
def test_only_letters_make_words(text, words):
    assert L.words_of(text) == words


def test_texts_without_letters_are_und_and_copies_count_once(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    hot = t.orderBy("doc_id").limit(1).crossJoin(spark.range(400)).select(F.col("doc_id") + 10_000 + F.col("id"), "text", "lang")
    vocab, rules = public_tokenizers.path("piece_bpe_32k.model"), L.LanguageRules(fit_docs=60, fit_words=3000)
    plain, copied = L.fit(t, vocab, rules), L.fit(t.union(hot), vocab, rules)
    assert plain.languages == copied.languages and np.array_equal(plain.prob, copied.prob)
    odd = spark.createDataFrame([(1, "½ ² ① Ⅷ"), (2, None), (3, "日" * 100_000), (4, "the house and the garden " * 20_000)],
                                "doc_id long, text string")
    got = {r.doc_id: r for r in L.predict(odd, plain).collect()}
    assert [got[i].lang_pred for i in (1, 2)] == ["und"] * 2 and got[1].score == 0
    assert got[4].lang_pred == "en" and got[3].lang_pred in plain.languages
