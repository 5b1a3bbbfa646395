import random

import numpy as np
import public_tokenizers
import pytest

from pagemill.llm import op11_bpe
from pagemill.llm.op11_bpe import Merges, Vocabulary, decode, encode
from pagemill.llm.queries import op11_bpe as query

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def check(spark, library, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in decode(encode(df, PATH), PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == expected(library, t), (i, t[:80])


def test_odd_rows(spark, library, odd_docs, odd_rows):
    got = sorted((r["doc_id"] is None, r["doc_id"], r["ids"], r["decoded"]) for r in decode(encode(odd_docs, PATH), PATH).collect())
    assert got == sorted((d is None, d, *expected(library, t)) for d, t, *_ in odd_rows)


def test_every_character_of_the_fast_way(spark, library):
    letters = [chr(c) for c in range(op11_bpe.STABLE)]
    check(spark, library, [*letters, *("a" + c + "b" for c in letters), *("7" + c + c for c in letters), "".join(letters)])


def test_other_scripts_and_added_tokens(spark, library):
    texts = [
        "ΑΣ ΟΔΟΣ ΣΣ", "é ẹ́ ́x", "中文字符 日本語テキスト", "한국어 한", "😀👩‍👩‍👧 ok", "x<|endoftext|>y", "<|endoftext|><|startoftext|>", "<|ENDOFTEXT|>", "a <|startoftext|>\n b", "İstanbul ǅ Ⱥ ß ẞ",
        "we'll they're i'm 'S 'LL ''s", " a　b​c᠎", "\x1c\x1d\x85\xa0", "١٢٣ ½ ²", "don't’s",
    ]
    check(spark, library, texts)


def test_random_strings(spark, library):
    rng = random.Random(3)
    alphabet = "aab bcdeéèß'’\n\t 0123 ,.!<|>endofstartx中😀́"
    check(spark, library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)])


def test_long_texts_in_parts(spark, library, monkeypatch):
    rng = random.Random(4)
    words = ["stone", "river's", "café", "x" * 40, "12", "<|endoftext|>", "Über", "they'll", "\n", " ", "中"]
    text = " ".join(rng.choice(words) for _ in range(400_000))  # over two megabytes, so in parts
    check(spark, library, [text, "a" * 300_000, "ab" * 100_000 + " end"])


def test_parts_join_to_the_text():
    text = "one two\nthree  four " * 40_000 + "é ü"
    pieces = list(op11_bpe.parts(text))
    assert len(pieces) > 2 and "".join(pieces) == text


def slow(merges, symbols):
    """Lowest rank first, leftmost first."""
    rank = {p: i for i, p in enumerate(merges)}
    while True:
        pairs = [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


def test_index_of_pairs_against_merging_one_by_one():
    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("ab", "ab"), ("aa", "aa"), ("b", "b"), ("abab", "a")]
    vocab = {t: i for i, t in enumerate(["a", "b", "aa", "ab", "aaa", "abab", "aaaa", "bb", "ababa"])}
    table, rng = Merges(vocab, merges), random.Random(9)
    words = [[rng.choice("ab" if rng.random() < 0.5 else "a") for _ in range(rng.randint(0, 14))] for _ in range(500)]
    start = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ids, off = table.apply(np.array([vocab[c] for w in words for c in w], np.int32), start)
    for w, a, b in zip(words, off[:-1], off[1:]):
        assert ids[a:b].tolist() == [vocab[t] for t in slow(merges, w)]


def test_tables_out_of_order_are_refused():
    with pytest.raises(ValueError, match="later merge"):
        Merges({t: i for i, t in enumerate(["a", "b", "ab", "abb"])}, [("ab", "b"), ("a", "b")])


def test_tasks_forget_words(spark, library, monkeypatch):
    vocabulary = Vocabulary(PATH)
    encoder = op11_bpe.Encoder(vocabulary)
    monkeypatch.setattr(op11_bpe, "REMEMBERED", 3)
    for text in ("one two three four", "five six <|endoftext|> one", ""):
        words, first = encoder.encode([text, text])
        assert encoder.tokens(words[: first[1]]).tolist() == expected(library, text)[0]


def test_other_vocabularies(spark):
    with pytest.raises(ValueError, match="decoder"):
        Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_decode_null_and_unknown(spark):
    vocabulary = Vocabulary(PATH)
    with pytest.raises(ValueError, match="vocabulary"):
        op11_bpe.spell(vocabulary, np.array([10**6]))
    df = spark.createDataFrame([(1, None), (2, []), (3, [320])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in decode(df, PATH).orderBy("doc_id").collect()] == ["", "", vocabulary.library.id_to_token(320)]


def test_empty_table(spark, no_docs):
    assert decode(encode(no_docs, PATH), PATH).collect() == []


def test_query_digests(spark, library):
    from hashlib import sha256

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = expected(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
    assert dict(query(spark, sf).dtypes)["n_tokens"] == "bigint"
