from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm.op01_packing import Encoder, Packer, pack

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_give_every_document_back(odd_docs, odd_rows):
    """Rows with an id used once: ids match the tokenizer, pieces are gapless, sequences are at most 1024 long."""
    rows = pack(odd_docs, VOCABULARY).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    by, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    times = defaultdict(int)
    for doc, *_ in odd_rows:
        times[doc] += 1
    for doc, text, *_ in odd_rows:
        if times[doc] > 1:
            continue
        ids, got = tokenizer.encode(text or "", add_special_tokens=False).ids + [0], []
        for r in sorted(by[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (len(got), len(ids))
            got += np.frombuffer(r["ids"], "<u4").tolist()
        assert got == ids
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in odd_rows)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == w[0]["sequence_tokens"] <= 1024 and at & (at - 1) == 0  # nothing is padded


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y <|endoftext", " " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "z" * 1_000_000, "q <|endoftext|>" + "\t" * 1_000_000 + " <|endoftext|>", "\u00e9\u3000" * 1000])
def test_ids_are_those_of_the_tokenizer(text):
    """With its default settings; strings of added tokens and long runs of one character too."""
    assert Encoder(VOCABULARY)(text).tolist() == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_a_long_text_of_blanks_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (None, "x <|endoftext|>")], "doc_id long, text string")
    assert 50256 in np.frombuffer(pack(docs, VOCABULARY).where("doc_id is null").first()["ids"], "<u4")
    assert pack(docs, VOCABULARY).where("doc_id = 1").count() > 900


def test_empty_table(no_docs):
    assert pack(no_docs, VOCABULARY).count() == 0


@pytest.mark.parametrize("sizes", [[5], [1024], [1, 1, 1], [700, 400, 300, 1500, 64, 64, 9], list(range(1, 200))])
def test_packer_keeps_all_tokens_and_balances_steps(sizes):
    packer, out = Packer(pool=4, step=4, steps=2), []
    for doc, n in enumerate(sizes):
        out += packer.add(doc, np.full(n, doc, np.uint32))
    out += packer.finish()
    seen = defaultdict(int)
    for _, _, window in out:
        for doc, _, ids, n in window:
            assert n == sizes[doc] and (ids == doc).all()
            seen[doc] += len(ids)
    assert [seen[d] for d in range(len(sizes))] == sizes
    steps = defaultdict(int)
    for _, step, _ in out:
        steps[step] += 1
    assert max(steps.values()) <= 4
