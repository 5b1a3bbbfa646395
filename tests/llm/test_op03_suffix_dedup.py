import numpy as np
import pytest

from pagemill.llm import op03_suffix_dedup
from pagemill.llm.op03_suffix_dedup import least_owner, pieces, remove_repeats, shared_prefixes, suffix_array

LAST = 1 << 62


def brute(rows, length):
    first = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min(first.get(w, LAST), LAST if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (LAST if doc is None else doc):
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((doc, len(raw), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "k"), [(50, 24), (20, 8)])
def test_against_brute_force(odd_docs, odd_rows, length, k):
    got = remove_repeats(odd_docs, length, k).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in got), key=str) == brute(odd_rows, length)


def test_common_anchors_are_trimmed(spark):
    """A passage with different surroundings in many documents, with batches so small that it fills several."""
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common = noise(120)
    rows = [(i, noise(int(rng.integers(0, 60))) + common[: int(rng.integers(60, 121))] + noise(int(rng.integers(0, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(docs, batch_bytes=500).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in got), key=str) == brute(rows, 50)


@pytest.mark.parametrize("part", [1, 64, 700, 1 << 19])
def test_pieces_of_long_texts_have_every_window_once(monkeypatch, part):
    monkeypatch.setattr(op03_suffix_dedup, "PART", part)
    rng = np.random.default_rng(3)
    size = [0, 30, 50, 51, 2000, 49, 777, 0]
    off = np.concatenate([[0], np.cumsum(size)])
    data = rng.integers(97, 99, off[-1]).astype(np.uint8)
    _, text, start, length, _ = pieces(data, off, 50, 24)
    windows = [(t, p) for t, s, n in zip(text.tolist(), start.tolist(), length.tolist(), strict=True) for p in range(s, s + n - 49)]
    assert windows == [(t, p) for t in range(len(size)) for p in range(off[t], off[t + 1] - 49)]


def test_texts_longer_than_a_part(spark):
    rng = np.random.default_rng(4)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common = noise((1 << 19) + 3000)
    rows = [(1, common[1000:]), (2, noise(70) + common), (3, common[-200:] + noise(60)), (4, noise(300))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in got), key=str) == brute(rows, 50)


@pytest.mark.parametrize("seed", range(20))
def test_interval_expansion_gives_shared_windows(seed):
    rng = np.random.default_rng(seed)
    strings = [rng.integers(97, 99 + seed % 3, int(rng.integers(1, 40))).astype(np.uint8).tobytes() for _ in range(int(rng.integers(1, 12)))]
    length, owner = int(rng.integers(1, 8)), rng.integers(0, 9, len(strings))
    least, begin = least_owner(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), owner, length)
    for i, s in enumerate(strings):
        for p in range(len(s) - length + 1):
            assert least[begin[i] + p] == min(owner[j] for j, t in enumerate(strings) if s[p : p + length] in t)


def test_suffix_order_and_prefixes():
    symbol = np.array([*b"banana", 0, *b"ananas", 0, *b"anan", 0], np.int16)
    order, n = suffix_array(symbol), len(symbol)
    # separators are distinct symbols in order of place
    key = [tuple((0, i) if c == 0 else (1, c) for i, c in zip(range(p, n), symbol[p:].tolist(), strict=True)) for p in range(n)]
    assert order.tolist() == sorted(range(n), key=lambda p: key[p])

    def common(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    for stop in range(1, 7):
        assert shared_prefixes(symbol, order, stop)[1:].tolist() == [common(key[order[i - 1]], key[order[i]]) >= stop for i in range(1, n)]


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).count() == 0
