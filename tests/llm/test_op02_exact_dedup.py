import hashlib
from collections import defaultdict

import numpy as np
import pytest

from pagemill.llm.op02_exact_dedup import FIELDS, chunk_hash, combine, exact_duplicates


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    out = []
    for doc, text, *_ in rows:
        members = groups[text or ""]
        known = [m for m in members if m is not None]
        keep = max(known) if known else None
        out.append((doc, keep, len(members), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fields", "chunk"), [(FIELDS, 1 << 16), (FIELDS, 16), (((5, 3), (7, 2)), 8), (((2, 1), (3, 1)), 64)])
def test_against_brute_force(odd_docs, odd_rows, fields, chunk):
    """Tiny primes make fingerprints meet by chance: the comparison of chunks must tell texts apart."""
    got = exact_duplicates(odd_docs, fields=fields, chunk_bytes=chunk).collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got), key=str) == brute(odd_rows)


def test_chunks_combine_like_the_whole():
    data = np.frombuffer(bytes(range(256)) * 5, np.uint8)
    for prime, base in FIELDS:
        whole = int(chunk_hash(data, np.array([0, len(data)]), prime, base)[0])
        parts = chunk_hash(data, np.array([0, 100, 777, len(data)]), prime, base)
        joined = combine(combine(int(parts[0]), int(parts[1]), 677, prime, base), int(parts[2]), len(data) - 777, prime, base)
        assert joined == whole


def test_empty_table(no_docs):
    assert exact_duplicates(no_docs).count() == 0
