"""Byte-pair encoding with an index of pair occurrences, and decoding.

The different words of a slice of a partition lie one after the other in one array of symbols,
with links to the symbols before and after in the same word. The index holds, for each rank
of the merge table, all positions of its pair. Active ranks are applied in ascending order: a
rank's positions are checked (a symbol may have been merged meanwhile), merged at once, left
to right where they overlap, and the pairs that arise at both sides are added to the lists of
their ranks. A merge only makes pairs of higher ranks, which is checked when the table is
loaded, so one ascending pass gives each word what merging its lowest rank first gives it.

``encode`` gives the ids of the ``tokenizers`` library for a BPE model over bytes with its default
settings: strings of added tokens become their ids. ``decode`` joins the tokens of ids with
spaces, as that library does where the file names no decoder.

Cases: a null or empty text has no ids and decodes to an empty text; rows that repeat an id are
separate rows; a null id stays null; an empty table gives an empty result; other columns are not
looked at. A text of any length is encoded whole, in parts that end before a space or line end between
ASCII letters or digits; a task holds some 50 bytes for each byte of a slice (8 MB), or of a longer part without such a place.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import flat, slices, spread

SLICE_BYTES = 8 << 20
PART_CHARS = 1 << 18
#: Words that a task remembers; more, and it starts anew.
REMEMBERED = 400_000
#: Ids that leave a task in one batch, and ids decoded at once.
BATCH_IDS, DECODED_IDS = 1 << 20, 1 << 17
#: Characters below are stable under NFC, have had their classes since long, and their lower case (but for one added dot) is below too.
STABLE = 0x180
ODD = re.compile(f"[^\x00-{chr(STABLE - 1)}]").search


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabularies over bytes."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge table: ranks by pair, and the pair index that applies them."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = dict(zip(reversed(self.made.tolist()), range(len(merges) - 1, -1, -1), strict=True))
        late = [r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)) if max(born.get(a, -1), born.get(b, -1)) >= r]
        if late or len(born) < len(merges):
            raise ValueError(f"merges {late[:3]} use tokens of later merges, or two make one token: ranks can't be applied in one ascending pass")
        key = self.left << 32 | self.right
        self.order = np.argsort(key)
        self.key = np.append(key[self.order], np.iinfo(np.int64).max)
        self.order = np.append(self.order, -1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none (b may be negative: no symbol)."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.order[at], -1)

    def apply(self, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words: ``symbols[start[i]:start[i+1]]`` is word i. Gives tokens and their offsets by word."""
        n = len(symbols)
        sym = np.append(symbols.astype(np.int64), -1)  # the place n stands for "no symbol"
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        full = start[:-1] < start[1:]
        after[start[1:][full] - 1] = n
        before[start[:-1][full]] = n
        after[n] = before[n] = n
        rank = self.ranks(sym[:n], sym[after[:n]])
        places = np.flatnonzero(rank >= 0)
        index = {}
        self._file(index, rank[places], places.astype(np.int32))
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = np.unique(np.concatenate(lists))
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:  # of pairs that overlap in a row, every other one
                joined = np.append(False, after[at[:-1]] == at[1:])
                count = np.arange(len(at))
                at = at[(count - np.maximum.accumulate(np.where(joined, 0, count))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            sym[at] = self.made[r]
            sym[gone] = -2
            after[at] = then
            before[then] = at
            before[n] = n
            back = before[at]
            at, back = at[then < n], back[back < n]
            rank_at = self.ranks(sym[at], sym[after[at]])
            rank_back = self.ranks(sym[back], sym[after[back]])
            new = np.concatenate([rank_at, rank_back])
            real = new >= 0
            for fresh in self._file(index, new[real], np.concatenate([at, back])[real]):
                heapq.heappush(active, fresh)
        alive = sym[:n] >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return sym[:n][alive].astype(np.int32), count[start]

    @staticmethod
    def _file(index: dict[int, list[np.ndarray]], rank: np.ndarray, places: np.ndarray) -> list[int]:
        """Add places to the lists of their ranks; gives the ranks that had no list."""
        if not len(rank):
            return []
        order = np.argsort(rank, kind="stable")
        rank, places = rank[order], places[order]
        edge = np.flatnonzero(np.diff(rank)) + 1
        fresh = []
        for r, lot in zip(rank[np.append(0, edge)].tolist(), np.split(places, edge), strict=True):
            if r in index:
                index[r].append(lot)
            else:
                index[r] = [lot]
                fresh.append(r)
        return fresh


class Vocabulary:
    """What is needed of a tokenizer file: BPE over bytes, with or without a suffix for ends of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "dropout", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"not a plain BPE model over bytes without decoder and post-processor: {odd}")
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        letters, suffix = byte_symbols(), model.get("end_of_word_suffix") or ""
        self.inner = np.array([model["vocab"][c] for c in letters], np.int32)
        self.last = np.array([model["vocab"][c + suffix] for c in letters], np.int32)
        self.byte_of = {c: b for b, c in enumerate(letters)}
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that strip, or match words or normalised text, are not read")
        self.added = {t["content"]: t["id"] for t in added}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        spelt = [(tokens.get(i, "") + " ").encode() for i in range(max(tokens) + 1)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_off = np.concatenate([[0], np.cumsum([len(s) for s in spelt])])
        self.words = self._matcher(spec)

    def _matcher(self, spec: dict):
        """A compiled pattern for the words of texts of stable characters, where the file has the steps that it stands for."""
        kind = lambda c: unicodedata.category(chr(c))[0]
        shape = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        # fixed values: the only steps that the fast way knows
        known = [
            {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
            {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
                ],
            },
        ]
        if shape != json.dumps(known):
            return None
        letters = "".join(re.escape(chr(c)) for c in range(STABLE) if kind(c) == "L")
        digits = "".join(re.escape(chr(c)) for c in range(STABLE) if kind(c) == "N")
        blank = " \t\n\v\f\r\x85\xa0"
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blank}{letters}{digits}]+").findall

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text, and its added tokens with a space before (no word holds one), in lists."""
        for part in parts(text):
            pieces = self.split_added.split(part) if self.split_added else [part]
            for k, piece in enumerate(pieces):
                if k % 2:
                    yield [" " + piece]
                elif piece:
                    yield self.words(piece.lower()) if self.words and (piece.isascii() or not ODD(piece)) else self.by_library(piece)

    def by_library(self, piece: str) -> list[str]:
        if self.library.normalizer is not None:
            piece = self.library.normalizer.normalize_str(piece)
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]


def parts(text: str) -> Iterator[str]:
    """A text in parts that each begin at white space: no word, contraction or added token goes over such a place."""
    at = 0
    while len(text) - at > PART_CHARS:
        found = BREAK.search(text, at + PART_CHARS)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


#: A space or line end before a letter or digit of ASCII, so that neither runs of white space nor composed characters are cut.
BREAK = re.compile(r"(?<=[0-9A-Za-z])[ \n](?=[0-9A-Za-z])")


class Numbers(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes slices of texts; words that it has met keep their tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.ids, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, and where each text's begin."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        number, lots, first = self.numbers.__getitem__, [], [0]
        for text in texts:
            n = 0
            for words in self.vocabulary.split(text):
                lots.append(np.fromiter(map(number, words), np.int32, len(words)))
                n += len(words)
            first.append(first[-1] + n)
        self._learn(list(self.numbers)[len(self.off) - 1 :])
        return np.concatenate(lots) if lots else np.zeros(0, np.int32), np.array(first)

    def _learn(self, words: list[str]) -> None:
        """The tokens of new words, by the index of all their pairs."""
        if not words:
            return
        v = self.vocabulary
        raw = [b"" if w[0] == " " else w.encode() for w in words]
        start = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = v.inner[data]
        ends = start[1:][start[:-1] < start[1:]] - 1
        symbols[ends] = v.last[data[ends]]
        ids, off = v.merges.apply(symbols, start)
        special = [k for k, w in enumerate(words) if w[0] == " "]
        if special:
            ids = np.insert(ids, off[special], [v.added[words[k][1:]] for k in special])
            step = np.zeros(len(off), np.int64)
            step[np.array(special) + 1] = 1
            off = off + np.cumsum(step)
        self.off = np.concatenate([self.off, self.off[-1] + off[1:]])
        self.ids = np.concatenate([self.ids, ids])

    def tokens(self, words: np.ndarray) -> np.ndarray:
        return self.ids[spread(self.off[words], self.off[words + 1] - self.off[words])]

    def lengths(self, words: np.ndarray) -> np.ndarray:
        return self.off[words + 1] - self.off[words]


def spell(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The tokens of ids, joined by spaces."""
    out, off = [], vocabulary.spelt_off
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(off) - 1):
        raise ValueError("an id is not in the vocabulary")
    for i in range(0, len(ids), DECODED_IDS):
        some = ids[i : i + DECODED_IDS]
        out.append(vocabulary.spelt[spread(off[some], off[some + 1] - off[some])].tobytes())
    return b"".join(out)[:-1]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids (array of int)`` for each row; ``path`` names a tokenizer file that every executor has."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Vocabulary(path))
            data, off = flat(batch.column(1))
            raw = memoryview(data)
            for i, j in slices(off, SLICE_BYTES):
                words, first = encoder.encode([str(raw[off[k] : off[k + 1]], "utf-8") for k in range(i, j)])
                ends = np.concatenate([[0], np.cumsum(encoder.lengths(words))])[first]
                a = 0
                while a < j - i:  # some texts at a time
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + BATCH_IDS, side="right")) - 1)
                    ids = encoder.tokens(words[first[a] : first[b]])
                    lists = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i + a : i + b], lists], schema=schema)
                    a = b

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded``: the tokens of ``ids``, joined by spaces; null ids give an empty text."""

    def run(batches):
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(path)
            lists = batch.column(1)
            for k in range(0, len(lists), 256):
                some = lists[k : k + 256]
                # flatten() leaves out what null lists may hide
                size = np.array([0 if x is None else x for x in pc.list_value_length(some).to_pylist()], np.int64)
                ends = np.concatenate([[0], np.cumsum(size)])
                ids = some.flatten().to_numpy(zero_copy_only=False)
                texts = [spell(vocabulary, ids[a:b]).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 256], some, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
