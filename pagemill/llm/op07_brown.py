"""Language-model scores by a Brown class-based bigram model.

Words (lower-cased, between white space) are counted over all training documents, those of which
crc32(doc_id as text) modulo ``folds`` is not 0. Exchange clustering gives each word that is
seen twice or more a class, so that the class bigrams' likelihood rises:

1. On the driver, the ``head`` most frequent of these are moved one by one between ``classes`` classes, with
   each other word as one of a few shapes (its length, its last character, whether it is ASCII).
2. In the tasks, every other word of the vocabulary is moved. Its contexts (how often each class
   stands before and after it, over the whole corpus) are grouped sums; a task that has them
   all judges the exchange against the table of class bigrams. All words are judged against the same
   table; if the likelihood of the new classes were lower, the old ones would stay.

Words that are seen once stand, as in step 1, for the words of their shape that are never seen. Then

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

Class transitions are interpolated with class frequencies. A word that is seen n > 1 times is emitted with
n / (tokens of its class). A shape's words that are seen once share its tokens with
one slot of weight U for unseen words (the mean number of such words in a shape). A text is its
tokens and one end, which also stands before it. log10 P(text) gives the perplexity.

Texts are read once and written as slices: the different words of some megabytes of text (64-bit hashes: 59
bits, and the shape) and the texts as places in that list. Counts, contexts and classes are rows keyed by
word; answers go back to the slices. The driver and each task hold the head, at most
``(head + 25) ** 2`` pair counts, the table of class bigrams and a slice; nothing else grows with the vocabulary there.

Cases: a null or empty text is one end; a null doc_id is trained on; without training
documents all tokens are unseen; rows that repeat are scored each by itself and
all count in training; a text of any length is one slice, and a task holds some 40 bytes for each of its
bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import INK, U64, Words, byte_set, flat, pack_bytes, slices, spread, squeeze, squeeze_codes, unpack_bytes, unsqueeze, unsqueeze_codes
from .session import cut, written

SHAPES = 24
LETTER = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: What a word's last byte gives to its shape: a letter or digit, a full stop, a comma, anything else.
TAIL = np.where(LETTER, 0, np.where(np.arange(256) == 46, 2, np.where(np.arange(256) == 44, 4, 6))).astype(np.uint8)
SLICE = 8 << 20
MISSING = -(1 << 63)  # stands for a null doc_id inside


def tokens(data: np.ndarray, off: np.ndarray) -> Words:
    """The words of a slice; the low 5 bits of a hash are the word's shape."""
    words = Words(data, off, INK)
    if len(words.start):
        size = words.stop - words.start
        wide = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data >= 128, dtype=np.int32, out=wide[1:])
        shape = TAIL[data[words.stop - 1]]
        shape += np.uint8(8) * (size >= 5) + np.uint8(8) * (size >= 9)
        shape += wide[words.stop] > wide[words.start]
        words.hash &= ~U64(31)
        words.hash |= shape
    return words


def shape_of(word: np.ndarray) -> np.ndarray:
    return (word.view(U64) & U64(31)).astype(np.int64)


#: A slice: its texts (doc, number of words, whether trained on), its different words in order, their counts in training,
#: and each token as a place in that order.
ENCODED = "slice long, trained_texts long, texts binary, words binary, counts binary, places binary"


class Slice:
    """One row of the slices, read back."""

    def __init__(self, texts: bytes, words: bytes, counts: bytes, places: bytes):
        self.doc, self.n, trained = np.frombuffer(unpack_bytes(texts), "<i8").reshape(3, -1)
        self.trained = trained.astype(bool)
        self.words, self.counts, self.places = unsqueeze_codes(words), unsqueeze(counts), unsqueeze(places).astype(np.int64)

    def sequence(self, of_word: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' symbols with an end before and after each text, and where each text begins."""
        return sequence(of_word[self.places] if len(self.places) else self.places, self.n, end)

    @staticmethod
    def each(batches):
        for batch in batches:
            for number, _, *parts in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                yield number, Slice(*parts)


def sequence(symbols: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.cumsum(n + 2) - (n + 2)
    out = np.full(len(symbols) + 2 * len(n), end, np.int64)
    out[spread(begin + 1, n)] = symbols
    return out, begin


def encode(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """Slices of ``docs (text, doc_id, trained)``."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = flat(batch.column(0))
            doc = batch.column(1).to_numpy(zero_copy_only=False)
            trained = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in slices(off, slice_bytes):
                words = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                own, place = np.unique(words.hash, return_inverse=True)
                times = np.bincount(place[np.repeat(trained[i:j], words.count)], minlength=len(own))
                texts = pack_bytes(np.stack([doc[i:j], words.count, trained[i:j]]).astype("<i8").tobytes())
                row = [number, int(trained[i:j].sum()), texts, squeeze_codes(own), squeeze(times), squeeze(place)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)], [x.split()[0] for x in ENCODED.split(", ")])
                number += 1

    return docs.select("text", "doc_id", "trained").mapInArrow(run, ENCODED)


def word_counts(encoded: DataFrame) -> DataFrame:
    """``word, n`` of the training texts."""

    def run(batches):
        for _, s in Slice.each(batches):
            seen = np.flatnonzero(s.counts)
            yield pa.RecordBatch.from_arrays([pa.array(s.words[seen].view(np.int64)), pa.array(s.counts[seen].astype(np.int64))], ["word", "n"])

    return encoded.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Symbols:
    """The symbols that the driver clusters: head words by falling count, then the shapes, then the end."""

    def __init__(self, head: np.ndarray):
        self.order = np.argsort(head)
        self.sorted, self.n_head = head[self.order], len(head)
        self.size = self.n_head + SHAPES + 1
        self.end = self.size - 1

    def of(self, word: np.ndarray) -> np.ndarray:
        out = self.n_head + shape_of(word)
        if self.n_head:
            at = np.minimum(np.searchsorted(self.sorted, word), self.n_head - 1)
            same = self.sorted[at] == word
            out[same] = self.order[at[same]]
        return out


def _pairs(seq: np.ndarray, begin: np.ndarray, n: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Places in a sequence, of texts that are trained on, that follow another symbol."""
    inside = np.repeat(trained, n + 2)
    inside[begin] = False
    return np.flatnonzero(inside)


def pair_counts(encoded: DataFrame, symbols: Symbols) -> np.ndarray:
    """How often each symbol follows each other one in the training documents."""
    sent = encoded.sparkSession.sparkContext.broadcast(symbols)

    def run(batches):
        symbols = sent.value
        for _, s in Slice.each(batches):
            seq, begin = s.sequence(symbols.of(s.words), symbols.end)
            at = _pairs(seq, begin, s.n, s.trained)
            pair, n = np.unique(seq[at - 1] * symbols.size + seq[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

    rows = encoded.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(symbols.size**2)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(symbols.size, symbols.size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """What the classes give to the log likelihood of the class bigrams."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def exchange(pairs: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """The class of each symbol, by exchange clustering of the bigram counts."""
    m = len(pairs)
    classes = min(classes, m)
    weight = pairs.sum(0) + pairs.sum(1)
    rank = np.argsort(np.argsort(-weight, kind="stable"), kind="stable")
    of = np.where(rank < classes, rank, rank % classes)
    member = np.zeros((m, classes))
    member[np.arange(m), of] = 1
    table = member.T @ pairs @ member
    to, back = pairs @ member, member.T @ pairs  # symbol to class, class to symbol
    left, right = table.sum(1), table.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in np.argsort(-weight, kind="stable"):
            if not weight[w]:
                break
            a, own = of[w], pairs[w, w]
            out_w, in_w = to[w].copy(), back[:, w].copy()
            out_w[a] -= own
            in_w[a] -= own
            # without w
            table[a] -= out_w
            table[:, a] -= in_w
            table[a, a] -= own
            left[a] -= out_w.sum() + own
            right[a] -= in_w.sum() + own
            # the gain of putting w in each class
            rows, cols = table + out_w[None, :], table + in_w[:, None]
            gain = (_xlogx(rows) - _xlogx(table)).sum(1) + (_xlogx(cols) - _xlogx(table)).sum(0)
            d = np.arange(classes)
            x = table[d, d]
            gain += _xlogx(x + out_w + in_w + own) - _xlogx(x + out_w) - _xlogx(x + in_w) + _xlogx(x)
            gain -= _xlogx(left + out_w.sum() + own) - _xlogx(left) + _xlogx(right + in_w.sum() + own) - _xlogx(right)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out_w
            table[:, b] += in_w
            table[b, b] += own
            left[b] += out_w.sum() + own
            right[b] += in_w.sum() + own
            if b != a:
                moved += 1
                of[w] = b
                to[:, a] -= pairs[:, w]
                to[:, b] += pairs[:, w]
                back[a] -= pairs[w]
                back[b] += pairs[w]
        if not moved:
            break
    return of


def class_table(pairs: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    member = np.zeros((len(of), classes))
    member[np.arange(len(of)), of] = 1
    return member.T @ pairs @ member


#: How often a class (slot: before it, or the number of classes more, after it) stands beside a word.
ENTRY = np.dtype([("slot", "u1"), ("n", "<u4")])


def contexts(encoded: DataFrame, symbols: Symbols, of: np.ndarray, classes: int) -> DataFrame:
    """``word, around``: entries for each slice and each of its trained words beyond the head."""
    sent = encoded.sparkSession.sparkContext.broadcast((symbols, of))

    def run(batches):
        symbols, of = sent.value
        for _, s in Slice.each(batches):
            symbol = symbols.of(s.words)
            tail = symbol >= symbols.n_head
            seq, begin = s.sequence(of[symbol], int(of[symbols.end]))
            at = spread(begin + 1, s.n)
            at = at[np.repeat(s.trained, s.n) & tail[s.places]] if len(at) else at
            who = s.places[np.repeat(s.trained, s.n) & tail[s.places]] if len(s.places) else s.places
            key = np.concatenate([who * 2 * classes + seq[at - 1], who * 2 * classes + classes + seq[at + 1]])
            key, n = np.unique(key, return_counts=True)
            word = key // (2 * classes)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
            entry = np.empty(len(key), ENTRY)
            entry["slot"], entry["n"] = key % (2 * classes), n
            edge = np.append(first, len(key)).astype(np.int32) * ENTRY.itemsize
            around = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(entry.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(s.words[word[first]].view(np.int64)), around], ["word", "around"])

    return encoded.mapInArrow(run, "word long, around binary")


def best_class(table: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The class that gives the most likelihood to each word, from its contexts (rows), or its own among equals."""
    words, classes = before.shape
    n = before.sum(1)
    gain = np.zeros((words, classes))
    for around, t in ((after, table), (before, table.T)):  # as the first of a bigram, as the second
        who, c = np.nonzero(around)
        x = around[who, c][:, None]
        now = t[:, c].T
        mine = np.arange(len(who)), own[who]
        now[mine] -= x[:, 0]  # without the word
        value = _xlogx(now + x) - _xlogx(now)
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else who
        gain[who[first]] += np.add.reduceat(value, first, axis=0) if len(first) else 0
        total = np.repeat(t.sum(1)[None, :], words, 0)
        total[np.arange(words), own] -= n
        gain -= _xlogx(total + n[:, None]) - _xlogx(total)
    best = gain.argmax(1)
    stay = gain[np.arange(words), best] <= gain[np.arange(words), own] + 1e-9
    return np.where(stay, own, best)


def tail_classes(around: DataFrame, table: np.ndarray, shape_class: np.ndarray) -> DataFrame:
    """``word, class`` of the words beyond the head that are seen twice or more."""
    classes = len(table)

    def judged(word, dense):
        often = dense[:, :classes].sum(1) >= 2
        word, dense = word[often], dense[often]
        best = best_class(table, shape_class[shape_of(word)], dense[:, :classes], dense[:, classes:])
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(best.astype(np.int32))], ["word", "class"])

    def run(batches):
        last, rest = None, None  # a word's rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = flat(batch.column(1))
            entry = np.frombuffer(data.tobytes(), ENTRY)
            new = np.concatenate([[True], word[1:] != word[:-1]])
            kind = np.cumsum(new) - 1
            which = np.repeat(kind, np.diff(off) // ENTRY.itemsize)
            dense = np.bincount(which * 2 * classes + entry["slot"], entry["n"], minlength=(kind[-1] + 1) * 2 * classes).reshape(-1, 2 * classes)
            own = word[new]
            if last is not None:
                if own[0] == last:
                    dense[0] += rest
                else:
                    own, dense = np.concatenate([[last], own]), np.concatenate([rest[None, :], dense])
            last, rest = own[-1], dense[-1]
            yield judged(own[:-1], dense[:-1])
        if last is not None:
            yield judged(np.array([last]), rest[None, :])

    return around.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, class int")


#: A slice after the words' counts and classes have come back: for each text its known tokens, its sums of log10(c + 0.1)
#: and of what its words take from their classes; the tokens' classes.
TAGGED = "texts binary, sums binary, classes binary"


def tag(encoded: DataFrame, lexicon: DataFrame, symbols: Symbols, of: np.ndarray, head_counts: np.ndarray, once: np.ndarray, unseen: float) -> DataFrame:
    """Slices with what ``lexicon (word, n, class)`` knows of their words; a null class is that of the word's shape."""
    sent = encoded.sparkSession.sparkContext.broadcast((symbols, of, head_counts))
    share = np.log10(np.maximum(once, 0.5)) - np.log10(once + unseen)  # of a word seen once; the unseen ones' slot has U times as much

    def asks(batches):
        symbols = sent.value[0]
        for number, s in Slice.each(batches):
            tail = np.flatnonzero(symbols.of(s.words) >= symbols.n_head)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tail), number)), pa.array(tail.astype(np.int32)), pa.array(s.words[tail].view(np.int64))], ["slice", "place", "word"])

    def lean(batches):
        """The slices with symbols, which take less room, in place of words."""
        symbols = sent.value[0]
        for batch in batches:
            for number, _, texts, words, _, places in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                symbol = squeeze(symbols.of(unsqueeze_codes(words)))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, texts, symbol, places), (pa.int64(), *[pa.binary()] * 3), strict=True)], ["slice", "texts", "symbols", "places"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        symbols, of, head_counts = sent.value
        rows = []
        for texts, symbol, places in zip(*(left.column(c).to_pylist() for c in ("texts", "symbols", "places")), strict=True):
            size = np.frombuffer(unpack_bytes(texts), "<i8").reshape(3, -1)[1]
            symbol, places = unsqueeze(symbol).astype(np.int64), unsqueeze(places)
            n, own = np.zeros(len(symbol)), of[symbol]
            head = np.flatnonzero(symbol < symbols.n_head)
            n[head] = head_counts[symbol[head]]
            place = right.column("place").to_numpy()
            n[place] = right.column("n").to_numpy()
            known = right.column("class").fill_null(-1).to_numpy()
            own[place] = np.where(known >= 0, known, own[place])
            rare = share[np.maximum(symbol - symbols.n_head, 0)]  # head words are seen more than once
            emit = np.where(n > 1, np.log10(np.maximum(n, 1)), np.where(n == 1, rare, rare + np.log10(unseen)))
            text = np.repeat(np.arange(len(size)), size)
            sums = [np.bincount(text, x[places], minlength=len(size)) if len(text) else np.zeros(len(size)) for x in (n > 0, np.log10(n + 0.1), emit)]
            rows.append((texts, np.stack(sums).astype("<f8").tobytes(), pack_bytes(own.astype(np.uint8)[places].tobytes() if len(text) else b"")))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(3)], ["texts", "sums", "classes"])

    answers = encoded.mapInArrow(asks, "slice long, place int, word long").join(lexicon, "word").select("slice", "place", "n", "class")
    payload = encoded.mapInArrow(lean, "slice long, texts binary, symbols binary, places binary")
    return payload.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(meet, TAGGED)


def _tagged(batches, end: int):
    """Texts, sums, and the classes' sequence of each slice."""
    for batch in batches:
        for texts, sums, classes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            doc, n, trained = np.frombuffer(unpack_bytes(texts), "<i8").reshape(3, -1)
            seq, begin = sequence(np.frombuffer(unpack_bytes(classes), np.uint8), n, end)
            yield doc, n, trained.astype(bool), np.frombuffer(sums, "<f8").reshape(3, -1), seq, begin


def tagged_table(tagged: DataFrame, classes: int, end: int) -> np.ndarray:
    """The class bigrams of the training texts."""

    def run(batches):
        for _, n, trained, _, seq, begin in _tagged(batches, end):
            at = _pairs(seq, begin, n, trained)
            times = np.bincount(seq[at - 1] * classes + seq[at], minlength=classes**2)
            pair = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times[pair].astype(np.int64))], ["pair", "n"])

    out = np.zeros(classes**2)
    for r in tagged.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(classes, classes)


def transitions(table: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """log10 of P(class | class before) over the class's tokens, so that a word's count gives its probability."""
    n = len(table)
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * n)
    move = (table + strength * share) / (table.sum(1, keepdims=True) + strength)
    return np.log10(move) - np.log10(np.maximum(table.sum(0), 0.5))[None, :]


def class_scores(docs: DataFrame, head: int = 1000, classes: int = 48, folds: int = 10, slice_bytes: int = SLICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per input row."""
    if classes > 127:
        raise ValueError("a slot is one byte: at most 127 classes")
    doc_id = F.col(id_col).cast("long")
    apart = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(F.coalesce(doc_id, F.lit(MISSING).cast("long")).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~apart).alias("trained"))
    encoded = written(encode(rows, slice_bytes))
    words = written(word_counts(encoded))

    shape = F.col("word").bitwiseAND(F.lit(31))
    by_shape = {r["s"]: r for r in words.groupBy(shape.alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()}
    n, v, once = (np.array([by_shape[s][k] if s in by_shape else 0 for s in range(SHAPES)], np.float64) for k in ("n", "v", "once"))
    trained = encoded.agg(F.coalesce(F.sum("trained_texts"), F.lit(0))).first()[0]
    total, kinds = n.sum() + trained, v.sum() + (trained > 0)
    unseen = max(1.0, float(np.average(once, weights=once)) if once.sum() else 1.0)

    top = words.where("n > 1").orderBy(F.desc("n"), "word").limit(head).collect()
    symbols = Symbols(np.array([r["word"] for r in top], np.int64).view(U64))
    head_counts = np.array([r["n"] for r in top], np.float64)
    pairs = pair_counts(encoded, symbols)
    of = exchange(pairs, classes)
    k, end = int(of.max()) + 1, int(of[symbols.end])
    before = class_table(pairs, of, k)
    shapes = of[symbols.n_head : symbols.n_head + SHAPES]
    moved = tail_classes(contexts(encoded, symbols, of, k), before, shapes)
    lexicon = written(words.join(moved, "word", "left"))
    tagged = written(tag(encoded, lexicon, symbols, of, head_counts, once, unseen))
    table = tagged_table(tagged, k, end)
    if likelihood(table) < likelihood(before):
        tagged = written(tag(encoded, lexicon.withColumn("class", F.lit(None).cast("int")), symbols, of, head_counts, once, unseen))
        table = tagged_table(tagged, k, end)
    move = transitions(table)
    ends = float(np.log10(trained + 0.1))
    base = float(np.log10(total + 0.1 * (kinds + 1)))

    def score(batches):
        for doc, n, is_trained, (known, plain, emit), seq, begin in _tagged(batches, end):
            step = np.zeros(len(seq))
            step[1:] = move[seq[:-1], seq[1:]]
            step[begin] = 0
            score = np.add.reduceat(step, begin) + emit + ends
            ids = pa.array(doc, mask=doc == MISSING)
            yield pa.RecordBatch.from_arrays([ids, pa.array(~is_trained), pa.array(n + 1), pa.array(known.astype(np.int64) + int(trained > 0)), pa.array(plain + ends - (n + 1) * base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = tagged.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
