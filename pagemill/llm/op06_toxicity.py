"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy from confirmed toxic
documents and unlabelled text; its intercept is then set on labelled training texts. With the class prior ``p``, the risk is

    p * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - p * E_pos[loss(-f)])

and while the bracket is negative, the step goes against it, so the model does not
fit the positives that hide in the unlabelled text. Words are chosen by how far their
share among the positives stands out from the unlabelled text; a text is the set of
its chosen words, so its length does not matter.

The training sample is bounded: at most ``max_positive`` toxic documents,
``max_unlabelled`` of all documents without their labels, and as many labelled clean ones, those with the least hash of doc_id. Scores cover every row and whole texts
and use the text only.

Cases: null and empty texts have no words and get the score of the intercept; without
positives every score is 0; a null label is no label; a doc_id with several labels is toxic if
one says so; rows that repeat a doc_id are scored each by its text, and one of them is in the sample (that with the
least set of features); a row with a null doc_id is scored and in no sample. Texts of any length are scored whole, in slices of
4 MB or of a longer text; one task holds some 60 bytes for each of their bytes. Ties: documents with one hash are ordered by doc_id,
features that stand out alike by their number, thresholds that err alike by how near they are to the model's own. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_np import ALNUM, LOWER, Words, flat, mix, slices
from .session import cut

BITS = 22
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: A word or beginning is another feature where it stands so often, or (under 1) twice and in such a share of the text's words.
OFTEN = (2, 3, 0.02)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of doc_id as text leaves no remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def text_words(column: pa.Array):
    """For slices of a column of texts: their range, and the distinct (text, feature number) pairs."""
    data, off = flat(column)
    for i, j in slices(off):
        part = data[off[i] : off[j]]
        words = Words(part, off[i : j + 1] - off[i], ALNUM)
        text = words.text_of().astype(np.uint64) << np.uint64(32)
        padded = np.concatenate([LOWER[part], np.zeros(8, np.uint8)])
        head = np.ndarray((len(part) + 1,), "<u8", padded, strides=(1,))[words.start]
        size = words.stop - words.start
        pairs = [text | words.hash >> np.uint64(32)]
        for k in BEGINNINGS:
            own = size >= k
            begin = mix((head[own] & np.uint64((1 << 8 * k) - 1)) + np.uint64(k << 60))
            pairs.append(text[own] | begin >> np.uint64(32))
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        owner, low = pair & ~np.uint64(0xFFFFFFFF), pair & np.uint64(0xFFFFFFFF)
        features = [pair]
        for n, least in enumerate(OFTEN, 1):
            often = times >= least if least >= 1 else (times >= 2) & (times >= least * words.count[(pair >> np.uint64(32)).astype(np.int64)])
            features.append(owner[often] | mix(low[often] + np.uint64(n << 40)) >> np.uint64(32))
        f = np.concatenate(features)
        yield i, j, np.unique(f >> np.uint64(32) << np.uint64(BITS) | (f & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS))


def word_sets(rows: DataFrame) -> DataFrame:
    """``doc_id, kind, words binary`` of ``doc_id, text, kind``: each text's distinct feature numbers as unsigned 32-bit integers, 2**22 at most."""

    def run(batches):
        for batch in batches:
            out = []
            for i, j, pair in text_words(batch.column(1)):
                text, word = (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype("<u4")
                edge = np.searchsorted(text, np.arange(j - i + 1))
                out += [word[a:b].tobytes() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "kind", "words"])

    return rows.select("doc_id", "text", "kind").mapInArrow(run, "doc_id long, kind int, words binary")


def views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a column, without copies of them."""
    out = []
    for chunk in column.chunks:
        if len(chunk):
            _, off, data = chunk.buffers()
            off = np.frombuffer(off, "<i4")[chunk.offset : chunk.offset + len(chunk) + 1] >> 2
            data = np.frombuffer(data, "<u4", count=int(off[-1])) if off[-1] else np.zeros(0, "<u4")
            out += [data[a:b] for a, b in zip(off, off[1:])]
    return out


class Model:
    """Weights of the chosen words and the intercept."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, intercept: float):
        order = np.argsort(words)
        self.words, self.weights, self.intercept = words[order], weights[order], intercept

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.words] = self.weights
        return out


def choose_words(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_words: int, least: int = 3) -> np.ndarray:
    """The words whose share among the positives stands out most, by a two-sample z score."""
    def share(sets):
        out = np.zeros(1 << BITS, np.int32)
        for s in sets:  # a text's words are distinct
            out[s] += 1
        return out

    return choose(share(positive), share(unlabelled), len(positive), len(unlabelled), n_words, least)


def choose(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, n_words: int, least: int = 3) -> np.ndarray:
    """As ``choose_words``, from how many of the ``n_p`` positives and ``n_u`` unlabelled texts have each word."""
    n_u = max(1, n_u)
    words = np.flatnonzero(p >= least)
    p, u = p[words], u[words]
    pool = (p + u + 1) / (n_p + n_u + 2)
    z = (p / n_p - u / n_u) / np.sqrt(pool * (1 - pool) * (1 / n_p + 1 / n_u))
    z[z < 5] = 0
    best = np.argsort(-z, kind="stable")[:n_words]
    return words[best[z[best] > 0]]


def shares(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """How many positives and unlabelled texts of ``sample (kind, words)`` have each word, and how many texts these are; the driver holds one partition's sets at a time."""
    out, n = {1: np.zeros(1 << BITS, np.int32), 2: np.zeros(1 << BITS, np.int32)}, {1: 0, 2: 0}
    for kind, words in sample.select("kind", "words").where("kind & 3 > 0").toLocalIterator():
        for k in out:
            if kind & k:
                out[k][np.frombuffer(words, "<u4")] += 1
                n[k] += 1
    return out[1], out[2], n[1], n[2]


def only(sample: DataFrame, words: np.ndarray) -> DataFrame:
    """``doc_id, kind, words`` of the sample with the chosen words alone."""
    chosen = np.sort(words).astype("<u4")

    def run(batches):
        for batch in batches:
            sets = views(pa.chunked_array([batch.column(2)]))
            cut_down = [s[np.isin(s, chosen)].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut_down, pa.binary())], ["doc_id", "kind", "words"])

    return sample.select("doc_id", "kind", "words").mapInArrow(run, "doc_id long, kind int, words binary")


def matrix(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """A row for each text: 1 for each of the words that it has, and in a last column for the intercept."""
    place = np.full(1 << BITS, -1, np.int32)
    place[words] = np.arange(len(words))
    x = np.zeros((len(sets), len(words) + 1), np.uint8)
    x[:, -1] = 1
    for i, s in enumerate(sets):
        at = place[s]
        x[i, at[at >= 0]] = 1
    return x


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, n_words: int = 1024, epochs: int = 240, rate: float = 0.05, decay: float = 1e-3, seed: int = 7, words: np.ndarray | None = None) -> Model:
    """Minimise the non-negative risk with the logistic loss by Adam over mini-batches; ``words`` are the chosen ones, if they are known."""
    if not positive:
        return Model(np.zeros(0, np.int64), np.zeros(0), -50.0)
    words = choose_words(positive, unlabelled, n_words) if words is None else words
    x_p, x_u = matrix(positive, words), matrix(unlabelled or [np.zeros(0, np.uint32)], words)
    w, rng = np.zeros(len(words) + 1), np.random.default_rng(seed)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    size = 2048
    for _ in range(epochs):
        order = rng.permutation(len(x_u))
        for i in range(0, len(order), size):
            u, p = x_u[order[i : i + size]].astype(np.float64), x_p[rng.permutation(len(x_p))[:size]].astype(np.float64)
            f_u, f_p = u @ w, p @ w
            # loss(z) = log(1 + exp(-z)); loss'(z) = -sigmoid(-z)
            g_pos = -(sigmoid(-f_p) @ p) / len(p) * prior
            negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
            g_neg = (sigmoid(f_u) @ u) / len(u) - prior * (sigmoid(f_p) @ p) / len(p)
            g = g_pos + g_neg if negative >= 0 else -g_neg
            g[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(words, w[:-1], float(w[-1]))


def place_threshold(model: Model, toxic: list[np.ndarray], other: list[np.ndarray]) -> Model:
    """The model with the intercept under which it errs least on labelled training texts, its own among equals."""
    if not toxic or not other:
        return model
    table = model.table()
    odds = lambda sets: model.intercept + np.array([table[s].sum() for s in sets])
    t, o = np.sort(odds(toxic)), np.sort(odds(other))
    cuts = np.unique(np.concatenate([t, o, [0.0]]))
    middle = np.concatenate([[0.0], (cuts[1:] + cuts[:-1]) / 2])
    wrong = np.searchsorted(t, middle) + len(o) - np.searchsorted(o, middle)
    best = middle[np.lexsort((np.abs(middle), wrong))[0]]
    return Model(model.words, model.weights, model.intercept - float(best))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000, folds: int = 5, n_words: int = 1024) -> Model:
    """A model from the labels of the rows that are not held out, and a bounded sample of all documents."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"), folds))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marked.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    order = F.xxhash64("doc_id")
    positive = marked.where("toxic > 0").select("doc_id").orderBy(order, "doc_id").limit(max_positive)
    clean = marked.where("toxic = 0").select("doc_id").orderBy(order, "doc_id").limit(max_unlabelled)
    other = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    other = other.groupBy("doc_id").count().orderBy(order, "doc_id").limit(max_unlabelled)
    kinds = (positive.withColumn("kind", F.lit(1)), other.select("doc_id", F.lit(2).alias("kind")), clean.withColumn("kind", F.lit(4)))
    ids = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("doc_id").agg(F.bit_or("kind").alias("kind"))
    # one reading of the texts for all three samples; of rows that repeat a doc_id the least set counts
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(cut(ids)), "doc_id")
    sample = cut(word_sets(text).groupBy("doc_id", "kind").agg(F.min("words").alias("words")))
    # only the chosen words of the sample are gathered: whole sets pass the driver a partition at a time
    p, u, n_p, n_u = shares(sample)
    words = choose(p, u, n_p, n_u, n_words) if n_p else np.zeros(0, np.int64)
    del p, u
    rows = only(sample, words).withColumn("order", F.xxhash64("doc_id")).toArrow()
    at = np.lexsort([rows.column(c).to_numpy() for c in ("doc_id", "order")])
    sets = views(rows.column("words"))
    kind, sample = rows.column("kind").to_numpy()[at], [sets[i] for i in at]
    toxic_sets, other_sets, clean_sets = ([s for s, k in zip(sample, kind, strict=True) if k & which] for which in (1, 2, 4))
    model = train(toxic_sets, other_sets, toxic / n if n else 0.0, words=words)
    # errors are weighed as the labels have them
    if toxic and len(toxic_sets):
        clean_sets = clean_sets[: max(1, round(len(toxic_sets) * (n - toxic) / toxic))]
        toxic_sets = toxic_sets[: max(1, round(len(clean_sets) * toxic / max(1, n - toxic)))]
    return place_threshold(model, toxic_sets, clean_sets)


def scores(column: pa.Array, weights: np.ndarray, intercept: float) -> np.ndarray:
    """The log odds of each text."""
    out = np.full(len(column), intercept)
    for i, j, pair in text_words(column):
        w = weights[(pair & np.uint64((1 << BITS) - 1)).astype(np.int64)]
        hit = np.flatnonzero(w)
        out[i:j] += np.bincount((pair[hit] >> np.uint64(BITS)).astype(np.int64), w[hit], minlength=j - i)
    return out


def score(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, intercept = sent.value.table(), sent.value.intercept
        for batch in batches:
            out = scores(batch.column(1), weights, intercept)
            p = 1 / (1 + np.exp(-np.clip(out, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(F.col("doc_id"), folds), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    return score(docs, fit(docs, labels, **limits))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **limits) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **limits))
    place = docs.columns.index("text")

    def run(batches):
        weights, least = sent.value.table(), np.log(threshold / (1 - threshold))
        for batch in batches:
            out = scores(batch.column(place), weights, sent.value.intercept)
            yield batch.filter(pa.array(out < least))

    return docs.mapInArrow(run, docs.schema)
