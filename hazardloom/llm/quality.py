"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded as a vector of what its bytes and words look like; gated attention,
softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages of a document, and a logistic function of their weighted mean
is the document's score. Weights of attention and of the mean are learned together, from labels of documents alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.workers import sliced
from hazardloom.session import discard, written

WORDS = 64  # of a passage; a document's last one may have fewer
MAX_TRAINING = 8_000  # labelled documents to learn from, chosen by hash of their id
MAX_BYTES = 32_000  # longer labelled documents are not learned from (all are scored)
THRESHOLD = 0.3
HIDDEN, EPOCHS, BAGS, RATE, DECAY = 16, 30, 256, 0.01, 1e-4
SEGMENT = 1 << 20  # bytes encoded at once

CLASSES = 10  # of bytes: see byte_classes
BUCKETS = 32  # of pairs of neighbouring bytes
_STEP = np.uint64(0x9E3779B97F4A7C15)


def byte_classes() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 full stop or comma, 6 exclamation or question mark, 7 other ASCII,
    8 first and 9 further bytes of other characters."""
    out = np.full(256, 7, dtype=np.int64)
    for i, group in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t", b"\r\n\x0b\x0c", b".,;:", b"!?"]):
        out[list(group)] = i
    out[0x80:0xC0], out[0xC0:] = 9, 8
    return out


_CLASS = byte_classes()
FEATURES = CLASSES + BUCKETS + 9


def encode(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of the passages of documents that begin at ``starts`` of the UTF-8 bytes ``raw``.

    A passage has WORDS words (runs of bytes other than white space) and the white space after them; a document has one at least.
    """
    n_docs, size = len(starts), len(raw)
    doc = np.repeat(np.arange(n_docs), np.diff(np.append(starts, size)))
    kind = _CLASS[raw]
    solid = (kind != 3) & (kind != 4)
    begin, end = solid.copy(), solid.copy()
    first = starts[starts < size]
    new = np.zeros(size, dtype=bool)
    new[first] = True
    if size:
        begin[1:] &= ~solid[:-1] | new[1:]
        end[:-1] &= ~solid[1:] | new[1:]
    word = np.cumsum(begin) - 1  # number of the word at or before each byte
    at = np.flatnonzero(begin)
    per_doc = np.bincount(doc[at], minlength=n_docs)
    first_word = np.cumsum(per_doc) - per_doc
    passages = np.maximum(1, -(-per_doc // WORDS))
    first_passage = np.cumsum(passages) - passages
    of_doc = np.repeat(np.arange(n_docs), passages)
    p = first_passage[doc] + np.maximum(word - first_word[doc], 0) // WORDS  # passage of each byte
    n = len(of_doc)

    classes = np.bincount(p * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    inner = np.flatnonzero((p[1:] == p[:-1]) & solid[1:] & solid[:-1]) if size else np.zeros(0, dtype=np.int64)
    pair = (raw[inner].astype(np.uint32) * np.uint32(40503) + raw[inner + 1].astype(np.uint32) * np.uint32(30011)) >> np.uint32(7)
    pairs = np.bincount(p[inner] * BUCKETS + (pair % BUCKETS).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)

    stop = np.flatnonzero(end)
    length, wp = stop - at + 1, p[at]
    words = np.bincount(wp, minlength=n)
    mean = np.bincount(wp, weights=length, minlength=n) / np.maximum(words, 1)
    square = np.bincount(wp, weights=length.astype(float) ** 2, minlength=n) / np.maximum(words, 1)
    place = (np.arange(size) - at[word] if len(at) else np.zeros(size, dtype=np.int64))[solid] % 64
    power = _STEP ** (np.arange(64, dtype=np.uint64) + np.uint64(1))
    keys = np.add.reduceat((raw[solid].astype(np.uint64) + np.uint64(1)) * power[place], np.cumsum(length) - length) if len(at) else np.zeros(0, np.uint64)
    again = np.bincount(wp[1:][(keys[1:] == keys[:-1]) & (wp[1:] == wp[:-1])], minlength=n)
    order = np.lexsort((keys, wp))
    k, w = keys[order], wp[order]
    distinct = words - np.bincount(w[1:][(k[1:] == k[:-1]) & (w[1:] == w[:-1])], minlength=n)
    heads, tails = kind[at], kind[stop]
    share = lambda marks: np.bincount(wp[marks], minlength=n) / np.maximum(words, 1)
    bytes_ = np.maximum(classes.sum(axis=1), 1)
    other = np.column_stack([
        np.log1p(words), mean, np.sqrt(np.maximum(square - mean**2, 0)), again / np.maximum(words, 1), distinct / np.maximum(words, 1),
        share(heads == 1), share(tails == 7), share(tails == 5), share((length == 1) & (heads == 7)),
    ])
    return np.hstack([classes / bytes_[:, None], pairs / np.maximum(pairs.sum(axis=1), 1)[:, None], other]).astype(np.float32), of_doc


def _cut(raw: np.ndarray, at: int) -> int:
    """End of a piece of one long text from ``at`` on: a passage's first word (pieces begin with one, too), or the text's end."""
    size = SEGMENT
    while at + size < len(raw):
        kind = _CLASS[raw[at : at + size]]
        solid = (kind != 3) & (kind != 4)
        begin = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        begin = np.concatenate([[0], begin]) if solid[0] else begin
        if len(begin) > WORDS:
            return at + int(begin[(len(begin) - 1) // WORDS * WORDS])
        size *= 2
    return len(raw)


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, text) of the passages of texts, in portions of whole texts; null counts as empty.

    A portion has about SEGMENT bytes; of a longer text only the passages' features are held together, not all of its arrays.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, side="right")) - 1)
        raw = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(raw) > SEGMENT:
            parts, at = [], 0
            while at < len(raw):
                end = _cut(raw, at)
                parts.append(encode(raw[at:end], np.zeros(1, dtype=np.int64))[0])
                at = end
            x = np.concatenate(parts)
            yield x, np.full(len(x), i)
        else:
            x, doc = encode(raw, offsets[i:j] - offsets[i])
            yield x, doc + i
        i = j


@dataclass
class Attention:
    """Gated attention over standardised passages and a logistic function of their weighted mean."""

    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5).astype(float)

    def weights(self, h: np.ndarray, first: np.ndarray, bag: np.ndarray):
        """Attention of every passage, and the two gates."""
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.w
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        return a / np.add.reduceat(a, first)[bag], t, g

    def scores(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        """Score of each bag; ``bag`` numbers them without gaps, in order."""
        first = np.flatnonzero(np.diff(bag, prepend=-1))
        h = self.standard(x)
        a, _, _ = self.weights(h, first, bag)
        z = np.add.reduceat(a[:, None] * h, first)
        return 1 / (1 + np.exp(-np.clip(z @ self.c + self.b[0], -30, 30)))

    def gradients(self, h: np.ndarray, first: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean log loss of the bags and its gradients by v, u, w, c, b."""
        a, t, g = self.weights(h, first, bag)
        z = np.add.reduceat(a[:, None] * h, first)
        s = np.clip(z @ self.c + self.b[0], -30, 30)
        loss = float(np.mean(np.logaddexp(0, s) - y * s))
        ds = (1 / (1 + np.exp(-s)) - y) / len(y)
        da = (h @ self.c) * ds[bag]
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, dg = de[:, None] * self.w * g * (1 - t * t), de[:, None] * self.w * t * g * (1 - g)
        return loss, [h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ ds, np.array([ds.sum()])]


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Attention:
    """Adam over portions of bags, in an order that depends on the seed alone."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    r = np.random.default_rng(seed)
    n, start = x.shape[1], lambda *size: r.standard_normal(size) / np.sqrt(size[0])
    model = Attention(mean, np.where(scale > 1e-6, scale, 1.0), start(n, HIDDEN), start(n, HIDDEN), start(HIDDEN), np.zeros(n), np.zeros(1))
    h, first = model.standard(x), np.flatnonzero(np.diff(bag, prepend=-1))
    many = np.diff(np.append(first, len(bag)))
    params = [model.v, model.u, model.w, model.c, model.b]
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), BAGS):
            pick = order[at : at + BAGS]
            begin = np.cumsum(many[pick]) - many[pick]
            own = np.repeat(np.arange(len(pick)), many[pick])
            rows = np.arange(len(own)) - begin[own] + first[pick][own]
            _, grads = model.gradients(h[rows], begin, own, y[pick])
            step += 1
            for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
                g = g + DECAY * p
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(key, text, quality) of at most ``most`` labelled ids that are not held out, texts of at most ``most_bytes``, one for each id."""
    known = labels.where("quality IN (0, 1)").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounds the broadcast
    texts = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return found.select(F.col("doc_id").alias("key"), "text", "quality")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, most_bytes: int = MAX_BYTES) -> Attention | None:
    """Learn from at most ``most`` labelled documents, whose encoded passages are gathered; None where no document is labelled."""
    texts = written(training_texts(docs, labels, most, most_bytes), "training")

    def each(batches):
        for b in sliced(batches):
            for x, i in bags(b.column(1)):
                row = pa.array(i)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(2).take(row), flat], names=["key", "quality", "x"])

    found = texts.mapInArrow(each, f"key {texts.schema['key'].dataType.simpleString()}, quality int, x array<float>").toArrow()
    discard(texts)
    if not found.num_rows:
        return None
    key = found.column("key").combine_chunks().dictionary_encode()
    rank = np.argsort(np.argsort(np.array(key.dictionary.to_pylist())))[key.indices.to_numpy()]
    order = np.argsort(rank, kind="stable")  # an id's passages come from one task, in order
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)[order]
    bag, first = np.unique(rank[order], return_index=True)
    return train(x, rank[order], found.column("quality").to_numpy()[order][first].astype(float))


def quality(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """Per input row: doc_id, held_out, score in (0, 1), predicted (1 at ``threshold`` or more).

    Labels of held-out documents are not used; neither are language, source and id. Null texts count as empty; an empty text is one
    passage without words. Repeated rows and null ids get their own rows; an id with two labels counts as good if one says so, one with
    two texts teaches the smaller one. Without labelled documents every score is 0.5. Other columns are not read; an empty table
    gives no rows. Long texts are scored whole.
    """
    model = fit(docs, labels, most)

    def each(batches):
        for b in sliced(batches, 2000):
            score = np.full(b.num_rows, 0.5)
            for x, i in bags(b.column(1)) if model else ():
                score[i[0] : i[-1] + 1] = model.scores(x, i - i[0])
            yield pa.RecordBatch.from_arrays([*b.columns[:1], b.column(2), pa.array(score)], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(each, f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
