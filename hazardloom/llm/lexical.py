"""Ranked lexical search by scanning documents with an Aho-Corasick automaton of all item terms; documents are never indexed.

The automaton's patterns are the items' terms with a guard character on both sides. A document's bytes are folded by one table (A-Z to
lower case, everything between terms to the guard), so a pattern is found exactly where its term stands alone. One scan gives a
document's length in terms and the frequencies of item terms; the corpus statistics are sums over those small rows, and a second pass
over them maps the automaton's outputs to items and keeps each task's best.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.llm.workers import sliced
from hazardloom.session import written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GUARD = 32
AUTOMATON_BYTES = 1 << 20  # text of the items of one automaton, which bounds what is broadcast; further items get further ones
EXACT = 2**53  # doubles hold all integers up to here
NO_ID = np.iinfo(np.int64).max


def fold_table() -> bytes:
    """Byte to byte: A-Z to a-z, digits, letters and all bytes from 0x80 to themselves, the rest to the guard."""
    keep = [chr(b).isalnum() or b >= 0x80 for b in range(128)] + [True] * 128
    return bytes(b + 32 if 65 <= b <= 90 else b if keep[b] else GUARD for b in range(256))


FOLD = fold_table()
_FOLD = np.frombuffer(FOLD, dtype=np.uint8)


def terms(text: str | None) -> list[str]:
    """The terms of a text, in order, A-Z lower-cased."""
    lower = {c: c + 32 for c in range(65, 91)}
    return [t.translate(lower) for t in TERM.findall(text or "")]


def automaton(words: list[str]):
    """Aho-Corasick automaton over bytes (as Latin-1 characters); the output of ``words[i]`` between guards is i."""
    import ahocorasick

    out, guard = ahocorasick.Automaton(), chr(GUARD)
    for i, w in enumerate(words):
        out.add_word(guard + w.encode().decode("latin-1") + guard, i)
    out.make_automaton()
    return out


def term_counts(texts: pa.Array) -> np.ndarray:
    """Number of terms of each text, by one look at the bytes of the whole column."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
    inside = _FOLD[raw] != GUARD
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = offsets - offsets[0]
    begins = at[:-1][at[:-1] < at[1:]]
    starts[begins] = inside[begins]  # a text's first byte continues nothing
    before = np.concatenate([[0], np.cumsum(starts)])
    return before[at[1:]] - before[at[:-1]]


def scan(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) per document with a term: its length, and number and frequency of each of ``words`` in it."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(words))

    def each(batches):
        search = shared.value
        for b in sliced(batches, 1000):
            n, found = term_counts(b.column(1)), []
            for i in range(b.num_rows):
                if n[i]:
                    text = b.column(1)[i].as_buffer().to_pybytes().translate(FOLD).decode("latin-1")
                    found.append(Counter(map(itemgetter(1), search.iter(f" {text} "))))
            some = pa.array(n > 0)
            ends = np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int32)
            flat = [np.fromiter((x for c in found for x in part(c)), dtype=np.int64, count=ends[-1]) for part in (Counter.keys, Counter.values)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(t))) for x, t in zip(flat, (np.int32, np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(some), pa.array(n[n > 0]), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(each, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Scorer:
    """Scores scanned documents against items and keeps the best ``k`` of each item."""

    def __init__(self, weights: np.ndarray, owners: list[tuple[int, int, int]], n_items: int, docs: int, total: int, k: int):
        """``owners``: (term, item, how often), sorted. ``weights``: of each term. ``docs``, ``total``: N and L."""
        term, self.item, times = (np.array(x, dtype=np.int64) for x in zip(*owners, strict=True))
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        self.weight = weights[term] * times
        self.docs, self.total, self.k, self.n_items = docs, total, k, n_items
        most = np.bincount(self.item, weights=self.weight, minlength=n_items).max(initial=0) * 1_000_000
        self.exact = most < EXACT  # a term adds at most 10^6 times its weight
        self.best = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, score, 1 for a null id, id
        self.bars = np.ones(n_items, dtype=np.int64)  # scores that can still enter

    def scores(self, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Matrix documents x items, exact integers."""
        m = 75 + np.array([25 * int(x) * self.docs // self.total for x in n], dtype=np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        many = self.first[term + 1] - self.first[term]
        entry = np.repeat(np.arange(len(term)), many)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[term], many)
        cell, value = doc[entry] * self.n_items + self.item[at], part[entry] * self.weight[at]
        size = len(n) * self.n_items
        if self.exact:
            return np.bincount(cell, weights=value, minlength=size).astype(np.int64).reshape(len(n), -1)
        out = np.zeros(size, dtype=np.int64)
        np.add.at(out, cell, value)
        return out.reshape(len(n), -1)

    def add(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        score = self.scores(n, ends, term, tf)
        d, i = np.nonzero(score >= self.bars)
        if not len(d):
            return
        new = (i, score[d, i], null[d].astype(np.int64), ids[d])
        every = [np.concatenate(x) for x in zip(self.best, new, strict=True)]
        order = np.lexsort((every[3], every[2], -every[1], every[0]))
        item, score = every[0][order], every[1][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.k - 1
        self.bars[item[last]] = score[last]
        self.best = [x[order[rank < self.k]] for x in every]


def _chunks(items: DataFrame, id_col: str, text_col: str, most: int):
    """Lists of (id, text), each of one automaton: together at most about ``most`` bytes, or one item."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    chunk, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if chunk and size + len(r.text) > most:
            yield chunk
            chunk, size = [], 0
        chunk.append((r.item_id, r.text))
        size += len(r.text)
    if chunk:
        yield chunk


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item with the highest scores above 0, exactly.

    A term is a run of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased. All statistics (N, L, df) are of all
    documents with a term; a score sums w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included. Ties go to the smaller
    doc_id. Rows with a null or empty text take no part; a null doc_id is a document like any other, after all ids in ties;
    repeated rows are documents of their own. An item row that comes twice is ranked twice, a null item_id too; items without terms
    and empty tables give no rows. Other columns are not read. Texts of any length are scanned whole.

    The automaton is broadcast; items beyond ``automaton_bytes`` of text get automata of their own, each with its own scan.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    kind = f"item_id {items.schema[item_col].dataType.simpleString()}"
    out = spark.createDataFrame([], f"{kind}, rank int, doc_id bigint, score bigint")
    for chunk in _chunks(items, item_col, item_text, automaton_bytes):
        counts = [Counter(terms(text)) for _, text in chunk]
        words = sorted({t for c in counts for t in c})
        if not words:
            continue
        scanned = written(scan(docs, words), "scanned")
        n_docs, total = scanned.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(words), dtype=np.int64)
        for r in scanned.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the automaton has terms
            df[r.t] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        number = {w: i for i, w in enumerate(words)}
        owners = sorted((number[t], i, times) for i, c in enumerate(counts) for t, times in c.items())
        out = out.union(_best(scanned, chunk, weights, owners, n_docs, total, k, kind))
    return out


def _best(scanned: DataFrame, chunk: list, weights: np.ndarray, owners: list, n_docs: int, total: int, k: int, kind: str) -> DataFrame:
    """Each task's best k of every item, then the best of all tasks."""
    n_items = len(chunk)

    def each(batches):
        scorer = Scorer(weights, owners, n_items, n_docs, total, k)
        for b in sliced(batches, max(1, min(1000, 2_000_000 // n_items))):
            lists = b.column(2), b.column(3)
            ends = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))])
            ids, null = b.column(0).fill_null(NO_ID).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
            scorer.add(ids, null, b.column(1).to_numpy(), ends, *flat)
        item, score, null, ids = scorer.best
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(ids, mask=null.astype(bool)), pa.array(score)], names=["i", "doc_id", "score"]
        )

    best = scanned.mapInArrow(each, "i int, doc_id bigint, score bigint")
    first = Window.partitionBy("i").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = scanned.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(chunk)], f"i int, {kind}")
    return ranked.join(F.broadcast(names), "i").select("item_id", "rank", "doc_id", "score")
