"""Pack tokenised documents into sequences of one length: shortest pack first, over the histogram of lengths."""

from __future__ import annotations

import heapq
import os
import re
import string
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.llm.workers import kept
from hazardloom.session import written

LENGTH = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
ROWS_PER_GROUP = 2_000
CACHED, CACHED_CHARS = 1_000_000, 48  # words a worker remembers, and the bytes of the longest of them
SLICE = 1000  # documents whose words are looked up together
BROADCAST_RANGES = 200_000  # parts of patterns that are broadcast, each once for every cell it lies in; more meet the pieces in a shuffle
CELLS = 1024  # cells for the joins of all pieces


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each value begins and how long it is."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    return raw, offsets[:-1], np.diff(offsets)


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of many ranges, one range after the other."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class WordTable:
    """Words and their ids in flat arrays, found by hash and compared byte by byte. Over ``most`` words, those unused longest go."""

    def __init__(self, most: int):
        self.most, self.clock = most, 0
        self.raw, self.ids = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint16)
        self.keys, self.entry = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # sorted hashes and whose they are
        self.word = self.word_size = self.begin = self.size = self.used = np.zeros(0, dtype=np.int64)

    @staticmethod
    def hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        out, some = size.astype(np.uint64), size > 0
        place = _places(np.zeros(int(some.sum()), dtype=np.int64), size[some])
        power = np.uint64(0x9E3779B97F4A7C15) ** (np.arange(64, dtype=np.uint64) + np.uint64(1))
        values = (raw[_places(begin[some], size[some])].astype(np.uint64) + np.uint64(1)) * power[place % 64]
        if len(values):
            out[some] += np.add.reduceat(values, np.cumsum(size[some]) - size[some])
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, words: pa.Array) -> np.ndarray:
        """Entry of each word, -1 for those that aren't here."""
        self.clock += 1
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys) or not len(words):
            return out
        raw, begin, size = _buffers(words)
        key = self.hashes(raw, begin, size)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        entry = self.entry[at]
        hit = np.flatnonzero((self.keys[at] == key) & (self.word_size[entry] == size))
        same = raw[_places(begin[hit], size[hit])] == self.raw[_places(self.word[entry[hit]], size[hit])]
        wrong = np.repeat(np.arange(len(hit)), size[hit])[~same]
        hit = np.delete(hit, np.unique(wrong))
        out[hit] = entry[hit]
        self.used[entry[hit]] = self.clock
        return out

    def add(self, words: pa.Array, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Remember words, whose ids are ranges of ``ids``; a word whose hash is taken, or that is long, is left out."""
        raw, word, length = _buffers(words)
        key, first = np.unique(self.hashes(raw, word, length), return_index=True)
        taken = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
        fresh = ~taken & (length[first] <= CACHED_CHARS)
        key, first = key[fresh], first[fresh]
        n, word, length, begin, size = len(self.used), word[first], length[first], begin[first], size[first]
        at = np.searchsorted(self.keys, key)
        self.keys, self.entry = np.insert(self.keys, at, key), np.insert(self.entry, at, n + np.arange(len(key)))
        self.word = np.concatenate([self.word, len(self.raw) + np.cumsum(length) - length])
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.raw = np.concatenate([self.raw, raw[_places(word, length)]])
        self.ids = np.concatenate([self.ids, ids[_places(begin, size)]])
        self.word_size, self.size = np.concatenate([self.word_size, length]), np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.full(len(key), self.clock)])
        if len(self.used) > self.most:
            self._forget()

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        number = np.full(len(self.used), -1)
        number[keep] = np.arange(len(keep))
        stay = number[self.entry] >= 0
        self.keys, self.entry = self.keys[stay], number[self.entry[stay]]
        self.raw, self.ids = self.raw[_places(self.word[keep], self.word_size[keep])], self.ids[_places(self.begin[keep], self.size[keep])]
        self.word_size, self.size, self.used = self.word_size[keep], self.size[keep], self.used[keep]
        self.word, self.begin = np.cumsum(self.word_size) - self.word_size, np.cumsum(self.size) - self.size


class WordIds:
    """Token ids of texts as 16-bit numbers.

    This vocabulary drops white space before it splits, so each stretch without ASCII white space has its own ids; those of many words
    are remembered, and the tokenizer sees the rest. Words stay in Arrow; only unusual ones become Python strings.
    """

    odd_space = re.compile("[\x1c-\x1f]")
    # the vocabulary's split pattern for lower-case ASCII without white space
    plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.table = WordTable(CACHED)
        self.pieces: dict[str, list[int]] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _letters(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for lower-case words of letters only: each is one pre-token, so many go as one text and come apart again."""
        if not len(forms):
            return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int64)
        ends = pa.array([*range(0, len(forms), 256), len(forms)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(ends, forms), " ").to_pylist()
        ids, sizes = [], []
        for i, e in enumerate(self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            part, words = forms.slice(256 * i, 256), np.array(e.word_ids)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(words)) + 1, [len(words)]])
            if len(cuts) == len(part) + 1:
                ids.append(np.array(e.ids, dtype=np.uint16))
                sizes.append(np.diff(cuts))
            else:
                each = self._library(part.to_pylist())
                ids += [np.array(x, dtype=np.uint16) for x in each]
                sizes.append(np.array([len(x) for x in each], dtype=np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _strings(self, words: list[str]) -> list[list[int]]:
        """Ids of words one by one: those of their pre-tokens for ASCII, else the tokenizer gets the word whole."""
        parts = {w: self.plain.findall(w.lower()) for w in words if w.isascii() and "<|" not in w and not self.odd_space.search(w)}
        new = list({p for ps in parts.values() for p in ps}.difference(self.pieces))
        if len(self.pieces) + len(new) > CACHED // 4:
            self.pieces = {}
            new = list({p for ps in parts.values() for p in ps})
        self.pieces.update(zip(new, self._library(new), strict=True))
        whole = [w for w in words if w not in parts]
        ids = dict(zip(whole, self._library(whole), strict=True))
        got = [[i for p in parts[w] for i in self.pieces[p]] if w in parts else ids[w] for w in words]
        for p in [p for p in new if len(p) > CACHED_CHARS]:
            del self.pieces[p]
        return got

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size) of new words. Letters, maybe with signs behind them, have the ids of their lower-case form and of the signs."""
        core = pc.utf8_rtrim(words, characters=string.punctuation)
        low = pc.utf8_lower(core)
        plain = pc.and_(pc.utf8_is_alpha(core), pc.utf8_is_alpha(low))
        plain = pc.and_(plain, pc.invert(pc.match_substring_regex(words, "[ΣİẞΩKÅ]")))
        for text in (words, low):
            plain = pc.and_(plain, pc.equal(pc.utf8_normalize(text, form="NFC"), text))
        coded = low.filter(plain).dictionary_encode()
        forms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        entry = self.table.find(forms)
        known = entry >= 0
        new_ids, new_size = self._letters(forms.filter(pa.array(~known)))
        bank, form_begin, form_size = [self.table.ids, new_ids], np.empty(len(forms), dtype=np.int64), np.empty(len(forms), dtype=np.int64)
        form_begin[known], form_size[known] = self.table.begin[entry[known]], self.table.size[entry[known]]
        form_begin[~known], form_size[~known] = len(self.table.ids) + np.cumsum(new_size) - new_size, new_size
        at = len(self.table.ids) + len(new_ids)

        # what follows the letters of a word, as bytes of it; a few distinct ones
        simple = plain.to_numpy(zero_copy_only=False)
        raw, begin, size = _buffers(words)
        trimmed = pc.binary_length(core).to_numpy(zero_copy_only=False).astype(np.int64)
        tail = np.where(simple, size - trimmed, 0)
        tails = pa.StringArray.from_buffers(
            len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(tail)]).astype(np.int32)), pa.py_buffer(raw[_places(begin + trimmed, tail)])
        ).dictionary_encode()
        odd = words.filter(pa.array(~simple)).to_pylist()
        lists = [self._strings(tails.dictionary.to_pylist()), self._strings(odd)]
        flat, counts = [np.array([i for x in xs for i in x], dtype=np.uint16) for xs in lists], [np.array([len(x) for x in xs], dtype=np.int64) for xs in lists]
        tail_begin, odd_begin = at + np.cumsum(counts[0]) - counts[0], at + len(flat[0]) + np.cumsum(counts[1]) - counts[1]
        bank = np.concatenate([*bank, *flat])

        # every word is two ranges of the bank: its letters or all of it, and what follows
        first, first_size = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        first[simple], first_size[simple] = form_begin[code], form_size[code]
        first[~simple], first_size[~simple] = odd_begin, counts[1]
        sign = tails.indices.to_numpy(zero_copy_only=False)
        second, second_size = tail_begin[sign], np.where(tail > 0, counts[0][sign], 0)
        ids = bank[_places(np.column_stack([first, second]).ravel(), np.column_stack([first_size, second_size]).ravel())]
        total = first_size + second_size
        unknown = np.flatnonzero(~known)
        self.table.add(forms.take(pa.array(unknown)), bank, form_begin[unknown], form_size[unknown])
        return ids, np.cumsum(total) - total, total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin and end. Arrow splits the texts and numbers their distinct words."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        entry = self.table.find(words)
        known = entry >= 0
        begin, size = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        begin[known], size[known], old = self.table.begin[entry[known]], self.table.size[entry[known]], self.table.ids
        missing = words.filter(pa.array(~known))
        ids, first, total = self._learn(missing) if len(missing) else (np.zeros(0, dtype=np.uint16), *[np.zeros(0, dtype=np.int64)] * 2)
        begin[~known], size[~known] = len(old) + first, total
        if len(missing):
            self.table.add(missing, ids, first, total)
        ids = np.concatenate([old, ids])
        count = size[code]
        ends = np.concatenate([[0], np.cumsum(count)])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids[_places(begin[code], count)], ends[offsets]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        ids, at = self.encode(pa.array(texts, pa.string()))
        return [ids[i:j].tobytes() for i, j in pairwise(at.tolist())]


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Per document (null text: empty) its ids and ``end_id``, in pieces of at most ``length``; ``ids`` is 16-bit, little-endian."""
    end = np.array([end_id], dtype="<u2").tobytes()

    def each(batches):
        words = kept(("WordIds", path), lambda: WordIds(path))
        for b in batches:
            doc, texts = b.column(0), b.column(1)
            for at in range(0, b.num_rows, SLICE):
                rows, start, total, ids = [], [], [], []
                flat, bounds = words.encode(texts.slice(at, SLICE))
                for i, (first, last) in enumerate(pairwise(bounds.tolist())):
                    x = flat[first:last].tobytes() + end
                    for s in range(0, len(x), 2 * length):
                        rows.append(at + i)
                        start.append(s // 2)
                        total.append(len(x) // 2)
                        ids.append(x[s : s + 2 * length])
                size = [len(x) // 2 for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        each, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary"
    )


class Packs:
    """``count`` packs alike. ``parts``: (piece length, first rank, start in the piece, length), for consecutive ranks."""

    __slots__ = ("count", "parts", "space")

    def __init__(self, count: int, parts: list[tuple[int, int, int, int]], space: int):
        self.count, self.parts, self.space = count, parts, space

    def take(self, n: int) -> Packs:
        """Split the first n packs off."""
        first = Packs(n, self.parts, self.space)
        self.parts = [(size, rank + n, start, length) for size, rank, start, length in self.parts]
        self.count -= n
        return first

    def __lt__(self, other: Packs) -> bool:
        return self.space > other.space


def pack_histogram(histogram: dict[int, int], length: int = LENGTH, max_padding: float = 0.005) -> list[Packs]:
    """Packs for ``histogram[size]`` pieces of each size, as patterns with counts.

    Lengths are placed longest first, each into the packs with the most space; packs alike are one pattern with a count, so
    the work follows the number of lengths, not of pieces. Where lengths don't go together (all slightly over half, say)
    and padding exceeds ``max_padding`` of the tokens, the emptiest packs are dissolved and their pieces cut
    to fill the largest gaps.
    """
    heap: list[Packs] = []
    for size in sorted(histogram, reverse=True):
        n, rank = histogram[size], 0
        while n:
            if not heap or heap[0].space < size:
                heapq.heappush(heap, Packs(n, [(size, rank, 0, size)], length - size))
                break
            p = heapq.heappop(heap)
            if p.count > n:
                first = p.take(n)
                heapq.heappush(heap, p)
                p = first
            heapq.heappush(heap, Packs(p.count, [*p.parts, (size, rank, 0, size)], p.space - size))
            n, rank = n - p.count, rank + p.count
    padding = sum(p.count * p.space for p in heap)
    most = int(max_padding * sum(size * n for size, n in histogram.items()))
    while (padding - most) // length > 0:
        p = heapq.heappop(heap)
        y = min(p.count, (padding - most) // length)
        if y < p.count:
            first = p.take(y)
            heapq.heappush(heap, p)
            p = first
        padding -= y * length
        fill = [(y, part) for part in p.parts]
        while fill:
            n, (size, rank, start, left) = fill.pop()
            gap = heapq.heappop(heap)
            m = min(n, gap.count)
            if gap.count > m:
                first = gap.take(m)
                heapq.heappush(heap, gap)
                gap = first
            if n > m:
                fill.append((n - m, (size, rank + m, start, left)))
            cut = min(left, gap.space)
            heapq.heappush(heap, Packs(m, [*gap.parts, (size, rank, start, cut)], gap.space - cut))
            if left > cut:
                fill.append((m, (size, rank, start + cut, left - cut)))
    return sorted(heap, key=lambda p: (p.space, p.parts))


def pattern_ranges(packs: list[Packs]) -> list[tuple[int, ...]]:
    """(piece length, first rank, end of ranks, start, length, first sequence, offset), one per part of each pattern."""
    rows, sequence = [], 0
    for p in packs:
        offset = 0
        for size, rank, start, part in p.parts:
            rows.append((size, rank, rank + p.count, start, part, sequence, offset))
            offset += part
        sequence += p.count
    return rows


def pack(
    docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, max_padding: float = 0.005,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset and ``ids`` (16-bit).

    Every id lies in exactly one piece; a sequence's pieces follow each other from offset 0. Only the histogram of piece
    lengths, at most ``length`` numbers, comes to the driver. Null and empty texts consist of the end id alone; null and
    repeated ids are packed like others; an empty table gives no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    # a written number, so that equal pieces spread over groups and a repeated task deals alike
    pieces = written(tokenised(docs, path, end_id, length, id_col, text_col).withColumn("no", F.monotonically_increasing_id()), "pieces")
    histogram = dict(pieces.groupBy("length").count().collect())
    ranges = pattern_ranges(pack_histogram(histogram, length, max_padding))
    table = spark.createDataFrame(
        ranges or [(0,) * 7], "size long, first long, end long, cut long, part long, sequence long, offset long"
    )
    # groups of a length get about ROWS_PER_GROUP pieces each; ranks of a length meet its ranges in cells of ``step`` ranks, one cell for
    # each range and one for each CELLS-th of all pieces, so ranges are repeated about twice
    parts, total = Counter(r[0] for r in ranges), sum(histogram.values())
    groups = spark.createDataFrame(
        [(n, -(-c // ROWS_PER_GROUP), -(-c // (parts[n] + -(-CELLS * c // total)))) for n, c in histogram.items()] or [(0, 1, 1)],
        "length long, groups long, step long",
    )
    table = table.join(F.broadcast(groups.select(F.col("length").alias("size"), "step")), "size")
    table = table.withColumn("cell", F.explode(F.sequence(F.expr("first DIV step"), F.expr("(end - 1) DIV step")))).drop("step")
    if len(ranges) <= BROADCAST_RANGES:
        table = F.broadcast(table)
    keyed = pieces.join(F.broadcast(groups), "length").withColumn(
        "group", F.pmod(F.xxhash64("no"), F.col("groups"))
    ).drop("groups")
    counts = written(keyed.groupBy("length", "group").count(), "counts")
    before = counts.select(
        "length", "group", (F.sum("count").over(Window.partitionBy("length").orderBy("group")) - F.col("count")).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("length", "group").orderBy("no")) - 1
    ranked = keyed.withColumn("inside", inside).join(before, ["length", "group"]).withColumn("rank", F.col("before") + F.col("inside"))
    ranked = ranked.withColumn("at", F.expr("rank DIV step"))
    met = ranked.join(table, (F.col("length") == F.col("size")) & (F.col("at") == F.col("cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return met.select(
        "doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("part").alias("length"), "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
        F.expr("substring(ids, int(2 * cut + 1), int(2 * part))").alias("ids"),
    )


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32``, the CRC-32 of the ids as little-endian 32-bit numbers, instead of the ids."""

    def each(batches):
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x, dtype="<u2").astype("<u4")) for x in b.column("ids").to_pylist()]
            rest = b.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(crc, pa.int64())], names=[*rest.schema.names, "ids_crc32"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name != "ids")
    return packed.mapInArrow(each, f"{kinds}, ids_crc32 bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves: sequence_id, ``ids`` (array of int) and ``documents`` (id, start, length) in order."""
    part = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))

    def each(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(x), dtype="<u2").astype(np.int32) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("sequence_id"), pa.array(ids, pa.list_(pa.int32())), b.column("documents")],
                names=["sequence_id", "ids", "documents"],
            )

    kind = packed.schema["doc_id"].dataType.simpleString()
    grouped = packed.groupBy("sequence_id").agg(part.alias("parts")).select(
        "sequence_id", F.col("parts.ids").alias("ids"),
        F.transform("parts", lambda p: F.struct(p.doc_id.alias("doc_id"), p.start.alias("start"), p.length.alias("length"))).alias("documents"),
    )
    return grouped.mapInArrow(
        each, f"sequence_id bigint, ids array<int>, documents array<struct<doc_id:{kind},start:bigint,length:bigint>>"
    )
