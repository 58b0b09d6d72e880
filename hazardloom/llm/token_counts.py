"""Token counts by rank-synchronous merging of byte-pair sequences held as ragged arrays."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
REMEMBERED, REMEMBERED_CHARS = 500_000, 48  # stretches of text whose count a worker keeps, in each of two generations
BATCH_BYTES = 4_000_000  # bytes of new pre-tokens that are merged at once


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 ones stand for themselves."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merger:
    """Counts the symbols left in byte strings after all merges of a byte-pair vocabulary.

    All strings lie one after the other in one array of symbols. In each round every pair of neighbours gets its rank, every string
    its lowest rank, and all strings merge that pair at once, until no string has a pair with a rank. A pair's rank is above
    those that make its parts (checked when the vocabulary is read), so merging all of a pair's places at once gives what
    one at a time gives.
    """

    def __init__(self, vocabulary: dict):
        model = vocabulary["model"]
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {}
        for rank, (a, b) in enumerate(merges):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or a + b in made:
                raise ValueError("merges don't follow their parts")
            made[a + b] = rank
        symbols = byte_symbols()
        self.first = np.array([ids[symbols[b]] for b in range(256)], dtype=np.int64)
        self.size = max(ids.values()) + 1
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.result = np.array([ids[a + b] for a, b in merges], dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def counts(self, strings: list[bytes]) -> np.ndarray:
        """Symbols left of each string; the strings are not empty."""
        left = np.array([len(s) for s in strings], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(strings), dtype=np.uint8)]
        live = np.arange(len(strings))  # strings that still have merges
        lengths, none = left.copy(), len(self.keys)
        while len(live):
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            rank = np.full(len(symbols), none)
            if len(symbols) > 1:
                rank[:-1] = self._rank(symbols[:-1], symbols[1:])
            rank[starts + lengths - 1] = none  # no pair reaches into the next string
            lowest = np.minimum.reduceat(rank, starts)
            on = lowest < none
            if not on.all():  # finished strings leave the arrays
                keep = np.repeat(on, lengths)
                symbols, rank, live, lengths, lowest = symbols[keep], rank[keep], live[on], lengths[on], lowest[on]
                if not len(live):
                    break
            owner = np.repeat(np.arange(len(live)), lengths)
            hit = np.flatnonzero(rank == lowest[owner])
            # of places that overlap (a pair of two equal symbols), every other one merges, from the left
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
            symbols[hit] = self.result[rank[hit]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[hit + 1] = False
            lengths = lengths - np.bincount(owner[hit], minlength=len(live))
            symbols, left[live] = symbols[stay], lengths
        return left


class TokenCounter:
    """Counts tokens of texts: special strings, then pre-tokens, then merges. Frequent stretches of text are remembered.

    A pre-token never reaches over a place where white space follows another character, so each stretch of white space
    and the characters behind it is counted by itself.
    """

    def __init__(self, vocabulary: dict):
        import regex

        self.merger = Merger(vocabulary)
        self.special = [t["content"] for t in vocabulary.get("added_tokens", ())]
        # Fixed value: the split pattern of byte-level vocabularies
        self.pretoken = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.stretch = regex.compile(r"\s*\S+|\s+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = re.compile(r"\s\s")
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _stretches(self, text: str) -> list[str]:
        if self.odd.search(text):
            return self.stretch.findall(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def _learn(self, new: set[str]) -> dict[str, int]:
        """Counts of the stretches ``new``."""
        parts = {s: self.pretoken.findall(s) for s in new}
        unique = list({p for ps in parts.values() for p in ps})
        encoded, count, at = [p.encode() for p in unique], {}, 0
        while at < len(unique):
            end, size = at, 0
            while end < len(unique) and (end == at or size + len(encoded[end]) <= BATCH_BYTES):
                size += len(encoded[end])
                end += 1
            count.update(zip(unique[at:end], self.merger.counts(encoded[at:end]).tolist(), strict=True))
            at = end
        return {s: sum([count[p] for p in ps]) for s, ps in parts.items()}

    def __call__(self, texts: list[str | None]) -> list[int]:
        out, todo = [0] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            sections = self.cut.split(text) if self.cut else [text]
            out[i] += len(sections) // 2  # every second one is a special string
            todo.extend((i, self._stretches(s)) for s in sections[::2] if s)
        known, older = self.known, self.older
        new = {s for _, ss in todo for s in ss if s not in known}
        again = {s: older[s] for s in new if s in older}
        learned = again | self._learn(new - again.keys())
        for i, ss in todo:
            out[i] += sum([known[s] if s in known else learned[s] for s in ss])
        if len(known) + len(learned) > REMEMBERED:
            self.older, self.known = known, {}
        self.known.update((s, n) for s, n in learned.items() if len(s) <= REMEMBERED_CHARS)
        return out


def read_vocabulary(path: str) -> dict:
    """A tokenizer's JSON file, from any file system that pyarrow knows; a plain path is local."""
    fs, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(inside) as f:
        return json.loads(f.read())


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: the id, n_bytes (UTF-8), n_tokens and over_limit. Null texts count as empty, with 0 of both.

    Repeated rows and null ids get their own rows; an empty table gives none; other columns are not read. ``path`` names the
    vocabulary, which every executor reads.
    """

    def each(batches):
        count = TokenCounter(read_vocabulary(path))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                texts = b.column(1).slice(at, 500).to_pylist()
                tokens = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 500), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                     pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(each, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
