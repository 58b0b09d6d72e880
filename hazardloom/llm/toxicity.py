"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers read the classes of a clause's words: insults, threats, targets, negations and reported speech. Their composition
is one table; it sums what insults and threats weigh in their clause, more where somebody is addressed, less where the
clause negates or reports. A document's clauses then go through a logistic function. Which words insult is learned:
stems (beginnings of words) are weighed by how often they occur in documents labelled toxic and in others.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.llm.workers import kept, sliced
from hazardloom.session import discard, written

# Words of the grammar's classes, lower case
INSULTS = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]
THREATS = ["kill", "hurt", "destroy", "beat", "attack", "shoot", "stab", "hang", "burn", "tuer", "töten", "matar"]
TARGETS = ["you", "your", "yours", "yourself", "he", "she", "him", "her", "they", "them", "toi", "vous", "dich", "euch", "usted", "vosotros"]
NEGATIONS = ["not", "never", "isn't", "aren't", "wasn't", "don't", "nobody"]
REPORTS = ["said", "says", "called", "calls", "wrote", "writes", "quoted", "claimed", "reported", "alleged"]

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
PRIOR_WEIGHT = 3.0  # of the insults above, before labels say more
STEM_LENGTHS = range(3, 9)
MAX_TRAINING = 20_000  # labelled documents to learn from, chosen by hash of their id
MAX_STEMS = 20_000  # stems kept, those in most documents first
WHOLE = 48  # letters of a whole word that tell it from others
MIN_DOCS, MIN_RATIO = 4, 5.0  # toxic documents a stem needs, and how much likelier it must be in them
THRESHOLD = 0.3  # a score from which a document is toxic, for the operator and the pipeline
REMEMBERED = 120_000  # words whose class a worker keeps
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_END = re.compile(r"[.!?;:]\W*$")


# ---- the grammar ---------------------------------------------------------------------------------------------------

# Each transducer: state -> {class: (next state, factor)}; unnamed classes go to the "else" entry. The factor is multiplied
# into the weight of the word that is read.
INSULT_FST = {0: {"else": (0, 1.0)}}
THREAT_FST = {  # a threat counts once a target follows within two words or stood before it; 2, 3 and 4 wait for one
    0: {TARGET: (1, 1.0), THREAT: (2, 0.5), "else": (0, 1.0)},
    1: {THREAT: (1, 1.5), TARGET: (1, 1.0), "else": (1, 1.0)},
    2: {TARGET: (1, 1.0), THREAT: (4, 0.5), "else": (3, 1.0)},  # the last word threatens
    3: {TARGET: (1, 1.0), THREAT: (2, 0.5), "else": (0, 1.0)},  # the one before it
    4: {TARGET: (1, 1.0), THREAT: (4, 0.5), "else": (3, 1.0)},  # both
}
WAITING, HELD_BACK = (2, 3, 4), 1.5 / 0.5 - 1  # what a target adds to each waiting threat, as a multiple of what that gave
TARGET_FST = {
    0: {TARGET: (1, 1.0), "else": (0, 1.0)},
    1: {INSULT: (1, 1.2), "else": (1, 1.0)},
}
NEGATION_FST = {  # reaches over the two words after it
    0: {NEGATION: (2, 1.0), "else": (0, 1.0)},
    1: {NEGATION: (2, 1.0), INSULT: (0, 0.6), THREAT: (0, 0.6), "else": (0, 1.0)},
    2: {NEGATION: (2, 1.0), INSULT: (0, 0.6), THREAT: (0, 0.6), "else": (1, 1.0)},
}
REPORT_FST = {
    0: {REPORT: (1, 1.0), "else": (0, 1.0)},
    1: {INSULT: (1, 0.8), THREAT: (1, 0.8), "else": (1, 1.0)},
}


def compose(*machines: dict) -> tuple[list[list[int]], list[list[float]]]:
    """Product of the transducers: tables [state][class] of next states and of factors; state 0 starts a clause."""
    states = list(product(*(sorted(m) for m in machines)))
    number = {s: i for i, s in enumerate(states)}
    to, factor = [], []
    for s in states:
        steps = [[m[q].get(c, m[q]["else"]) for m, q in zip(machines, s, strict=True)] for c in range(6)]
        to.append([number[tuple(t for t, _ in x)] for x in steps])
        factor.append([math.prod(f for _, f in x) for x in steps])
    return to, factor


MACHINES = (INSULT_FST, THREAT_FST, TARGET_FST, NEGATION_FST, REPORT_FST)
GRAMMAR = compose(*MACHINES)
# Per composed state, what a target gives back to the threats among the two words before it
LIFTS = [HELD_BACK if s[1] in WAITING else 0.0 for s in product(*(sorted(m) for m in MACHINES))]


def keys_of(run: str) -> list[str]:
    """What a run of letters is looked up by: itself (its first WHOLE letters), marked by ``$``, and its stems."""
    return [run[:WHOLE] + "$", *(run[:n] for n in STEM_LENGTHS if n <= len(run))]


class Reader:
    """Reads texts with a lexicon of stems; remembers the class and weight of words it has seen, up to a bound."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.seen = stems, {}
        self.classes = {w: (c, 0.0) for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.classes |= {w: (THREAT, 2.0) for w in THREATS}

    def look_up(self, word: str) -> tuple[int, float]:
        """Class and weight of a token: of its runs of letters the worst insult, else the first that has a class."""
        runs, stems = _LETTERS.findall(word), self.stems
        weight = max([0.0, *(stems.get(k, 0.0) for run in runs for k in keys_of(run))])
        got = (INSULT, weight) if weight > 0 else next((self.classes[run] for run in runs if run in self.classes), (OTHER, 0.0))
        if len(self.seen) >= REMEMBERED:
            self.seen = {}
        if len(word) <= 48:
            self.seen[word] = got
        return got

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """(largest clause, sum of clauses, insulting clauses, threatening clauses), sums dampened by their logarithm."""
        words = (text or "").lower().split()
        seen, look = self.seen.get, self.look_up
        tags = [seen(w) or look(w) for w in words]
        marked = [i for i, t in enumerate(tags) if t[0] in (INSULT, THREAT)]
        if not marked:
            return (0.0, 0.0, 0.0, 0.0)
        to, factor = GRAMMAR
        best = total = 0.0
        insulting = threatening = at = 0
        for i in marked:
            if i < at:
                continue
            first = i
            while first > at and not _END.search(words[first - 1]):
                first -= 1
            state, weight, at, threat = 0, 0.0, first, False
            last = before = (0.0, 0.0)  # weight and factor of the last two words, if they threaten
            while at < len(words):
                c, w = tags[at]
                f = factor[state][c]
                weight += w * f
                threat |= c == THREAT and f > 1
                if c == TARGET and (lift := LIFTS[state]):
                    weight += lift * (last[0] * last[1] + before[0] * before[1])
                    threat |= max(last[1], before[1]) * (1 + lift) > 1
                last, before = (w, f) if c == THREAT else (0.0, 0.0), last
                state = to[state][c]
                at += 1
                if _END.search(words[at - 1]):
                    break
            best, total = max(best, weight), total + weight
            insulting += 1
            threatening += threat
        return (best, math.log1p(total), math.log1p(insulting), math.log1p(threatening))


# ---- learning ------------------------------------------------------------------------------------------------------

def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 4 == 2


def training_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """(text, toxic, half) of at most ``most`` labelled documents that are not held out."""
    known = labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounds the broadcast
    text = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    return text.join(F.broadcast(chosen), "doc_id").select(
        "text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    )


def stem_counts(texts: DataFrame) -> DataFrame:
    """(stem, half, toxic, n): documents of each half and label with a word that begins so; a whole word ends in ``$``."""

    def each(batches):
        for b in sliced(batches):
            counts: dict[tuple, int] = {}
            for text, toxic, half in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = {k for run in set(_LETTERS.findall((text or "").lower())) for k in keys_of(run)}
                for s in found:
                    counts[s, half, toxic] = counts.get((s, half, toxic), 0) + 1
                if len(counts) > 100_000:
                    yield _count_batch(counts)
                    counts = {}
            yield _count_batch(counts)

    return texts.mapInArrow(each, "stem string, half int, toxic int, n bigint").groupBy("stem", "half", "toxic").agg(F.sum("n").alias("n"))


def _count_batch(counts: dict) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
        names=["stem", "half", "toxic", "n"],
    )


def lexicon(rows: list, halves: tuple[int, ...], sizes: dict[tuple[int, int], int]) -> dict[str, float]:
    """Stems and their weights, the logarithm of how much likelier they are in toxic documents of these halves."""
    p, n = (sum(sizes.get((h, t), 0) for h in halves) for t in (1, 0))
    out = {w: PRIOR_WEIGHT for w in INSULTS} | {w + "$": PRIOR_WEIGHT for w in INSULTS}
    for r in rows:
        pos, neg = (sum(r[f"n{t}{h}"] for h in halves) for t in (1, 0))
        ratio = ((pos + 0.5) / (p + 1)) / ((neg + 0.5) / (n + 1))
        if pos >= MIN_DOCS and ratio >= MIN_RATIO:
            out[r["stem"]] = math.log(ratio)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients and constant of a logistic regression, by Newton steps; the constant is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, most_stems: int = MAX_STEMS) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, coefficients). Each half of the labelled documents is read with the other half's lexicon to fit the coefficients.

    To the driver come the ``most_stems`` best stems and four numbers for each of at most ``most`` documents. Without labelled documents,
    or labels of one kind, the grammar's own words and a fixed constant remain.
    """
    texts = written(training_texts(docs, labels, most), "training")
    sizes = {(r.half, r.toxic): r.n for r in texts.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = (sum(v for (_, t), v in sizes.items() if t == k) for k in (1, 0))
    if not p or not n:
        return lexicon([], (0, 1), sizes), np.array([1.0, 0.0, 0.0, 0.0, -3.0])
    at = {f"n{t}{h}": F.sum(F.when((F.col("toxic") == t) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{t}{h}")
          for t in (0, 1) for h in (0, 1)}
    wide = stem_counts(texts).groupBy("stem").agg(*at.values())
    ratio = ((F.col("n10") + F.col("n11") + 0.5) / (p + 1)) / ((F.col("n00") + F.col("n01") + 0.5) / (n + 1))
    rows = [
        r.asDict() for r in wide.where((F.col("n10") + F.col("n11") >= MIN_DOCS) & (ratio >= MIN_RATIO / 2))
        .orderBy(F.desc(F.col("n10") + F.col("n11")), "stem").limit(most_stems).collect()
    ]
    other = {h: lexicon(rows, (1 - h,), sizes) for h in (0, 1)}

    def each(batches):
        readers = {h: Reader(s) for h, s in other.items()}
        for b in sliced(batches):
            got = [readers[h].features(t) for t, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [pa.array([g[i] for g in got], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*cols, b.column(1)], names=["a", "b", "c", "d", "toxic"])

    seen = np.array(texts.mapInArrow(each, "a double, b double, c double, d double, toxic int").collect(), dtype=float)
    seen = seen[np.lexsort(seen.T)]  # sums in one order, so that reruns agree
    discard(texts)
    return lexicon(rows, (0, 1), sizes), fit_logistic(seen[:, :4], seen[:, 4])


def scoring(stems: dict[str, float], w: np.ndarray):
    """A function of texts: the probabilities that they are toxic; null and empty texts count as texts without words."""
    w = [float(v) for v in w]
    key = ("Reader", hashlib.sha1(repr(sorted(stems.items())).encode()).hexdigest())

    def score(texts: pa.Array) -> pa.Array:
        reader, out = kept(key, lambda: Reader(stems)), []
        for at in range(0, len(texts), 500):
            for t in texts.slice(at, 500).to_pylist():
                z = sum(a * b for a, b in zip(reader.features(t), w, strict=False)) + w[-1]
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return pa.array(out, pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """Per input row: doc_id, held_out, score in (0, 1), predicted (1 at ``threshold`` or more).

    Labels of held-out documents are not used; neither are language, source and id. Null and empty texts count as texts without words;
    texts of any length are read whole. Documents that come more than once and documents without id get their own rows; a
    document with two labels counts as toxic if one says so. Other columns are not read; an empty table gives no rows.
    """
    score = F.arrow_udf(scoring(*fit(docs, labels, most)), T.DoubleType())
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns. Null and empty texts, repeated rows, rows without id and
    empty tables are treated as in ``toxicity``; every row is judged by itself.

    Rows pass through one Arrow function in small slices, which reads the text and hands on the rows that stay: nothing waits for a score.
    """
    score, at = scoring(*fit(docs, labels, most)), docs.columns.index("text")

    def each(batches):
        for b in sliced(batches):
            yield b.filter(pc.less(score(b.column(at)), threshold))

    return docs.mapInArrow(each, docs.schema)
