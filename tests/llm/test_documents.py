"""The document operators against plain Python versions, on small tables with odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazardloom.llm import mixing, packing, simhash, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, variant string, size string"


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, copies, near copies, a hot source, clashing extra columns."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = text(120)
    rows = [(i, text(r.randint(1, 60)), r.choice(["hot", "hot", "a", "b", None, "é"])) for i in range(60)]
    rows += [(100 + i, base, "hot") for i in range(12)]
    for i in range(12):  # each changed in another place
        w = base.split()
        w[5 + 9 * i] = "changed"
        rows.append((200 + i, " ".join(w), "b"))
    rows += [(300, None, "a"), (301, "", None), (302, " \n\t ", "a"), (303, text(9000), "é"), (304, "one two", "a"), (305, "ONE\x0btwo", "b")]
    rows += [(1, rows[1][1], rows[1][2]), (None, base, "hot"), (None, text(20), "a"), (None, None, None), (306, "<|endoftext|> x y\x1cz 'S don't  Σ", "a")]
    return [(i, t, "en", s, 7, 1, "v", "s") for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- near-duplicates

def plain_print(text, k=3):
    w = plain_words(text)
    parts = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    bits = Counter(b for p in parts for b in range(64) if xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(parts))


def components(n, linked):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in linked:
        at[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash_components(docs, odd_rows, nothing):
    prints = [plain_print(r[1]) for r in odd_rows]
    n = len(prints)
    root = components(n, [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {c: min((odd_rows[i][0] for i in range(n) if root[i] == c and odd_rows[i][0] is not None), default=None) for c in root}
    want = sorted((str(odd_rows[i][0]), prints[i], str(least[root[i]])) for i in range(n))
    got = [(str(r.doc_id), r.fingerprint % 2**64, str(r.component_id)) for r in simhash.simhash_components(docs).collect()]
    assert sorted(got) == want
    assert simhash.simhash_components(nothing).count() == 0


def test_ball_finds_every_pair_within_two_bits(spark):
    r = random.Random(1)
    prints = [r.getrandbits(64) for _ in range(40)]
    prints += [p ^ (1 << r.randrange(64)) for p in prints[:20]] + [p ^ (1 << 3) ^ (1 << 60) for p in prints[:20]] + [p ^ 7 for p in prints[20:30]]
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    found = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()
    place = {p: i for i, p in enumerate(signed)}
    got = components(len(prints), [(place[x.src], place[x.dst]) for x in found])
    want = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    group = lambda c: sorted(sorted(i for i in range(len(c)) if c[i] == k) for k in set(c))
    assert group(got) == group(want)
    with pytest.raises(ValueError):
        simhash.ball(64, 1) and simhash.fingerprint_links(spark.createDataFrame([(1,)], "fingerprint long"), radius=3)


def test_near_duplicate_survivors(docs, odd_rows, nothing):
    prints = [plain_print(r[1]) for r in odd_rows]
    n = len(odd_rows)
    root = components(n, [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    want = sorted(str(min((odd_rows[i][0] for i in range(n) if root[i] == c and odd_rows[i][0] is not None), default=None)) for c in set(root))
    kept = simhash.near_duplicate_survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert simhash.near_duplicate_survivors(nothing).count() == 0


def test_survivors_among_rows_of_equal_id_and_text(spark):
    rows = [(1, "a b c d", "x", "left"), (1, "a b c d", "y", "right"), (2, "other words here now", "x", "s")] + [(2, "other words here now", "x", "s")] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string")
    kept = [sorted(map(tuple, simhash.near_duplicate_survivors(frame.repartition(n)).collect())) for n in (1, 7)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 2] and set(kept[0]) <= set(rows)


# ---- mixing

def test_mixture(docs, odd_rows, nothing):
    got = mixing.words_taken(docs, block=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.words_taken(docs.repartition(2), block=64).collect()))
    assert len(got) == len(odd_rows)
    size = Counter()
    for r in odd_rows:
        size[r[3]] += len(plain_words(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(order, (5, 2, 1) * 9))
    free, total = set(order), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        free -= over
    target = {s: level * weight[s] if s in free else 2 * size[s] for s in order}
    sources = defaultdict(set)
    for r in odd_rows:
        sources[r[0]].add(r[3])
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        (s,) = [s for s in sources[r.doc_id] if math.isclose(target[s], r.target) and size[s] == r.source_size] or [None]
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    assert mixing.words_taken(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixed_documents_hold_the_taken_words(docs):
    mixed = mixing.mixed_documents(docs, block=64)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    taken = mixing.words_taken(docs, block=64).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()
    assert sorted(map(str, words)) == sorted(map(str, taken))


def test_mixed_documents_of_equal_id_and_text(spark):
    rows = [(1, "a b c d", "x", "left"), (1, "a b c d", "y", "right")] + [(5, "one two three", "x", "same")] * 30 + [(None, "p q", None, "n")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string")
    uses = Counter()
    for r in mixing.mixed_documents(frame, block=4).collect():
        uses[r.doc_id, r.source, r._key] += len(r.text.split())
    words, taken = Counter(), Counter()
    for i, t, s, k in rows:
        words[i, s, k] += len(t.split())
        taken[s] += uses[i, s, k] / rows.count((i, t, s, k))
    assert set(uses) <= set(words) and all(uses[k] <= 2 * words[k] for k in uses)
    assert uses[1, "x", "left"] > 0 and uses[1, "y", "right"] > 0
    targets = {r.source: r.target for r in mixing.words_taken(frame, block=4).select("target", "source_size").distinct().join(
        frame.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size")), "source_size").collect()}
    assert {s: round(v) for s, v in taken.items()} == {s: round(t) for s, t in targets.items()}


def test_schedule_keeps_the_proportions(spark):
    sources = spark.createDataFrame([(1, 60_000), (2, 30_000), (3, 10_000), (4, 0)], "k long, take long")
    rows = mixing.schedule(sources, 10).orderBy("slot").collect()
    assert Counter(r.k for r in rows) == {1: 6000, 2: 3000, 3: 1000}
    for k in (1, 2, 3):
        assert [r["rank"] for r in rows if r.k == k] == list(range(Counter(r.k for r in rows)[k]))
    for at in range(0, 9000, 500):
        part = Counter(r.k for r in rows[at : at + 500])
        assert abs(part[1] - 300) <= 4 and abs(part[2] - 150) <= 4 and abs(part[3] - 50) <= 4


# ---- packing and counting tokens

def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path(name))


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_packing(docs, odd_rows, nothing, broadcast, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_RANGES", broadcast)
    monkeypatch.setattr(packing, "ROWS_PER_GROUP", 5)
    monkeypatch.setattr(packing, "CELLS", 30)
    path, tokenizer = packing.vocabulary_path("word_bpe_49k.json"), library("word_bpe_49k.json")
    rows = packing.digests(packing.pack(docs, path, length=256)).collect()
    ids = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in odd_rows]
    want = Counter(str(r[0]) for r, x in zip(odd_rows, ids) for _ in x)
    got, sequences = Counter(), defaultdict(list)
    by_id = defaultdict(list)
    for r, x in zip(odd_rows, ids):
        by_id[r[0]].append(x)
    for r in rows:
        got[str(r.doc_id)] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        crc = [zlib.crc32(np.array(x[r.start : r.start + r.length], dtype="<u4").tobytes()) for x in by_id[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in crc
    assert got == want
    used = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
        used += end
    assert set(sequences) == set(range(len(sequences))) and 256 * len(sequences) - used < 0.02 * used + 256
    assert packing.pack(nothing, path).count() == 0
    real = packing.sequences(packing.pack(docs, path, length=256))
    assert real.agg(F.sum(F.size("ids"))).first()[0] == sum(map(len, ids))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_place_every_piece_once(histogram):
    packs = packing.pack_histogram(histogram, 64)
    total = sum(n * c for n, c in histogram.items())
    assert sum(p.count for p in packs) * 64 - total <= 0.005 * total + 64
    covered = Counter()
    for p in packs:
        assert sum(part for *_, part in p.parts) + p.space == 64 and p.space >= 0
    for size, first, end, start, part, _, _ in packing.pattern_ranges(packs):
        for rank in range(first, end):
            for at in range(start, start + part):
                covered[size, rank, at] += 1
    assert covered == Counter({(s, r, a): 1 for s, n in histogram.items() for r in range(n) for a in range(s)})


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 40)
    own, tokenizer = packing.WordIds(packing.vocabulary_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    r = random.Random(1)
    words = ["".join(r.choice("abcdeé9.$") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["x" * 200, "Über,", "İx", "a<|endoftext|>"]
    for _ in range(12):
        texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(5)] + [None, ""]
        want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
        assert own(texts) == want and len(own.table.used) <= 40


TEXT = st.text(st.sampled_from(list("aAbBtsS .,'’\n\t 1²Ⅷé́İıΣσßﬁάÅ\x1c\x85 ​　一😀<|>")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_word_ids_are_the_librarys(texts):
    encode = test_word_ids_are_the_librarys.__dict__.setdefault("own", packing.WordIds(packing.vocabulary_path("word_bpe_49k.json")))
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encode(texts) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_counts_are_the_librarys(texts):
    kept = test_counts_are_the_librarys.__dict__
    path = packing.vocabulary_path("byte_bpe_50k.json")
    own = kept.setdefault("own", token_counts.TokenCounter(token_counts.read_vocabulary(path)))
    other = kept.setdefault("other", library("byte_bpe_50k.json"))
    assert own(texts) == [len(e.ids) for e in other.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, odd_rows, nothing):
    path, tokenizer = packing.vocabulary_path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    want = sorted((str(r[0]), len((r[1] or "").encode()), count(r[1]), count(r[1]) > 1024) for r in odd_rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect()) == want
    assert token_counts.token_counts(nothing, path).count() == 0


def test_long_runs_of_one_character():
    path = packing.vocabulary_path("byte_bpe_50k.json")
    own, other = token_counts.TokenCounter(token_counts.read_vocabulary(path)), library("byte_bpe_50k.json")
    texts = ["a" * 30_001, "ab" * 5000, " " * 7000, "=" * 4097, "\n" * 33, "é" * 999, "x" + "!" * 500]
    assert own(texts) == [len(e.ids) for e in other.encode_batch(texts, add_special_tokens=False)]


# ---- toxicity

def test_the_pipeline_drops_what_the_operator_calls_toxic(spark):
    docs = spark.createDataFrame([(1, "she said idiot"), (2, "plain words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scored = {r.doc_id: r for r in toxicity.toxicity(docs, none).collect()}
    assert 0.3 <= scored[1].score < 0.5 and scored[1].predicted == 1
    assert [r.doc_id for r in toxicity.without_toxic(docs, none).collect()] == [2]


def clause(words):
    reader = toxicity.Reader({"idiot$": 3.0, "idiot": 3.0})
    return reader.features(words)[0]


def test_grammar():
    assert clause("the idiot is here") == pytest.approx(3.0)
    assert clause("you are an idiot") == pytest.approx(3.6)  # a target stands before it
    assert clause("he is not an idiot") < clause("he is an idiot")
    assert clause("she said he is an idiot") < clause("he is an idiot")
    assert clause("they said nothing. an idiot") == pytest.approx(3.0)  # the report ends with its clause
    assert clause("you idiot idiot") > clause("you idiot. idiot")
    reader = toxicity.Reader({})
    assert reader.features("we will hurt you, you will burn")[3] > 0 and reader.features("the fire will burn")[3] == 0
    assert reader.features(None) == reader.features("") == (0.0, 0.0, 0.0, 0.0)


def test_a_threat_counts_once_its_target_follows():
    read = toxicity.Reader({}).features
    for text in ("we will kill you", "I will hurt all you people"):
        assert read(text)[0] == pytest.approx(3.0) and read(text)[3] > 0
    for text in ("the fire will burn", "burn it. you see", "kill time and then you rest"):
        assert read(text)[0] == pytest.approx(1.0) and read(text)[3] == 0
    assert read("kill and hurt you")[0] == pytest.approx(4.0)  # the first one's two words are over
    assert read("kill hurt you")[0] == pytest.approx(6.0)
    assert read("we will not kill you")[0] == pytest.approx(1.8) and read("we will not kill you")[3] == 0
    assert read("you kill you")[0] == pytest.approx(3.0)  # counted once


def test_composition_is_the_product():
    to, factor = toxicity.GRAMMAR
    machines = (toxicity.INSULT_FST, toxicity.THREAT_FST, toxicity.TARGET_FST, toxicity.NEGATION_FST, toxicity.REPORT_FST)
    r = random.Random(2)
    for _ in range(300):
        state, single, weight, product = 0, [0] * 5, 1.0, 1.0
        for c in (r.randrange(6) for _ in range(12)):
            weight *= factor[state][c]
            state = to[state][c]
            for i, m in enumerate(machines):
                single[i], f = m[single[i]].get(c, m[single[i]]["else"])
                product *= f
        assert weight == pytest.approx(product)


def test_all_letter_runs_of_a_token_are_read():
    reader = toxicity.Reader(toxicity.lexicon([], (0, 1), {}))
    spaced = reader.features("you idiot")
    assert reader.features("you/idiot")[0] > 0 and reader.features("so-called-idiot")[0] > 0 and spaced[0] > 0
    assert reader.features("x,kill you")[3] > 0 and reader.look_up("(you)")[0] == toxicity.TARGET
    long = "w" * 60
    assert toxicity.Reader({long[: toxicity.WHOLE] + "$": 2.0}).features(long)[0] > 0


def test_toxicity(spark, nothing):
    r = random.Random(3)
    soup = lambda n: [r.choice(["der", "lom", "trin", "vale", "os", "quen"]) + r.choice(["a", "e", "i", "o"]) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        words = soup(40)
        toxic = i % 5 == 0
        if toxic:
            words[r.randrange(40)] = r.choice(["idiot", "zurga" + r.choice("bcdf"), "zurgaxx"])
        rows.append((i, " ".join(words)))
        labels += [(i, int(toxic))] * (2 if i % 7 == 0 else 1)
    rows += [(None, "plain"), (1000, None), (1001, ""), (1, rows[1][1]), (1002, "idiot " * 5000)]
    labels += [(None, 1), (2, None), (3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3)
        assert x.held_out == (zlib.crc32(str(x.doc_id if x.doc_id is not None else "").encode()) % 4 == 2)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert len(held) > 100 and sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)
    # labels of held-out documents change nothing
    other = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, toxicity.toxicity(docs, other).collect())) == sorted(map(str, got))
    kept = toxicity.without_toxic(docs.withColumn("_score", F.lit(1)), marks)
    assert kept.columns == ["doc_id", "text", "toxic", "_score"] and 440 < kept.count() < 500
    none = marks.limit(0)
    assert toxicity.toxicity(docs, none).where("text LIKE 'idiot%'").first().predicted == 1
    assert toxicity.toxicity(nothing, none).count() == 0
