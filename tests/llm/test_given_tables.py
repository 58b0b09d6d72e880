"""Operators without SQL against brute force on the given tables."""

import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from tokenizers import Tokenizer

from hazardloom.llm import toxicity
from hazardloom.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def clause_values(tagged):
    """(weight, threatens) of a clause by the grammar's rules, word by word, without its tables."""
    weight, threatens, classes = 0.0, False, [c for c, _ in tagged]
    for i, (c, w) in enumerate(tagged):
        if c not in (toxicity.INSULT, toxicity.THREAT):
            continue
        factor = 1.0
        if c == toxicity.INSULT and toxicity.TARGET in classes[:i]:
            factor *= 1.2
        if c == toxicity.THREAT:
            factor *= 1.5 if toxicity.TARGET in classes[:i] + classes[i + 1 : i + 3] else 0.5
        for j in range(i - 1, max(-1, i - 3), -1):
            if classes[j] in (toxicity.INSULT, toxicity.THREAT):
                break
            if classes[j] == toxicity.NEGATION:
                factor *= 0.6
                break
        if toxicity.REPORT in classes[:i]:
            factor *= 0.8
        weight += w * factor
        threatens |= c == toxicity.THREAT and factor > 1
    return weight, threatens


def toxic_score(text, stems, w):
    """The score of a text: its words' classes, its clauses, the logistic function."""
    named = {v: c for c, vs in ((toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS)) for v in vs}
    clauses, clause = [], []
    for word in (text or "").lower().split():
        runs = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", word)
        keys = [k for r in runs for k in [r[:48] + "$"] + [r[:n] for n in range(3, 9) if n <= len(r)]]
        insult = max((stems.get(k, 0.0) for k in keys), default=0.0)
        known = [(toxicity.THREAT, 2.0) if r in toxicity.THREATS else (named[r], 0.0) for r in runs if r in toxicity.THREATS or r in named]
        clause.append((toxicity.INSULT, insult) if insult > 0 else known[0] if known else (toxicity.OTHER, 0.0))
        if re.search(r"[.!?;:]\W*$", word):
            clauses, clause = [*clauses, clause], []
    marked = [clause_values(c) for c in [*clauses, clause] if any(k in (toxicity.INSULT, toxicity.THREAT) for k, _ in c)]
    x = [max((v for v, _ in marked), default=0.0), math.log1p(sum(v for v, _ in marked)), math.log1p(len(marked)), math.log1p(sum(t for _, t in marked))]
    return 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, w[:4]) + w[4])))))


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stems, w = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    planted = ["you kill, kill you. not an idiot", "he said: trash", "they said you idiot moron never a stupid clown; burn it all you see", "don't hurt, hang him", None, ""]
    texts |= {-1 - i: t for i, t in enumerate(planted)}
    score = toxicity.scoring(stems, w)
    for t, s in zip(texts.values(), score(pa.array(list(texts.values()), pa.string())).to_pylist(), strict=True):
        assert abs(s - toxic_score(t, stems, w)) < 1e-9
    got = QUERIES["op4_toxicity_grammar"](spark, SF).collect()
    assert len(got) == len(table("documents"))
    for r in got:
        assert abs(r.score - toxic_score(texts[r.doc_id], stems, w)) < 1e-9 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_token_counts(spark):
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in table("documents")}
    got = {r.doc_id: r for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())


def test_packing(spark):
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in table("documents")}
    by_doc, by_sequence = {}, {}
    for r in QUERIES["op2_shortest_pack_first"](spark, SF).collect():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length == len(piece) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, wanted in [*((by_doc[i], len(ids[i])) for i in ids), *((s, None) for s in by_sequence.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == wanted if wanted else at <= 4096


def test_simhash_components(spark):
    prints = {}
    for r in table("documents"):
        lowered = re.sub(r"[A-Z]", lambda m: m.group().lower(), r["text"] or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        votes = np.zeros(64, dtype=int)
        for run in runs:
            votes += np.unpackbits(np.frombuffer(xxhash.xxh64_intdigest(run.encode(), seed=42).to_bytes(8, "big"), dtype=np.uint8))
        prints[r["doc_id"]] = int("".join("1" if 2 * v > len(runs) else "0" for v in votes), 2)
    names = sorted(prints)
    component = {i: i for i in names}
    changed = True
    while changed:
        changed = False
        for i in names:
            low = min(component[j] for j in names if (prints[i] ^ prints[j]).bit_count() <= 2)
            if low < component[i]:
                component[i], changed = low, True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in names}


def test_recall_of_nearest(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table("embeddings")}
    got = {}
    for r in QUERIES["op3_adaptive_dimension_scan"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        hits += len(got[q] & set(sorted((i for i in rows if i != q), key=lambda i: (-(rows[q] @ rows[i]), i))[:20]))
    assert set(got) == {i for i in rows if i % 20 == 0} and hits >= 0.9 * 20 * len(got)
