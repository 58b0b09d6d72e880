"""Archives, vectors, urls and conversations against plain Python versions and round trips."""

import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from hazardloom.llm import ann, components, quotes, redirects, topk, vectors, warc

PAGES = "page_id long, url string, html string, digest string, keeper long"


# ---- archives

def page_rows():
    r = random.Random(4)
    rows = [(i, f"http://h/{i}", "<p>" + "".join(r.choice("abcé ") for _ in range(r.randint(0, 3000)))) for i in range(300)]
    rows += [(1000 + i, "http://copy/", rows[7][2] * 3) for i in range(20)] + [(2000, None, rows[7][2] * 3), (2000, "again", rows[7][2] * 3)]
    rows += [(3000, "a\r\nb\x00", "x" * 999), (3001, "u", "x" * 999), (3002, "", "é" * 500), (3003, "ü", "é" * 500)]
    rows += [(3004, "u", None), (3005, "u", ""), (None, "n", "é" * 500), (None, "n", "é" * 501), (3006, "long", "w " * 2_000_000)]
    return [(*row, "d", 5) for row in rows]


def test_archived_pages(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    largest = {}
    for i, _, html, *_ in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(i, largest.get(html, i))
    want = []
    for i, _, html, *_ in rows:
        payload = (html or "").encode()
        keeper = largest.get(html) if len(payload) >= 1000 else None
        revisit = keeper is not None and keeper != i
        want.append((str(i), len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", str(keeper if revisit else None)))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.archived_pages(pages).collect()]
    assert sorted(got) == sorted(want)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows()[:300], PAGES)
    archives = warc.write_archives(warc.with_keepers(pages))
    warc.export_files(archives, tmp_path.as_uri()).collect()
    back = warc.read_archives(warc.archive_files(spark, tmp_path.as_uri()), payloads=True)
    got = sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in back.collect())
    assert got == sorted(r[:3] for r in page_rows()[:300])


def test_dictionary_frames():
    records = [warc.record_bytes(i, f"http://h/{i}", b"<html><body>" + bytes(str(i * i), "ascii") * 60, "0" * 40, None) for i in range(400)]
    data = warc.build_archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size == warc.DICTIONARY_BYTES
    assert list(warc.read_records(data)) == records
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])  # a compressed dictionary, and another skippable frame
    other = struct.pack("<II", magic, len(packed)) + packed + struct.pack("<II", 0x184D2A50, 3) + b"abc" + data[8 + size :]
    assert list(warc.read_records(other)) == records
    few = warc.build_archive(records[:3])
    assert list(warc.read_records(few)) == records[:3]
    for broken in (data[:-5], data[:6], few[:-1], b"junk" + few, few + b"\x00\x01"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(broken))


def test_frames_of_streaming_writers_and_damage():
    records = [warc.record_bytes(i, f"http://h/{i}", b"<html>" + b"x" * (i * 4000), "0" * 40, None) for i in range(40)]
    streamed = []
    for r in records:
        writer = zstandard.ZstdCompressor(write_content_size=False, write_checksum=True).compressobj()
        streamed.append(writer.compress(r) + writer.flush())
    assert zstandard.frame_content_size(streamed[0]) == -1
    assert list(warc.read_records(b"".join(streamed))) == records
    with pytest.raises(warc.WarcError, match="more than"):
        list(warc.read_records(b"".join(streamed), most=1000))
    with pytest.raises(warc.WarcError, match="more than"):
        list(warc.read_records(zstandard.ZstdCompressor().compress(records[-1]), most=1000))
    whole = b"".join(streamed)
    for at in (4, 5, 9, 20, len(streamed[0]) + 4):  # one byte of a header or of content changed
        broken = whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :]
        with pytest.raises(warc.WarcError):
            for r in warc.read_records(broken):
                warc.checked_page(r)
    with pytest.raises(warc.WarcError, match="UTF-8"):
        warc.parse_record(records[0].replace(b"http://h/0", b"http://\xff/"))


@pytest.mark.parametrize("change", [
    (b"WARC/1.1", b"HTTP/1.1"), (b"Content-Length: 5", b"Content-Length: 6"), (b"Content-Length: 5", b"Content-Length: x"),
    (b"WARC-Type: response\r\n", b""), (b"WARC-Date", b"WARC Date no colon\r\nX"), (b"hello", b"hullo"), (b"<urn:page:1>", b"<urn:uuid:1>"),
])
def test_damaged_records(change):
    good = warc.record_bytes(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    assert warc.checked_page(good)["payload"] == b"hello"
    with pytest.raises(warc.WarcError):
        warc.checked_page(good.replace(*change, 1))


# ---- vectors

def vector_rows(n=700, dim=24):
    x = np.random.default_rng(6).standard_normal((n, dim)).astype(np.float32)
    x[300:400] = x[300] + 0.01 * x[300:400]  # a third crowds in one place
    x[50:60] = x[50]  # equal vectors tie
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    rows += [(900, None, 1), (1000, [None] * dim, 1), (1001, [float("nan")] * dim, 1), (1050, [float("inf")] + [0.0] * (dim - 1), 1),
             (1100, [0.0] * dim, 1), (1200, [1.0], 1), (None, [1.0] * dim, 1), (1150, [], 1), (7, rows[7][1], 1)]
    return rows


@pytest.mark.parametrize("scale, sizes", [(256.0, {}), (256.0, {"stripe": 100, "group": 3}), (1e15, {})])
def test_exact_top_k(spark, scale, sizes):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(4)
    good = [(i, [int(np.floor(v * scale)) for v in np.array(e, dtype=np.float32).astype(float)]) for i, e, _ in rows
            if i is not None and e and len(e) == 24 and None not in e and np.isfinite(e).all()]
    want = []
    for q, e in sorted({i: e for i, e in good if i % 50 == 0}.items()):
        found = sorted((-max(min(sum(a * b for a, b in zip(e, c)), 2**63 - 1), -2**63), i) for i, c in good if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    got = topk.exact_top_k(frame, scale=scale, **sizes).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == want
    assert topk.exact_top_k(frame.limit(0)).count() == 0


def test_bands_of_norms_leave_pairs_out_and_lose_nothing(spark):
    """Norms that differ much, ties, repeated rows and one id on a third of all rows; few pilot vectors and bands of few rows."""
    r = np.random.default_rng(12)
    x = np.round(r.standard_normal((900, 8)) * np.exp(r.uniform(-4, 1, 900))[:, None], 2)
    x[200:300] = x[100]
    ids = np.where(np.arange(900) < 600, np.arange(900), 75)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(5)
    whole, want = np.floor(256 * x).astype(int), []
    for q in range(0, 600, 50):
        found = sorted((-int(whole[q] @ c), int(i)) for i, c in zip(ids, whole) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    for sizes in ({}, {"stripe": 40, "group": 3, "pilot": 30, "bands": 20}, {"pilot": 3, "bands": 1}):
        got = topk.exact_top_k(frame, **sizes).orderBy("query_id", "rank").collect()
        assert [(g.query_id, g["rank"], g.vec_id, g.score) for g in got] == want


def test_groups_by_reach():
    first, number, met = topk.groups_by_reach([2, 0, 5, 1, 0, 7], 4)  # queries that reach 0 to 5 bands
    assert (first[5], number[5]) == (0, 2) and (first[2], number[2]) == (first[3], number[3]) == (2, 2) and first[0] == 4
    assert met == [4, 4, 4, 2, 2]
    assert topk.groups_by_reach([0, 0, 3], 4)[2] == [1, 1] and topk.groups_by_reach([3, 0], 4)[2] == [0]


def test_bounds_leave_candidates_out():
    x = np.floor(256 * np.random.default_rng(7).standard_normal((3000, 64)) * np.linspace(2, 0.05, 64))
    got, share = topk.search_stripe(x, np.arange(3000), x[:20], np.arange(20), 5)
    score = x[:20] @ x.T
    score[np.arange(20), np.arange(20)] = -np.inf
    assert got[1].reshape(20, 5).tolist() == np.argsort(-score, axis=1, kind="stable")[:, :5].tolist() and share < 0.6


def test_nearest(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(4)
    got = ann.nearest(frame).collect()
    good = {i: np.array(e, dtype=np.float32).astype(float) for i, e, _ in rows
            if i is not None and e and len(e) == 24 and None not in e and np.isfinite(e).all() and any(e)}
    hits, asked = 0, [i for i in good if i % 20 == 0]
    for q in asked:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        for r in mine:
            assert r.vec_id != q and r.score == pytest.approx(good[q] @ good[r.vec_id], abs=1e-12)
        hits += len({r.vec_id for r in mine} & set(sorted((i for i in good if i != q), key=lambda i: (-(good[q] @ good[i]), i))[:20]))
    assert {r.query_id for r in got} == set(asked) and hits >= 0.9 * 20 * len(asked)
    few = frame.where("vec_id < 6 OR vec_id = 20").where("vec_id > 0")
    assert few.count() == 6 and ann.nearest(few).count() == 5
    assert ann.nearest(frame.limit(0)).count() == 0 and ann.nearest(frame.where("vec_id = 40")).count() == 0


def test_scan_abandons_far_candidates():
    r = np.random.default_rng(8)
    x = r.standard_normal((2000, 128))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:30] + 0.02 * r.standard_normal((30, 128))
    (query, vec, score), share = ann.scan_part(x, np.arange(2000), q, np.arange(5000, 5030), np.full(30, 0.3), ann.rotation(129), 1.0, 1)
    assert vec.tolist() == list(range(30)) and share < 0.4


def test_components_of_a_chain_a_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(160, 159), (7, 7), (None, 3), (200, 201), (201, 200)] * 2
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 161)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "bad.org", "/")]


def test_rules_and_aliases(spark):
    link = lambda href: f'<head><link href="{href}" rel="canonical"></head>'
    rows = [
        (1, "https://EXAMPLE.com/en/1?q", None, "block", "example.com/en/"), (2, "https://www.example.com/en/1", "", "allow", "www.example.com/en/"),
        (3, "https://a.b.example.com/de/", "x", "allow", "com/"), (4, "https://example.com", "x", "allow", None),
        (5, "http://notexample.com/en/", "", "allow", "com/"), (6, "no scheme", link("http://bad.org/"), "allow", None),
        (7, None, None, "allow", None), (8, "http://x.net/es/", "", "block", "net/es/"), (9, "http://x.net/fr/es/", "", "allow", None),
        # aliases: a chain that ends at a blocked url, one that also has an allowed one, and one through a page with its own rule
        (10, "http://a.io/1#frag", link("/2"), "block", None), (11, "http://a.io/2", "<META HTTP-EQUIV='Refresh' CONTENT='5; URL=//bad.org/x'>", "block", None),
        (12, "http://c.io/1", link("http://bad.org/y"), "allow", None), (13, "http://c.io/2", link("http://bad.org/y"), "allow", None),
        (14, "http://c.io/2", link("https://www.example.com/en/7?a=1&amp;b=2"), "allow", None),
        (15, "http://d.io/1", "<!-- " + link("http://bad.org/z") + " --><script>" + link("http://bad.org/z") + "</script>", "allow", None),
        (16, "http://e.io/", "<meta name=refresh content='0;url=http://bad.org/'><link rel=stylesheet href=http://bad.org/>canonical", "allow", None),
        (17, "http://f.io/a/b", link("c"), "block", None), (18, "http://f.io/a/c", link("http://bad.org/q" + "x" * 50_000), "block", None),
        (19, "http://y.net/es/1", link("http://www.example.com/en/1"), "block", "net/es/"), (20, "http://bad.org/x", "", "block", "bad.org/"),
        (20, "http://bad.org/x", "", "block", "bad.org/"), (None, "http://g.io/?x", "", "allow", None),
    ]
    pages = spark.createDataFrame([(*r[:3], "r", "v") for r in rows], "page_id long, url string, html string, rule string, verdict string")
    got = redirects.judge(pages, RULES).collect()
    assert sorted((str(r.page_id), r.verdict, str(r.rule)) for r in got) == sorted((str(i), v, str(rule)) for i, _, _, v, rule in rows)
    by = {r.page_id: (r.host, r.path) for r in got}
    assert by[1] == ("example.com", "/en/1") and by[4] == ("example.com", "") and by[6] == by[7] == ("", "")
    more = redirects.judge(pages, RULES, spark.createDataFrame([("http://x.net/fr/es/", "http://bad.org/"), (None, "u")], "src string, dst string"))
    assert more.where("page_id = 9").first().verdict == "block"
    assert redirects.judge(pages.limit(0), RULES).count() == 0


def test_a_hot_alias_and_a_long_chain(spark):
    n = 300
    rows = [(i, f"http://s.io/{i}", f'<link rel=canonical href="http://s.io/{i + 1}">') for i in range(n)]
    rows += [(n + i, f"http://t.io/{i}", '<link rel=canonical href="http://hub.io/">') for i in range(n)] + [(5000, "http://hub.io/", '<link rel=canonical href="http://bad.org/">')]
    got = redirects.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).groupBy("host", "verdict").count().collect()
    assert sorted((r.host, r.verdict, r["count"]) for r in got) == [("hub.io", "block", 1), ("s.io", "allow", n), ("t.io", "block", n)]


# ---- conversations

def plain_threads(rows):
    """(conv, turn, role) -> (parent, thread, depth, text) by going through each conversation message by message."""
    import re

    def runs(text):
        out = []
        for line in re.split(r"\r\n|\n|\r", text or ""):
            mark = re.match(r"[ \t]*>(?:[ \t]*>)*", line)
            level = mark[0].count(">") if mark else 0
            body = re.sub(r"^[ \t]?", "", line[mark.end():]) if mark else line
            if out and out[-1][0] == level:
                out[-1][1].append(body)
            else:
                out.append((level, [body]))
        return [(level, "\n".join(b)) for level, b in out]

    norm = lambda s: re.sub(r"[\s\xa0]+", " ", s.lower()).strip(" ")
    units = lambda s: {u for u in map(norm, [s, *re.split(r"\n[ \t]*\n", s), *s.split("\n")]) if u}
    first, parent = {}, {}
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        for level, s in runs(text):
            for u in units(s) if not level else ():
                first[conv, u] = min(turn, first.get((conv, u), turn))
    for conv, turn, _, text in rows:
        votes = {}
        for level, u in {(level, u) for level, s in runs(text) if level for u in units(s)} if conv is not None and turn is not None else ():
            source = first.get((conv, u))
            if source is not None and source < turn:
                votes[level, source] = votes.get((level, source), 0) + len(u)
        if votes:
            parent[conv, turn] = max(votes, key=lambda k: (-k[0], votes[k], k[1]))[1]
    out = []
    for conv, turn, role, text in rows:
        root, depth = turn, 0
        while (conv, root) in parent:
            root, depth = parent[conv, root], depth + 1
        own = "\n".join(s for level, s in runs(text) if not level)
        own = None if text is None else re.sub(r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+\Z", "", own)
        out.append((conv, turn, role, parent.get((conv, turn)), root, depth, own))
    return out


def test_reply_ordered(spark):
    r = random.Random(9)
    rows = [(None, 0, "u", "> x"), (1, None, "u", "y"), (2, 1, None, None), (2, 0, "a", ""), (3, 0, "u", ">only a quote"), (3, 1, "u", "only a quote")]
    for conv in (10, 11, 12):
        own = []
        for turn in range(40 if conv == 10 else 12):
            text = "\n".join(" ".join(r.choice("abcdefg") * 3 for _ in range(4)) for _ in range(r.randint(1, 3)))
            body = text
            if own and r.random() < 0.7:
                asked = r.choice(own)
                quoted = "\n".join(r.choice(["> ", ">", " > "]) + line.upper() for line in asked.split("\n"))
                body = quoted + "\n\n" + text
            own.append(body)
            rows.append((conv, turn, r.choice("ua"), body))
    for turn in range(70):  # a chain of replies
        rows.append((20, turn, "u", f"> message {turn - 1}\nmessage {turn}"))
    rows += [(20, 70, "u", "> message 3\n" + "line\n" * 20_000 + "end"), (20, 71, "u", "> line"), (20, 71, "u", "> line")]
    frame = spark.createDataFrame([(*x, 1, "h") for x in rows], "conv_id long, turn long, role string, text string, level int, hash string")
    got = quotes.reply_ordered(frame.repartition(6)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(key(x[:6] + x[7:]) for x in got) == sorted(map(key, plain_threads(rows)))
    for conv in {x.conv_id for x in got}:
        mine = sorted((x for x in got if x.conv_id == conv), key=lambda x: x.position)
        assert [x.position for x in mine] == list(range(len(mine)))
        order = [(x.thread is not None, x.thread or 0, x.turn or 0) for x in mine]
        assert order == sorted(order)
    assert quotes.reply_ordered(frame.limit(0)).count() == 0
