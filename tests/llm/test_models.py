import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from tests_llm_helpers import SCHEMA, awkward, words

from tablewarden.llm import fingerprints, licences, toxicity, warc

CALM = "the of and to in is it that was for on are with as at be this have from or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
INSULTS = ["idiot", "moron", "stupid", "scumbag", "pathetic"]


def kernel(a, b):
    """Sum over pairs of equal three-letter subsequences, each weighing DECAY to its span, up to SPAN characters."""

    def grams(s):
        code, out = toxicity._codes()[[ord(c) for c in s.lower()]], {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    if code[i] and code[j] and code[k]:
                        key = (code[i], code[j], code[k])
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = grams(a), grams(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_table_gives_the_kernel():
    row, col, val = toxicity.features(["idiot"])
    table = np.zeros(toxicity.SIZE**3, np.float32)
    np.add.at(table, col, val)
    units = ["idiot", "id-iot", "xxidxioty", "zz", "the"]
    got = toxicity.unit_scores(units, table)
    norm = lambda s: np.sqrt(sum(toxicity.DECAY ** (2 * (d1 + d2 + 1)) for d1, d2 in toxicity.STEPS for i in range(len(s)) if i + d1 + d2 < len(s) and all(toxicity._codes()[ord(s[j])] for j in (i, i + d1, i + d1 + d2))))
    want = [kernel(u, "idiot") / norm(u) / norm("idiot") if norm(u) else 0 for u in units]
    assert np.allclose(got, want, atol=1e-4)


def talk(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(CALM) + rng.choice(["", "", "s", "ly"]) for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.3
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS) + rng.choice(["", "s", "!"]))
        rows.append((i, " ".join(w) + ".", "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_gaps(spark):
    rows, labels = talk(700, 3)
    odd = [(9000, "well you are an id-iot said he", "en", "s", 0), (9001, "well you are an i d i o t said he", "en", "s", 0), (9002, "he is a m0ron and so on", "en", "s", 0), (9003, "well you id iot said he", "en", "s", 0), (9004, "so stu pid of him", "en", "s", 0), (9005, "that pathetic scumbag of a man", "en", "s", 0)]
    docs = spark.createDataFrame(rows + odd + awkward(5000), SCHEMA)
    model = toxicity.learn(docs, spark.createDataFrame(labels + [(None, 1, 1)], "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i, _, _ in labels if out[i]["held_out"]]
    truth = {i: t for i, _, t in labels}
    assert np.mean([(out[i]["score"] >= 0.3) == bool(truth[i]) for i in held]) > 0.97
    assert all(out[i]["score"] >= 0.3 for i in range(9000, 9006))
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[5000]["score"] < 0.3
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


def test_licence_families(spark):
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice(CALM) for _ in range(40))
    notices = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    rows, truth = [], {}
    for i in range(200):
        family = rng.choice([None, None, *notices])
        rows.append((i, f"{plain()}.\n{notices[family]}\n{plain()}" if family else plain(), "en", "s", 0))
        truth[i] = family or "none"
    docs = spark.createDataFrame(rows + awkward(5000), SCHEMA)
    got = licences.scan_licences(docs, licences.learn(docs)).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: r["licence"] for r in got if r["doc_id"] in truth} == truth
    assert {r["licence"] for r in got if r["doc_id"] in (5000, 5001, 5002)} == {"none"}
    strange = ["You may copy and modify this software, provided that this copyright notice is kept; the authors give no warranty of any kind.", "Use of the software in source and binary forms needs permission of the copyright holders."]
    calm = ["two times three is six", "people now say that water may find its way down"]
    more = spark.createDataFrame([(i, f"{plain()}.\n{t}\n{plain()}", "en", "s", 0) for i, t in enumerate(strange + calm)], SCHEMA)
    assert [r["licence"] for r in licences.scan_licences(more, licences.learn(docs)).orderBy("doc_id").collect()] == ["unknown"] * 2 + ["none"] * 2
    long = " ".join(licences.TEMPLATES["mit"].split("\n")[2:4])  # one line of more than 64 words
    assert licences.scan_licences(spark.createDataFrame([(1, long, "en", "s", 0)], SCHEMA), licences.learn(docs)).first()["n_notices"] == 1


def test_licence_notices_within_long_lines(spark):
    rng = random.Random(6)
    plain = lambda n: " ".join(rng.choice(CALM) for _ in range(n))
    notices = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    rows, truth = [], {}
    for i, (family, notice) in enumerate(notices.items()):
        for j, before in enumerate((1, 7, 20, 59, 60, 62, 63, 64, 100, 125, 126)):  # also across words 64 and 128
            rows.append((100 * i + j, f"{plain(before)} {notice} {plain(90)}", "en", "s", 0))
            truth[100 * i + j] = [family]
        rows.append((100 * i + 50, f"{plain(6)} {notice} {plain(6)}", "en", "s", 0))
        truth[100 * i + 50] = [family]
    rows.append((1000, f"{plain(70)} {notices['mit']} {plain(80)} {notices['gpl']} {plain(9)}", "en", "s", 0))
    truth[1000] = ["gpl", "mit"]
    for i in range(2000, 2150):
        rows.append((i, f"{plain(60)} under the terms of the {plain(60)}", "en", "s", 0))
        truth[i] = []
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in licences.scan_licences(docs, licences.learn(docs)).collect()}
    assert {i: r["families"] for i, r in got.items()} == truth
    assert all(r["n_notices"] == len(truth[i]) and r["n_unknown"] == 0 for i, r in got.items())


def test_span_scores_match_paragraph_scores():
    rng = np.random.default_rng(3)
    table, bias = rng.normal(size=(licences.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2])
    grams = licences.Paragraphs(pa.array(["one two three four\nfive", "six", "seven eight"]))
    spans = grams.span_scores(grams.begin, grams.begin + grams.count, table, bias)
    assert np.allclose(spans, grams.scores(table, bias), atol=1e-3)


def test_paragraph_scores_match_brute_force():
    rng = np.random.default_rng(1)
    table, bias = rng.normal(size=(licences.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2])
    texts = ["One two, three four.\nfive", "", "six seven\n\neight " + "nine " * 130]
    got = licences.Paragraphs(pa.array(texts))
    assert got.count.tolist() == [4, 1, 2, 64, 64, 3] and got.doc.tolist() == [0, 0, 2, 2, 2, 2]
    scores = got.scores(table, bias)
    for p in range(6):
        mine = got.gram[got.of == p]
        col = (mine >> np.uint64(64 - 17)).astype(int)
        assert np.allclose(scores[p], table[col].sum(axis=0) / np.sqrt(len(mine)) + bias, atol=1e-3)


def shingles(text, k=5):
    w = words(text)
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints_estimate_jaccard(spark):
    import hashlib

    rng = random.Random(8)
    rows = [(i * 3, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.randint(0, 200))), "en", "s", 0) for i in range(150)]
    rows += [(9001, rows[4][1], "en", "s", 0)] + [r for r in awkward(5000) if r[0] not in (None, 5004)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", fingerprints.F.lit(1)).withColumn("extra", fingerprints.F.lit(1))
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs.repartition(5)).collect()}
    texts = [(i, t or "") for i, t, *_ in sorted(rows)]
    errors = []
    for n, (i, t) in enumerate(texts):
        after = texts[(n + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["edited"] == edited and got[i]["n_chars"] == len(t)
        for other, name in ((edited, "near_edited"), (after, "near_next")):
            a, b = shingles(t), shingles(other)
            errors.append(got[i][name] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.06
    assert got[9001]["fingerprint"] == got[12]["fingerprint"]
    assert len(got[9001]["fingerprint"]) == fingerprints.BINS * fingerprints.DIGITS
    assert fingerprints.fingerprints(docs.limit(0)).collect() == []
    null = spark.createDataFrame(awkward(1), SCHEMA)
    assert fingerprints.fingerprints(null).count() == null.count()


def test_densification_is_right(spark):
    """Bins with a value keep it; an empty bin has the value of one of those, the same for equal sets."""
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "alone")], "i long, text string")
    got = {r["i"]: r["f"] for r in fingerprints.fingerprint(df, "text", "f").collect()}
    assert got[1] == got[2]
    assert len({got[3][j : j + 2] for j in range(0, 256, 2)}) == 1
    assert len({got[1][j : j + 2] for j in range(0, 256, 2)}) == 2


PAGE = "<html lang='en'><head><title>A &amp; B</title><style>p{}</style></head><body><nav><a href='/x'>X</a></nav><!-- no --><p>One<br>two  <b>three</b></p><script>var t='</p>'</script></body></html>"


def test_records_are_linked_and_kept(spark, tmp_path):
    rows = [(1, "http://a.example/", PAGE), (2, None, None), (None, "http://b.example", ""), (1, "http://a.example/", PAGE), (3, "not a url", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("headers", warc.F.lit("x"))
    out = warc.build_derivatives(warc.responses_of_pages(pages)).collect()
    assert len(out) == 2 * len(rows)
    first = {r["record_type"]: r for r in out if r["page_id"] == 1}
    assert first["conversion"]["block"] == "X\nOne\ntwo three"
    assert first["metadata"]["block"] == "title: A & B\r\nlanguage: en\r\noutlinks: 1\r\n"
    for r in out:
        other = next(o for o in out if o["page_id"] == r["page_id"] and o["record_type"] != r["record_type"])
        assert r["refers_to"] == other["refers_to"] and f"WARC-Concurrent-To: {other['record_id']}" in r["headers"]
        assert r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        assert "X-Source-HTTP-Status: 200" in r["headers"]
    df = warc.build_derivatives(warc.responses_of_pages(pages))
    warc.write_warc(df.repartition(2), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((b["headers"]["WARC-Record-ID"], b["block"]) for b in back) == sorted((r["record_id"], r["block"]) for r in out)
    assert warc.build_derivatives(warc.responses_of_pages(pages.limit(0))).collect() == []


def test_unclosed_tags_take_linear_time():
    import time

    began = time.time()
    for piece in ("<a ", "<!-- ", "<script ", "<title>", "<", "</title ", "<a>", "<style>x"):
        warc.parsed(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20
    assert warc.parsed("a < b <b>c</b> <i") == ("a < b c <i", [("outlinks", "0")])
    assert warc.parsed("<head><title>T &lt;<b>1</title></head>x<!-- no > end <p>")[0] == "x"
    assert warc.parsed("<header>h</header><p>1<script>if (a</b) x</script>2<!-- c --> 3")[0] == "h\n1 2 3"


def warc_bytes(version, kind, block, **headers):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_responses_of_warc_files(spark, tmp_path):
    import gzip

    page = "<html lang=fr><head><meta charset=iso-8859-1><title>Été</title></head><p>Déjà vu\r\n\r\nWARC/1.0 ici</html>".encode("latin-1")
    zipped = gzip.compress(b"<p>zipped")
    chunks = b"4\r\n<p>o\r\n3\r\nne \r\n0\r\n\r\n"
    records = [
        warc_bytes("1.0", "warcinfo", b"software: x\r\n"),
        warc_bytes("1.0", "response", b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + page, WARC_Record_ID="<urn:uuid:1>", WARC_Target_URI="<http://a.example/>", WARC_Date="2020-01-02T03:04:05Z", WARC_Payload_Digest="sha1:GIVEN"),
        warc_bytes("1.1", "response", b"HTTP/1.1 404 Not Found\r\ncontent-encoding: gzip\r\n\r\n" + zipped, WARC_Record_ID="<urn:uuid:2>", WARC_Target_URI="http://b.example/"),
        warc_bytes("1.1", "response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks, WARC_Record_ID="<urn:uuid:3>", WARC_Target_URI="http://c.example/"),
        warc_bytes("1.1", "request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:4>"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)) + gzip.compress(records[1])[:40])
    responses = warc.read_responses(spark, str(tmp_path / "in"))
    assert responses.count() == 6
    out = warc.build_derivatives(responses).collect()
    by = {(r["refers_to"], r["record_type"]): r for r in out}
    assert len(out) == 12 and len(by) == 6
    first = by["<urn:uuid:1>", "conversion"]
    assert first["block"] == "Déjà vu\nWARC/1.0 ici" and first["source_payload_digest"] == "sha1:GIVEN" and first["target_uri"] == "http://a.example/"
    assert "WARC-Date: 2020-01-02T03:04:05Z" in first["headers"] and "X-Source-Server: s" in first["headers"]
    assert by["<urn:uuid:1>", "metadata"]["block"] == "title: Été\r\nlanguage: fr\r\ncharset: iso-8859-1\r\noutlinks: 0\r\n"
    assert by["<urn:uuid:2>", "conversion"]["block"] == "zipped" and by["<urn:uuid:3>", "conversion"]["block"] == "one"
    assert "X-Source-HTTP-Status: 404" in by["<urn:uuid:2>", "metadata"]["headers"]


def test_pairs_of_words_are_those_of_a_sentence():
    from tablewarden.llm.words import Words

    texts = ["you id iot. of no use\nto me, a b verylongword it", None, "x", "stu pid of", "ünd so é"]
    words = Words(pa.array(texts))
    raw = words.buf.tobytes()
    got = [(int(words.doc[i]), f"{raw[words.start[i]:words.end[i]].decode()} {raw[words.start[i + 1]:words.end[i + 1]].decode()}".lower()) for i in toxicity._pairs_of(words)]
    assert sorted(set(got)) == sorted((d, p) for d, t in enumerate(texts) for p in toxicity.sentence_pairs(t or ""))
    assert (0, "id iot.") in got and (0, "iot. of") not in got and (0, "use to") not in got


@pytest.mark.parametrize("pack", [lambda *parts: b"".join(parts), lambda *parts: b"".join(map(gzip.compress, parts))])
def test_records_after_a_damaged_one_are_read(spark, tmp_path, pack):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>%d</p>"
    good = [warc_bytes("1.0", "response", page % i, **{"WARC-Target-URI": f"http://a/{i}"}) for i in range(6)]
    long = good[4].replace(b"Content-Length: ", b"Content-Length: 9")
    packed = pack(good[0], good[1].replace(b"Content-Length: ", b"Content-Length: x"), good[2], b"stray bytes\r\nof no record\r\n\r\n", good[3], long, good[5])
    (tmp_path / "a.warc").write_bytes(packed)
    got = {r["url"] for r in warc.read_responses(spark, str(tmp_path)).collect()}
    assert got == {f"http://a/{i}" for i in (0, 2, 3, 5)}
    report = {(r["kind"], r["reason"]): r["records"] for r in warc.read_report(spark, str(tmp_path)).collect()}
    assert report[("response", None)] == 4 and sum(n for (k, _), n in report.items() if k == "skipped") == 3


def test_a_damaged_gzip_member_costs_its_own_records_alone(spark, tmp_path):
    rng = random.Random(1)
    page = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(rng.randrange(97, 120) for _ in range(5000))
    members = [bytearray(gzip.compress(warc_bytes("1.1", "response", page, **{"WARC-Target-URI": f"http://a/{i}"}))) for i in range(4)]
    members[1][900:940] = b"\xff" * 40
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(bytes, members)))
    assert {r["url"] for r in warc.read_responses(spark, str(tmp_path)).collect()} == {f"http://a/{i}" for i in (0, 2, 3)}
