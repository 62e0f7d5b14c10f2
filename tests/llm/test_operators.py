"""Each operator against brute force on a small table with nulls, empty, long, repeated and clashing cases."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, html_extract, language_id, license_scan, passages, simhash, sketch, suffix_dedup, toxicity
from plumbline.llm.common import components

SYLLABLES = ["ra", "tion", "the", "Ou", "lé", "st", "ing", "ñ", "be", "re", "an"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared, line = prose(rng, 70), "Permission to use this line in all documents is granted to everyone who reads it, again and again and again.\n"
    out = [(i, prose(rng, rng.randint(1, 120))) for i in range(30)]
    out += [(100 + i, prose(rng, 20) + "\n" + line + shared + " " + prose(rng, 20)) for i in range(8)]
    out += [(200, out[3][1]), (201, out[3][1]), (202, out[4][1] + " tail"), (203, "a" * 700), (204, "ab" * 400 + prose(rng, 5)), (205, prose(rng, 3000))]
    out += [(300, None), (301, ""), (302, "  \n"), (303, "Released under the MIT License."), (304, "😀 ünder thé MIT"), (305, line * 5), (None, out[5][1]), (400, "twice"), (400, "twice")]
    words = out[31][1].split()
    words[12] = "changed"
    words[40:42] = ["gone"]
    out.append((500, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, row string, fp string, _id int, kept string, report int, words string, lang string"
    return spark.createDataFrame([(i, t, "x", None, 1, "k", 2, "w", None) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def brute_dedup(rows, length):
    order = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows})
    seen, out = set(), {}
    for i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i, t] = (len(b), len(b) - len(kept), sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [100, 30])
def test_suffix_dedup(docs, rows, nothing, length):
    got = suffix_dedup.dedup(docs, length, kept="rest", report="facts").select("doc_id", "text", "facts.*").collect()
    want = brute_dedup(rows, length)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:] == want[-(1 << 63) if r[0] is None else r[0], r[1] or ""], r
    assert suffix_dedup.dedup(nothing, kept="rest", report="facts").count() == 0


def test_crowded_keys_change_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(suffix_dedup, "CROWDED_SHARE", 0.0)
    got = suffix_dedup.dedup(docs, kept="rest", report="facts").select("doc_id", "text", "facts.*").collect()
    want = brute_dedup(rows, 100)
    assert all(tuple(r)[2:] == want[-(1 << 63) if r[0] is None else r[0], r[1] or ""] for r in got)


@pytest.mark.parametrize("key_bytes", [0, 300, 2000])
def test_keys_over_the_ceiling_change_nothing(docs, rows, key_bytes):
    got = suffix_dedup.dedup(docs, kept="rest", report="facts", key_bytes=key_bytes).select("doc_id", "text", "facts.*").collect()
    want = brute_dedup(rows, 100)
    assert len(got) == len(rows) and all(tuple(r[2:]) == want[-(1 << 63) if r[0] is None else r[0], r[1] or ""] for r in got)


def test_interval_bounds_are_common_prefixes():
    rng = np.random.default_rng(3)
    for n, sigma in ((1, 2), (50, 2), (400, 3), (400, 200)):
        text = np.append(rng.integers(1, sigma + 1, n), 0).astype(np.uint16)
        for depth in (1, 5, 40):
            order, bwt = suffix_dedup.transform(text, depth)
            edge = suffix_dedup.bounds(bwt, depth)
            turn = [bytes(np.roll(text, -i)[:depth].astype("u2").tobytes()) for i in order]
            assert all(edge[i] == (turn[i] != turn[i - 1]) for i in range(1, len(turn)))


def test_passages(spark, docs, rows, nothing):
    got = {r["doc_id"]: r for r in passages.passage_report(docs).collect()}
    members = {100 + i for i in range(8)}
    assert all(got[i]["n_links"] > 0 and got[i]["passage_words"] >= 60 for i in members)
    assert len({got[i]["component_id"] for i in members}) == 1
    assert got[500]["n_links"] > 0
    assert got[0]["n_links"] == 0 and got[300]["n_links"] == 0 and got[301]["passages"] == []
    assert passages.passage_report(docs).count() == len(rows)
    assert passages.passage_report(nothing).count() == 0


def test_chains_against_quadratic_scores():
    rng = random.Random(1)
    for _ in range(30):
        pts = sorted({(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(25)})
        best = passages.chains(np.array([p for p, _ in pts]), np.array([q for _, q in pts]))
        assert sorted(x for c in best for x in c) == pts
        assert all(a[0] < b[0] and a[1] < b[1] for c in best for a, b in zip(c, c[1:]))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(v, v) == find(v) for v in root)


def test_bpe(docs, rows, nothing):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()
    want = sorted((str(i), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    texts = {str(i): t for i, t in rows if i is not None}
    assert all(r["decoded_sha256"] == hashlib.sha256((texts[str(r["doc_id"])] or "").encode()).hexdigest() for r in got if r["doc_id"] is not None)
    codec = bpe.Codec(ranks, P.PATTERN)
    rng = random.Random(9)
    odd = [chr(c) for c in [*range(0, 0x250), 0x1680, 0x180E, 0x2028, 0x200B, 0x3000, 0xFEFF, 0x4E2D, 0x1F600, 0x660, 0x301]]
    for _ in range(400):
        s = "".join(rng.choice(odd) for _ in range(rng.randint(0, 50)))
        assert list(memoryview(codec.encode(s)).cast("I")) == enc.encode_ordinary(s)
        assert codec.decode(codec.encode(s)) == s.encode()
    assert bpe.encode_decode(nothing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_long_pieces_take_linear_time():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = bpe.Codec(bpe.read_ranks(open(path, "rb").read()), public_tokenizers.PATTERN)
    usual = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = " " * 20_000 + "x"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == usual.encode_ordinary(text)
    text = " " * 1_000_000
    begin = time.process_time()
    assert own.decode_text(own.encode(text)) == text and time.process_time() - begin < 20


def test_utf8_machine_against_the_library():
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice([0x41, 0x7F, 0x80, 0xA0, 0xBF, 0xC0, 0xC3, 0xE0, 0xE2, 0xED, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]) for _ in range(30))
        cuts = sorted(rng.sample(range(31), 3))
        chunks = [data[a:b] for a, b in zip([0, *cuts], [*cuts, 30])]
        assert "".join(bpe.utf8_stream(chunks)) == data.decode("utf-8", "replace")


def test_utf8_stream():
    text = "aé€😀z" * 5
    data = text.encode()
    for size in range(1, 9):
        assert "".join(bpe.utf8_stream(data[i:i + size] for i in range(0, len(data), size))) == text
    assert "".join(bpe.utf8_stream([b"a\xe2\x82"])) == "a�"


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_license_scan(docs, rows, nothing, spark):
    more = [(900 + i, t) for i, t in enumerate(["x under the MIT License y Under the mit license", "Apache License, Version 2.0", "cc-by-nc 4.0 and CC BY NC", "cc by ncx under the mit licenses", "Permission is hereby granted, free of charge, to any person obtaining a copy"])]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = license_scan.scan_licenses(table).collect()
    want = []
    for i, t in rows + more:
        w = WORD.findall(ascii_lower(t or ""))
        at = [(s, label) for p, label in license_scan.BASE_PHRASES.items() for s in range(len(w)) if w[s:s + len(p.split())] == p.split()]
        want.append((str(i), len(w), len(at), min((s for s, _ in at), default=None), max((s for s, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted(map(str, want)) == sorted(str((str(r[0]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert next(r["labels"] for r in got if r["doc_id"] == 904) == "mit"
    assert license_scan.scan_licenses(nothing).count() == 0


def test_license_labels_against_every_place():
    """Labels and score against a scan that compares every template at every word."""
    rng = random.Random(6)
    index, words = license_scan.Index(), sorted({w for _, t, _ in license_scan.TEMPLATES for w in t.split()})
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            text = rng.choice([t for _, t, _ in license_scan.TEMPLATES] + [*license_scan.BASE_PHRASES]).split()
            if rng.random() < 0.5:
                text[rng.randrange(len(text))] = rng.choice(words)
            parts += text + rng.choices(words, k=rng.randint(0, 3))
        labels, score = set(), 0.0
        for label, entry, must, is_base in index.entries:
            entry, must = [w.decode() for w in entry], [w.decode() for w in must]
            first = next(i for i in range(len(entry)) if entry[i:i + len(must)] == must)
            for at in range(-len(entry), len(parts)):
                got = [0 <= at + i < len(parts) and parts[at + i] == w for i, w in enumerate(entry)]
                if all(got) if is_base else all(got[first:first + len(must)]):
                    labels.add(label)
                    share = sum(index.idf[w.encode()] for w, ok in zip(entry, got) if ok) / sum(index.idf[w.encode()] for w in entry)
                    score = max(score, 1.0 if is_base else min(1.0, share / index.near))
        got = index.scan(" ".join(parts))
        assert got[5] == ",".join(sorted(labels)) and abs(got[6] - score) < 1e-12


def test_language_id(spark, data, nothing, docs):
    table = spark.read.parquet(f"{data}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(table, ~held)
    got = language_id.identify(table, model).join(table.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.9
    und = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert und[300]["lang_pred"] == und[301]["lang_pred"] == und[302]["lang_pred"] == "und" and und[0]["lang_pred"] != "und"
    assert language_id.identify(nothing, language_id.fit(nothing)).count() == 0


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{li}</ul></nav><div class='ad'>Buy</div><article><h1>{h}</h1>{p}</article><div class='comments'><p>me too</p></div><footer>&copy; x</footer></body></html>"


def test_html_extract(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(24):
        ps = [prose(rng, 12) + " &amp; &eacute;" for _ in range(rng.randint(1, 4))]
        rows.append((i, f"https://a{i % 3}.example.com/x", PAGE.format(li="<li><a href='/'>m</a></li>" * rng.randint(1, 5), h=f"Head {i}", p="".join(f"<p>{p}\n <b>bold</b><br>x</p>" for p in ps)), "clash"))
        want[i] = " ".join([f"Head {i}"] + [" ".join((p.replace("&amp;", "&").replace("&eacute;", "é") + " bold x").split()) for p in ps])
    for i in range(30, 36):
        rows.append((i, "http://plain.example.org/", f"<body><div id=nav>menu</div><div class=top><p>Same words</p></div><div class=story><p>Tale {i}</p><p>More {i}</p></div></body>", "c"))
        want[i] = f"Tale {i} More {i}"
    rows += [(40, None, None, "c"), (41, "nonsense", "", "c"), (42, "http://plain.example.org/", "<p>cut <b>off", "c")]
    want |= {40: "", 41: "", 42: "cut off"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(df.where("false")).count() == 0


def test_wrapper_groups():
    stream = html_extract.Page("<ul><li>a</li><li>b</li><li>c</li></ul>").stream
    flat = html_extract.squeeze(stream)
    assert any(isinstance(t, tuple) and t[0] == "*" for t in flat)
    w = html_extract.align(html_extract.squeeze(html_extract.Page("<div><p>x</p></div>").stream), html_extract.squeeze(html_extract.Page("<div><h1>t</h1><p>y</p></div>").stream))
    assert any(isinstance(t, tuple) and t[0] == "?" for t in w) and "#\tdiv" in w


def test_wrapper_decides_between_places(spark):
    """No element or class tells: sibling containers with variable prose stay, what never differs goes, whatever optional blocks stand between."""
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(12):
        lead, story, aside = prose(rng, 8), [prose(rng, 9) for _ in range(rng.randint(1, 20))], "<div class=x><p>Always here</p></div>" * (i % 2)
        rows.append((i, "http://h.example/", f"<body><div class=a><p>{lead}</p></div>{aside}<div class=b>" + "".join(f"<section class=s><h2>{t}</h2><p>{t} end</p></section>" for t in story) + "</div><div class=c>Never changes</div></body>"))
        want[i] = " ".join([lead, *(f"{t} {t} end" for t in story)])
    for parts in (1, 5):
        got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
        assert {r["page_id"]: r["text"] for r in got} == want


def test_repeated_groups_may_be_long():
    item = "".join(f"<p class=k{i}>text {i}</p>" for i in range(9))
    flat = html_extract.squeeze(html_extract.Page("<ol>" + f"<li>{item}</li>" * 40 + "</ol>").stream)
    assert len(flat) == 3 and flat[1][0] == "*" and len(flat[1][1]) == 29


def test_alignment_of_long_pages(monkeypatch):
    rng = random.Random(2)
    for cells in (1 << 22, 50):
        monkeypatch.setattr(html_extract, "MOST_CELLS", cells)
        for _ in range(30):
            a, b = ([f"<t{rng.randrange(12)}>" for _ in range(rng.randint(0, 40))] for _ in range(2))
            pairs = html_extract._matched(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
            if cells > 50:
                best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                for i, x in enumerate(a):
                    for j, y in enumerate(b):
                        best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
                assert len(pairs) == best[-1][-1]
    monkeypatch.undo()
    pages = [html_extract.Page("<body>" + "".join(f"<div class=c{rng.randrange(10**6)}><p>{i}</p></div>" for i in range(5_000)) + "<main>end</main></body>") for _ in range(2)]
    assert all(len(p.stream) > 20_000 for p in pages)
    begin = time.process_time()
    wrapper = html_extract.align(*(html_extract.squeeze(p.stream) for p in pages))
    assert html_extract.article_places(wrapper) == ["body/main"] and time.process_time() - begin < 30


def brute_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("tile", [4096, 2])
def test_simhash(spark, docs, rows, nothing, tile, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (2, tile))
    rng = random.Random(7)
    base = rng.getrandbits(64)
    near = [base]
    for _ in range(12):
        near.append(near[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = sorted((str(i), f"{fp:016x}", str(min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None))) for (i, _), fp, g in zip(rows, fps, group))
    assert sorted((str(r[0]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0
    signed = [v - (1 << 64) if v >> 63 else v for v in {*near}]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    assert components(links.select("a", "b")).select("root").distinct().count() == 1


def test_toxicity(spark, docs, nothing):
    rng = random.Random(8)
    bad = ["idiot", "moron", "trash"]
    rows = []
    for i in range(240):
        w = prose(rng, 40).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"), F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in toxicity.score(table, lex).collect()}
    assert all((got[i]["predicted"] == 1) == bool(y) for i, _, y in rows)
    assert lex.score("what an 1d10t and a m0r0n іdіоt") > 0.7 > lex.score("quiet words")
    odd = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lex).collect()}
    assert odd[300] == odd[301] == odd[302] and 0 <= odd[300] < 0.7
    assert toxicity.keep_clean(docs, lex).columns == docs.columns
    empty = toxicity.fit(nothing, table.where("false"))
    assert toxicity.score(docs, empty).where("predicted = 1").count() == 0 and toxicity.score(nothing, empty).count() == 0


def brute_contamination(text, items):
    w, hit, names = WORD.findall(ascii_lower(text or "")), set(), set()
    for name, t in items:
        v = WORD.findall(ascii_lower(t or ""))
        n = min(13, len(v))
        windows = {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if v else set()
        for s in range(len(w) - n + 1):
            if n and tuple(w[s:s + n]) in windows:
                hit |= set(range(s, s + n))
                names.add(name)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bound,size", [(1_000_000, 1 << 26), (1_000_000, 0), (0, 1 << 26)])
def test_decontaminate(spark, docs, rows, nothing, bound, size, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_PRINTS", bound)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
    items = [("a", rows[31][1][:400]), ("b", rows[2][1]), ("c", "MIT license"), ("d", None), ("e", ""), ("f", rows[2][1]), ("g", "One Two " + " ".join(rows[41][1].split()[100:140])), ("h", "a" * 700)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, doc_id string")
    got = decontaminate.contamination(docs, bench).collect()
    want = sorted((str(i), *brute_contamination(t, items)) for i, t in rows)
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == want and any(w[-1] for w in want)
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("bucket", [1 << 20, 200])
def test_sketch(docs, rows, nothing, bucket, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET_BYTES", bucket)
    got = sorted(sketch.fingerprints(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(order)
    texts = [t or "" for _, t in order]
    edited = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1])]

    def kept(t):
        w = [x for x in re.split("[\x00-\x20]+", t.lower()) if x]
        return w, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    for r, (i, _), t, e in zip(got, order, texts, edited):
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == e)
    errors = []
    for r, t, u, e in zip(got, texts, texts[1:] + texts[:1], edited):
        for near, other in ((r["near_edited"], e), (r["near_next"], u)):
            (_, a), (_, b) = kept(t), kept(other)
            if t != other and min(len(a), len(b)) >= 40:
                errors.append(abs(near - len(a & b) / min(len(a), len(b))))
    # of 40 shingles some 10 hashes are kept, so that a containment of a half is known to about 0.16
    assert len(errors) > 20 and sum(errors) / len(errors) < 0.1 and max(errors) < 0.5
    by = {r["doc_id"]: r for r in got}
    assert by[200]["near_next"] == 1 and by[200]["fingerprint"] == by[201]["fingerprint"]
    w, s = kept(dict(rows)[205])
    size = (len(by[205]["fingerprint"]) - 17) / 10
    assert abs(size - len(s) / sketch.SCALE) < 6 * (len(s) / sketch.SCALE) ** 0.5
    assert sketch.fingerprints(nothing).count() == 0
