"""Each operator against plain Python on small rows, and on rows made to be awkward."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnstile.llm import components, decontaminate, line_dedup, ngram_join, piece_transducer, quality, secrets, token_files, url_filter, warc, wrapper

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def test_quality_base_statistics_and_edges(odd, none):
    got = {r["row"]["doc_id"]: r["base"] for r in quality.judged(odd, ["doc_id"]).collect()}
    for doc, text in {r["doc_id"]: r["text"] or "" for r in odd.collect()}.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = defaultdict(list)
        for i in range(len(words) - 2):
            seen[tuple(words[i : i + 3])].append(i)
        covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[doc])[:5] == want
        assert got[doc]["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.judged(none, ["doc_id"]).count() == 0


def test_quality_rejects_what_lies_far_off(spark, shared):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(120)), "en", "a") for i in range(120)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(120)), "en", "a") for i in range(12)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {r[0] for r in clean}


def test_quality_rejects_by_each_statistic_alone(spark, shared):
    """One planted document for each of the four statistics; one short line that comes twice is none."""
    rng = random.Random(8)
    word = lambda low=2, high=8: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(low, high)))
    plain = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, plain(200)) for i in range(150)]
    lines = [plain(20) for _ in range(5)]
    clean.append((200, "\n".join([plain(7), *lines, plain(100)]) + "\n" + plain(7)))
    clean.append((201, "\n".join([short := plain(7), *lines, plain(100), short])))
    labels, phrase = [plain(1) + str(i) for i in range(12)], "red green blue "
    planted = {
        1000: " ".join(word(8, 12) for _ in range(200)),
        1001: " ".join(word() + "#" * (i % 3 == 0) for i in range(200)),
        1002: plain(150) + "\n" + "\n".join(rng.choice(labels) for _ in range(70)),
        1003: plain(110) + " " + phrase * 30,
        1004: plain(150) + "\nClick here" * 60,
    }
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in [*clean, *planted.items()]], "doc_id long, text string, lang string, source string")
    rows = quality.judged(docs, ["doc_id"]).collect()
    assert not any(r["base"]["base_failed"] for r in rows)
    assert {r["row"]["doc_id"] for r in rows if not r["kept"]} == set(planted)


def test_line_dedup_against_brute_force(spark, odd, none):
    rng = random.Random(5)
    bank = [" ".join(rng.choice(["the", "of", "mill", "sea", "was", "old"]) for _ in range(rng.randint(5, 9))) for _ in range(60)]

    def edited(line):
        words = line.split(" ")
        k = rng.randrange(len(words))
        return " ".join(rng.choice([words[:k] + words[k + 1 :], words[:k] + ["x"] + words[k:], words[:k] + ["y"] + words[k + 1 :], words]))

    rows = [(i, "\n".join(edited(rng.choice(bank)) for _ in range(6))) for i in range(60)]
    lines = sorted((i, k, x) for i, t in rows for k, x in enumerate(t.split("\n")))
    # A line of under five words goes only if it equals an earlier one.
    far = lambda x: len(x.split(" ")) >= 5
    near = lambda x, y: x == y or far(x) and far(y) and line_dedup.within_one_edit(x.split(" "), y.split(" "))
    gone = {(i, k) for n, (i, k, x) in enumerate(lines) if any(near(x, y) for _, _, y in lines[:n])}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["row"]["doc_id"]: r["kept_text"] for r in out.collect()} == want

    out = line_dedup.deduplicated(odd).collect()
    assert len(out) == odd.count()
    by_id = defaultdict(list)
    for r in out:
        by_id[r["row"]["doc_id"]].append(r)
    assert by_id[None][0]["n_removed"] == 5 and by_id[1][0]["kept_text"] == "" and by_id[5][0]["kept_text"] is None
    assert by_id[8][0]["n_removed"] == 1 and by_id[7][0]["n_removed"] == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.999, 256)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 256


def test_ngram_classes(odd, none, spark):
    got = defaultdict(set)
    for r in ngram_join.classed(odd).collect():
        got[r["doc_id"]].add(r["class_id"])
    assert got[1] == got[2] == got[3] == {1} and got[7] == {7} and got[4] == {4} and got[None] == {None}
    assert {r["doc_id"] for r in ngram_join.keep_one_of_each(odd).collect()} == {1, 4, 5, None, 6, 7, 8, 9}
    assert ngram_join.classed(none).count() == 0


@pytest.mark.parametrize("block", [7, 2000])
def test_every_link_of_a_class_is_counted(spark, shared, monkeypatch, block):
    """Classes of many different texts, with repeated rows and copies, against the sets of every pair."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rng = random.Random(6)
    rows = []
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(200)]
        for k in range(40):
            text = list(base)
            for at in rng.sample(range(200), rng.randint(1, 4)):
                text[at] = f"edit{c}x{k}x{at}"
            rows.append((100 * c + k, " ".join(text)))
    rows += [rows[0], (900, rows[1][1]), (901, "w " * 30)]
    sets = {t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows}
    want = {d: sum(x != t and len(sets[x] & sets[t]) >= 0.8 * len(sets[x] | sets[t]) for x in sets) for d, t in rows}
    assert 30 < max(want.values()) and len(set(want.values())) > 3
    got = ngram_join.classed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["n_links"] for r in got} == want


def test_links_across_blocks():
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(50, 150), np.arange(1, 101)]
    assert sorted(ngram_join.links_across([0, 1, 2, 0], sets, 0.8)) in ([(1, 0), (1, 3)], [(0, 1), (1, 0), (1, 3), (3, 1)])


def test_components(spark, shared):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(n, n) == r for n, r in root.items())


def test_decontamination(spark, shared, odd, none):
    rng = random.Random(2)
    items = [" ".join(rng.choice(["sun", "moon", "tide", "rock", "wind", "fire"]) + str(rng.randrange(50)) for _ in range(40)) for _ in range(3)]
    changed = items[0].split(" ")
    changed[10], changed[25] = "other", "words"
    docs = spark.createDataFrame([(1, "before " + items[1] + " after"), (2, "x " + " ".join(changed)), (3, "nothing of it"), (4, items[2][:40]), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {(1, 1), (2, 0)} and found[1, 1] == 1.0 and 0.8 < found[2, 0] < 1
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()} == {3, 4, 5}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.keep_clean(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_is_smith_waterman_of_every_pair(spark, shared):
    """Exact and edited copies of one item together, edits at even and at random places, and chance hits."""
    rng = random.Random(5)
    word = lambda: rng.choice("sun moon tide rock wind fire".split()) + str(rng.randrange(30))
    items = [[word() for _ in range(m)] for m in (40, 40, 20, 15, 59, 6, 3, 1)] + [["of", "the"] * 8]

    def edited(item, places):
        out = []
        for i, w in enumerate(item):
            out += [w] if i not in places else rng.choice([["replaced"], [], [w, "extra"]])
        return out

    texts = [[w if i % 8 != 4 else "other" for i, w in enumerate(items[0])], [w if i % 4 != 3 else "other" for i, w in enumerate(items[0])]]
    for item in items:
        texts.append(["before", *item, "after"])
        for _ in range(12):
            places = rng.sample(range(len(item)), rng.randint(0, max(1, len(item) // 3)))
            texts.append([word() for _ in range(rng.randrange(30))] + edited(item, places) + [word() for _ in range(rng.randrange(30))])
    want = {}
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            above, best = [0] * (len(text) + 1), 0
            for x in item:
                row = [0]
                for j, y in enumerate(text):
                    row.append(max(0, above[j] + (1 if x == y else -1), above[j + 1] - 1, row[j] - 1))
                best, above = max(best, *row), row
            if best >= max(0.5 * len(item), min(4, len(item))):
                want[d, k] = best / len(item)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(0, 0), (1, 0)} <= set(want) and {(r["doc_id"], r["item_id"]): r["score"] for r in found} == want
    for r in found:
        assert 0 <= r["start_word"] < r["end_word"] <= len(texts[r["doc_id"]])


def test_decontamination_counts_rare_seeds_where_items_share_most(spark, shared):
    """More items than COMMON_ITEMS begin with one stock phrase; an edited copy of each is found, the phrase alone is not."""
    stock = [f"stock{i}" for i in range(12)]
    items = [stock + [f"own{k}x{i}" for i in range(18)] for k in range(40)]
    texts = [[w if i % 7 != 6 else "other" for i, w in enumerate(t)] for t in items] + [stock]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(k, k) for k in range(40)}


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 4, 9).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint64)
        h = np.zeros((10, 13), int)
        for i in range(1, 10):
            for j in range(1, 13):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_pieces_equal_the_library(odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in piece_transducer.encoded(odd, PIECES, ["doc_id", "text"]).collect():
        text = r["row"]["text"] or ""
        assert r["ids"] == library.encode(text) and r["decoded"] == library.decode(r["ids"]) == text.replace("▁", " ")


def test_unigram_path_is_the_shortest():
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def message(*fields):
        return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(k << 3) + varint(v) for k, v in fields)

    words = {"▁": -4.0, "a": -3.0, "b": -3.0, "ab": -3.5, "▁a": -5.0, "▁ab": -9.0}
    pieces = [message((1, f"<0x{i:02X}>".encode()), (3, 6)) for i in range(256)] + [message((1, w.encode()), (2, s)) for w, s in words.items()]
    model = b"".join(message((1, p)) for p in pieces) + message((2, message((3, 1), (35, 1))), (3, message((4, 0))))
    machine = piece_transducer.Transducer(model)
    assert [machine.pieces[i][0] for i in machine.path("▁ab")] == ["▁", "ab"]
    assert machine.decode(np.array(machine.path("▁abé"))) == "abé"


def test_urls_spread_blocks_to_aliases(spark, shared):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://Bad.example.org/es/1", ""), (2, "https://alias.net/x", link.format("http://bad.example.org/es/1")), (3, "https://far.net/y?a=1", link.format("https://alias.net/x")),
        (4, "http://good.org/z", link.format("https://lone.net/1")), (5, "https://lone.net/1", link.format("http://de.com/de/1")), (6, "http://de.com/de/1", None), (7, None, None), (8, "no scheme", ""), (9, "https://free.net/", "<p>"),
        (9, "https://free.net/", "<p>"),
    ]
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/")]
    out = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), rules, ["page_id"])
    got = sorted((r["row"]["page_id"], r["rule"], r["verdict"]) for r in out.collect() if r["row"]["page_id"] != 9)
    assert got == [(1, "example.org/es/", "block"), (2, None, "block"), (3, None, "block"), (4, "org/", "allow"), (5, None, "allow"), (6, "com/de/", "block"), (7, None, "allow"), (8, None, "allow")]
    assert out.count() == 10


def test_urls_resolve_relative_targets_and_take_all(spark, shared):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0;url={}">'
    site = "https://a.example.net"
    want = {"/bad/1": "/bad/1", "//a.example.net/bad/1": "/bad/1", "1": "/x/y/1", "./1?q=2": "/x/y/1?q=2", "../1": "/x/1", "../../../1": "/1", "..": "/x/", "?p": "/x/y/z?p"}
    rows = [(t, site + "/x/y/z?old", (canonical if i % 2 else refresh).format(t)) for i, t in enumerate(want)]
    for t, url, html in rows:
        from_urls = url_filter.equivalences(spark.createDataFrame([(t, url, html)], "page_id string, url string, html string"))
        b = spark.createDataFrame([(site + want[t],)], "url string").select(url_filter.node_of(F.col("url"))).first()[0]
        assert [r["b"] for r in from_urls.collect()] == [b], t
    pages = [(0, site + "/bad/1", ""), (1, site + "/ok/1", canonical.format("/ok/2") + canonical.format("/bad/1")), (2, site + "/ok/3", canonical.format("mailto:a@b") + refresh.format("#x")), (3, None, canonical.format("/bad/1"))]
    out = url_filter.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), [("block", "example.net", "/bad/")], ["page_id"])
    assert {r["row"]["page_id"]: r["verdict"] for r in out.collect()} == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_archives(spark, shared, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/\r\nX: y", None), (4, None, ""), (5, "http://d/", "é" * 200_000), (None, "u", "same"), (6, "v", "one")] * 2
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("url").collect()), key=repr)
    top = {"same": 2, "": 4, "é" * 200_000: 5, "one": 6}
    want = []
    for page, _, text in rows:
        raw = (text or "").encode()
        first = top[text or ""]
        want.append((page, len(raw), warc.base32_sha1(raw), "response" if page == first else "revisit", None if page == first else first))
    assert got == sorted(want, key=repr)
    one = warc.record(1, "u", b"abc", None, False)
    for bad in (one.replace(b"abc", b"abd"), one[:-1], one.replace(b"WARC/1.1", b"WARC/9.9"), one.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    import zstandard

    packed = zstandard.ZstdCompressor().compress(one)
    assert list(warc.frames(io.BytesIO(packed + packed))) == [one, one]
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(packed[:-3])))


def test_secrets_against_re(odd, none, spark):
    text = 'é api_key: "abcdefgh12" token=token: abcdefgh AKIA' + "A" * 12 + " deadbeef" * 2 + " " + "0f" * 20 + " passwd=short"
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, text)], "doc_id long, text string"))
    for r in secrets.scanned(docs).collect():
        if r["doc_id"] not in (50, 9):
            assert (r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) == (0, 0, 0, "")
            continue
        own = text if r["doc_id"] == 50 else [x["text"] for x in odd.collect() if x["doc_id"] == 9][0]
        spans = sorted((m.start(), k, m.end()) for k, rule in enumerate(secrets.BASE) for m in re.finditer(rule.pattern, own) if len(m[rule.group]) >= rule.least)
        written = ",".join(f"{secrets.BASE[k].kind}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest() and r["spans"] == written
    assert secrets.scanned(none).count() == 0
    assert secrets.trigram_query("abc[0-9]+defg|xyz") == [] and secrets.trigram_query("ab?cd") == [frozenset({"abc", "bcd"}), frozenset({"acd"})]


def test_token_files(odd, none, spark):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    got = sorted((r["start"], r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(odd, BYTES, file_tokens=500).collect())
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.collect())
    at, want = 0, []
    for doc, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want.append((at, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.round_trip(none, BYTES).count() == 0
    rng = random.Random(6)
    parts = ["a", " ", "  ", "\n", "\t", "the", "\x1c", "\x85", "　", "!", "'s", "é", "😀", "12", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    assert token_files._Pieces().encode(tokenizer, texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, 5], "<u4")
    control, data = token_files.pack(ranks)
    assert token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), 7).tolist() == ranks.tolist()


def test_wrapper(spark, shared):
    page = "<html><body><div>Acme daily</div><nav>{n}</nav><article><h1>T{n}</h1><p>one {n}<br>two&amp;&nbsp;<b>three</b><p>last {n}</article><div id=comments>c{n}</div><footer>f</footer></body></html>"
    plain = "<body><div>Acme daily</div><div class=x><p>text {n}</div><script>s</script><div>Read more at Acme</div>"
    rows = [(n, "http://a/", page.format(n=n)) for n in range(7)] + [(100 + n, "http://b/", plain.format(n=n)) for n in range(7)] + [(200, None, None), (201, "http://c/", ""), (202, "x", "<div>" * 3000 + "deep")]
    got = {r["row"]["page_id"]: r["text"] for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert all(got[n] == f"T{n}\none {n} two& three\nlast {n}" for n in range(7))
    assert all(got[100 + n] == f"text {n}" for n in range(7))
    assert got[200] == got[201] == "" and got[202] == "deep"


def test_pipeline_stages(spark, shared, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids", "decoded"]
