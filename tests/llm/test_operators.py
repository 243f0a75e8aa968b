"""Operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamount.llm import decontaminate, html_labeller, license_scan, line_crf, masked_lm, mixing, near_dedup, token_huffman, warc_store
from seamount.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _size int, k int, key string, start int"


def docs(spark, rows):
    """Documents with a null in every other column and columns whose names the operators use as well."""
    return spark.createDataFrame([(i, t, None, s, None, 1, 2, "x", 3) for i, t, s in rows], SCHEMA)


def words(n, seed=0, size=40):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, size, n)]


TEXTS = [
    (1, "a b", "s1"), (2, None, None), (3, "", "s1"), (4, "  \n ", "s2"), (1, "a b", "s1"), (None, "a  b\n\nc", "s1"), (None, None, "s2"), (7, " ".join(words(30_000, 5, 5000)), "s1"),
    (8, "Tab\tand été \U0001f600 <|endoftext|> don't\r\nstop.  two", "s3"), (8, "another text", "s3"), (9, "x\n" * 50, "s3"), (10, "the end\nis near.\n\nNo", "\U0001f600"),
]


def test_token_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert t.encode("a<|endoftext|>b", add_special_tokens=False).ids[1] == 50256
    got = token_huffman.encode_documents(docs(spark, TEXTS), tokenizer_path()).collect()
    assert len(got) == len(TEXTS)
    at = 0
    want = sorted(((i is not None, i or 0, x is not None, x or "") for i, x, _ in TEXTS))
    for row, (has, i, _, text) in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens) == (i if has else None, at, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_huffman.encode_documents(docs(spark, []), tokenizer_path()).count() == 0


def test_pieces_of_texts():
    e = token_huffman.encoder(tokenizer_path())
    parts = ["a", " ", "\n", "b.", "  ", "\t", "é", "'s", "12", "Ġ", "Ċ", "!?", "\r\n", "\x85", "#x"]
    texts = ["".join(p) for n in range(1, 5) for p in itertools.product(parts, repeat=n) if n < 4 or zlib.crc32(repr(p).encode()) % 11 == 0]
    texts += ["", "a <|endoftext|> b", "<|endoftext|>", "\x1c b", "b \u3000c", "c\u3000 d"]
    for text, raw in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(raw, e.kind).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_slices():
    import pyarrow as pa

    e = token_huffman.Encoder(tokenizer_path())
    e.KEEP = 3  # what is remembered is forgotten again and again
    own = ["one two", None, "", "three. two!\nfour", " \n x", "one"]
    for _ in range(3):
        flat, sizes = e.encode_array(pa.array(own).slice(1), b"\x07\x00")
        want = [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in own[1:]]
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])
    assert [x.tolist() for x in e.encode_array(pa.array([], pa.string()), b"\x07\x00")] == [[], []]


def test_other_files_are_encoded_whole(tmp_path):
    import json

    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    e = token_huffman.Encoder(str(tmp_path / "t.json"))
    texts = ["one two\nthree", "", "a"]
    assert not e.apart and [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_are_read_without_what_wrote_them(spark):
    import subprocess
    import sys
    from pathlib import Path

    folder = token_huffman.write_ids(docs(spark, TEXTS), tokenizer_path())
    program = (
        "import sys; from pyspark.sql import SparkSession; from seamount.llm.token_huffman import read_ids\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print(sorted(tuple(r)[1:] for r in read_ids(s, sys.argv[1]).collect()))"
    )
    out = subprocess.run([sys.executable, "-c", program, folder], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], check=True).stdout
    assert out.strip().splitlines()[-1] == str(sorted(tuple(r)[1:] for r in token_huffman.read_ids(spark, folder).collect()))


@pytest.mark.parametrize("counts", [[0], [5], [1, 1], [3, 0, 1, 7, 7, 100000], list(range(1, 400)), [2**i for i in range(40)]])
def test_code(counts):
    counts = np.array(counts, np.int64)
    lengths = token_huffman.code_lengths(counts, 12)
    used = lengths[counts > 0].astype(float)
    assert (lengths[counts == 0] == 0).all() and lengths.max() <= 12
    assert len(used) < 2 or (2.0**-used).sum() == 1
    r = np.random.default_rng(1)
    ids = r.choice(np.flatnonzero(counts), 1000).astype(np.uint32) if counts.any() else np.empty(0, np.uint32)
    blocks = [ids[:0], ids[:1], ids[:128], ids[:129], ids]
    codes, table = token_huffman.canonical_codes(lengths), token_huffman.decode_table(lengths)
    packed = [(*token_huffman.pack(b, codes, lengths), len(b)) for b in blocks]
    assert all((a == b).all() for a, b in zip(token_huffman.unpack(packed, table), blocks, strict=True))


def windows(text, size=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_decontamination(spark):
    item = " ".join(words(25, 1))
    items = [(1, item), (2, "short one"), (3, None), (4, ""), (None, "not an item"), (5, "the " * 14), (15, "short one"), (6, item), (7, "lone")]
    rows = [
        (1, "x " + item.upper() + " y", "s"), (2, "x, Short, ONE! short one", "s"), (2, "x, Short, ONE! short one", "s"), (3, " ".join(item.split()[3:13]), "s"), (4, " ".join(item.split()[3:12]), "s"), (5, None, "s"), (6, "", "s"),
        (None, "the " * 40, "s"), (7, "the " * 12 + " ".join(words(30_000, 9, 3000)) + " " + item, "s"), (8, "not an item", "s"), (9, "lone wolf", "s"), (7, "other text", None),
    ]
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit(1))).collect()
    want = []
    for i, text, _ in rows:
        w, _ = windows(text)
        hit, own = set(), set()
        for item_id, t in items:
            if item_id is not None:
                for g in windows(t)[1]:
                    for at in range(len(w) - len(g) + 1):
                        if tuple(w[at : at + len(g)]) == g:
                            hit |= set(range(at, at + len(g)))
                            own.add(str(item_id))
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    items = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, decontaminate.contamination(docs(spark, rows), items, limit=0).collect()), key=key) == sorted(want, key=key)
    for limit in (0, 1000):
        clean = decontaminate.clean_rows(docs(spark, rows), items, limit=limit)
        assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted(((i, t) for (i, t, _), w in zip(rows, want) if not w[-1]), key=key)
        assert clean.columns == docs(spark, []).columns
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs(spark, rows), empty).where("contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, []), empty).count() == 0


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates(spark):
    r = np.random.default_rng(4)
    rows = list(TEXTS)
    for base in range(12):
        own = words(int(r.integers(20, 160)), base + 50, 3000)
        for copy in range(int(r.integers(1, 9))):
            new = list(own)
            for _ in range(int(r.integers(0, 5))):
                new[int(r.integers(0, len(new)))] = f"z{r.integers(0, 99999)}"
            rows.append((1000 + 20 * base + copy, " ".join(new).upper(), "s"))
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    want = []
    for i, (doc_id, _, _) in enumerate(rows):
        mates = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)] if sets[i] else [doc_id]
        least = min((m for m in mates if m is not None), default=None)
        want.append((doc_id, len(sets[i]), least, doc_id == least if doc_id is not None and least is not None else least is None))
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, near_dedup.star_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()))
    assert got == {i: 0 for i in range(41)} | dict.fromkeys((100, 101, 102), 100) | dict.fromkeys((200, 201), 200)


def test_mix(spark):
    rows = TEXTS + [(100 + i, " ".join(words(5 + i % 40, i)), f"s{i % 4}") for i in range(400)]
    got = mixing.mix_report(docs(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, open_, target = 1.5 * sum(total.values()), list(names), {}
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            budget -= target[s]
            open_.remove(s)
    for s in names:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == total[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max([r["size"] for r in own], default=0) / 2 + 1e-6
    again = mixing.mix_report(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixed_documents(docs(spark, rows))
    assert mixed.columns == docs(spark, []).columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix_report(docs(spark, [])).count() == 0
    # columns with the names of the plan's own keep their values, and weights may be given
    own = ["target", "epochs", "source_size", "copies", "_size", "_key", "_source", "_null", "_row", "_cut"]
    named = docs(spark, rows[:40]).withColumns({c: F.lit(777) for c in own})
    back = mixing.mixed_documents(named, weight=F.lit(1.0))
    assert back.columns == named.columns and {tuple(r) for r in back.select(*own).collect()} == {(777,) * len(own)}


def test_forward_backward():
    r = np.random.default_rng(2)
    scores, trans = r.normal(size=(3, 5)), r.normal(size=(2, 2))
    counts = np.array([5, 1, 3])
    mask = np.arange(5) < counts[:, None]
    good, pairs = line_crf.forward_backward(scores, mask, trans, np.ones(3))
    steps = np.zeros((2, 2))
    for d in range(3):
        n = counts[d]
        p, z, own = np.zeros(n), 0.0, np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(scores[d, i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z, p = z + w, p + w * np.array(y)
            for a, b in zip(y, y[1:]):
                own[a, b] += w
        steps += own / z
        assert good[d, :n] == pytest.approx(p / z)
    assert pairs == pytest.approx(steps)


def test_quality_of_held_out_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = line_crf.score(d, line_crf.train(d, labels)).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    right = (held["predicted"] == held["quality"]).mean()
    assert right >= 0.95 and held[held["quality"] == 1]["predicted"].mean() >= 0.97


def test_quality_edges(spark):
    d = docs(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = line_crf.score(d, line_crf.train(d, none)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    one = line_crf.train(d, spark.createDataFrame([(1, 1, 0), (7, 1, 0), (8, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int"))
    assert {r.predicted for r in line_crf.score(d, one).where("doc_id IN (1, 7)").collect()} == {1}
    assert line_crf.keep_good(d, one).columns == d.columns
    assert line_crf.score(docs(spark, []), one).count() == 0


def test_masked_likelihood(spark):
    d = docs(spark, TEXTS)
    w, tokens = masked_lm.vocabulary(d)
    assert tokens == sum(len((t or "").split()) for _, t, _ in TEXTS) and w.size == math.ceil(math.sqrt(tokens))
    net = masked_lm.train(d, w, tokens, shard=9000)
    got = masked_lm.score(d, net).collect()
    want, pad = [], w.pad
    for i, text, _ in TEXTS:
        leaf, within = w.ids(masked_lm.hashes((text or "").encode()))
        c, total = [pad] * 2 + leaf.tolist() + [pad] * 2, 0.0
        for at in range(2, len(c) - 2):
            h = np.tanh(sum(net.e[c[at + s]].astype(float) * net.s[j] for j, s in enumerate((-2, -1, 1, 2))) + net.b)
            for k in range(w.starts[c[at]], w.starts[c[at]] + w.sizes[c[at]]):
                total -= math.log1p(math.exp(-w.signs[k] * (net.u[w.nodes[k]].astype(float) @ h)))
            total += within[at - 2]
        want.append((i, len(leaf), total))
    key = lambda r: (str(r[0]), r[1])
    for r, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:2] == x[:2] and r[2] == pytest.approx(x[2], rel=1e-4)
        assert r[3] is None if not x[1] else r[3] == pytest.approx(x[2] / x[1], rel=1e-4)
    again = masked_lm.train(docs(spark, TEXTS[::-1]).repartition(3), w, tokens, shard=9000)
    assert (again.rows == net.rows).all()
    assert masked_lm.score_documents(docs(spark, [])).count() == 0
    assert {r[1:] for r in masked_lm.score_documents(docs(spark, [(1, " ", None), (2, None, "s")])).collect()} == {(0, 0.0, None)}


def test_masked_network_predicts_words():
    """All words' probabilities sum to 1, and held-out texts are likelier than by the shares of words alone."""
    r = np.random.default_rng(1)
    follows = r.integers(0, 60, (60, 2))

    def text():
        at, out = int(r.integers(0, 60)), []
        for _ in range(100):
            at = int(follows[at, r.integers(0, 2)])
            out.append(f"w{at}")
        return " ".join([*out, f"rare{r.integers(0, 10**6)}"]).encode()

    own, other = [text() for _ in range(1500)], [text() for _ in range(30)]
    words, n = np.unique(np.concatenate([masked_lm.hashes(t) for t in own]), return_counts=True)
    order = np.argsort(-n, kind="stable")
    rare = np.bincount(words[order[60:]] % 1024, n[order[60:]], 1024)
    w = masked_lm.words_of([(int(words[i]), int(n[i])) for i in order[:60]], rare)
    trainer = masked_lm.Trainer(w, masked_lm.Network(w).rows)
    for i in range(0, 1500, 100):
        trainer.learn(*masked_lm.stream([w.ids(masked_lm.hashes(t))[0] for t in own[i : i + 100]], w.pad))
    every = np.arange(w.pad)
    h = np.repeat(r.normal(size=(1, masked_lm.HIDDEN)).astype(np.float32), len(every), axis=0)
    x = trainer.net.branches(h, every)
    assert np.exp(-np.add.reduceat(np.logaddexp(0, -x.odds), x.begin)).sum() == pytest.approx(1, abs=1e-4)
    assert np.exp(w.share).sum() == pytest.approx(masked_lm.RARE, rel=1e-4)
    size, total = masked_lm.score_texts(trainer.net, other)
    shares = np.concatenate([n[order[:60]], np.bincount(np.arange(1024) % masked_lm.RARE, rare, masked_lm.RARE) + 1.0])
    shares = np.log(shares / shares.sum())
    alone = sum(shares[leaf].sum() + within.sum() for leaf, within in (w.ids(masked_lm.hashes(t)) for t in other))
    assert total.sum() / size.sum() > alone / size.sum() + 1


def test_licenses(spark):
    rows = [
        (1, "Intro text.\nLicensed under the Apache License, Version 2.0. More.", "s"), (2, None, "s"), (3, "", "s"), (4, "# Copyright (c) 2020 Foo\n# All rights reserved.\n", "s"), (None, "Released under the MIT License.", "s"),
        (5, "nothing of the sort. " * 2000, "s"), (1, "All rights reserved. Licensed under CC BY 4.0", "s"),
    ]
    got = {(r.doc_id, r.sentence_ids): (r.licenses, r.n_unmatched) for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == {
        (1, "APACHE2"): ("Apache-2.0", 0), (2, ""): ("", 0), (3, ""): ("", 0), (4, "COPYRIGHT,RESERVED"): ("Proprietary", 0), (None, "MIT"): ("MIT", 0), (5, ""): ("", 0), (1, "RESERVED,CCBY4"): ("CC-BY-4.0,Proprietary", 0),
    }
    assert license_scan.scan(docs(spark, [])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id bigint, url string, html string, key string, last int")


def test_archive(spark):
    big = "é" * 600
    rows = [(1, "u\r\nv", big), (2, None, big), (3, "w", big + "!"), (4, "w", "small"), (5, "w", "small"), (6, "w", None), (7, "w", ""), (None, "w", big), (8, "w", "x" * 300_000)]
    headers, payloads = warc_store.write_archive(pages(spark, rows))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_store.read_archive(headers, payloads).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = h == big and i != 2
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)
    assert payloads.count() == 5  # each payload once
    whole = {r.page_id: bytes(r.record) for r in warc_store.warc_bytes(headers, payloads).collect()}
    assert whole[4].endswith(b"Content-Length: 5\r\n\r\nsmall\r\n\r\n") and whole[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    with pytest.raises(Exception, match="key says|digest"):
        warc_store.read_archive(headers, payloads.withColumn("payload", F.encode(F.lit("forged"), "utf-8"))).collect()
    assert warc_store.read_archive(*warc_store.write_archive(pages(spark, []))).count() == 0


def test_blocks():
    page = "<p>a &amp; b<br>c<script>x<p></script><!-- <p>no --><p>d <b>e</b> f</p><ul><li>g<li><a href='?a>b'>h</a></ul>tail"
    assert [b[1] for b in html_labeller.blocks_of(page)] == ["a & b c", "d e f", "g", "h", "tail"]
    for broken in ("", "<", "<p", "a < b", "<p><div></p></div>", "</p>" * 3, "<script>", "<!--"):
        html_labeller.blocks_of(broken)


def test_gradient():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in html_labeller.first_weights().items()}
    x, counts, y = r.normal(size=(7, html_labeller.SIZE)).astype(np.float32), np.array([4, 3]), np.array([1, 0, 1, 1, 0, 0, 1.0])

    def loss(w):
        o = html_labeller.log_odds(w, x, counts).astype(np.float64)
        return (np.logaddexp(0, o) - y * o).sum() / len(x)

    g = html_labeller._gradient(w, x, counts, y)
    for k in w:
        at = tuple(r.integers(0, n) for n in w[k].shape)
        a, b = {n: v.copy() for n, v in w.items()}, {n: v.copy() for n, v in w.items()}
        a[k][at] += 1e-2
        b[k][at] -= 1e-2
        assert g[k][at] == pytest.approx((loss(a) - loss(b)) / 2e-2, abs=2e-4)


def test_main_text(spark):
    w = html_labeller.model()
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>A head</h1><p>{}</p><p>Second &eacute; paragraph of the text that goes on.</p></article><footer>&copy; 2024 all rights reserved</footer></body></html>"
    rows = [(1, "u", page.format("The first paragraph is about many things and ends here.")), (2, None, None), (3, "u", ""), (None, "u", page.format("word " * 20_000)), (1, "u", page.format("The first paragraph is about many things and ends here."))]
    got = html_labeller.extract(pages(spark, rows), w).collect()
    texts = {(r.page_id, r.url): r.text for r in got}
    assert len(got) == 5 and texts[2, None] == texts[3, "u"] == "" and all(r.n_chars == len(r.text) for r in got)
    assert texts[1, "u"] == "A head\nThe first paragraph is about many things and ends here.\nSecond é paragraph of the text that goes on."
    assert len(texts[None, "u"]) > 99_000
    assert html_labeller.extract(pages(spark, []), w).count() == 0
