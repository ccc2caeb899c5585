"""The training-data operators against brute force on small inputs, with nulls, empty and repeated rows."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from parcelflow.llm import bpe, chats, decontaminate, embeddings, licenses, near, quality, secrets, substrings, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score int"
EDGE = [(900001, None, None, None), (900002, "", "s", 1), (900003, "   \n", "s", 1), (900004, "one two", "s", 1), (900005, "x " * 5000, "s", 1), (None, "a null id", "s", 1), (900006, "one two", "s", 1)]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(r.doc_id, r.text, r.source, 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return spark.createDataFrame(rows + EDGE, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_decontaminate(spark, docs, texts, empty):
    bench = spark.createDataFrame([(r.item_id, r.text, 1) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(77777, None, 1), (77778, "One, TWO", 1), (None, "one two", 1)], "item_id long, text string, n_words int")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, t, _ in bench.collect():
        ws = low(t)
        if item is not None and ws:
            n = min(10, len(ws))
            for i in range(len(ws) - n + 1):
                windows[tuple(ws[i : i + n])].add(str(item))
    want = []
    for d, t in texts:
        ws, hit, items = low(t), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[w]
        want.append((d, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.report(decontaminate.matches(docs, bench)).drop("longest").collect()
    assert Counter(map(tuple, got)) == Counter(want) and any(w[-1] for w in want)
    assert decontaminate.report(decontaminate.matches(empty, bench)).count() == 0
    assert decontaminate.report(decontaminate.matches(docs, bench.limit(0))).where("contaminated").count() == 0


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(0)
    base = rng.standard_normal(64)
    rows += [(10_000 + i, [float(x) for x in base + 0.1 * rng.standard_normal(64)]) for i in range(300)]
    odd = [(20_000, None), (20_001, [0.0] * 64), (20_002, [float("nan")] * 64), (20_003, [None] * 64), (20_004, []), (20_005, [1.0, 2.0]), (20_006, [2.0, 4.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    ids = [r[0] for r in rows]
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True)] + [(20_005, 20_006)]
    root = roots(ids + [o[0] for o in odd], pairs)
    n = Counter(a for a, _ in pairs) + Counter([20_006])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    want = {i: (n[i], root[i], root[i] == i) for i in root}
    same = sum(got[i] == want[i] for i in want)
    assert len(got) == len(want) and same >= 0.98 * len(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_secrets(docs, texts, empty):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(docs).collect())
    want = Counter()
    for d, t in texts:
        t = t or ""
        a = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{x}:{y}" for x, k, y in sorted(a + b + c))
        want[(d, len(a), len(b), len(c), hashlib.sha256(told.encode()).hexdigest())] += 1
    assert got == want
    key = "AKIA" + "A" * 16
    assert [s[1] for s in secrets.find(f"{key} token=short")] == [1, 3]
    assert secrets.find("token=short https://x.example") == []
    assert [s[1] for s in secrets.find(f"{key} " + "x " * 300 + "token=short")] == [1]
    assert secrets.scan(empty).count() == 0
    assert key not in "".join(r.text or "" for r in secrets.redact(docs).collect())


def test_substrings(docs, texts, empty):
    places = Counter()
    split = [(d, [] if t is None else re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts]
    for _, ws in split:
        places.update(tuple(ws[i : i + 35]) for i in range(len(ws) - 34))
    want = Counter()
    for d, ws in split:
        gone = {k for i in range(len(ws) - 34) if places[tuple(ws[i : i + 35])] > 1 for k in range(i, i + 35)}
        want[(d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone))] += 1
    got = Counter(tuple(r) for r in substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect())
    assert got == want and any(w[2] for w in want)
    assert substrings.remove_repeats(empty).count() == 0


def test_near(docs, texts, empty):
    sets = {}
    for d, t in texts:
        if d is not None:
            ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets[d] = {tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set()
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(ids, pairs)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.link(docs, 4).where("doc_id is not null").collect()}
    assert got == {(d, len(sets[d]), root[d], root[d] == d) for d in ids} and pairs
    assert near.link(empty).count() == 0


def test_bpe(docs, texts, empty):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANK_FILE), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode(docs, P.path(bpe.RANK_FILE), P.PATTERN).collect())
    assert got == Counter((d, np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in texts)
    codec = bpe.Codec(P.path(bpe.RANK_FILE), P.PATTERN)
    for t in ("aaaaaaa" * 9, "a\x1cb  c d\n\n e", "it's 12½ ½", "日本語😀 ABABABAB", "<|endoftext|>"):
        assert codec.encode([t])[0] == np.array(own.encode_ordinary(t), "<u4").tobytes(), t
    assert bpe.digest(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_quality_held_out(spark):
    out = quality.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    held = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_urls(spark):
    rows = [(r.page_id, r.url, "h") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(1_000_000, None, "h"), (1_000_001, "no scheme", "h"), (1_000_002, "http://A.Example.ORG/es/x?q", "h"), (1_000_003, "http://org", "h"), (None, "ftp://x.com/de/#a", "h"), (None, "ftp://x.com/de/#a", "h")]
    got = [tuple(r)[:5] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()]
    assert len(got) == len(rows) and all(g[4] in ("allow", "block") for g in got)
    want = Counter()
    for p, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.lower()
        fit = [(len(h + q), h + q, v) for v, h, q in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        want[(p, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "")] += 1
    assert Counter((*g[:4], g[4] if g[3] else "") for g in got) == want
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_licenses(spark, docs, texts, empty):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    cut = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    want = Counter()
    for d, t in texts:
        s = cut(words(t))
        want[(d, ",".join(n for n, b in sorted(licenses.TEMPLATES.items()) if len(s & cut(words(b))) >= 0.8 * len(cut(words(b)))))] += 1
    got = Counter((r.doc_id, r.licenses) for r in licenses.scan(spark, docs).collect())
    assert got == want and any(w[1] for w in want)
    assert licenses.scan(spark, empty).count() == 0


def test_chats(spark):
    one = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes")]
    rows = one + [(2, *r[1:]) for r in one] + [(2, 2, "user", "more"), (3, 0, "user", "hi"), (4, 0, None, None), (5, 0, "user", "else"), (6, 0, "user", "else")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r.conv_id for r in chats.maximal(frame).collect()) == [2, 4, 5]
    assert chats.maximal(frame.limit(0)).count() == 0


def test_license_sentences(spark):
    said = {
        1: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        2: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        3: ("# Licensed under the GNU General Public License, version 2 or later", "GPL-2.0"),
        4: ("you may use it under the GNU Lesser General Public License v2.1 only", "LGPL-2.1"),
        5: ("Distributed under the GNU Affero General Public License version 3.", "AGPL-3.0"),
        6: ("You may redistribute it under the GNU General Public License.", "GPL"),
        7: ("The figures are shared under a CC BY 4.0 licence.", "CC-BY-4.0"),
        8: ("Text is available under the Creative Commons Attribution-ShareAlike 3.0 License", "CC-BY-SA-3.0"),
        9: ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        10: ("/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) */", "BSD-3-Clause,GPL-2.0-only"),
        11: ("This package is distributed under the MIT license; see the file.", "MIT"),
        12: ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided", "ISC"),
        13: ("Use of this source is governed by the BSD 3-Clause License found beside it", "BSD-3-Clause"),
        14: ("Subject to the Mozilla Public License, Version 2.0 as published", "MPL-2.0"),
        15: ("The driver must carry a license while the version of the public road is four.", ""),
    }
    got = {r.doc_id: (r.n_licenses, r.licenses) for r in licenses.scan(spark, spark.createDataFrame([(k, t) for k, (t, _) in said.items()], "doc_id long, text string")).collect()}
    for k, (t, want) in said.items():
        names = got[k][1].split(",") if got[k][1] else []
        parts = want.split(",") if want else []
        assert got[k][0] == len(parts) and all(n.startswith(p) for n, p in zip(names, parts, strict=True)), (t, got[k])


def test_url_models(spark):
    """Scores against models of order 5 over raw characters, written anew."""
    paths = ["/fr/A", "/fr/a", "/fr/q~1", "/fr/é+é", "/de/B=1", "/de/b@1", "/de/日本😀", "/x/A", "/x/a", "/x/B=1", "/x/B~1", "/x/é+é", "/x/日本😀", ""]
    rows = [(i, f"http://h{i % 3}.com{p}") for i, p in enumerate(paths * 3)] + [(0, "http://h0.com/fr/A")] * 2
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    grams = lambda t: [t[i : i + 6] for i in range(len(t) - 5)]
    seen, symbols = {"allow": [Counter() for _ in range(6)], "block": [Counter() for _ in range(6)]}, set()
    for _, u in rows:
        t = "\0" * 5 + u[7:] + "\1"
        symbols |= set(t[5:])
        for g in grams(t):
            for c, mark in (("allow", ".com/fr/"), ("block", ".com/de/")):
                if mark in u:
                    for k in range(6):
                        seen[c][k][g[5 - k :]] += 1

    def chance(c, g):
        n = seen[c][len(g) - 1]
        if len(g) == 1:
            return (n[g] + 1) / (sum(n.values()) + len(symbols) + 1)
        after = [v for h, v in n.items() if h[:-1] == g[:-1]]
        lower = chance(c, g[1:])
        return (n[g] + len(after) * lower) / (sum(after) + len(after)) if after else lower

    assert len(got) == len(rows)
    for r in got:
        each = [np.log(chance("allow", g) / chance("block", g)) for g in grams("\0" * 5 + r.host + r.path + "\1")]
        assert r.score == pytest.approx(np.mean(each), abs=1e-9), (r.host, r.path)
    score = {r.path: r.score for r in got if r.host == "h1.com" or r.path.startswith("/x")}
    assert score["/x/A"] != score["/x/a"] and score["/x/B=1"] != score["/x/B~1"] and score["/x/é+é"] > 0 > score["/x/日本😀"]


def test_decontaminate_blocks(spark, docs, monkeypatch):
    """Many blocks of benchmark give what one block gives, row by row."""
    first, second = "alpha beta gamma delta", "uno due tre quattro"
    more = [(d, t, "s", 1) for d in (7_000_007, None) for t in (first, second, "nothing of it here", first)] + [(8, f"{first} {second}", "s", 1)] * 2
    rows = docs.unionByName(spark.createDataFrame(more, DOCS))
    items = [(1, first), (2, second), (None, first), (3, None), (4, f"{second} x {first}")]
    items += [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(20).collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = lambda: Counter(map(tuple, decontaminate.report(decontaminate.matches(rows, bench)).collect()))
    want = told()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert told() == want and sum(want.values()) == rows.count()
    assert sum(n for w, n in want.items() if w[0] == 7_000_007 and w[-1]) == 3 and sum(n for w, n in want.items() if w[0] == 7_000_007) == 4


def test_secret_pairs(spark):
    key, secret, url, short = "AKIA" + "A" * 16, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "https://x.example", "AKIASHORT"
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.find(t)]
    named = f"aws_secret_access_key = {secret}"
    alone = {"named": named, "bare": secret, "id": short, "endpoint": url, "weak": "token=short"}
    assert [t for t in alone.values() if kinds(t)] == []
    pairs = {("id", k) for k in alone if k != "id"} | {(k, "endpoint") for k in ("named", "bare")}
    for a, ta in alone.items():
        for b, tb in alone.items():
            if (a, b) in pairs:
                assert kinds(f"{ta} and {tb}") == [a, b] and kinds(f"{tb} and {ta}") == [b, a]
                assert kinds(f"{ta} {'x ' * 300}{tb}") == []
    for k in ("named", "bare", "weak", "endpoint"):
        assert kinds(f"{key} {alone[k]}") == ["access", k]
    assert kinds(f"{short} password=longenough123") == ["id", "assign"]
    # Words and paths beside an address aren't tokens; a hook's key in its path is.
    assert kinds("https://blog.example/2024/My-Long-Post-Title-Here internationalization-of-everything") == []
    assert kinds("https://hooks.example/T0/x8Kq2LmZp0VbN4tYw7RdGh5s") == ["endpoint", "bare"]
    frame = spark.createDataFrame([(1, f"{key} {named}"), (2, f"{url} {secret}"), (3, f"{secret}")], "doc_id long, text string")
    hidden = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert secret not in hidden[1] + hidden[2] and hidden[3] == secret
    assert {r.doc_id: r.n_linked for r in secrets.scan(frame).collect()} == {1: 1, 2: 2, 3: 0}


def test_pipeline_rows(spark, tmp_path, monkeypatch):
    """Null and repeated ids through all stages: each row is judged by itself, and one of exact copies stays."""
    import corpus_pipeline

    monkeypatch.setattr(quality, "ACCEPT", 0.0)
    a, b, c, d, leak = (" ".join(f"{w}{i}" for i in range(40)) for w in ("ash", "birch", "cedar", "dill", "leak"))
    rows = [(1, a), (1, a), (5, a), (None, b), (None, b), (2, f"{c} {leak}"), (2, d), (None, f"oak {leak}"), (3, ""), (3, ""), (4, ""), (None, None), (None, None)]
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter((k, hashlib.sha256(t.encode()).hexdigest()) for k, t in [(1, a), (None, b), (2, d), (3, ""), (4, ""), (None, "")])


def test_quality_few_labels(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, f"{'Clean sentences explain the matter well' if k % 2 else 'BUY!!! $$$ NOW 999 CLICK'} {k}", "s", 1) for k in range(1, 31)]
    frame = spark.createDataFrame(rows, DOCS)
    for ids in (range(1, 5), range(1, 15)):
        labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
        model = quality.fit(frame, labels)
        score = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
        assert not model[1].constant and min(v for k, v in score.items() if k % 2) > max(v for k, v in score.items() if k % 2 == 0)
    for y in ([1, 0], [0] * 9 + [1], [1] * 4 + [0]):
        x = np.array(y, float)[:, None] + np.arange(3) / 9
        made = quality.Network(x, np.array(y, float)).score(x)
        assert np.isfinite(made).all() and made[np.array(y) == 1].min() > made[np.array(y) == 0].max()
    spark.createDataFrame([(2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.keep_quality(spark, frame, str(tmp_path)).count() == 30


def test_near_repeated_ids(spark):
    """Versions of one id, null ids and equal sets in another order, against brute force, over several partitionings."""
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 60)] for _ in range(6)]
    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (6, " ".join([*base[0], "end"])), (7, " ".join([*base[1], "end"])), (None, " ".join(base[0])), (None, None), (8, ""), (8, None)]
    # A chain: neighbours are alike, its ends aren't. Many near copies of one text. Repeated rows.
    chain = base[2]
    for k in range(8):
        rows.append((20 + k, " ".join(chain)))
        chain = [*chain[4:], *(f"c{k}_{i}" for i in range(4))]
    rows += [(100 + k, " ".join([*base[3], f"t{k}"])) for k in range(40)] + [(100, " ".join([*base[3], "t0"]))] * 3
    rows += [(300 + k, " ".join(base[4][:30])) for k in range(5)] + [(400, "a b"), (401, "a b"), (402, "A B"), (403, "b a")]
    sets = defaultdict(list)
    for d, t in rows:
        ws = (t or "").lower().split()
        sets[d].append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    ids = sorted(d for d in sets if d is not None)
    alike = lambda s, t: s and t and 100 * len(s & t) >= 80 * len(s | t)
    root = roots(ids, [(a, b) for a in ids for b in ids if a < b and any(alike(s, t) for s in sets[a] for t in sets[b])])
    want = Counter((d, None if d is None else root[d], d is None or root[d] == d) for d, _ in rows)
    assert root[20] == root[27] == 20 and root[7] == 5
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert Counter((r.doc_id, r.component_id, r.kept) for r in near.link(frame).collect()) == want


def test_substrings_small_sketch(spark, docs):
    """A sketch of 64 cells, so nearly all collide, loses nothing and adds nothing; rows repeat."""
    few = docs.limit(60)
    few = few.union(few.limit(3))
    rows = lambda **k: Counter(map(tuple, substrings.remove_repeats(few, **k).collect()))
    split = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in few.collect()]
    places = Counter(tuple(ws[i : i + 35]) for _, ws in split for i in range(len(ws) - 34))
    want = Counter()
    for d, ws in split:
        gone = {k for i in range(len(ws) - 34) if places[tuple(ws[i : i + 35])] > 1 for k in range(i, i + 35)}
        want[(d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone))] += 1
    assert rows(bits=6) == want == rows()


def test_embeddings_planted(spark, monkeypatch):
    """Recall on pairs at cosine 0.95 to 0.96, exact copies, a dense group over several blocks, and trees deeper than their sample."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64)).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.96, (3000, 1))
    dense = x[0] + 0.01 * rng.standard_normal((300, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * y, dense, dense[:1], dense[:1]]))]
    rows += [(7000, x[5].tolist()), (7000, x[6].tolist()), (7000, x[6].tolist()), (None, x[7].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(embeddings, "SAMPLE", 300)
    monkeypatch.setattr(embeddings, "LEAF", 100)
    monkeypatch.setattr(embeddings, "BLOCK", 128)
    got = defaultdict(list)
    for r in embeddings.near_duplicates(frame).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    z = np.array([v for k, v in rows if k is not None])
    ids = np.array([k for k, v in rows if k is not None])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    linked = z @ z.T >= 0.95
    np.fill_diagonal(linked, False)
    once = np.flatnonzero(ids < 7000)
    n = {k: len({int(i) for i in ids[linked[k]]}) for k in once.tolist()}
    pairs = [k for k in range(8, 3000) if n[k] == n[3000 + k] == 1]
    assert len(pairs) > 2900 and np.mean([got[k][0][0] == 1 and got[3000 + k][0][1] == k for k in pairs]) > 0.97
    for k in [*range(6000, 6302)]:
        assert got[k][0][0] <= n[k] and got[k][0][0] >= 0.97 * n[k] and got[k][0][1] == 0
    assert len(got[7000]) == 3 and got[7000][0][1] == 5 and got[6][0][1] == 5 and got[None] == [(0, None, True)]
    assert sum(map(len, got.values())) == len(rows)


def test_bpe_every_code_point():
    """Pieces as tiktoken cuts them: in this vocabulary a letter or number merges with what follows it in its piece."""
    import public_tokenizers as P
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for b in range(0x80, 0xC0):
        for e in b"a1":
            ranks[bytes([b, e])] = len(ranks)
    own = tiktoken.Encoding("probe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(P.path(bpe.RANK_FILE), P.PATTERN)
    points = [chr(x) for x in range(0x80, 0x40000) if not 0xD800 <= x < 0xE000]
    for end in "a1":
        for c in points:
            merged = len(own.encode_ordinary(c + end)) == len(c.encode())
            assert (len(codec.split(c + end)) == 1) == merged, hex(ord(c))
    assert "".join(codec.split("x\U00018DA7\U00033000y \U0001E6E7")) == "x\U00018DA7\U00033000y \U0001E6E7"


def test_bpe_any_ranks(tmp_path, monkeypatch):
    """Ranks in no order of length, so merges make pairs that go first: as tiktoken merges them, whatever way a word is replayed."""
    import tiktoken

    again, stepwise = [], bpe.stepwise
    monkeypatch.setattr(bpe, "stepwise", lambda pieces, *a: again.extend(pieces) or stepwise(pieces, *a))
    n = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        tokens = {"".join(rng.choice(list("abc"), rng.integers(2, 7))).encode() for _ in range(150)}
        ranks = {t: k for k, t in enumerate([*(bytes([b]) for b in range(256)), *rng.permutation(sorted(tokens)).tolist()])}
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        own = tiktoken.Encoding("own", pat_str=r"\p{L}+|\s+", mergeable_ranks=ranks, special_tokens={})
        codec = bpe.Codec(str(path), r"\p{L}+|\s+")
        texts = [*("".join(rng.choice(list("aabc "), k)) for k in range(1, 200)), "a" * 301, "ab" * 150, None]
        got = codec.encode(texts)
        assert got == [np.array(own.encode_ordinary(t or ""), "<u4").tobytes() for t in texts]
        n += len(codec.cache)
    assert 0 < len(again) < n


def test_bpe_cheap(docs, monkeypatch):
    """Ordinary texts cost no search of each character for rare letters, and no replay place by place."""
    import public_tokenizers as P

    def never(*a):
        raise AssertionError

    texts = [r.text for r in docs.select("text").where("doc_id is not null").limit(40).collect()] + ["müde, 日本語 ½ год"]
    assert not all(t is None or t.isascii() for t in texts)
    codec = bpe.Codec(P.path(bpe.RANK_FILE), P.PATTERN)
    want = codec.encode(texts)
    monkeypatch.setattr(bpe, "RARE", type("Rare", (), {"search": never, "sub": never}))
    monkeypatch.setattr(bpe, "stepwise", never, raising=False)
    assert bpe.Codec(P.path(bpe.RANK_FILE), P.PATTERN).encode(texts) == want


def test_chats_ambiguous(spark):
    """A line break in a role, null turns, roles and texts, a null id: against turn lists in Python, and the SQL likewise."""
    import duckdb

    rows = [(1, 0, "a\nb", "c"), (2, 0, "a", "b\nc"), (3, None, "user", "x"), (3, 0, "user", "y"), (4, 0, "user", "x"), (5, 0, None, None), (5, 1, "", "z"), (6, 0, "", ""), (None, 0, "a", "b\nc"), (7, 0, "r", "t"), (8, 0, "r", "t")]
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    k = {c: [v[2:] for v in sorted(vs)] for c, vs in convs.items()}
    first = lambda c: min((o for o in k if k[o] == k[c] and o is not None), default=None) == c
    want = sorted(c for c in k if c is not None and first(c) and not any(len(o) > len(k[c]) and o[: len(k[c])] == k[c] for o in k.values()))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r.conv_id for r in chats.maximal(frame).collect()) == want == [1, 2, 3, 5, 7]
    conversations = frame.where("conv_id is not null").toPandas()  # noqa: F841 - the SQL reads it
    assert sorted(r[0] for r in duckdb.sql(chats.OP5_SQL).fetchall()) == want


def test_near_rounds(spark, monkeypatch):
    """Buckets that hold many unlike members: all rounds of leaders run, or pairs are compared at once, with the same result as brute force."""
    rng = np.random.default_rng(8)
    rows = []
    for f in range(2):
        base = [f"f{f}w{x}" for x in range(60)]
        for k in range(30):
            ws, at = list(base), int(rng.integers(0, 60))
            for i in range(int(rng.integers(3, 12))):
                ws[(at + i) % 60] = f"v{f}_{k % 12}_{i}"
            rows.append((100 * f + k, " ".join(ws)))
    sets = {d: (lambda ws: {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)})(t.split()) for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(sorted(sets), pairs)
    assert 2 < len(set(root.values())) < len(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for easy, stale in ((near.EASY, near.STALE), (-1, 2)):
        monkeypatch.setattr(near, "EASY", easy)
        monkeypatch.setattr(near, "STALE", stale)
        assert {r.doc_id: r.component_id for r in near.link(frame, 4).collect()} == root


def test_word_hashes_long_text(monkeypatch):
    """Texts far longer than what is hashed at once, one of them a single word, hash as they do in one piece."""
    from parcelflow.llm import common

    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 500, 3000)), None, "x" * 20_000, "", "a b " + "y" * 5000 + " c"])
    whole = common.word_hashes(texts, substrings.SPACE, substrings.SAME)
    monkeypatch.setattr(common, "HASH_BYTES", 1000)
    parts = common.word_hashes(texts, substrings.SPACE, substrings.SAME)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0]) == 3005


def test_near_large_buckets(spark, monkeypatch):
    """Buckets above SMALL, cut into many blocks, give fewer links than rows and the same result as brute force."""
    rng = np.random.default_rng(9)
    base, rows = [f"w{x}" for x in range(60)], []
    for k in range(80):
        ws, at = list(base), int(rng.integers(0, 60))
        for i in range(int(rng.integers(2, 12))):
            ws[(at + i) % 60] = f"v{k % 30}_{i}"
        rows.append((k, " ".join(ws)))
    sets = {d: (lambda ws: {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)})(t.split()) for d, t in rows}
    root = roots(sorted(sets), [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert 2 < len(set(root.values())) < len(rows)
    frame, forest, given = spark.createDataFrame(rows, "doc_id long, text string"), near._forest, []

    def counted(buckets, *rest):
        out = forest(buckets, *rest)
        given.append((out.count(), buckets.count()))
        return out

    monkeypatch.setattr(near, "_forest", counted)
    for small, block, hashes in ((2, 4096, 1 << 20), (2, 16, 1 << 20), (8, 4096, 500)):
        for name, value in (("SMALL", small), ("BLOCK", block), ("BLOCK_HASHES", hashes)):
            monkeypatch.setattr(near, name, value)
        assert {r.doc_id: r.component_id for r in near.link(frame, 4).collect()} == root
    assert len(given) == 3 and given[0][0] < given[0][1] / 4
