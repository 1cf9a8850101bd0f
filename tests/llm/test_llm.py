"""The corpus operators against brute force, the libraries they follow, and held-out labels."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from echograph.llm import bpe, decontaminate, html, quality, repeats, simhash, toxicity, vectors, warc
from echograph.llm.common import Tables, components
from echograph.llm.queries import digests, vocabulary

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \n\t", "one", "one two", "one two three", "é" * 9, "a" * 3000, "x y " * 900, "a\x1cb\x85c d", "<|endoftext|> I'm", "퟿\U0001f642 Σίσυφος İ"]


def roots(pairs, ids):
    to = {i: i for i in ids}

    def find(x):
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


# components


def test_components_chains_stars_loops(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 400)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5), (7, 8), (7, 8), (8, 7)]
    pairs += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(pairs, "a long, b long"), Tables(spark)).collect()}
    real = [p for p in pairs if p[0] != p[1]]
    want = roots(real, {x for p in real for x in p})
    assert got == want


def test_components_empty(spark):
    assert components(spark, spark.createDataFrame([], "a long, b long"), Tables(spark)).collect() == []


# SimHash


def plain_fingerprint(text):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").split("[\x20\x09-\x0d]+", raw) if w]
    parts = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] if len(found) >= 3 else [" ".join(found)] if found else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", EDGE)
def test_fingerprint_edges(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("level", [2, 3, 4, 5])
def test_pigeonring_loses_no_pair(level):
    rng = random.Random(level)
    masks = simhash.fixed_bits(level)
    for _ in range(150):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << k
        d = np.array([a ^ b], np.uint64)
        assert any(a & m == b & m and simhash.viable(d, p, level)[0] for p, m in enumerate(masks))


def near_prints(rng, groups, size):
    out = []
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, size)):
            out.append(x)
            for k in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << k
    return out


@pytest.mark.parametrize("most", [4096, 6])
def test_link_components_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(3)
    prints = sorted(set(near_prints(rng, 60, 12) + [rng.getrandbits(12) for _ in range(120)] + [0]))
    rows = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)]
    got = {r.fingerprint: r.component for r in simhash.link_components(spark, spark.createDataFrame(rows, "fingerprint long, id long"), Tables(spark)).collect()}
    want = roots([(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], range(len(prints)))
    assert got == {f: want[k] for f, k in rows}


def test_near_duplicates_documents(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(300)
    texts = [*docs.text, *EDGE, EDGE[4], docs.text[3] + " tail"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark, frame(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = roots([(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], range(len(texts)))
    assert got == {k: (f"{p:016x}", want[k]) for k, p in enumerate(prints)}
    kept = simhash.keep_one(spark, frame(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_duplicates_empty_and_extra_columns(spark):
    assert simhash.near_duplicates(spark, frame(spark, [])).collect() == []
    docs = spark.createDataFrame([(1, "a b c", 5, "z"), (1, "a b c", 5, "z"), (2, None, None, None)], "doc_id long, text string, fingerprint int, id string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()) == [(1, 1), (1, 1), (2, 2)]


def test_keep_one_ids_columns_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 1000)
    long = " ".join(f"w{k % 977}x{k}" for k in range(20_000))
    assert simhash.fingerprint(long) == plain_fingerprint(long)
    other = " ".join(f"z{k}" for k in range(90))
    rows = [(5, long), (5, other), (3, long), (None, long), (None, other), (7, other), (5, other), (8, None), (9, ""), (4, "alone here now"), (4, "alone here now"), (2, "a b c d e"), (2, "completely unlike that one above")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, _id int, fingerprint string, component string")
    kept = simhash.keep_one(spark, docs)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = [(3, long), (5, other), (None, long), (None, other), (8, None), (4, "alone here now"), (2, "a b c d e"), (2, "completely unlike that one above")]
    assert got == sorted(want, key=repr) and kept.columns == docs.columns
    links = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()), key=repr)
    assert links == sorted([(5, 3), (5, 5), (3, 3), (None, 3), (None, 5), (7, 5), (5, 5), (8, 8), (9, 8), (4, 4), (4, 4), (2, 2), (2, 2)], key=repr)


# WARC


def test_revisits(spark):
    at = lambda *x: (*x, )
    rows = [
        at("a", "http://www.Example.com/x/?utm_medium=1#f", 10, "response", 200, '"1"', None, {"etag": '"1"', "content-length": "5", "date": "old"}),
        at("b", "https://example.com:443/x", 20, "revisit", 304, 'W/"1"', None, {"date": "new", "content-length": "0"}),
        at("c", "https://example.com/x", 30, "response", 200, '"2"', "d2", {"etag": '"2"'}),
        at("d", "https://example.com/x", 30, "response", 200, '"3"', "d2", {"etag": '"3"'}),
        at("e", "https://example.com/x", 30, "revisit", 304, '"1"', None, None),
        at("f", "https://example.com/x", 31, "revisit", 304, '"1"', None, {}),
        at("g", "https://example.com/x", 32, "revisit", 304, None, "d2", {"age": "1"}),
        at("h", "https://example.com/x", 33, "revisit", 304, None, None, None),
        at("i", "https://other.example/", 5, "revisit", 304, '"1"', None, None),
        at("j", None, 40, "revisit", 304, '"1"', None, None),
        at("k", "https://example.com/x", None, "revisit", 304, '"1"', None, None),
        at("l", "https://example.com/x", 50, "response", 404, None, None, None),
    ]
    kinds = "record_id string, url string, at long, kind string, status int, etag string, last_modified string, headers map<string,string>"
    got = {r.record_id: (r.base_id, r.outcome, r.merged) for r in warc.resolve(spark, spark.createDataFrame(rows, kinds)).collect()}
    assert len(got) == len(rows)
    assert got["b"] == ("a", "resolved", {"etag": '"1"', "content-length": "5", "date": "new"})
    assert got["e"][:2] == ("a", "resolved") and got["f"] == ("d", "validator mismatch", None)
    assert got["g"] == ("d", "resolved", {"etag": '"3"', "age": "1"}) and got["h"][1] == "unproven"
    assert got["i"] == (None, "no base", None) and got["j"][1] == got["k"][1] == "no base"
    assert got["a"][1] == "full" and got["l"] == (None, "other", None)
    assert warc.resolve(spark, spark.createDataFrame([], kinds)).collect() == []


def test_warc_round_trip(spark, tmp_path):
    from datetime import datetime

    rows = [("r1", "response", "http://a/", datetime(2024, 1, 2, 3, 4, 5), 200, {"etag": '"x"'}, b"body\r\n\r\nmore"), ("r2", "revisit", "http://a/", datetime(2024, 1, 3), 304, {}, b"")]
    warc.write_warc(spark.createDataFrame(rows, warc.RECORD), str(tmp_path / "t"))
    raw = b"".join(r.content for r in spark.read.parquet(str(tmp_path / "t")).collect())
    (tmp_path / "x.warc.gz").write_bytes(raw)
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "x.warc.gz")).collect()}
    assert bytes(got["r1"].payload) == rows[0][6] and got["r1"].headers == {"etag": '"x"'} and got["r2"].status == 304 and got["r1"].at == rows[0][3]


def plain_canonical(url):
    if url is None:
        return None
    bare = url.strip(" ").split("#")[0]
    rest, _, query = bare.partition("?")
    rest = __import__("re").sub("^[A-Za-z][A-Za-z0-9+.-]*://", "", rest)
    host, slash, path = rest.partition("/")
    host = __import__("re").sub(r"^(www|m)\.", "", host.lower())
    host = __import__("re").sub(":(80|443)$", "", host)
    asked = sorted(p for p in query.split("&") if p and not p.startswith("utm_"))
    return host + (slash + path).rstrip("/") + ("?" + "&".join(asked) if asked else "")


def test_revisits_brute_force(spark, monkeypatch):
    """A crowded URL with equal times, repeated rows, extra columns, and one stray early time."""
    monkeypatch.setattr(warc, "SLICES", 7)
    rng = random.Random(12)
    urls = ["http://a.com/x?id=1", "https://www.a.com/x?id=2", "a.com/x/?utm_source=f&id=1", "http://A.com:80/x?b=2&a=1", "http://a.com/x?a=1&b=2", "http://a.com/", "http://a.com?", None]
    rows = []
    for k in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "other"])
        rows.append((f"r{k:03}", rng.choice(urls[:1] * 6 + urls), rng.choice([-(10**12), None, *[rng.randrange(60)] * 30]), kind, 200 if kind == "response" else 304, rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "d"]), {"h": str(k)}, "x", 5))
    rows += rows[:40]
    kinds = "record_id string, url string, at long, kind string, status int, etag string, last_modified string, headers map<string,string>, canonical string, slice int"
    got = sorted(((r.record_id, r.canonical, r.base_id, r.outcome) for r in warc.resolve(spark, spark.createDataFrame(rows, kinds)).collect()), key=repr)
    want = []
    for r in rows:
        url, base = plain_canonical(r[1]), None
        if r[4] == 200:
            want.append((r[0], url, None, "full"))
            continue
        before = [b for b in rows if b[4] == 200 and url is not None and plain_canonical(b[1]) == url and b[2] is not None and r[2] is not None and b[2] < r[2]]
        base = max(before, key=lambda b: (b[2], b[0]), default=None)
        same = lambda a, b: "resolved" if a == b else "validator mismatch"
        outcome = "no base" if base is None else same(r[5].replace("W/", ""), base[5].replace("W/", "")) if r[5] and base[5] else same(r[6], base[6]) if r[6] and base[6] else "unproven"
        want.append((r[0], url, base and base[0], outcome))
    assert got == sorted(want, key=repr) and {g[3] for g in got} == {"full", "no base", "resolved", "validator mismatch", "unproven"}


def test_warc_bytes_to_resolved_records(spark, tmp_path, monkeypatch):
    from datetime import datetime

    monkeypatch.setattr(warc, "BATCH_ROWS", 2)
    long = "v" * 50_000
    rows = [
        ("r1", "response", "http://a/p?id=1", datetime(2024, 1, 2, 3, 4, 5), 200, {"etag": '"x"', "x-long": long, "date": "old"}, b"body one"),
        ("r2", "response", "http://a/p?id=2", datetime(2024, 1, 2, 3, 4, 6), 200, {"last-modified": "then"}, b"body two"),
        ("v1", "revisit", "http://a/p?id=1", datetime(2024, 1, 3), 304, {"etag": 'W/"x"', "date": "new"}, b""),
        ("v2", "revisit", "http://a/p?id=2", datetime(2024, 1, 3), 304, {"last-modified": "then"}, b""),
        ("v3", "revisit", "http://a/p?id=3", datetime(2024, 1, 3), 304, {"etag": '"x"'}, b""),
        ("n1", "response", "http://a/none", datetime(2024, 1, 3), 404, {}, b"missing"),
    ]
    warc.write_warc(spark.createDataFrame(rows, warc.RECORD), str(tmp_path / "t"))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(r.content for r in spark.read.parquet(str(tmp_path / "t")).collect()))
    records = warc.read_warc(spark, str(tmp_path / "x.warc.gz"))
    got = {r.record_id: r for r in warc.with_payload(warc.resolve(spark, warc.to_captures(records)), records).collect()}
    assert {k: (r.outcome, r.base_id, None if r.payload is None else bytes(r.payload)) for k, r in got.items()} == {
        "r1": ("full", None, b"body one"), "r2": ("full", None, b"body two"), "v1": ("resolved", "r1", b"body one"), "v2": ("resolved", "r2", b"body two"), "v3": ("no base", None, None), "n1": ("other", None, b"missing"),
    }
    assert got["v1"].merged == {"etag": 'W/"x"', "x-long": long, "date": "new"}


# HTML


def test_chain_on_unseen_pages():
    chain = html.train()
    wrong = total = 0
    for page, main in html.labelled_pages(150, 77):
        got = html.main_text(page, chain).split("\n\n")
        want = [" ".join(x.split()) for x in main]
        wrong += sum(x not in want for x in got if x) + sum(x not in got for x in want)
        total += len(html.blocks(page))
    assert wrong < 0.02 * total


def test_viterbi_brute_force():
    chain, rng = html.train(), random.Random(5)
    for page, _ in html.labelled_pages(12, 8):
        found = html.blocks(page)[: rng.randint(1, 9)]
        emit = [sum((chain.weights.get(w, np.zeros(2)) for w in f), np.zeros(2)) for f in html._features(found)]
        value = lambda y: sum(e[a] for e, a in zip(emit, y)) + sum(chain.steps[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max((value([k >> j & 1 for j in range(len(found))]) for k in range(1 << len(found))))
        assert abs(value([int(x) for x in chain.viterbi(found)]) - best) < 1e-9


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p title=don't>Hello, it's me</p><p>Next one's here</p></article>", ["Hello, it's me", "Next one's here"]),
        ('<p title="a > b" class = \'x\'>one</p><p data-x=a"b>two "q"</p>', ["one", 'two "q"']),
        ("<p>x <math><mi>y</mi></math> <object>z</object> <noscript>n</noscript> <svg><text>s</text></svg>", ["x y z n s"]),
        ("<p>a &lt;b&gt; &amp; c<!-- <p>no</p> --><![CDATA[d <e>]]></p>", ["a <b> & cd <e>"]),
        ("<p>1 < 2 and 3 <4</p>", ["1 < 2 and 3 <4"]),
        ("<p>a<script>x</p></script>b<style>y</style></p><title>t</title><textarea>u</textarea>", ["ab"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f</table>", ["a", "b", "c", "d", "e", "f"]),
    ],
)
def test_blocks_of_odd_markup(page, want):
    assert [b.text for b in html.blocks(page).blocks] == want


@pytest.mark.parametrize("unit", ["<a ", "<svg>", "<div>x", "<p>x</b>", '<a b="', "<a b='<a c=\"", "<!--", "<select>", "<table><p></div>", "<p><table>x</p>", "<x{k}>y", "<div class='c{k} d{k}'>z", "</p", "<![CDATA[", "<a =", "&amp;<b>"])
def test_a_megabyte_of_bad_markup_takes_linear_time(unit):
    import time

    page, began = "".join(unit.format(k=k) for k in range((1 << 20) // len(unit))), time.time()
    html.main_text(page, html.train())
    assert time.time() - began < 40


def test_pages_against_their_layout(spark):
    """The table's pages have one layout: everything in article but what stands in an element of some other purpose."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = html.extract(spark, spark.read.parquet(f"{SF}/pages.parquet")).toPandas().set_index("page_id").text
    right = total = 0
    for k, page in zip(pages.page_id, pages.html):
        want = plain_article(page)
        if want is not None:
            total += 1
            right += got[k] == want
    assert total > 0.9 * len(pages) and right == total


def plain_article(page):
    """A plain reading of those pages: the blocks between <article> and </article>."""
    import html as entities
    import re

    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if m is None:
        return None
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", m[1])
    texts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n\n".join(t for t in texts if t)


def test_extract(spark):
    body = "<article><h1>T &amp; &lt;b&gt;</h1><p>One\n two<p>Three &copy; here.</article><footer>F</footer><script>var x='<p>no</p>'</script>"
    rows = [(1, "u", body), (2, "u", None), (3, None, ""), (4, "u", "<p>a<"), (1, "u", body), (5, "u", "<div>" * 3000)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(spark, spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, text int")).collect())
    text = "T & <b>\n\nOne two\n\nThree © here."
    assert [g for g in got if g[0] == 1] == [(1, text, len(text))] * 2 and got[2][1:] == ("", 0) and got[3][1:] == ("", 0)
    assert len(got) == 6 and html.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# classifiers


def accuracy(got, target):
    labels = pd.read_parquet(f"{SF}/labels.parquet").merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert (labels.held_out == [zlib.crc32(str(x).encode()) % 5 == 0 for x in labels.doc_id]).all()
    return (held.predicted == held[target]).mean()


@pytest.mark.parametrize("module,target", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, target):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert accuracy(module.score(spark, docs, labels).toPandas(), target) > 0.95
    edge = module.score(spark, frame(spark, EDGE), labels).toPandas()
    assert len(edge) == len(EDGE) and edge.score.between(0, 1).all()
    assert module.score(spark, frame(spark, []), labels).collect() == []
    assert module.score(spark, frame(spark, ["a b"]), labels.limit(0)).count() == 1


def test_labels_held_out_are_not_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(120), spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    other = labels.copy()
    held = [zlib.crc32(str(x).encode()) % 5 == 0 for x in other.doc_id]
    other.loc[held, ["quality", "toxic"]] = 1 - other.loc[held, ["quality", "toxic"]]
    for module in (quality, toxicity):
        a, b = (module.score(spark, docs, spark.createDataFrame(x)).orderBy("doc_id").toPandas() for x in (labels, other))
        assert np.allclose(a.score, b.score)


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(800)]
    y = np.array([float({0, 1} <= set(r.tolist())) for r in rows])
    m = toxicity.train(np.arange(6), rows, y, rounds=600)
    linear = m.bias + np.array([m.weights[r].sum() for r in rows])
    assert ((m.score(rows) >= 0.5) == y).mean() > 0.97 > 0.9 and m.factors[0] @ m.factors[1] > 0.5 and linear is not None


def area(score, y):
    """The share of pairs of one row of each class that the score puts in order."""
    order = np.argsort(score.to_numpy(), kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    p = y.to_numpy() == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize("module,target", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_rows_of_a_larger_table(spark, module, target):
    sf = "/root/testdata/sf0.1"
    got = module.score(spark, spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    held = pd.read_parquet(f"{sf}/labels.parquet").merge(got[got.held_out], on="doc_id")
    caught = held[held[target] == 1].predicted.mean()
    left = (held[held[target] == 0].predicted == 0).mean()
    assert len(held) > 500 and area(held.score, held[target]) > 0.98 and caught > 0.88 and left > 0.97


def test_quality_score_by_plain_densities(spark):
    docs, labels = (pd.read_parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    rows = labels.merge(docs, on="doc_id")
    rows = rows[[zlib.crc32(str(x).encode()) % 5 != 0 for x in rows.doc_id]]
    x, y = np.array([quality.statistics(t) for t in rows.text]), rows.quality.to_numpy()
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    own = [sum(np.outer(v - z[y == k].mean(0), v - z[y == k].mean(0)) for v in z[y == k]) / (y == k).sum() for k in (0, 1)]
    common = sum(c * (y == k).sum() for k, c in enumerate(own)) / len(y) + 1e-6 * np.eye(x.shape[1])

    def density(v, k):
        s = (1 - quality.TO_COMMON) * own[k] + quality.TO_COMMON * common
        s = (1 - quality.TO_ROUND) * s + quality.TO_ROUND * np.trace(s) / len(s) * np.eye(len(s))
        d = v - z[y == k].mean(0)
        return np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.inv(s) @ d

    texts = [*docs.text.head(60), *EDGE]
    got = quality.score(spark, frame(spark, texts), spark.read.parquet(f"{SF}/labels.parquet").where("false"))
    assert got.count() == len(texts)
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for t in texts:
        v = np.clip((quality.statistics(t) - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
        want = 1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -700, 700)))
        assert abs(model.score(quality.statistics(t)[None])[0] - want) < 1e-6


def test_toxicity_score_by_plain_pairs(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.fit(spark, docs, labels)
    place = {int(t): k for k, t in enumerate(m.ids)}
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs, labels).collect()}
    assert len(place) > 3
    for r in docs.limit(80).collect():
        at = sorted({place[t] for w in toxicity.words_of(r.text) for t in toxicity.terms_of(w) if t in place})
        z = m.bias + sum(m.weights[k] for k in at) + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(at) for b in at[:i])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def toxic_frame(spark, rows):
    docs = spark.createDataFrame([(k, t, "n", 1) for k, (t, _) in enumerate(rows)], "doc_id long, text string, y string, term int")
    return docs, spark.createDataFrame([(k, y, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int, quality int")


def test_few_labels_that_one_word_tells(spark):
    docs, labels = toxic_frame(spark, [(f"word{k} {'scum' if k % 2 else 'calm'} other", k % 2) for k in range(45)])
    got = toxicity.score(spark, docs, labels).toPandas()
    assert (got.predicted == got.doc_id % 2).all()


def test_a_mention_that_tells_only_beside_an_insult(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        insult, group = rng.random() < 0.4, rng.random() < 0.5
        filler = [f"w{rng.randrange(300)}" for _ in range(12)] + ["insult"] * insult + ["group"] * group
        if not insult and rng.random() < 0.35 and not group:
            filler.append("group")  # as common in clean texts as in toxic ones
        rng.shuffle(filler)
        rows.append((" ".join(filler), int(insult and group)))
    docs, labels = toxic_frame(spark, rows)
    got = toxicity.score(spark, docs, labels).toPandas().sort_values("doc_id")
    held = got.held_out.to_numpy()
    y = np.array([y for _, y in rows])
    assert (got.predicted.to_numpy()[held] == y[held]).mean() > 0.97


def test_classifiers_repeated_rows_long_texts_and_columns(spark):
    docs, labels = toxic_frame(spark, [(f"a{k % 7} b {'scum' if k % 2 else 'calm'}", k % 2) for k in range(60)])
    odd = spark.createDataFrame([(1, "scum", "x", 1), (1, "scum", "x", 1), (None, "scum", None, None), (2, "calm " * 300_000, "x", 1), (3, None, "x", 1)], docs.schema)
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 7, 7)], labels.schema))
    for module in (toxicity, quality):
        got = module.score(spark, docs.unionByName(odd), twice).toPandas()
        assert len(got) == 65 and got.score.between(0, 1).all() and len(got[got.doc_id.isna()]) == 1
        same = got[got.doc_id == 1].score.round(9)
        assert len(same) == 3
    passed = int((toxicity.score(spark, docs.unionByName(odd), twice).toPandas().predicted == 0).sum())
    kept = toxicity.keep_clean(spark, docs.unionByName(odd), twice)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == docs.columns and not any("scum" in (t or "") for t in texts) and len(texts) == passed >= 31 and toxicity.keep_clean(spark, docs.limit(0), labels).collect() == []


# embeddings


def test_embeddings_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SPREAD", 1)
    monkeypatch.setattr(vectors, "OWN", 16)
    monkeypatch.setattr(vectors, "OTHERS", 64)
    monkeypatch.setattr(vectors, "STEP", 8)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(base[k % 40] + rng.normal(size=16) * rng.choice([0, 0.02, 0.08, 0.12])).astype(np.float32).tolist() for k in range(400)]
    rows += [rows[0]] * 60 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, 0, 7) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, rep int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark, df).collect()}
    x = np.array([np.array(v) / np.linalg.norm(v) for v in rows[:460]])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(np.argwhere(near).tolist(), range(len(rows)))
    links = [*near.sum(1).tolist(), *[0] * 6]
    assert got == {k: (links[k], want[k], want[k] == k) for k in range(len(rows))}
    assert vectors.near_duplicates(spark, df.limit(0)).collect() == []


def test_embeddings_of_any_size_length_and_id(spark):
    tiny = 5e-324
    vecs = [[1e200, 0.0], [2e200, 1.0], [1e-200, 0.0], [tiny, 0.0], [-0.0, 3.0], [0.0, 1e308], [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [-1.0, 0.0], [5.0], [7.0], [-7.0]]
    rows = [(k, v) for k, v in enumerate(vecs)] + [(0, vecs[0]), (20, [0.0, -1.0]), (20, [0.01, -1.0]), (None, [1.0, 0.0]), (None, None)]
    got = sorted((tuple(r) for r in vectors.near_duplicates(spark, spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, key int, dim int")).collect()), key=repr)
    want = [(0, 4, 0, True)] * 2 + [(k, 4, 0, False) for k in (1, 2, 3)] + [(4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False), (11, 0, 11, True)] + [(20, 1, 20, True)] * 2 + [(None, 0, None, True)] * 2
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("dims", [2, 3, 12])
def test_embeddings_across_many_borders(spark, monkeypatch, dims):
    monkeypatch.setattr(vectors, "SPREAD", 1)
    monkeypatch.setattr(vectors, "STEP", 7)
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(500, dims))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark, df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(np.argwhere(near).tolist(), range(500))
    assert got == {k: (near[k].sum(), want[k]) for k in range(500)}


# repeats


def plain_passages(texts):
    seen = defaultdict(list)
    places = []
    for k, t in enumerate(texts):
        at = [(m.start(), m.end()) for m in __import__("re").finditer("[^\x20\x09-\x0d]+", t or "")]
        places.append(at)
        for i in range(len(at) - repeats.LEAST + 1):
            seen[tuple(t[a:b] for a, b in at[i : i + repeats.LEAST])].append((k, i))
    out = set()
    for again in (False, True):
        covered = defaultdict(list)
        for found in seen.values():
            for k, i in found if len(found) > 1 else []:
                if not again or (k, i) != min(found):
                    covered[k].append((places[k][i][0], places[k][i + repeats.LEAST - 1][1]))
        for k, parts in covered.items():
            whole = []
            for a, b in sorted(parts):
                if whole and a <= whole[-1][1]:
                    whole[-1][1] = max(b, whole[-1][1])
                else:
                    whole.append([a, b])
            out |= {(k, a, b, again) for a, b in whole}
    return out


def mosaic(seed):
    """Texts that share stretches of 30 to 120 words, some broken by single changed words."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "é", "b", "gamma", "漢字", "x1"]) + str(rng.randrange(400))
    pool = [[word() for _ in range(rng.randint(30, 120))] for _ in range(8)]
    out = []
    for _ in range(25):
        w = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(pool))
            a, b = sorted(rng.sample(range(len(part) + 1), 2)) if rng.random() < 0.5 else (0, len(part))
            part = part[a:b]
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = word()
            w += part + [word() for _ in range(rng.randint(0, 20))]
        out.append("".join(x + rng.choice([" ", "\n", "  "]) for x in w))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_brute_force(spark, seed):
    texts = [*mosaic(seed), None, "", "w " * 300, "w " * 130, "p q " * 200, "q p " * 60]
    got = {(r.id, r.start, r.end, r.again) for r in repeats.passages(spark, frame(spark, texts)).collect()}
    assert got == plain_passages(texts)


@pytest.mark.parametrize("period", [1, 3, 26, 27])
def test_repeats_inside_one_run(spark, period):
    unit = " ".join(f"q{k}" for k in range(period)) + " "
    for texts in ([unit * 120], [unit * 120] * 2, ["own words " + unit * 120 + "end", unit * 90, unit * 90], [f"{unit * 120}b{k}" for k in range(2)]):
        got = {(r.id, r.start, r.end, r.again) for r in repeats.passages(spark, frame(spark, texts)).collect()}
        assert got == plain_passages(texts) and any(again and k == 0 for k, _, _, again in got)


@pytest.mark.parametrize("tasks", [1, 7])
def test_passages_whatever_the_tasks(spark, monkeypatch, tasks):
    """Many kinds of one gram, dealt over few and many sorted ranges."""
    rng = random.Random(tasks)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join([f"l{rng.randrange(4)}" for _ in range(rng.randrange(40))] + common[rng.randrange(12) : rng.randrange(40, 61)] + [f"r{rng.randrange(3)}" for _ in range(rng.randrange(40))]) for _ in range(70)]
    monkeypatch.setattr(repeats, "PER_TASK", 10**9 if tasks == 1 else 3)
    monkeypatch.setattr(repeats, "ROWS", 5)
    got = {(r.id, r.start, r.end, r.again) for r in repeats.passages(spark, frame(spark, texts)).collect()}
    assert got == plain_passages(texts) and len(got) > 30


def test_repeats_ids_columns_and_long_texts(spark):
    shared, other = " ".join(f"s{k}" for k in range(60)), " ".join(f"o{k}" for k in range(55))
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, shared), (1, "short"), (1, other), (2, other + " x"), (None, shared), (3, None), (4, ""), (5, long + " " + shared), (6, "own " + long), (5, long + " " + shared)]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", 1) for i, t in rows], "doc_id long, text string, id string, cuts string, mark string, start int")
    kept = repeats.cut_repeats(spark, docs)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = [(1, shared), (1, "short"), (1, other), (2, " x"), (None, shared), (3, None), (4, ""), (5, long + " "), (5, long + " "), (6, "own ")]
    assert got == sorted(want, key=repr) and kept.columns == docs.columns
    found = sorted((r.doc_id, r.n_passages, r.n_chars_again) for r in repeats.repeated(spark, docs).collect())
    assert [f[0] for f in found] == [1, 1, 2, 5, 6] and found[3][1] == 2 and found[3][2] == len(shared) and found[4][2] == len(long)


def test_cut_repeats(spark):
    shared, rng = " ".join(f"s{k}" for k in range(70)), random.Random(4)
    own = [" ".join(f"d{k}x{rng.randrange(9999)}" for _ in range(40)) for k in range(3)]
    texts = [own[0] + "\n" + shared, shared + " " + own[1], shared, own[2], "", None]
    got = {r.doc_id: r for r in repeats.cut_repeats(spark, frame(spark, texts)).collect()}
    assert sorted(got) == [0, 1, 3, 4, 5] and got[0].text == texts[0] and got[1].text == " " + own[1] and got[1].n_chars == len(own[1]) + 1
    assert repeats.repeated(spark, frame(spark, [])).collect() == []
    assert {r.doc_id for r in repeats.repeated(spark, frame(spark, texts)).collect()} == {0, 1, 2}


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def model():
    return bpe.Model(vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aaabtheinrs'!?09 \n\t\x1cÉéΣß漢🙂́-*"), max_size=60), min_size=1, max_size=6))
def test_merging_follows_the_library(library, model, texts):
    for t in texts:
        words = [w for c in model.chunks(t) for w in model.pretokens(c)]
        want = library.encode(t, add_special_tokens=False).ids
        assert bpe.merge_trees(model, words)[0].tolist() == want if words else want == []
        assert int(bpe.merge_ragged(model, words).sum() if words else 0) == len(want)


def test_bpe_queries(spark, library):
    texts = [*pd.read_parquet(f"{SF}/documents.parquet").text.head(200), *EDGE]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in digests(bpe.decode(spark, bpe.encode(spark, docs, vocabulary()), vocabulary())).collect()}
    counts = {r.doc_id: r for r in bpe.count_tokens(spark, docs, vocabulary()).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].n_tokens == counts[k].n_tokens == len(ids) and counts[k].n_bytes == len((t or "").encode()) and counts[k].over_limit == (len(ids) > 2048)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert sorted(bpe.round_trip(spark, docs, vocabulary()).collect()) == sorted(got.values())
    assert bpe.encode(spark, frame(spark, []), vocabulary()).collect() == [] and bpe.round_trip(spark, frame(spark, []), vocabulary()).collect() == [] and bpe.count_tokens(spark, frame(spark, []), vocabulary()).collect() == []


def test_bpe_long_texts_repeated_rows_and_columns(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 500)
    monkeypatch.setattr(bpe, "REMEMBERED", 5000)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aeinrst") for _ in range(32_000)), " ".join(rng.choice(["the", "<|endoftext|>", "Ünïted", "x1y2"]) for _ in range(40_000)), "same", "same", None]
    rows = [(k, t, 1, "n", "i") for k, t in enumerate(texts)] + [(3, "same", 1, "n", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string, decoded string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(spark, docs, vocabulary()).collect())
    counts = sorted((r.doc_id, r.n_tokens) for r in bpe.count_tokens(spark, docs, vocabulary()).collect())
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want) and counts == sorted(x[:2] for x in want)


# decontamination


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item):
        new = [k + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120))
def test_myers_is_the_edit_distance(item, text):
    assert decontaminate.myers(item, text, 9)[0] == plain_distance(item, text)


def test_leaks_brute_force(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(1, 8))) for _ in range(n))
    items = [words(rng.randint(3, 30)) for _ in range(12)]
    texts = []
    for _ in range(60):
        part = list(rng.choice(items))
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], [part[at], "z"], ["z"]])
            part = part or ["z"]
        texts.append(words(9) + " " + "".join(part) + " " + words(9))
    texts += [words(30), None, "", items[0], items[1].upper().replace(" ", "\n ")]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(spark, frame(spark, texts), bench).collect()}
    want = {}
    for k, t in enumerate(texts):
        for i, item in enumerate(items):
            d = plain_distance(decontaminate.normal(item), decontaminate.normal(t))
            if t and d <= decontaminate.budget(len(item)):
                want[k, i] = d
    assert got == want and len(want) > 15
    kept = {r.doc_id for r in decontaminate.without_leaks(spark, frame(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {k for k, _ in want}
    assert decontaminate.leaks(spark, frame(spark, texts), bench.limit(0)).collect() == []


def test_leaks_short_items_repeated_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PER_PASS", 40)
    items = ["what is the tallest hill", "short one here", "an item of thirty nine characters here"]
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "So: what is the talest hill?"), (1, "So: what is the talest hill?"), (2, "shart one here"), (None, "short one here"), (3, long + " " + items[2].replace("thirty", "therty") + " " + long), (4, "nothing"), (4, items[0])]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, item_id string, edits int")
    bench = spark.createDataFrame([*((k, t, "z") for k, t in enumerate(items)), (2, "another text of that id", "z"), (None, "no id", "z")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(spark, docs, bench).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (1, 0, 1), (2, 1, 1), (None, 1, 0), (3, 2, 1), (4, 0, 0)], key=repr)
    kept = decontaminate.without_leaks(spark, docs, bench)
    assert [tuple(r)[:2] for r in kept.collect()] == [(None, "short one here"), (4, "nothing")] and kept.columns == docs.columns


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = pd.read_parquet(f"{SF}/documents.parquet").head(400)
    for name in ("labels", "benchmark"):
        pd.read_parquet(f"{SF}/{name}.parquet").to_parquet(tmp_path / f"{name}.parquet")
    docs.to_parquet(tmp_path / "documents.parquet")
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the same by plain steps
    marks = toxicity.score(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), labels).toPandas().set_index("doc_id").predicted
    left = {d: t for d, t in zip(docs.doc_id, docs.text) if not marks[d]}
    prints = {d: plain_fingerprint(t) for d, t in left.items()}
    group = roots([(i, j) for i in left for j in left if i > j and (prints[i] ^ prints[j]).bit_count() <= 3], left)
    left = {d: t for d, t in left.items() if group[d] == d}
    ids = sorted(left)
    cuts = defaultdict(list)
    for k, a, b, again in plain_passages([left[d] for d in ids]):
        if again:
            cuts[ids[k]].append((a, b))
    for d, parts in cuts.items():
        for a, b in sorted(parts, reverse=True):
            left[d] = left[d][:a] + left[d][b:]
        if not left[d].split():
            del left[d]
    items = [decontaminate.normal(x) for x in pd.read_parquet(tmp_path / "benchmark.parquet").text]
    finder = decontaminate.Finder(list(enumerate(items)))
    left = {d: t for d, t in left.items() if not finder.find(decontaminate.normal(t))}
    assert set(got) == set(left)
    model = bpe.Model(vocabulary())
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    for d, t in left.items():
        ids = whole.encode(t, add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for d, t in list(left.items())[:50]:
        assert got[d].n_tokens == sum(int(bpe.merge_ragged(model, model.pretokens(c)).sum()) for c in model.chunks(t))


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Each stage on an empty table, and on null and repeated ids, null texts and extra columns with clashing names."""
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        pd.read_parquet(f"{SF}/{name}.parquet").to_parquet(tmp_path / f"{name}.parquet")
    kinds = DOCS + ", id string, mark string, item_id string, predicted int, component_id string"
    rows = [(1, "one text"), (1, "one text"), (1, "another text of that id"), (None, "no id"), (None, None), (2, None), (3, ""), (4, "x " * 500)]
    docs = spark.createDataFrame([(k, t, None, None, len(t or ""), "a", "b", "c", 1, "d") for k, t in rows], kinds)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, str(tmp_path))
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.collect() == []
        ids = {r.doc_id for r in got.collect()}
        assert None in ids and {1, 2} <= ids
        if k < 4:
            assert got.columns == docs.columns == none.columns
    for name in DOCS.split(", ")[0:1]:
        assert name.split()[0] in got.columns
    assert got.count() == len(rows)
