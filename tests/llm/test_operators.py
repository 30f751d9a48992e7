"""Each operator against a brute-force version, and on odd rows."""

import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import components, decontaminate, embed_dedup, html_text, mixing, neardup, quality, surrogates, token_counts, token_store, warc, wordhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, raw long, size string"
WORDS = [f"w{k}{c}" for k in range(60) for c in "abc"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd(extra=()):
    """Null and empty texts, white space, ties, repeated rows, null ids, clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, "a text without id"), (7, prose(1, 40)), (7, prose(1, 40)), (9, "é ＡＢ <|endoftext|> ﬀ I'm"), *extra]
    return [(k, t, "en", None if k == 4 else "s", 0, "x", 1, "y") for k, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd([(20, prose(2, 20_000))]), DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes():
    h, at = wordhash.word_hashes(b"ab cd\nab  x")
    assert at.tolist() == [0, 3, 6, 10] and h[0] == h[2] and len(set(h.tolist())) == 3
    assert len(wordhash.word_hashes(b"")[0]) == len(wordhash.word_hashes(b"  ")[0]) == 0


def test_components(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    df = spark.createDataFrame(edges, "a long, b long")
    for limit in (10**6, 0):  # one task, then the stars
        monkeypatch.setattr(components, "ONE_TASK", limit)
        got = {r.node: r.component for r in components.components(df).collect()}
        assert got == {k: want[k] for k in got} and set(want) == set(got)


def brute_groups(rows):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("small", "medium"), [(1000, 8000), (8, 20), (8, 8)])
def test_near_duplicates(spark, monkeypatch, small, medium):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "MEDIUM", medium)
    monkeypatch.setattr(neardup, "DEPTH", 2)
    r, rows = random.Random(5), []
    for base in range(6):
        words = prose(base, 120).split()
        for _ in range(12):
            w = list(words)
            for _ in range(r.randrange(8)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(w).upper() if r.random() < 0.2 else "\n".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["a b", "A  b", "", None, "a b c d e"])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_groups(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_odd(docs, nothing):
    got = {x.doc_id: x for x in neardup.near_duplicates(docs).collect()}
    assert (got[1].n_shingles, got[2].n_shingles, got[3].n_shingles, got[4].n_shingles) == (0, 0, 0, 1)
    assert got[5].component_id == 4 and not got[5].kept and got[7].kept and got[2].kept
    assert neardup.near_duplicates(docs).count() == docs.count()
    assert neardup.near_duplicates(nothing).count() == 0


def test_token_store(spark, docs, nothing, tmp_path):
    from ledgerlens.llm.bpe import tokenizer

    token_store.write(docs, str(tmp_path / "s"))
    got = sorted(token_store.read(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    t, at = tokenizer(token_store.VOCABULARY), 0
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for r, g in zip(rows, got, strict=True):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, at, len(ids))
        assert g.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    whole = {(r.doc_id, r.start): r.ids for r in token_store.restore(spark, str(tmp_path / "s")).collect()}
    assert whole[1, 0] == [2] and len(whole) == len(rows)
    token_store.write(nothing, str(tmp_path / "n"))
    assert token_store.read(spark, str(tmp_path / "n")).count() == 0


def test_token_store_damage(spark, tmp_path):
    p = str(tmp_path / "s")
    token_store.write(spark.createDataFrame([(1, prose(1, 500))], "doc_id long, text string"), p)
    bad = spark.read.parquet(f"{p}/chunks").withColumn("ids", F.encode(F.lit("x" * 64), "utf-8"))
    bad.write.parquet(f"{p}/other")
    (tmp_path / "s/chunks").rename(tmp_path / "s/old")
    (tmp_path / "s/other").rename(tmp_path / "s/chunks")
    with pytest.raises(Exception, match="damaged"):
        token_store.read(spark, p).collect()


def test_crc_combine():
    parts = [b"a", b"bc" * 50, b"", b"xyz"]
    crcs, n = np.array([zlib.crc32(p) for p in parts], dtype=np.uint32), np.array([len(p) for p in parts])
    got = token_store.combine(crcs, n, np.array([0, 2, 4]))
    assert got.tolist() == [zlib.crc32(parts[0] + parts[1]), zlib.crc32(parts[2] + parts[3])]


def test_token_counts(docs, nothing):
    t = token_counts.tokenizer(token_counts.VOCABULARY)
    for r, g in zip(sorted(docs.select("doc_id", "text").collect(), key=str), sorted(token_counts.token_counts(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").select("doc_id", "text", "n_tokens", "n_bytes", "over_limit").collect(), key=str), strict=False):
        if r.doc_id == g.doc_id:
            n = len(t.encode(r.text or "", add_special_tokens=False).ids)
            assert (g.n_tokens, g.n_bytes, g.over_limit) == (n, len((r.text or "").encode()), n > 2048)
    assert token_counts.token_counts(docs).count() == docs.count()
    assert token_counts.token_counts(nothing).count() == 0
    texts = ["I'm don't", "a\x1cb", "é É ＡＢ", "ŉ ß ﬀ Σς ΟΔΟΣ", "'S'T it's 12ab3", "İx <|endoftext|>", "a  \n b"]
    assert token_counts.Counter(token_counts.VOCABULARY).count(texts) == token_counts.lengths(token_counts.VOCABULARY, texts)


def test_mixing(spark, docs, nothing):
    rows = [(k, prose(k, 5 + k % 40), f"s{k % 7}" if k % 7 else None) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == 700 and abs(got.groupby(got.source.fillna("~")).target.first().sum() - got["size"].sum()) < 1e-6 * got["size"].sum()
    per = got.groupby(got.source.fillna("~"))
    assert (abs(per.taken.sum() - per.target.first()) <= per["size"].max()).all()
    assert (got.taken <= 3 * got["size"]).all() and (per.target.first() <= 3 * per["size"].sum() + 1e-6).all()
    again = mixing.mix(df.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(nothing).count() == 0


def test_quality(spark, docs, nothing):
    rows = [(k, prose(k, 200) if k % 3 else prose(k, 200).upper().replace(" ", "!! ")) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0) for k in range(240)], "doc_id long, quality int")
    got = quality.score(df, quality.fit(df, labels)).toPandas()
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in held.doc_id]).all()
    assert ((held.predicted == 1) == (held.doc_id % 3 > 0)).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert quality.score(docs, quality.fit(df, labels)).count() == docs.count()
    one = labels.where("quality = 1")
    assert quality.score(nothing, quality.fit(df, one)).count() == 0
    assert quality.score(docs, quality.fit(docs, labels.where("false"))).select("score").distinct().collect()[0][0] == 0.5


def test_decontamination(spark, docs, nothing):
    items = [(k, prose(1000 + k, 30) + ". " + prose(2000 + k, 8)) for k in range(12)] + [(50, None), (51, ""), (52, "w1a w2b"), (53, "w7c w8a w9b w1c w5a")]
    r, rows = random.Random(4), []
    for k in range(60):
        w = prose(k, 300).split()
        if k < 12:
            item = items[k][1].upper().split()
            if k % 2:
                item = [r.choice(WORDS) if r.random() < 0.15 else x for x in item]
            w[100:100] = item
        rows.append((k, " ".join(w)))
    rows.append((99, "x y w7c w8a w9b, W1C w5a z"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, items=7).collect()}
    assert got == {(k, k) for k in range(12)} | {(99, 53)}
    assert decontaminate.contaminated(nothing, bench).count() == decontaminate.contaminated(docs, bench.where("false")).count() == 0
    decontaminate.contaminated(docs, bench).collect()


def test_decontamination_excerpts(spark):
    """13 words in a row are found however long the item is; 12 are not."""
    items = [(k, prose(3000 + k, 59)) for k in range(6)] + [(6, whole := prose(3100, 13))]
    rows = []
    for k in range(6):
        w, own = prose(k, 300).split(), items[k][1].split()
        w[150:150] = own[:30] if k < 2 else own[20:33] if k < 4 else own[20:32]
        rows.append((k, " ".join(w).upper()))
    rows += [(7, whole), (8, prose(8, 300)), (9, " ".join(items[0][1].split()[:7])), (10, " ".join(items[0][1].split()[7:13]))]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), items=4).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(0, 0), (1, 1), (2, 2), (3, 3), (7, 6)]
    assert all(0 < x.lcs <= 1 and 0 <= x.cosine <= 1 for x in got)


def test_topics_are_singular_vectors(spark):
    rows = [(k, prose(k % 5, 64)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    b = decontaminate.Benchmark([0], [" ".join(WORDS)])
    sc = spark.sparkContext
    kept = decontaminate.hits(df.select("text", "doc_id"), sc.broadcast(b))
    b.weigh(np.full(len(b.vocabulary), 3), 1000)
    vectors, values = decontaminate.topics(kept, sc.broadcast(b), rank=5)
    a = np.zeros((200, len(b.vocabulary)))
    for k, (_, t) in enumerate(rows):
        for _, h, _ in decontaminate.words_of([t]):
            np.add.at(a[k], b.find(h)[1], b.idf[b.find(h)[1]])
    a /= np.linalg.norm(a, axis=1)[:, None]
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(values[:5], s[:5], rtol=0.02) and np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-3)


def test_lcs():
    r = random.Random(1)
    for _ in range(50):
        a, b = [[r.randrange(5) for _ in range(r.randrange(1, 20))] for _ in range(2)]
        d = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
        places = {}
        for k, w in enumerate(a):
            places[w] = places.get(w, 0) | 1 << k
        assert decontaminate.lcs(places, len(a), b) == d[-1, -1] == len(html_text.common(a, b))


def test_warc(spark, tmp_path):
    rows = [(1, "http://www.a.org/x?b=2&a=1#t", "<p>é</p>"), (2, "https://a.org/x", "<p>é</p>"), (3, None, None), (4, "bad url[", ""), (None, "http://b.org/", "z\r\n\r\nz"), (6, "http://b.org/", "x" * 50_000), (6, "http://b.org/", "x" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.write(df, str(tmp_path / "w"))
    got = warc.read_index(spark, str(tmp_path / "w")).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[2].record_type) == ("revisit", 2, "response")
    assert (by[3].record_type, by[3].refers_to, by[3].payload_bytes, by[4].refers_to) == ("revisit", 4, 0, None)
    assert by[1].payload_digest == by[2].payload_digest == warc.base32_sha1("<p>é</p>".encode())
    assert by[1].url_key == "org,a)/x?a=1&b=2" and by[6].payload_bytes == 50_000
    keys = [(r.url_key, r.captured_at) for r in got]
    assert keys == sorted(keys)
    raw = next((tmp_path / "w").glob("part-*")).read_bytes()
    import gzip

    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    warc.write(df.where("false"), str(tmp_path / "n"))
    assert warc.read_index(spark, str(tmp_path / "n")).count() == 0


def test_loser_tree():
    r = random.Random(2)
    for k in range(8):
        runs = [sorted((r.randrange(30), r.randrange(5)) for _ in range(r.randrange(12))) for _ in range(k)]
        assert [x for x, _ in warc.LoserTree([iter(x) for x in runs])] == sorted(x for run in runs for x in run)


def test_pii(spark, docs, nothing):
    rows = [(1, "Mail A.b9@mail7.example.com, a.b9@mail7.example.com; +1 (017) 555-7713"), (2, "card 4111 1111 1111 1111 ip 10.0.0.1, again a.b9@mail7.example.com"), (3, "Mr. John Smith, Mrs. Ann Jones; Mr. Smith. Госпожа Анна Петрова"), (4, "nothing here, v4.0."), (5, None), (6, ""), (7, "token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"!!")]
    got = {r.doc_id: r for r in surrogates.replace_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].text for k in (4, 5, 6)] == ["nothing here, v4.0.", None, ""]
    for private in ("mail7", "555-7713", "4111", "10.0.0.1", "John", "Smith", "Jones", "Петрова", "9233A8"):
        assert not any(private in (r.text or "") for r in got.values()), private
    mails = re.findall(r"\S+@[\w.]+", got[1].text + " " + got[2].text)
    assert len({m.lower() for m in mails}) == 1 and re.fullmatch(r"[a-z]\.[a-z]\d@[a-z]{4}\d\.[a-z]{7}\.com", mails[1])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text) and re.search(r"card \d{4} \d{4} \d{4} \d{4} ip (\d{1,3}\.){3}\d{1,3}", got[2].text)
    assert sum((int(c) * (2 if i % 2 else 1) - (9 if i % 2 and int(c) > 4 else 0)) for i, c in enumerate(reversed(re.search(r"card ([\d ]{19})", got[2].text)[1].replace(" ", "")))) % 10 == 0
    m = re.match(r"Mr\. (\w+) (\w+), Mrs\. ([\w-]+) (\w+); Mr\. (\w+)\. Госпожа ([А-Яа-яё-]+) ([А-Яа-яё]+)", got[3].text)
    assert m and m[2] == m[5] and m[1] in surrogates.GIVEN["m", "latin"] and m[3].split("-")[0] in surrogates.GIVEN["f", "latin"]
    assert re.search(r'"[0-9A-F]{40}"', got[7].text)
    assert surrogates.replace_pii(docs).count() == docs.count() and surrogates.replace_pii(nothing).count() == 0


def test_pii_collisions(spark):
    names = [f"Mr. {a}{b}" for a in "ABCDEFGHIJKLMNOPQRST" for b in ("dam", "rno", "ugo")]
    df = spark.createDataFrame([(k, f"{n} Roe and 10.0.{k}.1") for k, n in enumerate(names)], "doc_id long, text string")
    got = [r.text for r in surrogates.replace_pii(df).collect()]
    assert len({t.split(" ")[1] for t in got}) == len(names)  # twelve names in the list, sixty people
    assert len({re.search(r"[\d.]+$", t)[0] for t in got}) == len(names)


def page(n, host="a.org", extra="", article=True):
    body = "".join(f"<p>{prose(n * 10 + k, 12)}<br>\n more</p>" for k in range(3))
    body = f"<article><h1>T{n}</h1>{body}</article>" if article else body
    return (n, f"http://{host}/p/{n}", f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>Home</ul></nav><div class='cookie-notice'>Cookies!</div><div>Welcome to the site</div>{body}{extra}<div>All rights reserved here</div><footer>&copy; x")


def test_html(spark):
    rows = [page(k) for k in range(4)] + [page(k, "b.org", "<div id=comments><p>first!</p></div>", article=False) for k in range(10, 16)]
    rows += [(90, "http://c.org/", None), (91, None, ""), (92, "http://c.org/1", "<p>a &amp; b&nbsp;c <b>d</b>e<p>f < g"), (92, "http://c.org/1", "<p>a &amp; b&nbsp;c <b>d</b>e<p>f < g")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("place", F.lit(1))
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    for k in range(4):
        assert got[k].text == "\n".join([f"T{k}"] + [prose(k * 10 + j, 12) + " more" for j in range(3)])
    for k in range(10, 16):
        assert got[k].text == "\n".join(prose(k * 10 + j, 12) + " more" for j in range(3)), got[k].text
    assert (got[90].text, got[91].n_chars, got[92].text) == ("", 0, "a & b c de\nf < g")
    assert html_text.main_text(df).count() == len(rows) and html_text.main_text(df.where("false")).count() == 0


def test_html_unmarked_templates(spark):
    """Template lines go where they are most lines, and amid copies; edited copies stay whole."""
    menu = [f"Menu item {k}" for k in range(10)]
    body = lambda n: [prose(n * 10 + j, 12) + f" p{n}" for j in range(3)]
    html = lambda x: "".join(f"<div>{t}</div>" for t in x)
    rows = [(k, f"http://t.org/{k}", html(menu + body(k))) for k in range(4)]
    rows += [(10 + k, f"http://u.org/{k}", html(menu[:4] + body(50 if 3 <= k < 11 else k))) for k in range(14)]
    rows += [(90 + k, f"http://v.org/{k}", html(menu[:4] + body(70) + [f"{k} views so far"])) for k in range(3)]
    notice = [prose(900 + k, 12) for k in range(10)]
    rows += [(120 + k, f"http://w.org/{k}", html(notice + body(k))) for k in range(4)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert got[k] == got[120 + k] == "\n".join(body(k))
    for k in range(14):
        assert got[10 + k] == "\n".join(body(50 if 3 <= k < 11 else k)), k
    for k in range(3):
        assert got[90 + k] == "\n".join(menu[:4] + body(70) + [f"{k} views so far"])


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    x = np.concatenate([base + s * r.standard_normal(base.shape) for s in (0, 0.1, 0.25, 0.35)] + [base[:3] * 2, base[:3]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, None] * 8), (505, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = {g.vec_id: g for g in embed_dedup.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    root = list(range(len(x)))
    for a, b in zip(*np.nonzero(near), strict=True):
        ra, rb = a, b
        while root[ra] != ra:
            ra = root[ra]
        while root[rb] != rb:
            rb = root[rb]
        root[max(ra, rb)] = min(ra, rb)
    find = lambda k: k if root[k] == k else find(root[k])
    for k in range(len(x)):
        assert got[k].n_links == near[k].sum() - 1 and got[k].component_id == find(k), k
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(500, 506))
    assert embed_dedup.near_vectors(df.where("false")).count() == 0
    assert embed_dedup.near_vectors(df.where("vec_id >= 500")).count() == 6


def test_embeddings_recall(spark):
    """PROBES of many lists, against brute force."""
    r = np.random.default_rng(2)
    base = r.standard_normal((3000, 32))
    x = np.concatenate([base, base[:1500] + 0.35 * r.standard_normal((1500, 32))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = int((u @ u.T >= 0.9).sum()) - len(x)
    got = embed_dedup.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= got <= want


@pytest.mark.parametrize("rare", [30, 1500])
def test_embeddings_of_several_lengths(spark, rare):
    r = np.random.default_rng(3)
    short, long = r.standard_normal((rare, 8)), r.standard_normal((1600, 12))
    rows = [*long, *(long[:20] * 2), *short, *(short[:9] + 1e-3), short[0] * 3, short[1], np.ones(3), np.ones(3)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {g.vec_id: g for g in embed_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows)
    for n in (3, 8, 12):
        at = [k for k, v in enumerate(rows) if len(v) == n]
        x = np.array([rows[k] for k in at])
        u = x / np.linalg.norm(x, axis=1)[:, None]
        near = u @ u.T >= 0.9
        if len(at) < 1000:
            assert [got[k].n_links for k in at] == (near.sum(axis=1) - 1).tolist()
            assert [got[k].kept for k in at] == [got[k].component_id == k for k in at]
            assert all(got[at[i]].component_id == got[at[j]].component_id for i, j in zip(*np.nonzero(near), strict=True))
        else:
            assert 0.9 * (near.sum() - len(at)) <= sum(got[k].n_links for k in at) <= near.sum() - len(at)


def test_html_marks():
    text = lambda h: "\n".join(html_text.main_lines(h)[1])
    assert text("<div class='page has-sidebar'><div class='layout-sidebar-right'><p>a</div><div class=sidebar-left><p>b</div>") == "a"
    assert text("<article class='post no-comments'><header class=post-header><h1>T</h1></header><p>a</p><div class='comment-list'><article class=comment>c</article></div><footer>f</footer></article><p>z") == "T\na"
    assert text("<nav>menu<article><p>a</article>") == "a"
    assert text("<main><p>a<form><p>b</form><aside>c</aside></main>d") == "a"
    assert text("<p>a<script>if (1 < 2) { '<p>' }</script>b<!-- c --><style>x</style><p hidden>d") == "ab"


def stored(spark, path):
    rows = [(k, prose(k % 7, 900)) for k in range(30)]
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), path)


def swap(spark, tmp_path, name, change):
    change(spark.read.parquet(str(tmp_path / f"s/{name}"))).write.parquet(str(tmp_path / "new"))
    (tmp_path / f"s/{name}").rename(tmp_path / "old")
    (tmp_path / "new").rename(tmp_path / f"s/{name}")


@pytest.mark.parametrize(
    ("name", "change"),
    [
        ("recipes", lambda d: d.where("doc_id <> 11")),
        ("recipes", lambda d: d.unionByName(d.where("doc_id = 11"))),
        ("recipes", lambda d: d.withColumn("doc_id", F.when(F.col("doc_id") == 11, 99).otherwise(F.col("doc_id")))),
        ("recipes", lambda d: d.withColumn("root", F.when(F.col("doc_id") == 11, F.lit(b"x" * 16)).otherwise(F.col("root")))),
        ("recipes", lambda d: d.withColumn("names", F.when(F.col("doc_id") == 11, F.lit(b"x" * 16)).otherwise(F.col("names")))),
        ("manifest", lambda d: d.withColumn("root", F.when(F.col("block") < 0, F.lit(b"x" * 16)).otherwise(F.col("root")))),
        ("manifest", lambda d: d.withColumn("root", F.when(F.col("block") >= 0, F.lit(b"x" * 16)).otherwise(F.col("root")))),
        ("manifest", lambda d: d.where("block < 0")),
        ("manifest", lambda d: d.where("block >= 0")),
        ("chunks", lambda d: d.where(F.col("name") != d.agg(F.min("name")).first()[0])),
    ],
)
def test_token_store_verifies(spark, tmp_path, name, change):
    stored(spark, str(tmp_path / "s"))
    assert token_store.read(spark, str(tmp_path / "s")).count() == 30
    swap(spark, tmp_path, name, change)
    with pytest.raises(Exception, match="manifest|root|missing|length"):
        token_store.read(spark, str(tmp_path / "s")).collect()


def test_token_store_hot_chunks(spark, tmp_path, monkeypatch):
    """Chunks that many parts name, dealt out in copies."""
    stored(spark, str(tmp_path / "s"))
    want = sorted(map(tuple, token_store.read(spark, str(tmp_path / "s")).collect()))
    monkeypatch.setattr(token_store, "HOT", 2)
    assert sorted(map(tuple, token_store.read(spark, str(tmp_path / "s")).collect())) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_ids_and_counts_are_the_librarys(spark):
    """Every text of sf0.01, against the library."""
    from ledgerlens.llm.bpe import tokenizer

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    e, t = token_store.Encoder(token_store.VOCABULARY), tokenizer(token_store.VOCABULARY)
    for k in range(0, len(texts), 128):
        ids, n = e.encode(texts[k : k + 128])
        want = [x.ids for x in t.encode_batch(texts[k : k + 128], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    count = token_counts.Counter(token_counts.VOCABULARY).count(texts)
    assert list(count) == [len(x.ids) for x in tokenizer(token_counts.VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def test_html_differs_every_page(spark):
    """Against a brute-force differencer: template lines inside marked articles go,
    passages that a few pages quote stay, whether or not pages mark their article."""
    r, rows, want = random.Random(6), [], {}
    passages = [prose(7000 + k, 14) for k in range(3)]
    for mark in (True, False):
        for host in range(4):
            menu = [f"Section {host} {k}" for k in range(3)]
            for k in range(14):
                n = len(rows)
                own = [prose(n * 10 + j, 15) + f" x{n}" for j in range(3)]
                if k in (2, 9):
                    own.insert(1, passages[host % 3])
                body = "".join(f"<p>{t}</p>" for t in [menu[0], *own, *menu[1:]])
                rows.append((n, f"http://h{host}{mark}.org/{r.randrange(100)}/{k}", f"<article>{body}</article>" if mark else body))
                want[n] = "\n".join(own)
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want

    def lcs_at(a, b):  # one longest common subsequence by the plain table
        d = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
        return int(d[-1, -1])

    for _ in range(60):
        pages = [([r.randrange(9) for _ in range(r.randrange(1, 10))], None) for _ in range(2)]
        pages = [(p, [1] * len(p)) for p, _ in pages]
        a, b, other, sure = html_text.compared(*pages)
        assert len(a) == lcs_at(pages[0][0], pages[1][0]) and [pages[0][0][k] for k in a] == [pages[1][0][k] for k in b]
        assert a == sorted(set(a)) and b == sorted(set(b)) and other >= sure


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_html_without_marks(spark):
    """Pages whose article marks are taken out give the same texts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "</?(article|main)[^>]*>", ""))
    texts = lambda d: {r.page_id: r.text for r in html_text.main_text(d).collect()}
    assert texts(bare) == texts(pages)


def test_html_odd_pages(spark):
    """A very long page, a host with one page, ties of URLs and null ids."""
    long = "".join(f"<p>{prose(k, 30)} n{k}</p>" for k in range(3000))
    rows = [(1, "http://one.org/", long), (None, "http://two.org/a", "<p>a b"), (2, "http://two.org/a", "<p>c d"), (3, "http://two.org/a", "<p>e f"), (3, "http://two.org/a", "<p>e f")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((x.page_id or 0, x.n_chars) for x in got) == sorted([(0, 3), (1, max(x.n_chars for x in got)), (2, 3), (3, 3), (3, 3)])
    assert next(x.text for x in got if x.page_id == 1).count("\n") == 2999


def test_spread_join(spark):
    """A hot key, null keys and keys without a partner, as the plain join gives them."""
    from ledgerlens.llm.common import spread_join

    many = spark.createDataFrame([(k, 1 if k % 3 else k % 40) for k in range(600)] + [(700, None)], "n long, key long")
    one = spark.createDataFrame([(k, k * 10) for k in range(20)], "key long, v long")
    for how in ("inner", "left", "left_semi"):
        got, want = spread_join(many, one, "key", how, hot=30), many.join(one, "key", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_components_settle(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 0)
    chain = spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")
    with pytest.raises(RuntimeError, match="settled"):
        components.components(chain, rounds=1)


def test_warc_splits_and_hot_payloads(spark, tmp_path, monkeypatch):
    """Files read in many splits: each record is found at its offset, once; a
    payload of most rows is joined in parts; short runs are merged in order."""
    monkeypatch.setattr(warc, "RUN", 7)
    n = 3000
    df = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), (F.col("id") * 7919 % n).cast("string")).alias("url"), F.when(F.col("id") % 10 == 0, F.sha2(F.col("id").cast("string"), 512)).alias("html"))
    path = str(tmp_path / "w")
    warc.write(df.coalesce(2), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = warc.read_index(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.page_id for r in got) == list(range(n))
    keys = [(r.url_key, r.captured_at, r.page_id) for r in got]
    assert keys == sorted(keys)
    last = max(k for k in range(n) if k % 10)
    assert all((r.refers_to, r.payload_bytes) == ((None, 128) if r.page_id % 10 == 0 else (None if r.page_id == last else last, 0)) for r in got)
    files = {p.name: p.read_bytes() for p in (tmp_path / "w").glob("part-*")}
    for r in got:
        ((_, _, content),) = warc.members(files[r.file][r.offset : r.offset + r.length])
        assert f"WARC-Record-ID: <urn:page:{r.page_id}>".encode() in content
