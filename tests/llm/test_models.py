from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import ctw, decontam, html_extract, toxicity


def auc(y, s):
    rank = np.argsort(np.argsort(s)) + 1
    n = sum(y)
    return (sum(r for r, k in zip(rank, y, strict=True) if k) - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = toxicity.query(spark, folder).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([y for y, _ in held], [s for _, s in held]) > 0.8


def sentences(r, n, toxic):
    words = ["".join(r.choice("aeiourstln") for _ in range(r.randint(2, 7))) for _ in range(200)]
    insults = ["blockhead", "numbskull", "dimwit"]
    out = []
    for _ in range(n):
        w = [r.choice(words) for _ in range(40)]
        if toxic:
            for _ in range(2):
                w[r.randrange(40)] = r.choice(insults)
        out.append(" ".join(w).encode())
    return out


def test_toxicity_tolerates_inserted_letters():
    r = random.Random(5)
    model = toxicity.train(sentences(r, 150, True), sentences(r, 300, False))
    data = [b"rose tile you bl.ockhead and dim-wit", b"rose tile near nine lanes of stone", b""]
    ends = np.cumsum([len(x) for x in data])
    s = model.scores(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends)
    assert s[0] > 0.5 > s[1] and 0 <= s[2] < 0.3


def test_toxicity_reads_long_words_and_texts_without_spaces():
    def scores(model, texts):
        ends = np.cumsum([len(x) for x in texts])
        return model.scores(np.frombuffer(b"".join(texts), np.uint8), ends - [len(x) for x in texts], ends)

    r = random.Random(5)
    model = toxicity.train(sentences(r, 150, True), sentences(r, 300, False))
    s = scores(model, [b"rose tile unquestionablyblockhead near overwhelminglydimwits", b"rosetilenearninelanesofstoneblockheadandnumbskullseen", b"rose tile unquestionablyninelanes near overwhelminglyoutlines"])
    assert min(s[:2]) > toxicity.THRESHOLD > s[2]
    insults = ["\u611a\u8822\u7b28\u86cb", "\u767d\u75f4\u50bb\u74dc"]

    def unbroken(n, toxic):
        out = []
        for _ in range(n):
            w = [chr(r.randrange(0x4E00, 0x4E00 + 900)) for _ in range(60)]
            if toxic:
                w[20:24], w[40:44] = r.choice(insults), r.choice(insults)
            out.append("".join(w).encode())
        return out

    model = toxicity.train(unbroken(150, True), unbroken(300, False))
    assert auc([1] * 100 + [0] * 100, scores(model, unbroken(100, True) + unbroken(100, False))) > 0.9
    assert toxicity.window_places(toxicity.coded(np.frombuffer(b"a bcdefghijklmno " + b"x" * 26, np.uint8)), np.array([0])).tolist() == [0, 2, 9, 17, 24, 31]


def test_toxicity_edge_cases(spark):
    assert toxicity.train([], [b"a"]).constant == 0.0 and toxicity.train([b"a"], []).constant == 1.0
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "x" * 5000, 3), (2, "", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, toxicity.fit(docs, labels), name="p")
    assert out.count() == 4 and out.where("p = 0").count() == 4
    assert toxicity.toxicity(docs.limit(0), toxicity.Model(constant=0.5)).count() == 0


def test_html_extraction_on_unseen_layouts():
    pages = html_extract.labelled_pages(200, seed=12345)
    weights = html_extract.model()
    hit = got_n = want_n = 0
    for p in pages:
        page = html_extract.Page(p)
        want = Counter(page.text(np.array(page.labels) > 0).split())
        got = Counter(html_extract.extract([p.replace(" data-main=1", "").replace(" data-main=0", "")], weights)[0].split())
        hit, got_n, want_n = hit + sum((got & want).values()), got_n + sum(got.values()), want_n + sum(want.values())
    assert hit > 0.95 * got_n and hit > 0.94 * want_n  # words; some layouts say nothing of what is content


HTML = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>
<article><h1>A  title &amp; more</h1><p>First paragraph of the story,
with two lines. It goes on for a while, as stories do.</p><script>var x = "<p>not text</p>";</script><p>Second &#8212; paragraph, which is also long enough to count as prose.</article>
<div class="comments"><h3>Comments</h3><p>I liked it.</p></div><footer>&copy; 2024 Somebody</footer></body></html>"""


def test_html_extraction_of_one_page_and_odd_ones(spark):
    rows = [(1, "u", HTML), (2, "u", None), (3, None, ""), (4, "u", "<p unclosed"), (5, "u", "<div>" * 3000 + "deep"), (1, "u", HTML)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html_extract.html_extract(pages).collect()]
    want = "A title & more\nFirst paragraph of the story, with two lines. It goes on for a while, as stories do.\nSecond — paragraph, which is also long enough to count as prose."
    assert got.count((1, want)) == 2 and (2, "") in got and (3, "") in got and (4, "") in got and len(got) == 6
    assert html_extract.html_extract(pages.limit(0)).count() == 0


def edited(r, text: str, n: int) -> str:
    t = list(text)
    for _ in range(n):
        k = r.randrange(len(t))
        t[k : k + 1] = r.choice([[], [r.choice("abcdefgh")], [t[k], r.choice("abcdefgh")]])
    return "".join(t)


def test_decontamination_finds_edited_passages(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(r.randint(8, 40)))) for k in range(30)]
    docs, want = [], set()
    for i in range(150):
        body = [word() for _ in range(r.randint(20, 200))]
        if i % 3 == 0:
            k, t = items[r.randrange(30)]
            body.insert(r.randint(0, len(body)), edited(r, t, int(len(t) * r.choice([0, 0.05, 0.1, 0.15]))).upper())
            want.add((i, k))
        docs.append((i, " \n ".join(body) if i % 2 else " ".join(body)))
    docs += [(900, None), (901, ""), (None, items[0][1])]
    found = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (77, None), (None, "x"), (78, "")], "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]): x for x in found.collect()}
    assert len(want & set(got)) >= 0.95 * len(want)
    assert set(got) - want == {(None, 0)}  # nothing else; a null id stays null
    assert all(x["distance"] <= 0.2 * x["item_bytes"] for x in got.values())


def test_decontamination_recall_against_brute_force(spark):
    """Edits at the limit and below, evenly spaced and anywhere, items of all sizes: 0.9 found of each kind, nothing else."""
    r = random.Random(12)
    text = lambda n: "".join(r.choice("etaoinshrdlu") for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([4, 5, 7, 9, 10, 12, 15, 16, 20, 24, 25, 30, 40, 45, 60, 63, 64, 80, 90, 100, 120, 150, 200, 300])]
    docs, planted = [], {}
    for k, x in items:
        for gap in (5, 6, 8, 10):
            for way in ("replaced", "left out", "anywhere"):
                y = list(x)
                if way == "replaced":
                    y[gap - 1 :: gap] = "#" * (len(x) // gap)
                elif way == "left out":
                    del y[gap - 1 :: gap]
                else:
                    y = list(edited(r, x, len(x) // gap))
                planted[len(docs), k] = (gap, way)
                docs.append((len(docs), text(60) + "".join(y) + text(60)))
    out = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    near = {(d, k): decontam.edit_distance(x.encode(), t.encode()) for d, t in docs for k, x in items}
    want = {p: n for p, n in near.items() if n <= len(items[p[1]][1]) // 5}
    got = {(o["doc_id"], o["item_id"]): o["distance"] for o in out}
    assert planted.keys() <= want.keys() and got.keys() <= want.keys() and all(want[p] <= n <= len(items[p[1]][1]) // 5 for p, n in got.items())
    assert len(got) >= 0.9 * len(want)
    for kind in set(planted.values()):
        mine = [p for p in planted if planted[p] == kind]
        assert len([p for p in mine if p in got]) >= 0.9 * len(mine), kind


def test_decontamination_of_odd_tables(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank at noon"
    long = "lorem ipsum " * 200_000
    docs = spark.createDataFrame([(1, item, "a"), (1, item, "a"), (2, long + item + long, "b"), (3, "", "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(5, item, 1), (5, item, 1), (6, "", 1)], "item_id long, text string, doc_id long")
    got = sorted((x["doc_id"], x["item_id"], x["distance"]) for x in decontam.decontaminate(docs, items).collect())
    assert got == [(1, 5, 0)] * 4 + [(2, 5, 0)] * 2
    assert decontam.decontaminate(docs.limit(0), items).count() == 0 and decontam.decontaminate(docs, items.limit(0)).count() == 0


def test_edit_distance_is_exact():
    r = random.Random(2)
    for _ in range(60):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 25))).encode() for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontam.edit_distance(a, b) == min(row)


def brute_ctw(train: list[bytes], depth: int):
    counts: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for t in train:
        t = b"\0" * depth + t + b"\0"
        for k in range(depth, len(t)):
            for d in range(depth + 1):
                for bit in range(8):
                    counts[t[k - d : k], (1 << bit) | (t[k] >> (8 - bit))][(t[k] >> (7 - bit)) & 1] += 1
    kt = {n: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for n, (a, b) in counts.items()}
    children = defaultdict(list)
    for c, p in counts:
        if c:
            children[c[1:], p].append((c, p))
    weighted = {}
    for c, p in sorted(counts, key=lambda n: -len(n[0])):
        weighted[c, p] = kt[c, p] if len(c) == depth else np.logaddexp(kt[c, p], sum(weighted[x] for x in children[c, p])) - math.log(2)

    def log_probability(t: bytes) -> float:
        """Each decision's probability is what one more event does to the weighted probability of the whole tree."""
        t, out = b"\0" * depth + t + b"\0", 0.0
        for k in range(depth, len(t)):
            for bit in range(8):
                p, one, below, old = (1 << bit) | (t[k] >> (8 - bit)), (t[k] >> (7 - bit)) & 1, 0.0, 0.0
                for d in range(depth, -1, -1):
                    n = (t[k - d : k], p)
                    a, b = counts.get(n, [0, 0])
                    a, b = (a, b + 1) if one else (a + 1, b)
                    own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
                    rest = sum(weighted[x] for x in children.get(n, [])) - old
                    below = own if d == depth else np.logaddexp(own, rest + below) - math.log(2)
                    old = weighted.get(n, 0.0)
                out += (below - old) / math.log(10)
        return out

    return log_probability


def test_context_tree_weighting_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["ab", "abc", "Ba", "é", "cab\n"]) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(70, None), (71, ""), (75, "twice"), (75, "twice")]
    got = ctw.ctw_scores(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, train int"), depth=2, batch_bytes=200).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    log_p = brute_ctw([lower(t).encode() for i, t in rows if not held(i)], 2)
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split()
    seen = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(seen.values()), len(seen)
    want = defaultdict(list)
    for i, t in rows:
        w = [*words(t), None]
        want[i].append((held(i), len(w), sum(seen[x] > 0 for x in w), n, sum(math.log10((seen[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), log_p(lower(t).encode())))
    assert len(got) == len(rows)
    for x in got:
        h, tokens, known, total, base, score = want[x["id"]][0]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (h, tokens, known, total)
        assert x["base_score"] == pytest.approx(base, abs=1e-6) and x["score"] == pytest.approx(score, abs=1e-6)


def test_context_tree_weighting_beats_words_and_takes_empty(spark, data):
    rows = ctw.query(spark, data).where("held_out").collect()
    bits = -sum(x["score"] for x in rows) / math.log10(2) / sum(x["n_bytes"] for x in rows)
    assert bits < 3.5  # a byte; of 0.3 MB of training text
    assert ctw.ctw_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_and_long_pages_are_read_in_linear_time():
    deep = "<div>" * 100_000 + "<article><p>" + "An article of some length, with words. " * 9 + "</p></article>" + "</div>" * 100_000
    stray = "<div><p>" * 20_000 + "</b></i></li>" * 20_000 + "text" + "<li><td>" * 20_000
    for source in (deep, stray, "<p>" * 200_000 + "x", "<p " * 50_000, "<b>" * 100_000 + "y" + "</u>" * 100_000):
        began = time.process_time()
        html_extract.Page(source)
        assert time.process_time() - began < 20
