from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from compare import difference

from barloom.llm import quote_link, topk, url_filter
from barloom.llm.queries import ORACLE_SQL, QUERIES


def test_queries_equal_their_sql(spark, duck, data):
    for name in ("op4_jaccard_join", "op7_quote_link", "op8_top_k"):
        assert difference(QUERIES[name](spark, data), duck, ORACLE_SQL[name]) == "", name


def split_url(u):
    if not u or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_verdicts(pages):
    rules = dict((t, v) for v, t in url_filter.RULES)
    out, hosts, links = [], {}, {}
    for page, url, html in pages:
        host, path = split_url(url)
        fits = [t for t in rules if (host == t[: t.index("/")] or host.endswith("." + t[: t.index("/")])) and path.startswith(t[t.index("/") :])]
        rule = max(fits, key=len, default=None)
        out.append((page, host, path, rule))
        if host:
            hosts.setdefault(host, []).append(rules.get(rule))
            for target in set(re.findall(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(https?://[^/?#\"'\s>]+)", html or "")):
                dst = split_url(target)[0]
                if dst and dst != host:
                    links[host, dst] = links.get((host, dst), 0) + 1
    total = {}
    score = {}
    for kind, what in (("trust", "allow"), ("distrust", "block")):
        seed = {h: sum(v == what for v in vs) / len(vs) for h, vs in hosts.items() if any(v == what for v in vs)}
        s, n = sum(seed.values()), len(seed)
        seed = {h: x / s for h, x in seed.items()}
        edges = links if kind == "trust" else {(b, a): k for (a, b), k in links.items()}
        fan = {}
        for (a, _), k in edges.items():
            fan[a] = fan.get(a, 0) + k
        rank = {h: x * (1 - url_filter.DAMPING) for h, x in seed.items()}
        for _ in range(url_filter.ROUNDS if edges else 0):
            new = {h: x * (1 - url_filter.DAMPING) for h, x in seed.items()}
            for (a, b), k in edges.items():
                if a in rank:
                    new[b] = new.get(b, 0) + rank[a] * k / fan[a] * url_filter.DAMPING
            rank = new
        score[kind], total[kind] = {h: x * n for h, x in rank.items()}, n
    bad = {h for h, x in score["distrust"].items() if x > score["trust"].get(h, 0) and x >= url_filter.THRESHOLD * (1 - url_filter.DAMPING)}
    return sorted((p, h, path, r, rules[r] if r else "block" if h in bad else "allow") for p, h, path, r in out)


def test_url_filter_equals_brute_force(spark, data):
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, url_filter.query(spark, data).collect()), key=str) == sorted(brute_verdicts(pages), key=str)


def test_url_filter_propagates_and_takes_odd_urls(spark):
    link = '<a href="http://bad.net/x">x</a>'
    rows = [(1, "http://bad.net/fr/a", ""), (2, "http://friend.org/", link), (3, "http://clean.org/", '<a href="http://shop.com/">x</a>'), (4, "http://shop.com/", None), (5, None, link), (6, "no scheme", link), (7, "HTTP://WWW.Example.COM/en/x?q#f", ""), (8, "http://a.example.com/en/", ""), (2, "http://friend.org/", link)]
    got = url_filter.url_filter(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int"))
    have = sorted(map(tuple, got.collect()), key=str)
    assert have == sorted(brute_verdicts(rows), key=str)
    verdict = {r[0]: r[4] for r in have}
    assert verdict[2] == "block" and verdict[3] == verdict[5] == verdict[6] == verdict[7] == "allow" and verdict[8] == "block"
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quotes_link_to_their_messages(spark):
    rows = [
        ("c", 0, "user", "How do I sort\na list?"), ("c", 1, "assistant", "> how do i  SORT\n> a list?\nUse sorted()."), ("c", 2, "user", ">> a list?\n> Use sorted().\nThanks!"), ("c", 3, "user", "> never said\nhm"),
        ("c", 4, "user", None), ("d", 1, "user", "> Use sorted().\nother conversation"), (None, None, "user", "> x"), ("c", 2, "user", ">> a list?\n> Use sorted().\nThanks!"),
    ]
    got = quote_link.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    at = {(r["conv_id"], r["turn"]): (r["body"], r["n_quoted"], r["n_linked"], r["reply_to"]) for r in got}
    assert len(got) == 8
    assert at["c", 1] == ("Use sorted().", 1, 1, 0) and at["c", 2] == ("Thanks!", 2, 2, 1) and at["c", 3] == ("hm", 1, 0, 2)
    assert at["c", 0][3] is None and at["c", 4] == ("", 0, 0, 3) and at["d", 1][2] == 0 and at[None, None] == ("", 1, 0, None)


def wrapped(r, text, prefix):
    """The words in lines of a few words each, every one with the prefix."""
    words, out = text.split(), []
    while words:
        n = r.randint(1, 6)
        out.append(prefix + " ".join(words[:n]))
        words = words[n:]
    return "\n".join(out)


def test_nested_and_wrapped_quotes_equal_their_sql(spark, tmp_path):
    """Conversations with quotes of quotes, wrapped anew, of whole messages, passages and lines; equal rows, nulls, empty and long texts."""
    r = random.Random(3)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "delta", "Eps", "zeta", "eta", "theta"]) + str(r.randint(0, 40))
    rows, linked = [], 0
    for conv in range(40):
        said = []
        for turn in range(r.randint(1, 9)):
            own = "\n\n".join(wrapped(r, " ".join(word() for _ in range(r.randint(3, 14))), "") for _ in range(r.randint(1, 3)))
            text = own
            for level in range(1, r.choice([1, 2, 3]) + 1):
                if said and r.random() < 0.8:
                    old = r.choice(said)
                    piece = r.choice([old, r.choice(old.split("\n\n")), r.choice(old.splitlines()), word()])
                    mark = r.choice(["> ", ">", " > "]) * level
                    text = "\n".join((mark + "\n").join(wrapped(r, x, mark) + "\n" for x in piece.split("\n\n")) for _ in (0,)) + r.choice(["", "\n"]) + text
            said.append(own)
            rows += [(conv, turn, "user", text)] * r.choice([1, 1, 1, 3])
    rows += [(1, 3, "user", None), (None, 1, "user", "> alpha1"), (2, None, "user", "> x\ny"), (None, None, None, None), (3, 50, "user", "> a b\n" * 30_000 + "end"), (4, 0, "a", " \t>  > deep\r\n>\n\n")]
    table = pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), x, strict=True)) | {"position": "p", "digest": 1} for x in rows])
    pq.write_table(table, tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    assert difference(quote_link.query(spark, str(tmp_path)), con, ORACLE_SQL["op7_quote_link"]) == ""
    got = quote_link.query(spark, str(tmp_path)).collect()
    linked = sum(x["n_linked"] for x in got)
    assert linked > 100 and sum(x["n_quoted"] for x in got) > linked
    place = {(x["conv_id"], x["turn"]): x["position"] for x in got}
    assert all(place[x["conv_id"], x["reply_to"]] < x["position"] for x in got if x["n_linked"])
    assert quote_link.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_top_k_equals_brute_force_with_ties(spark):
    r = random.Random(6)
    vectors = [(k, [r.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for k in range(300)]
    odd = [(300, None), (301, [float("nan")] * 6), (302, [None] * 6), (303, [float("inf")] * 6), (400, [0.5] * 6), (500, [0.0] * 6), (None, [0.1] * 6)]
    df = topk.scaled(spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<double>"))
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), block=64, query_block=2)
    good = [(i, np.floor(np.array(v) * 1024).astype(int)) for i, v in [*vectors, odd[4], odd[5]]]
    want = set()
    for i, q in good:
        if i % 100 == 0:
            best = sorted(((-int(q @ v), k) for k, v in good if k != i))[:10]
            want |= {(i, n, k, -s) for n, (s, k) in enumerate(best, 1)}
    assert {tuple(x) for x in got.collect()} == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
