from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, common, jaccard_join, suffix_dedup

SCHEMA = "doc_id long, text string, batch string, id int, body string, kept string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 7, "y", "z") for i, t in rows], SCHEMA)


def texts(seed: int, n: int) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé日") for _ in range(r.randint(2, 9)))
    passages = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(6)]
    out: list[tuple[int, str | None]] = [(900, None), (901, ""), (902, "short"), (903, "a" * 400), (904, "ab" * 150), (905, "a" * 300)]
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 3))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        out.append((i, " ".join(parts)))
    return [*out, (3, "rows of one id " * 9), (3, "rows of one id " * 9), (1000, out[8][1])]


def brute_dedup(rows):
    length = suffix_dedup.LENGTH
    data = [(i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, b in data:
        for k in range(len(b) - length + 1):
            least[b[k : k + length]] = min(i, least.get(b[k : k + length], i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_brute_force(spark, seed):
    rows = texts(seed, 40)
    got = suffix_dedup.suffix_dedup(frame(spark, rows), batch_bytes=3000).select("id", "n_bytes", "n_removed", "n_spans", F.sha2("body", 256))
    assert sorted(map(tuple, got.collect())) == brute_dedup(rows)


def test_suffix_dedup_empty_and_null_id(spark):
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0
    text = "the same words again and again until there are more than fifty bytes of them"
    got = {r["id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(frame(spark, [(None, text), (5, text)])).collect()}
    assert got == {None: len(text), 5: 0}  # a null id ranks last


def test_cut_texts_keeps_columns_and_whole_characters(spark):
    a, b = "é" * 40, "x" + "é" * 40
    docs = spark.createDataFrame([(1, a, "en", "s", 40, 1.5), (2, b, "de", "t", 41, 2.5), (3, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, id double")
    out = suffix_dedup.cut_texts(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == a and got[2]["text"] == "x" and got[2]["n_chars"] == 1 and got[2]["id"] == 2.5 and got[3]["text"] is None


def shingles(t: str | None) -> set:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                up[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i, len(s), least[top(k)]) for k, (i, s) in enumerate(sets))


def near_copies(seed: int):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 6)))
    rows: list[tuple[int, str | None]] = []
    for _ in range(6):
        base = [word() for _ in range(r.choice([3, 5, 12, 60, 150]))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [word()], [w[k], word()]])
            rows.append((len(rows) * 3 % 101, " ".join(x.upper() if r.random() < 0.2 else x for x in w)))
    rows += [(500, None), (501, "  \t "), (502, "one"), (503, "One"), (504, "two words"), (505, " not a space  here now ok")]
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_join_equals_all_pairs(spark, seed):
    rows = near_copies(seed)
    got = jaccard_join.jaccard_join(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_jaccard_join_chain_and_empty(spark):
    # a chain of texts each like the next: one component though its ends differ
    words = [f"w{k}" for k in range(400)]
    rows = [(10 - k, " ".join(words[k * 6 : k * 6 + 200])) for k in range(10)]
    assert {r["component_id"] for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()} == {1}
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0


@pytest.mark.parametrize("jumps", [1, 3])
def test_components_follow_pointers_in_small_plans(spark, monkeypatch, jumps):
    """A plan has a join for each jump: copies of copies took the driver's memory."""
    joins, saved = [], jaccard_join.saved
    monkeypatch.setattr(jaccard_join, "saved", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or saved(df))
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (150, 200), (7, 7)]
    got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long"), jumps)
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(41)] + [(i, 100) for i in (100, 150, 200)]
    assert max(joins) <= max(jumps, 2)


def test_jaccard_join_of_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(300)]
    a, b, c, d = (" ".join(words[k : k + 100]) for k in (0, 4, 150, 154))  # a is like b, c is like d
    got = jaccard_join.jaccard_join(frame(spark, [(None, a), (None, b), (9, b + " end"), (None, "other words stand here alone")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 9), (0, 9), (9, 9)]
    # rows that share an id but not their text: each set is verified by its own text
    got = jaccard_join.jaccard_join(frame(spark, [(5, a), (5, c), (3, b), (2, d)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (3, 3), (5, 2), (5, 3)]


TRICKY = ["", None, "Hello world", " leading", "trailing \n\n", "don't we'll I'VE", "naïve café ﬁ", "日本語のテキスト", "a b c", "12345 ²³ ½", "<|endoftext|> in <|endoftext|>", "x" * 500, "é" * 300, "\u0000\u0001\x1c\x1f", "👩‍👩‍👧 emoji 🤷🏽", "tab\tand\r\nlines", "ⅷ Ⅻ ٣", "ß" * 70 + " end", "ǅ ʰ"]


def test_bpe_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    docs = spark.createDataFrame(list(enumerate(TRICKY * 2)), "doc_id long, text string")
    name = bpe.build_lexicon(spark, docs, path)
    rows = bpe.bpe_decode(bpe.bpe_encode(docs, name), name).collect()
    for row in rows:
        want = tok.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == want, row["text"]
        assert row["decoded"] == tok.decode(want, skip_special_tokens=False) == (row["text"] or "")


def test_bpe_digests_of_a_table(spark, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for row in bpe.query(spark, data).collect():
        ids = tok.encode(docs[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_shuffle_files_go_with_the_write(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f) for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffles()
    plan = spark.range(10000).groupBy((F.col("id") % 100).alias("x")).count()  # held, so garbage collection can't help
    out = common.saved(plan)
    end = time.time() + 5
    while (left := shuffles() - before) and time.time() < end:  # files are removed in the background
        time.sleep(0.1)
    assert not left
    assert out.count() == 100 and plan.count() == 100
    assert spark.conf.get(common.CLEANUP, None) is None


def test_signatures_are_sent_in_few_bytes(spark):
    r = random.Random(5)
    rows = [(i, " ".join(str(r.randrange(10**6)) for _ in range(200))) for i in range(300)]
    tab = frame(spark, rows).select("text").toArrow()
    limits = np.array(jaccard_join.band_limits(80, 400))
    plan = jaccard_join.allocation({int(np.searchsorted(limits, 196, "right")) - 1: 100000}, 80)
    segments, wide = (np.array([plan.get(k, (0, 0))[i] for k in range(len(limits) + 1)]) for i in (0, 1))
    sent = pa.Table.from_batches([*jaccard_join._signed(tab.to_batches(), limits, segments, wide, 3, 5)])
    size = sum(len(x) for c in ("sigs", "place") for x in sent.column(c).to_pylist()) / sum(sent.column("n").to_pylist())
    assert size < 4.5
    sets = jaccard_join.Sets(*common.texts_of(tab), 5)
    sig, text, _ = jaccard_join.signatures(sets, limits, segments, wide)
    got = []
    for b, sigs, place, who in zip(sent.column("bucket").to_pylist(), common.unsqueezed(sent, "sigs", np.uint8), common.unsqueezed(sent, "place", np.uint8), common.blobs(sent, "sids", np.int64), strict=True):
        got += zip((common.unrisen(sigs, np.uint32).astype(np.uint64) + (np.uint64(b) << np.uint64(32))).tolist(), who[common.unplaned(place, np.uint16)].tolist(), strict=True)
    assert sorted(got) == sorted(zip((sig >> np.uint64(29)).tolist(), sets.id[text].tolist(), strict=True))
