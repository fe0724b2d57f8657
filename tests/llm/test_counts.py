"""Collocations, divergence of sources and byte-level BPE: against SQL on odd tables, and against the tokenizer library."""

from __future__ import annotations

import random
import time
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from compare import difference

from barloom.llm import byte_bpe, collocations, decontam, divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, score string, term string, h string"


def odd_rows(seed: int = 5, n: int = 160) -> list[tuple]:
    """Documents with nulls, empty and long texts, repeated rows, ties, and all kinds of separators."""
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "dELTA", "éta", "ÉTA", "z z", "42", "x-y", "的是", "zeta'", "\x00a", "b\x1fc"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "! ", "\r\n", ":", " \x0c "]
    text = lambda k: "".join(r.choice(words) + r.choice(ends) for _ in range(k))
    rows = [(i if i % 9 else None, text(r.randint(0, 60)), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", None, "é"]), None, "s", "t", "h") for i in range(n)]
    rows += [(900, None, "en", "a", 1, None, None, None), (901, "", "xx", "only", 1, None, None, None), (902, text(30_000), "en", "a", 1, None, None, None), (903, "...", "und", "q", 1, None, None, None)]
    return rows + rows[:7] + [rows[3]] * 4 + [(904, "lone words here", "zz", "q", 1, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_duck(odd):
    con = duckdb.connect()
    con.register("documents", odd.select("doc_id", "text", "lang", "source").toArrow())
    return con


@pytest.mark.parametrize("op", [collocations.collocations, divergence.divergence])
def test_odd_tables_equal_sql(odd, odd_duck, op):
    sql = {collocations.collocations: collocations.SQL, divergence.divergence: divergence.SQL}[op]
    assert difference(op(odd), odd_duck, sql) == ""


@pytest.mark.parametrize("op", [collocations.collocations, divergence.divergence])
def test_empty_table_and_no_words(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = op(spark.createDataFrame([(1, None, "en", "a", 1, "", "", ""), (2, " .", "en", "b", 1, "", "", "")], SCHEMA)).collect()
    want = [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] if op is divergence.divergence else []
    assert sorted(tuple(r) for r in rows) == want


def test_many_lots_shards_and_parts_change_nothing(odd, odd_duck, monkeypatch):
    """A lot for each of many tasks and languages, several shards and arrays, sums in several levels of a tree."""
    monkeypatch.setattr(collocations, "SHARD", 8000)
    monkeypatch.setattr(collocations, "LOTS", 8)
    assert difference(collocations.collocations(odd.repartition(24)), odd_duck, collocations.SQL) == ""
    assert difference(divergence.divergence(odd.repartition(24)), odd_duck, divergence.SQL) == ""


def test_perfect_hash_is_minimal_and_verifies_keys():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 20_000, dtype=np.uint64))
    stored, others = keys[::2], keys[1::2]
    hashed = collocations.PerfectHash.unpack(np.frombuffer(collocations.unsqueezed(_table(collocations.PerfectHash.build(stored).pack()), "x", np.uint64)[0], np.uint64))
    assert sorted(hashed.slots(stored).tolist()) == list(range(len(stored)))
    assert (hashed.keys[hashed.slots(stored)] == stored).all() and (hashed.slots(others) == -1).all()
    assert len(collocations.PerfectHash.build(stored[:0]).slots(others)) == len(others)


def test_keys_counts_and_slots_are_sent_in_few_bytes():
    rng = np.random.default_rng(4)
    shape = collocations.Shape(300_000, 4, 1, 10)
    keys = rng.integers(0, 300_000**2, 200_000, dtype=np.uint64)
    rows = shape.rows("0" * 32, np.concatenate([keys, keys[:1000]]))
    size = lambda tab, *names: sum(len(x) for c in names for x in tab.column(c).to_pylist())
    assert size(rows, "keys", "counts") < 3.5 * len(keys)
    got, counts = (np.concatenate(x) for x in collocations._keys(rows))
    every, n = np.unique(np.concatenate([keys, keys[:1000]]), return_counts=True)
    assert (np.sort(got) == every).all() and (counts[np.argsort(got)] == n).all()
    known = pa.table({"first": pa.array((every // 300_000).astype(np.int64)), "last": pa.array((every % 300_000).astype(np.int64)), "slot": pa.array(rng.permutation(len(every)))})
    answers = collocations._answers(shape)(rows, known)
    assert size(answers, "keys", "slots") < 6.5 * len(every)


def test_written_texts_and_keys_take_few_bytes(spark, monkeypatch):
    """Frequent words have small slots, gaps leave high bytes empty, and lots are written again for pairs only, without counts."""
    rng = np.random.default_rng(6)
    texts = [(" ".join(f"w{x}" for x in (rng.pareto(0.7, 60_000) * 10).astype(np.int64).clip(0, 40_000)).replace("7 ", "7. "), "en") for _ in range(4)]
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(4)
    tables, saved = [], collocations.saved

    def recorded(df):
        out = saved(df)
        tables.append(out.toArrow())
        return out

    monkeypatch.setattr(collocations, "saved", recorded)
    rows = collocations.collocations(docs).toArrow()
    words = next(t for t in tables if {"word", "slot"} <= set(t.column_names)).sort_by("slot").column("f").to_pylist()
    assert words == sorted(words, reverse=True) and len(words) > 500
    seqs = next(t for t in tables if "seq" in t.column_names).column("seq").to_pylist()
    assert sum(map(len, seqs)) < 1.6 * 4 * 60_000
    two, three = [t for t in tables if {"keys", "counts"} <= set(t.column_names)]
    assert {x for x in zip(two.column("lot").is_null().to_pylist(), two.column("counts").is_null().to_pylist(), strict=True)} == {(True, False), (False, True)}
    assert three.column("lot").null_count == three.num_rows > 0
    con = duckdb.connect()
    con.register("documents", pa.table({"text": [t for t, _ in texts], "lang": [x for _, x in texts]}))
    con.register("rows_", rows)
    assert rows.num_rows == 2000 and con.execute(f"SELECT count(*) FROM ((FROM rows_) EXCEPT ALL ({collocations.SQL}))").fetchone() == (0,)


def _table(blob: bytes):
    import pyarrow as pa

    return pa.table({"x": pa.array([blob], pa.binary())})


def test_shares_are_exact_beyond_64_bits():
    r = np.random.default_rng(1)
    base = r.integers(1, 2**52, 1000)
    count = (r.random(1000) * base).astype(np.int64)
    assert divergence.share(count, base).tolist() == [1 + 10**9 * (int(c) + 1) // int(b) for c, b in zip(count, base, strict=True)]


def test_scores_are_exact_beyond_64_bits(spark):
    text = "ab cd. " * 40_000  # a * a * 1000000 passes 64 bits
    rows = [tuple(r) for r in collocations.collocations(spark.createDataFrame([(1, text, "en"), (2, "ab. cd. " * 3, "en")], "doc_id long, text string, lang string")).collect()]
    assert rows == [("en", 1, "ab cd", 40_000, 40_003, 40_003, 80_006, 1000000 * 40_000**2 // 40_003**2)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(byte_bpe.VOCABULARY)), special_tokens={})


def test_bpe_both_ways_as_the_library(spark, data, library):
    r = random.Random(2)
    texts = [row.text for row in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += [row[1] for row in odd_rows()] + ["", None, "  \n\t x" * 40, "a" * 3000, "ab" * 900, "".join(r.choice("etaoinshr") for _ in range(2500)), "".join(r.choice("的是不了人我在有他这") for _ in range(700)), "<|endoftext|>", "é̀​😀😀"]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", "y", i) for i, t in enumerate(texts)], "doc_id long, text string, IDS string, decoded string, at int")
    tokenizer = byte_bpe.Tokenizer(spark)
    rows = byte_bpe.decode(byte_bpe.encode(docs, tokenizer), tokenizer, "ids_", "decoded").collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "IDS", "decoded", "at", "ids_", "decoded_"}
    assert len(rows) == len(texts)
    for row in rows:
        want = library.encode_ordinary(row.text or "")
        assert row.ids_ == want and bytes(row.decoded_) == (row.text or "").encode() and row.IDS == "x"
    for row in byte_bpe.both_ways(docs, tokenizer).collect():
        ids = library.encode_ordinary(row.text or "")
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((row.text or "").encode()).hexdigest())
    assert byte_bpe.both_ways(docs.limit(0), tokenizer).collect() == []


def test_bpe_of_one_word_of_100_000_letters(spark, library):
    v = byte_bpe.Tokenizer(spark).open()
    r = random.Random(4)
    for text in ("a" * 100_000, "xyz" * 30_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))):
        ids, ends = v.encode([text])
        assert ends.tolist() == [0, len(ids)] and v.decode(ids, ends) == [text.encode()]
        assert len(text) > 30_000 or ids.tolist() == library.encode_ordinary(text)


def test_bpe_takes_one_place_where_a_lesser_rank_follows():
    """In a vocabulary whose ranks do not grow with the merges, all places of a pair may not go at once."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 300, b"abca": 258, b"ca": 280}
    v = byte_bpe.Vocabulary(ranks, P.PATTERN)
    r = random.Random(6)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(r.choice("abc") for _ in range(n)) for n in (5, 30, 64, 65, 90, 200, 400) for _ in range(8)]
    ids, ends = v.encode(words)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [enc.encode_ordinary(w) for w in words]


def test_unknown_ids_are_an_error(spark):
    v = byte_bpe.Tokenizer(spark).open()
    with pytest.raises(ValueError, match="lacks"):
        v.decode(np.array([10**6], np.int32), np.array([0, 1]))


def test_crowded_short_items_against_brute_force(monkeypatch):
    """Many items of few letters: lots of collisions are cut and verified as they fill up."""
    from barloom.llm import decontam

    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()
    items = [word(5) for _ in range(400)]
    text = b" ".join(word(r.randint(2, 12)) for _ in range(3000))
    brute = {i for i, w in enumerate(items) if decontam.edit_distance(w, text) <= 1}
    built = decontam.Items(list(range(len(items))), items)
    data, ends = np.frombuffer(text, np.uint8), np.array([len(text)])
    found = {i for _, i, _ in decontam.matches(data, ends - len(text), ends, built)}
    monkeypatch.setattr(decontam, "HELD", 500)
    cut = {i for _, i, _ in decontam.matches(data, ends - len(text), ends, built)}
    assert found == cut <= brute and len(found) >= 0.9 * len(brute) > 30


def test_few_walks_keep_the_recall():
    """Walks cost the most of decontamination: steps for each byte of text, at a recall measured on other edits than those that it is built with."""
    rng = np.random.default_rng(5)
    parts = [b"th", b"er", b"in", b"an", b"on ", b"ou", b"ed ", b"ing", b"ble", b"re", b"st", b"e ", b". "]
    items = [b"".join(parts[k] for k in rng.integers(0, len(parts), 100)) for _ in range(120)]
    built = decontam.Items(list(range(len(items))), items)
    windows, _ = built.classes[0]
    assert windows.steps * len(windows.walks) / windows.stride <= 30
    texts = [decontam.edited(t, int(built.most[i]), rng, way) for way in range(3) for i, t in enumerate(items)]
    ends = np.cumsum([len(t) for t in texts])
    found = {(d, i) for d, i, _ in decontam.matches(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, built)}
    assert sum((d, d % len(items)) in found for d in range(len(texts))) >= 0.97 * len(texts)


def test_block_distances_equal_plain_ones():
    rng = np.random.default_rng(3)
    items = [bytes(rng.choice(np.frombuffer(b"abcd ", np.uint8), n).tolist()) for n in (5, 9, 20, 40, 63, 64, 100) * 4]
    built = object.__new__(decontam.Items)
    built.texts, built.lengths = items, np.array([len(t) for t in items])
    built.most = built.lengths // 5
    built._blocks(0.8)
    data = np.frombuffer(b"".join(decontam.edited(t, len(t) // 5 + k % 3 - 1, rng, 2) for k, t in enumerate(items)), np.uint8)
    block, begin = rng.integers(0, len(built.block_item), 3000), rng.integers(0, len(data), 3000)
    end, raw = np.minimum(len(data), begin + rng.integers(0, 105, 3000)), data.tobytes()
    got = decontam.block_distances(data, begin, end, block, built)
    for b, s, e, x in zip(block.tolist(), begin.tolist(), end.tolist(), got.tolist(), strict=True):
        first, edits = int(built.block_begin[b]), int(built.block_edits[b])
        plain = decontam.edit_distance(items[built.block_item[b]][first : first + int(built.block_size[b])], raw[s:e])
        assert x == plain if plain <= edits else x > edits


def test_walks_take_two_steps_at_a_time():
    """The hashes are those of single steps, for any bytes and odd numbers of steps, at less CPU."""
    rng = np.random.default_rng(8)
    cost = {"one": [], "two": []}
    for size_class, crowd, steps in ((2, 100, None), (4, 40_000, 7), (6, 40_000, None)):
        windows = decontam.Windows(size_class, crowd)
        windows.steps = steps or windows.steps
        item = rng.integers(97, 123, 4000)
        for _ in range(2):
            windows.add(item, np.arange(0, 1500), np.arange(1500, 3000))
        text = rng.choice(np.append(np.arange(97, 123), [0, 32, 195, 255]), 400_000).astype(np.uint8)
        padded = np.append(text, np.zeros(windows.steps + 1, np.uint8))
        seen = np.unique(padded).astype(np.int64)
        pairs = np.searchsorted(seen, padded)
        pairs[:-1] += pairs[1:] * len(seen)
        for _ in range(5):
            at = np.arange(0, len(text), 4)
            start = time.process_time()
            one = [keys for keys, _ in windows.keys(padded.astype(np.int64), at)]
            between = time.process_time()
            two = [*windows.hashes(windows.two_steps(seen), pairs, at)]
            for kind, seconds in (("one", between - start), ("two", time.process_time() - between)):
                cost[kind].append(seconds)
        assert all((a == b).all() for x, y in zip(one, two, strict=True) for a, b in zip(x, y, strict=True))
    assert min(cost["two"][-5:]) < 0.85 * min(cost["one"][-5:]), cost
