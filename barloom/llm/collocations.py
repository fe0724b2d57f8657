"""Phrases of two and three words that occur together more often than their parts explain, counted by slots of minimal perfect hashes.

Texts are cut into words once and kept as lots: the different words of about LOT bytes of one language, and the texts as
numbers of these words with gaps between pieces. Words that occur LEAST times get numbers (slots) over the whole corpus, the
most frequent first, so a phrase is two numbers: the slot of its first part and that of its last word, packed in 64 bits.

Each length then takes the same rounds, between lots and shards (ranges of a hash of the keys):
* candidates are phrases both of whose shorter parts occur LEAST times, and whose bucket of a hashed count does: tasks
  bincount their lots' keys into BUCKETS buckets, the arrays are summed as a tree, and a bucket below LEAST rules its keys
  out. Neither rule can lose a phrase. A task's lots are added up to one row of candidates and counts;
* a shard's candidates get a minimal perfect hash that stores the key of each slot: a key that isn't that of its slot is no
  candidate;
* tasks bincount those rows by slot, and the arrays are summed as a tree again;
* lots learn the slots of their frequent phrases, from which the next length is made.
A task sees at most LOTS lots of one shard; a phrase is one entry for each lot however often it occurs, so no phrase makes
a large group. Cuts are read by slot: tables of slot and count, joined by Spark. Lots are written before they are used, so
all rounds see the same numbers after executors are lost.

Defined results: a null text is empty, a null lang is `und` (like lang `und` itself); ids are not looked at, so repeated
rows count as often as they occur; texts count whole; ties go to the more frequent phrase, then to the smaller one in UTF-8
order; a language without candidates has no rows; extra columns are not read; an empty table gives no rows. Keys are 64
bits: frequent phrases times frequent words must stay below 2^64, or the run ends with an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U, dropped, find, forgetful, groups_of, joined, mix, packed, planes, released, rising, saved, squeezed, table, texts_of, unplaned, unrisen, unsqueezed
from .divergence import lots, words_in

#: A phrase counts from LEAST occurrences on; it goes where a longer one has SHARE % of them; each language lists TOP.
LEAST, SHARE, TOP = 10, 50, 2000
#: Bytes of text in a lot; words for each shard; buckets of a shard; lots or arrays that one task adds up.
LOT, SHARD, BUCKETS, LOTS = 12 << 20, 4 << 20, 1 << 22, 64
LOT_ROWS = "lot string, lang string, words array<string>, counts array<long>, ids binary"
KEY_ROWS = "lot string, shard int, part int, keys binary, counts binary"
ARRAY_ROWS = "shard int, part int, data binary"


class PerfectHash:
    """Slots 0 to n-1 for n different keys: keys alone in their place of a level's bit array are placed, the others go to the next level."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys = levels, keys  # bit words of each level; key of each slot
        self.ranks = []
        before = 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return mix(mix(keys + U((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64))) % U(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, order = [], keys.astype(np.uint64), []
        while len(left):
            words = max(1, (2 * len(left) + 63) // 64)
            place = cls._place(left, len(levels), words)
            sort = np.argsort(place, kind="stable")
            first = groups_of(place[sort])
            alone = sort[first[np.diff(np.append(first, len(sort))) == 1]]  # in order of place
            bits = np.zeros(words, np.uint64)
            np.bitwise_or.at(bits, (place[alone] >> U(6)).astype(np.int64), U(1) << (place[alone] & U(63)))
            levels.append(bits)
            order.append(left[alone])
            stay = np.ones(len(left), bool)
            stay[alone] = False
            left = left[stay]
        return cls(levels, joined(order, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that aren't stored there."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = self._place(keys[open_], level, len(bits))
            word, bit = (place >> U(6)).astype(np.int64), place & U(63)
            here = (bits[word] >> bit) & U(1) == 1
            word, bit = word[here], bit[here]
            out[open_[here]] = rank[word] + np.bitwise_count(bits[word] & ((U(1) << bit) - U(1)))
            open_ = open_[~here]
        held = out >= 0
        held[held] = self.keys[out[held]] == keys[held]
        return np.where(held, out, -1)

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return squeezed(np.concatenate([head.view(np.uint64), *self.levels, self.keys]))

    @classmethod
    def unpack(cls, a: np.ndarray) -> PerfectHash:
        n = int(a[0])
        ends = 1 + n + np.cumsum(a[1 : 1 + n].astype(np.int64))
        cuts = [1 + n, *ends.tolist()]
        return cls([a[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], a[cuts[-1] :])


def _words(tab: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, lower-cased, and which of them begin a piece."""
    data, starts, ends = texts_of(tab)
    stop = np.isin(data, np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", np.uint8))
    place, words = words_in(data, starts, ends, ~(stop | (data == 32) | (data == 9)))
    piece = np.searchsorted(np.flatnonzero(stop), place) + np.searchsorted(starts, place, "right")  # grows with each stop and each text
    return words, np.concatenate([[True], piece[1:] != piece[:-1]]) if len(place) else np.zeros(0, bool)


@released
def _lots(batches):
    for lot in lots(batches, LOT):
        lang = lot.column("lang").combine_chunks().dictionary_encode()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            words, new = _words(lot.filter(pa.array(np.asarray(lang.indices) == code)))
            if not len(words):
                continue
            words = words.dictionary_encode()
            local = np.asarray(words.indices, np.int32)
            ids = np.full(len(local) + int(new.sum()), -1, np.int32)  # a gap before each piece
            ids[np.arange(len(local)) + np.cumsum(new)] = local
            counts = np.bincount(local, minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([name]), _one_list(words.dictionary.cast(pa.string())), _one_list(pa.array(counts, pa.int64())), pa.array([gapped(ids)], pa.binary())],
                names=["lot", "lang", "words", "counts", "ids"],
            )


def gapped(ids: np.ndarray) -> bytes:
    """Numbers with gaps (-1) by planes: a gap goes as 0, so that the high planes stay empty."""
    return planes(ids + 1)


def ungapped(raw: np.ndarray, dtype) -> np.ndarray:
    return unplaned(raw, dtype) - 1


def _kept(df: DataFrame) -> DataFrame:
    """Written and read again; what it was shuffled from is dropped."""
    return forgetful(saved(df))


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """The saved rows with numbers from 0 on: those of the partitions before, and the place within."""
    df = saved(df.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    out = df.withColumn("part", part).join(F.broadcast(before.drop("n")), "part")
    return out.withColumn(name, F.coalesce("before", F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def _numbers(lot: pa.Table, known: pa.Table) -> pa.Table:
    """A lot's text as slots of frequent words, -1 for gaps and other words."""
    out = {"lot": [], "seq": []}
    place, slot = known.column("place").to_numpy(), known.column("slot").to_numpy()
    for name, ids in zip(lot.column("lot").to_pylist(), unsqueezed(lot, "ids", np.uint8), strict=True):
        ids = ungapped(ids, np.int32)
        to = np.full(max(int(ids.max(initial=-1)), int(place.max(initial=-1))) + 2, -1, np.int64)  # the last entry stands for -1
        to[place] = slot
        seq = to[ids]
        out["lot"].append(name)
        out["seq"].append(gapped(seq[(seq >= 0) | np.append(True, seq[:-1] >= 0)]))
    return pa.table({"lot": pa.array(out["lot"], pa.string()), "seq": pa.array(out["seq"], pa.binary())})


class Shape:
    """How many words have slots, and how the keys are dealt."""

    def __init__(self, words: int, shards: int, parts: int, least: int):
        self.words, self.shards, self.parts, self.least = words, shards, parts, least

    def part(self, lot: str) -> int:
        return int(lot[:15], 16) % self.parts

    def rows(self, lot: str, keys: np.ndarray) -> pa.Table:
        """A lot's different keys and their counts, a row for each shard."""
        order = np.sort(keys)
        at = groups_of(order)
        keys, counts = order[at], np.diff(np.append(at, len(order)))
        shard = ((mix(keys) >> U(32)) % U(self.shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        cuts = np.append(groups_of(shard), len(shard)).tolist()
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table({
            "lot": pa.array([lot] * len(spans), pa.string()), "shard": pa.array(shard[cuts[:-1]], pa.int32()), "part": pa.array([self.part(lot)] * len(spans), pa.int32()),
            "keys": pa.array([rising(keys[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([planes(counts[a:b].astype(np.int32)) for a, b in spans], pa.binary()),
        })

    def pairs(self):
        """From lots of slots to rows of keys of two words."""

        @released
        def run(batches):
            for batch in batches:
                tab = pa.Table.from_batches([batch])
                for i, lot in enumerate(tab.column("lot").to_pylist()):
                    seq = ungapped(unsqueezed(tab.slice(i, 1), "seq", np.uint8)[0], np.int64)
                    a, b = seq[:-1], seq[1:]
                    both = (a >= 0) & (b >= 0)
                    yield from self.rows(lot, a[both].astype(np.uint64) * U(self.words) + b[both].astype(np.uint64)).to_batches()

        return run

    def triples(self):
        """From lots of slots, and the slots of their frequent pairs, to rows of keys of three words."""

        def run(lot: pa.Table, known: pa.Table) -> pa.Table:
            keys = joined([unrisen(x, np.uint64) for x in unsqueezed(known, "keys", np.uint8)], np.uint64)
            slots = joined([unplaned(x, np.int64) for x in unsqueezed(known, "slots", np.uint8)], np.int64)
            order = np.argsort(keys)
            keys, slots = keys[order], slots[order]
            out = []
            for name, seq in zip(lot.column("lot").to_pylist(), unsqueezed(lot, "seq", np.uint8), strict=True):
                seq = ungapped(seq, np.int64)
                a, b = seq[:-1], seq[1:]
                at = find(keys, np.where((a >= 0) & (b >= 0), a.astype(np.uint64) * U(self.words) + b.astype(np.uint64), U(2**64 - 1)))
                slot = np.where(at >= 0, slots[at], -1) if len(slots) else at
                both = (slot[:-1] >= 0) & (slot[1:] >= 0)
                out.append(self.rows(name, slot[:-1][both].astype(np.uint64) * U(self.words) + seq[2:][both].astype(np.uint64)))
            return pa.concat_tables(out) if out else self.rows("0" * 32, np.zeros(0, np.uint64))

        return run


def _keys(tab: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [unrisen(x, np.uint64) for x in unsqueezed(tab, "keys", np.uint8)], [unplaned(x, np.int32) for x in unsqueezed(tab, "counts", np.uint8)]


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) & U(BUCKETS - 1)).astype(np.int64)


def _array_row(tab: pa.Table, data: bytes) -> pa.Table:
    return pa.table({"shard": tab.column("shard").slice(0, 1), "part": tab.column("part").slice(0, 1), "data": pa.array([data], pa.binary())})


def _bucket_counts(least: int):
    def run(tab: pa.Table) -> pa.Table:
        """Hashed counts of a task's lots, up to `least`."""
        keys, counts = (joined(x, kind) for x, kind in zip(_keys(tab), (np.uint64, np.int32), strict=True))
        total = np.bincount(_bucket(keys), counts, BUCKETS)
        return _array_row(tab, squeezed(np.minimum(total, least).astype(np.min_scalar_type(least))))

    return run


def _bucket_sum(least: int):
    def run(tab: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for i in range(tab.num_rows):
            total = np.minimum(total + unsqueezed(tab.slice(i, 1), "data", np.min_scalar_type(least))[0], least)
        return _array_row(tab, squeezed(total.astype(np.min_scalar_type(least))))

    return run


def _full(least: int):
    def run(batches):
        """A bit for each bucket: whether it reaches `least`."""
        for batch in batches:
            bits = [squeezed(np.packbits(total >= least)) for total in unsqueezed(pa.Table.from_batches([batch]), "data", np.min_scalar_type(least))]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(bits, pa.binary())], names=["shard", "data"])

    return run


def _count_sum(tab: pa.Table) -> pa.Table:
    total = 0
    for i in range(tab.num_rows):
        total = total + unsqueezed(tab.slice(i, 1), "data", np.int64)[0]
    return _array_row(tab, squeezed(total))


def _union(tab: pa.Table) -> pa.Table:
    return _array_row(tab, squeezed(np.unique(joined(unsqueezed(tab, "data", np.uint64), np.uint64))))


def _tree(arrays: DataFrame, parts: int, add: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """One array a shard: at most LOTS arrays are added at a time."""
    while parts > 1:
        parts = -(-parts // LOTS)
        arrays = arrays.withColumn("part", F.expr(f"CAST(part DIV {LOTS} AS INT)")).groupBy("shard", "part").applyInArrow(lambda t: add(t), ARRAY_ROWS)
    return arrays


def _beside(rows: DataFrame, arrays: DataFrame, parts: int, run, schema: str) -> DataFrame:
    """Rows of each (shard, part) with the shard's arrays."""
    each = arrays.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("int"))
    return rows.groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInArrow(run, schema)


def _filtered(each: bool):
    def run(rows: pa.Table, full: pa.Table) -> pa.Table:
        """The keys whose buckets are full: a row without a lot with those of all the task's lots and their counts, and where wanted a row of keys for each lot."""
        if not rows.num_rows:
            return rows
        full = np.unpackbits(unsqueezed(full, "data", np.uint8)[0]).view(bool)
        lot, kept, times = [], [], []
        for name, keys, counts in zip(rows.column("lot").to_pylist(), *_keys(rows), strict=True):
            stay = full[_bucket(keys)]
            if stay.any():
                lot.append(name)
                kept.append(keys[stay])
                times.append(counts[stay])
        keys, counts = joined(kept, np.uint64), joined(times, np.int32)
        order = np.argsort(keys, kind="stable")
        first = groups_of(keys[order])
        sums = np.add.reduceat(counts[order], first, dtype=np.int64) if len(keys) else counts.astype(np.int64)
        lot, kept = (lot, kept) if each else ([], [])
        n = len(lot)
        lot, sent, sums = [*lot, None], [*map(rising, kept), rising(keys[order][first])], [*[None] * n, planes(sums)]
        shard, part = (pa.array([rows.column(c)[0].as_py()] * (n + 1), pa.int32()) for c in ("shard", "part"))
        return pa.table({"lot": pa.array(lot, pa.string()), "shard": shard, "part": part, "keys": pa.array(sent, pa.binary()), "counts": pa.array(sums, pa.binary())})

    return run


def _distinct(batches):
    """The keys of rows of a task's lots, as arrays."""
    for batch in batches:
        arrays = [squeezed(unrisen(x, np.uint64)) for x in unsqueezed(pa.Table.from_batches([batch]), "keys", np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("part"), pa.array(arrays, pa.binary())], names=["shard", "part", "data"])


def _hash_of(batches):
    for batch in batches:
        tab = pa.Table.from_batches([batch])
        hashes = [PerfectHash.build(keys).pack() for keys in unsqueezed(tab, "data", np.uint64)]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(hashes, pa.binary())], names=["shard", "hash"])


def _slot_counts(rows: pa.Table, hashes: pa.Table) -> pa.Table:
    """How often each slot's key occurs in a task's lots."""
    hashed = PerfectHash.unpack(unsqueezed(hashes, "hash", np.uint64)[0])
    total = np.zeros(len(hashed.keys), np.int64)
    for keys, counts in zip(unsqueezed(rows, "keys", np.uint8), unsqueezed(rows, "counts", np.uint8), strict=True):
        slot, counts = hashed.slots(unrisen(keys, np.uint64)), unplaned(counts, np.int64)
        total[slot[slot >= 0]] += counts[slot >= 0]  # a row's keys differ
    return _array_row(rows if rows.num_rows else hashes, squeezed(total))


def _frequent(least: int):
    @released
    def run(batches):
        """(shard, key, n) of the slots that reach `least`."""
        for batch in batches:
            tab = pa.Table.from_batches([batch])
            for i, shard in enumerate(tab.column("shard").to_pylist()):
                some = tab.slice(i, 1)
                keys, n = PerfectHash.unpack(unsqueezed(some, "hash", np.uint64)[0]).keys, unsqueezed(some, "data", np.int64)[0]
                high = n >= least
                yield from pa.table({"shard": pa.array(np.full(high.sum(), shard, np.int32)), "key": packed_rows(keys[high]).cast(pa.binary()), "n": pa.array(n[high])}).to_batches()

    return run


def packed_rows(keys: np.ndarray) -> pa.Array:
    """Each key as eight bytes, the high ones first."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(keys), [None, pa.py_buffer(packed(keys.astype(">u8")))])


def counted(keys: DataFrame, shape: Shape, each: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that may be frequent (with `each` those of the lots too), and (shard, first, last, n, slot) of the phrases that are: first is the slot of the part before the last word."""
    parts, least = shape.parts, shape.least
    sums = _tree(keys.groupBy("shard", "part").applyInArrow(_bucket_counts(least), ARRAY_ROWS), parts, _bucket_sum(least))
    full = sums.select("shard", "data").mapInArrow(released(_full(least)), "shard int, data binary")
    kept = _kept(_beside(keys, full, parts, _filtered(each), KEY_ROWS))
    sums = kept.where("lot IS NULL").select("shard", "part", "keys", "counts")
    hashes = _kept(_tree(sums.mapInArrow(released(_distinct), ARRAY_ROWS), parts, _union).mapInArrow(_hash_of, "shard int, hash binary"))
    counts = _tree(_beside(sums, hashes, parts, _slot_counts, ARRAY_ROWS), parts, _count_sum)
    rows = hashes.join(counts.drop("part"), "shard").mapInArrow(_frequent(least), "shard int, key binary, n long")
    key = "CAST(conv(hex(key), 16, 10) AS DECIMAL(20,0))"
    rows = rows.selectExpr("shard", f"{key} DIV {shape.words} first", f"CAST({key} % {shape.words} AS LONG) last", "n")
    found = _kept(_numbered(rows, "slot"))
    dropped(hashes)
    return kept, found


def _answers(shape: Shape):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        """A lot's keys that are frequent, and their slots."""
        keys = known.column("first").to_numpy().astype(np.uint64) * U(shape.words) + known.column("last").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        keys, slots = keys[order], known.column("slot").to_numpy()[order]
        out = []
        for mine in (unrisen(x, np.uint64) for x in unsqueezed(rows, "keys", np.uint8)):
            at = find(keys, mine)
            out.append((rising(mine[at >= 0]), planes(slots[at[at >= 0]])))
        return pa.table({"lot": rows.column("lot"), "keys": pa.array([x[0] for x in out], pa.binary()), "slots": pa.array([x[1] for x in out], pa.binary())})

    return run


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score."""
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    made = _kept(docs.mapInArrow(_lots, LOT_ROWS))
    size = saved(made.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (a, b) -> a + b)")).alias("n"), F.count("*").alias("lots")))
    flat = made.select("lot", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "word")).select("lot", "lang", "place", "word.words", "word.counts").toDF("lot", "lang", "place", "word", "f")
    words = _kept(_numbered(flat.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least).orderBy(F.desc("f"), "lang", "word"), "slot"))
    facts = size.agg(F.sum("n"), F.sum("lots")).first()
    shape = Shape(max(words.count(), 1), max(1, -(-(facts[0] or 0) // SHARD)), max(1, -(-(facts[1] or 0) // LOTS)), least)
    if shape.words**2 >= 2**64 - 1:
        raise ValueError("too many frequent words for keys of 64 bits")
    known = _kept(flat.join(words, ["lang", "word"]).select("lot", "place", "slot"))
    seqs = _kept(made.select("lot", "ids").groupBy("lot").cogroup(known.groupBy("lot")).applyInArrow(_numbers, "lot string, seq binary"))
    dropped(made, known)

    kept, two = counted(seqs.mapInArrow(shape.pairs(), KEY_ROWS), shape, True)
    if two.count() * shape.words >= 2**64 - 1:
        raise ValueError("too many frequent phrases for keys of 64 bits")
    mine = _beside(kept.where("lot IS NOT NULL"), two.select("shard", "first", "last", "slot"), shape.parts, _answers(shape), "lot string, keys binary, slots binary")
    three_keys = seqs.groupBy("lot").cogroup(mine.groupBy("lot")).applyInArrow(shape.triples(), KEY_ROWS)
    rest, three = counted(three_keys, shape, False)
    dropped(seqs, kept, rest)

    def word(i: int) -> DataFrame:
        return words.select(F.col("slot").alias(f"s{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))

    pairs = two.select(F.col("slot").alias("b1"), F.col("first").alias("s1"), F.col("last").alias("s2"), F.col("n").alias("a1"))
    later = pairs.toDF("b2", "s2", "s3", "a2")
    triples = three.select(F.col("first").alias("b1"), F.col("last").alias("s3"), F.col("n").alias("a")).join(pairs, "b1").join(later, ["s2", "s3"])
    covered = triples.selectExpr("b1", "a").unionByName(triples.selectExpr("b2 b1", "a")).groupBy("b1").agg(F.max("a").alias("longer"))
    alone = pairs.join(covered, "b1", "left").where(f"longer IS NULL OR CAST(longer AS DECIMAL(38,0)) * 100 < CAST(a1 AS DECIMAL(38,0)) * {share}")
    wide = "CAST({} AS DECIMAL(38,0))"
    score = f"({wide.format(1000000)} * {wide.format('a')} * {wide.format('a')}) DIV ({wide.format('{0}')} * {wide.format('{1}')})"
    of_two = alone.withColumnRenamed("a1", "a").join(word(1), "s1").join(word(2), "s2")
    of_two = of_two.selectExpr("lang", "concat_ws(' ', w1, w2) phrase", "a", "f1 l", "f2 r", f"{score.format('f1', 'f2')} score")
    of_three = triples.join(word(1), "s1").join(word(2), "s2").join(word(3), "s3")
    of_three = of_three.withColumns({"x": F.expr(score.format("f1", "a2")), "y": F.expr(score.format("a1", "f3"))})
    of_three = of_three.selectExpr("lang", "concat_ws(' ', w1, w2, w3) phrase", "a", "IF(x <= y, f1, a1) l", "IF(x <= y, a2, f3) r", "least(x, y) score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = of_two.unionByName(of_three).withColumn("rank", place).where(F.col("rank") <= top)
    return best.join(size.select("lang", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of all documents."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def _grams(k: int) -> str:
    names = ", ".join(f"w{i + 1}" for i in range(k))
    leads = ", ".join(f"lead(w, {i}) OVER o AS w{i + 1}" for i in range(k))
    return f"SELECT lang, {names}, count(*) AS f FROM (SELECT lang, {leads} FROM words WINDOW o AS (PARTITION BY doc, piece ORDER BY i)) WHERE w{k} IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}"


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
cut AS (SELECT doc, lang, regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]') AS p FROM docs),
pieces AS (SELECT doc, lang, unnest(p) AS text, generate_subscripts(p, 1) AS piece FROM cut),
lists AS (SELECT doc, lang, piece, regexp_extract_all(text, '[^\\x20\\x09]+') AS ws FROM pieces),
words AS (SELECT doc, lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
size AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
one AS ({_grams(1)}), two AS ({_grams(2)}), three AS ({_grams(3)}),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, a.f AS l, b.f AS r FROM two t JOIN one a ON a.lang = t.lang AND a.w1 = t.w1 JOIN one b ON b.lang = t.lang AND b.w1 = t.w2
  WHERE NOT EXISTS (SELECT 1 FROM three x WHERE x.lang = t.lang AND ((x.w1 = t.w1 AND x.w2 = t.w2) OR (x.w2 = t.w1 AND x.w3 = t.w2)) AND 100 * x.f >= {SHARE} * t.f)
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, a.f, b.f FROM three t JOIN one a ON a.lang = t.lang AND a.w1 = t.w1 JOIN two b ON b.lang = t.lang AND b.w1 = t.w2 AND b.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, a.f, b.f FROM three t JOIN two a ON a.lang = t.lang AND a.w1 = t.w1 AND a.w2 = t.w2 JOIN one b ON b.lang = t.lang AND b.w1 = t.w3
),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN size USING (lang) WHERE rank <= {TOP}
"""
