"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document is contaminated by a benchmark item if some stretch of it is within an edit similarity of SIMILARITY of the
item (edit distance at most (1 - SIMILARITY) times the item's length; both A-Z lower-cased, white space runs one
space). Candidates: the CGK walk reads a string and at each step writes the byte it stands on and stays or moves on by a
random bit of step and byte, so strings few edits apart give embeddings of small Hamming distance. A table samples some
places of the embedding; equal samples are a collision. Items are put into classes by size (powers of two up to
2**WIDEST); a class walks windows in proportion to its smallest items, from every byte of an item and every `stride`
bytes of a text (longer items so have many windows, some of which hold fewer edits than the item as a whole). Of DRAWS
walks that are drawn the one is taken that brings the fewest chance collisions between items. Walks are
repeated with new random bits until the recall, measured on items edited at the limit, evenly spaced and at random,
reaches TARGET. Each collision names an item and a diagonal. Collisions are looked at twice: a block of WORD bytes of
the item around the window must lie there within NEAR times its share of the edits. Then the item is verified by exact
edit distance. The recall is that of all these steps.

The items are broadcast in blocks of at most BLOCK bytes, each of which reads the texts once. Defined results: null texts
and items match nothing; items that allow no edit (below 5 bytes) match where they occur whole; repeated rows and items
each give rows; the distance is the least of the stretches found; order does not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, find, groups_of, pieces, released, spread, texts_of

SIMILARITY, TARGET = 0.8, 0.985
#: Bytes of items in a broadcast (their tables take some 300 times as much), of texts handled at once, windows walked at once.
BLOCK, PIECE, STEP = 1 << 18, 1 << 20, 1 << 13
#: Largest size class, samples of each walk, edited items that the recall is measured on, bits of a filter per key.
WIDEST, TABLES, TRIALS, FILTER = 6, 4, 600, 32
#: Draws for each walk, windows by which they are compared.
DRAWS, CROWD = 8, 1 << 13
#: Collisions that are held at once, before those on one diagonal become one and all are verified.
HELD = 1 << 20
#: Bytes of a block at most (a machine word holds its columns); items up to that are verified many at once.
WORD = 63
#: Blocks of longer items begin every GAP bytes; edits they may have in proportion to the item's.
GAP, NEAR = 21, 1.25
#: A random number for each byte at each step: a sample's hash is their sum.
VALUES = np.random.default_rng(1).integers(0, 2**32, (2 << WIDEST, 256), np.uint32)


def normalised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """A-Z lower-cased, runs of white space one space, none at the ends."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    low[space] = 32
    first = np.zeros(len(low), bool)
    first[starts[ends > starts]] = True
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep &= ~(first & space)
    count = np.concatenate([[0], np.cumsum(keep)])
    s, e = count[starts], count[ends]
    out = low[keep]
    trim = (e > s) & (out[np.maximum(e - 1, 0)] == 32) if len(out) else np.zeros(len(s), bool)
    return out, s, e - trim


class Windows:
    """Random walks over windows and the places of their embeddings that the tables sample.

    Walks and samples of short windows are longer where many windows of items crowd the keys (a step that reads a new byte
    every other time tells some five apart), so that a text's window meets few of them by chance, whatever their number;
    the recall that this costs is made up for by more walks.
    """

    def __init__(self, size_class: int, crowd: int):
        size = 1 << size_class
        least = math.ceil(math.log2(max(crowd, 2)) / 2.3)
        self.steps, self.stride = max(4, size // 2, min(2 * size, least)), max(1, size // 16)
        self.sampled = min(self.steps, max(3, 5 * self.steps // 16, least))
        self.tables = min(TABLES, math.comb(self.steps - 1, self.sampled - 1))
        self.rng = np.random.default_rng(size_class)
        self.walks = []

    def add(self, data: np.ndarray, some: np.ndarray, others: np.ndarray) -> None:
        """One more walk: of DRAWS, that by which the fewest windows of some items collide with those of others, which are chance."""
        best = None
        for _ in range(DRAWS):
            factor, shift = (self.rng.integers(0, n, self.steps) for n in (128, 256))
            places = [[*self.rng.choice(self.steps - 1, self.sampled - 1, replace=False).tolist(), self.steps - 1] for _ in range(self.tables)]
            moves = [(np.arange(256) * (2 * f + 1) + s & 255) >> 7 for f, s in zip(factor.tolist(), shift.tolist(), strict=True)]
            walk = moves, [[t for t in range(self.tables) if j in places[t]] for j in range(self.steps)]
            met = 0
            for one, two in zip(*(self._walked(walk, data, at)[0] for at in (some, others)), strict=True):
                two = np.sort(two)
                met += int((np.searchsorted(two, one, "right") - np.searchsorted(two, one)).sum())
            if best is None or met < best[0]:
                best = met, walk
        self.walks.append(best[1])

    def _walked(self, walk, data: np.ndarray, at: np.ndarray):
        moves, samples = walk
        place = at
        keys = [np.zeros(len(at), np.uint32) for _ in range(self.tables)]
        for j in range(self.steps):
            byte = data.take(place)
            if samples[j]:
                value = VALUES[j].take(byte)
                for t in samples[j]:
                    keys[t] += value
            last = place
            place = place + moves[j].take(byte)
        return keys, last

    def two_steps(self, seen: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Per walk and two steps, for the number of the byte stood on among those seen and len(seen) times that of the next: bytes moved on by, and what is added to each table's hash."""
        now, after = np.tile(seen, len(seen)), np.repeat(seen, len(seen))
        out = []
        for moves, samples in self.walks:
            out.append([])
            for j in range(0, self.steps, 2):
                move, sums = moves[j].take(now), np.zeros((len(now), self.tables), np.uint32)
                sums[:, samples[j]] += VALUES[j].take(now)[:, None]
                if j + 1 < self.steps:
                    then = np.where(move == 1, after, now)
                    sums[:, samples[j + 1]] += VALUES[j + 1].take(then)[:, None]
                    move = move + moves[j + 1].take(then)
                out[-1].append((move, sums))
        return out

    def hashes(self, steps, pairs: np.ndarray, at: np.ndarray):
        """The hashes of keys(), by the steps of two_steps(). pairs: numbers of each byte and the next."""
        for walk in steps:
            place, keys = at.copy(), np.zeros((len(at), self.tables), np.uint32)
            for move, sums in walk:
                two = pairs.take(place)
                keys += sums.take(two, 0)
                place += move.take(two)
            yield np.ascontiguousarray(keys.T)

    def keys(self, data: np.ndarray, at: np.ndarray):
        """Per walk: the hash of each table's sample for the windows that begin at `at`, and where they end. data: integers (indices of tables), steps longer than its texts."""
        for walk in self.walks:
            yield self._walked(walk, data, at)


def edited(item: bytes, edits: int, rng: np.random.Generator, way: int) -> bytes:
    """The item with evenly spaced bytes replaced (way 0) or left out (1), or edits of any kind anywhere (2)."""
    out = bytearray(item)
    for k in range(edits - 1, -1, -1):
        kind, new = (way if way < 2 else int(rng.integers(3))), int(rng.integers(97, 123))
        p = k * len(item) // edits if way < 2 else int(rng.integers(0, max(1, len(out))))
        if kind == 0 and out:
            out[p] = new if out[p] != new else new + 1
        elif kind == 1:
            del out[p : p + 1]
        else:
            out.insert(p, new)
    return bytes(out)


class Items:
    """A block of benchmark items, and per size class its walks and tables."""

    def __init__(self, ids: list[int], texts: list[bytes], similarity: float = SIMILARITY, target: float = TARGET):
        self.ids, self.texts = ids, texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.most = np.floor(self.lengths * (1 - similarity) + 1e-9).astype(np.int64)
        self.whole = [i for i in range(len(texts)) if self.lengths[i] and not self.most[i]]  # these allow no edit
        self._blocks(similarity)
        of = np.minimum(np.maximum(np.frexp(self.lengths)[1] - 1, 2), WIDEST)
        self.classes = []
        for c in np.unique(of[self.most > 0]).tolist():
            mine = np.flatnonzero((of == c) & (self.most > 0))
            windows, done = Windows(c, int(self.lengths[mine].sum())), self.classes
            text = np.frombuffer(b"".join(self.texts[k] + b"\0" * (windows.steps + 1) for k in mine), np.uint8).astype(np.int64)
            size = self.lengths[mine]
            begin = np.cumsum(size + windows.steps + 1) - (size + windows.steps + 1)
            half = []
            for part in (slice(0, None, 2), slice(1, None, 2)):  # windows inside of each other item, up to CROWD
                at = spread(begin[part], np.maximum(1, size[part] - windows.steps // 2))
                half.append(at[:: max(1, len(at) // CROWD)])
            while True:
                windows.add(text, *half)
                self.classes = [(windows, self._tables(windows, mine))]
                if min(self._recall(mine, way) for way in range(3)) >= target:
                    break
            self.classes += done

    def _recall(self, mine: np.ndarray, way: int) -> float:
        """Share of edited items (TRIALS of them, edited at the limit) that are found."""
        rng = np.random.default_rng(7)
        who = [int(mine[k * len(mine) // TRIALS if len(mine) >= TRIALS else k % len(mine)]) for k in range(TRIALS)]
        texts = [b" " * (k % 8) + edited(self.texts[i], int(self.most[i]), rng, way) for k, i in enumerate(who)]
        ends = np.cumsum([len(t) for t in texts])
        found = {(d, i) for d, i, _ in matches(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, self)}
        return sum((k, i) in found for k, i in enumerate(who)) / TRIALS

    def _blocks(self, similarity: float) -> None:
        """Blocks of at most WORD bytes of each item: where they begin, their size, edits, and columns of each byte."""
        n = np.where(self.lengths > WORD, -(-(self.lengths - WORD) // GAP) + 1, 1)
        self.block_first = np.cumsum(n) - n
        item = np.repeat(np.arange(len(n)), n)
        self.block_item = item
        self.block_begin = np.minimum((np.arange(len(item)) - self.block_first[item]) * GAP, np.maximum(0, self.lengths[item] - WORD))
        self.block_size = np.minimum(self.lengths[item], WORD)
        self.block_edits = np.where(self.lengths[item] > WORD, int(WORD * (1 - similarity) * NEAR), self.most[item])
        self.columns = np.zeros(len(item) * 256, np.uint64)
        begin = np.cumsum(self.lengths) - self.lengths
        at = spread(begin[item] + self.block_begin, self.block_size)
        block = np.repeat(np.arange(len(item)), self.block_size)
        bit = np.arange(len(at)) - np.repeat(np.cumsum(self.block_size) - self.block_size, self.block_size)
        np.bitwise_or.at(self.columns, block * 256 + np.frombuffer(b"".join(self.texts), np.uint8)[at], U(1) << bit.astype(np.uint64))

    def _tables(self, windows: Windows, mine: np.ndarray):
        """Per walk and table: a bit filter, sorted different keys, where each one's entries begin and how many they are, and the entries (item, offset)."""
        size = self.lengths[mine]
        begin = np.cumsum(size + windows.steps + 1) - (size + windows.steps + 1)
        pad = b"\0" * (windows.steps + 1)
        data = np.frombuffer(b"".join(self.texts[i] + pad for i in mine), np.uint8).astype(np.int64)
        at, which = spread(begin, size), np.repeat(np.arange(len(mine)), size)
        bits = max(10, int(FILTER * len(at) - 1).bit_length())
        out = []
        for keys, last in windows.keys(data, at):
            good = np.flatnonzero(last < (begin + size)[which])
            for key in keys:
                order = good[np.argsort(key[good], kind="stable")]
                key = key[order]
                filled = np.zeros(1 << bits, bool)
                filled[key >> np.uint32(32 - bits)] = True
                out.append((bits, np.packbits(filled), *np.unique(key, return_index=True, return_counts=True), mine[which[order]].astype(np.int32), (at - begin[which])[order].astype(np.int32)))
        return out


def collisions(data: np.ndarray, items: Items):
    """(place, item, offset): places of the text and the item whose windows collide, at most HELD and a window's at once."""
    for windows, tables in items.classes:
        padded = np.concatenate([data, np.zeros(windows.steps + 1, np.uint8)])
        seen = np.flatnonzero(np.bincount(padded, minlength=256))
        pairs = np.searchsorted(seen, np.arange(256)).take(padded)
        pairs[:-1] += pairs[1:] * len(seen)
        steps = windows.two_steps(seen)
        for low in range(0, len(data), STEP * windows.stride):
            at = np.arange(low, min(low + STEP * windows.stride, len(data)), windows.stride)
            k = 0
            for keys in windows.hashes(steps, pairs, at):
                for key in keys:
                    bits, filled, known, begin, count, item, offset = tables[k]
                    k += 1
                    slot = key >> np.uint32(32 - bits)
                    hit = np.flatnonzero(filled.take(slot >> np.uint32(3)) << (slot & np.uint32(7)).astype(np.uint8) & np.uint8(128))
                    which = find(known, key[hit])
                    hit, which = hit[which >= 0], which[which >= 0]
                    first, n = begin[which], count[which]
                    for i, j in pieces(np.cumsum(n) - n, np.cumsum(n), HELD):
                        entry, place = spread(first[i:j], n[i:j]), np.repeat(at[hit[i:j]], n[i:j])
                        yield place, item[entry].astype(np.int64), offset[entry].astype(np.int64)


def edit_distance(item: bytes, text: bytes) -> int:
    """Least edit distance of the item and any stretch of the text: Myers' bit-parallel columns."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        plus = (mh << 1 & full) | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best = score
    return best


def block_distances(data: np.ndarray, begin: np.ndarray, end: np.ndarray, block: np.ndarray, items: Items) -> np.ndarray:
    """The same for blocks of items and many stretches [begin, end) at once; exact up to the block's edits, beyond them only larger than these."""
    out = np.zeros(len(block), np.int64)
    one, padded = U(1), np.concatenate([data, np.zeros(1, np.uint8)]).astype(np.int64)
    for some in np.split(np.argsort(end - begin, kind="stable"), np.arange(STEP // 2, len(block), STEP // 2)):
        row, place, stop, edits = block[some] * 256, begin[some], end[some], items.block_edits[block[some]]
        score = items.block_size[block[some]]
        top, best = (score - 1).astype(np.uint64), score.copy()
        soon = int((score - edits).min(initial=WORD))  # columns before which no score is low
        plus, minus = np.full(len(some), ~U(0)), np.zeros(len(some), np.uint64)
        width, shortest = int((stop - place).max(initial=0)), int((stop - place).min(initial=0))
        for c in range(width):
            if width - c in (24, 16, 8):  # each column lowers the score by 1 at most
                stay = (best <= edits) | (score - np.maximum(stop - place, 0) <= edits)
                if not stay.all():
                    out[some] = best
                    some, row, place, stop, edits, score, top, best, plus, minus = (x[stay] for x in (some, row, place, stop, edits, score, top, best, plus, minus))
            inside = place < stop if c >= shortest else None
            eq = items.columns.take(row + padded.take(place if inside is None else np.where(inside, place, len(data))))
            if inside is not None:
                eq[~inside] = 0  # columns past the end never lower the score
            place += 1
            xv = eq | minus
            xh = eq & plus
            xh += plus
            xh ^= plus
            xh |= eq
            ph = xh | plus
            np.invert(ph, out=ph)
            ph |= minus
            xh &= plus
            bit = ph >> top
            bit &= one
            score += bit.view(np.int64)
            np.right_shift(xh, top, out=bit)
            bit &= one
            score -= bit.view(np.int64)
            ph <<= one
            xh <<= one
            plus = xv | ph
            np.invert(plus, out=plus)
            plus |= xh
            minus = ph & xv
            if c + 1 >= soon:
                np.minimum(best, score, out=best)
        out[some] = best
    return out


def candidates(data, starts, ends, items: Items):
    """(text, item, begin, end, distance) of stretches that a block is near to: distance -1 where the item is longer than its block. In lots of bounded size."""
    def met(found: list) -> tuple[np.ndarray, np.ndarray]:
        place, item, offset = map(np.concatenate, zip(*found, strict=True))
        text = np.searchsorted(starts, place, "right") - 1
        block = items.block_first[item] + np.maximum(0, np.minimum((offset - GAP) // GAP, -(-(items.lengths[item] - WORD) // GAP)))
        return once(text << 32 | block, (place - offset) >> 2)

    found, size, held = [], 0, []
    for some in collisions(data, items):
        found.append(some)
        size += len(some[0])
        if size > HELD:
            held.append(met(found))
            found, size = [], 0
            if len(held) > 1:
                held = [once(*map(np.concatenate, zip(*held, strict=True)))]
            if len(held[0][0]) > HELD:
                yield near(*held.pop(), data, starts, ends, items)
    if found:
        held.append(met(found))
    if held:
        yield near(*once(*map(np.concatenate, zip(*held, strict=True))), data, starts, ends, items)


def once(block: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once: blocks that collide on nearly one diagonal are one."""
    order = np.lexsort((diagonal, block))
    block, diagonal = block[order], diagonal[order]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (diagonal[1:] != diagonal[:-1])
    return block[new], diagonal[new]


def near(where: np.ndarray, diagonal: np.ndarray, data, starts, ends, items: Items):
    """Those of the collisions (text and block, diagonal by four) whose blocks lie there."""
    diagonal, block, text = diagonal << 2, where & 0xFFFFFFFF, where >> 32
    item = items.block_item[block]
    slack = items.block_edits[block] + 4
    begin = np.clip(diagonal + items.block_begin[block] - slack, starts[text], ends[text])
    end = np.clip(diagonal + 3 + items.block_begin[block] + items.block_size[block] + slack, starts[text], ends[text])
    distance = block_distances(data, begin, end, block, items)
    good = distance <= items.block_edits[block]
    text, item, diagonal, distance = (x[good] for x in (text, item, diagonal, distance))
    distance[items.lengths[item] > WORD] = -1
    slack = items.most[item] + 4
    return text, item, np.maximum(diagonal - slack, starts[text]), np.minimum(diagonal + 3 + items.lengths[item] + slack, ends[text]), distance


def matches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(text, item, distance) of all texts of normalised bytes."""
    out: dict[tuple[int, int], int] = {}
    raw = data.tobytes()
    for i in items.whole:
        s = raw.find(items.texts[i])
        while s >= 0:
            d = int(np.searchsorted(starts, s, "right")) - 1
            inside = s + int(items.lengths[i]) <= int(ends[d])
            if inside:
                out[d, i] = 0
            s = raw.find(items.texts[i], int(ends[d]) if inside else s + 1)
    spans: dict[tuple[int, int], list[list[int]]] = {}
    for text, item, begin, end, distance in candidates(data, starts, ends, items):
        short = distance >= 0
        pair, best = text[short] * len(items.texts) + item[short], distance[short]
        order = np.lexsort((best, pair))
        first = order[groups_of(pair[order])]
        for p, x in zip(pair[first].tolist(), best[first].tolist(), strict=True):
            at = divmod(p, len(items.texts))
            out[at] = min(x, out.get(at, x))
        for d, i, b, e in zip(*(x[~short].tolist() for x in (text, item, begin, end)), strict=True):
            spans.setdefault((d, i), []).append([b, e])
    for (d, i), stretches in spans.items():
        word, joined = items.texts[i], []
        for b, e in sorted(stretches):
            if joined and b <= joined[-1][1]:  # stretches that overlap are verified together
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([b, e])
        x = min(0 if word in raw[b:e] else edit_distance(word, raw[b:e]) for b, e in joined)
        if x <= items.most[i]:
            out[d, i] = x
    return [(d, i, x) for (d, i), x in out.items()]


def item_blocks(benchmark: DataFrame, key: str, text: str, block: int):
    """The normalised items, in blocks of a bounded size that are read one after another."""
    rows = benchmark.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-total // block)
    for n in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == n).orderBy("k", "t").toArrow()
        if got.num_rows:
            data, s, e = normalised(*texts_of(got, "t"))
            yield got.column("k").to_pylist(), [data[a:b].tobytes() for a, b in zip(s, e, strict=True)]


SCHEMA = "doc_id long, item_id long, distance long, item_bytes long"


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, distance, item_bytes): a row for each document and item that it contains."""
    spark = docs.sparkSession
    small = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for ids, texts in item_blocks(benchmark, item, item_text, BLOCK):
        shared = spark.sparkContext.broadcast(Items(ids, texts, similarity))

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                tab = pa.Table.from_batches([b])
                data, starts, ends = texts_of(tab)
                who = tab.column("doc_id").to_pylist()
                rows = []
                for i, j in pieces(starts, ends, PIECE):
                    rows += [(who[i + d], items.ids[k], x, len(items.texts[k])) for d, k, x in matches(*normalised(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]), items)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["doc_id", "item_id", "distance", "item_bytes"])

        found = small.mapInArrow(released(run), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, benchmark)
