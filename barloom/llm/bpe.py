"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus' most frequent words (counted over all documents) are encoded once on the driver and compiled into a minimal
acyclic automaton: equal suffixes share states, and the transitions' outputs add up to a word's number, which leads to
its ids. Automaton, merge table and vocabulary go into one file that every executor gets and its workers memory-map.
Words are looked up in the automaton, many at a time; unseen words are merged exactly, many at a time too, always the
leftmost pair of the lowest rank. The lexicon only saves time: results are those of the tokenizer file alone.

Defined results: null text is empty and has no ids; added tokens of the file are found in texts first, as the tokenizers
library does; repeated rows encode alike; an empty table gives no rows; the ids of any text decode to that text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import pieces, released, saved, spread, tidy

LEXICON_WORDS, PIECE, CACHE, LONG_WORD, NO_RANK = 32768, 1 << 20, 200_000, 64, 1 << 30
SPACE = r"\t-\r \x85\xa0  -     　"
TAIL = rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The pattern that splits text into words; the second is quicker and the same on texts without the characters of ODD.
FULL = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+" + TAIL)
QUICK = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^" + SPACE + r"\w]|_)+" + TAIL)
ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


def split_words(text: str) -> list[str]:
    return FULL.findall(text) if ODD.search(text) else QUICK.findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if it prints, else the next one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Minimal acyclic automaton of sorted byte strings; number(s) is a string's rank among them."""

    def __init__(self, words: list[bytes]):
        register: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.edges: list[tuple[tuple[int, int], ...]] = []
        path: list[list] = [[False, []]]  # open states along the last word: final, [(label, state)]
        labels: list[int] = []

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(self.final)
                    self.final.append(final)
                    self.edges.append(key[1])
                path[-1][1].append((labels.pop(), state))

        for w in words:
            common = 0
            while common < min(len(w), len(labels)) and labels[common] == w[common]:
                common += 1
            close(common)
            for c in w[common:]:
                labels.append(c)
                path.append([False, []])
            path[-1][0] = True
        close(0)
        self.root = len(self.final)
        self.final.append(path[0][0])
        self.edges.append(tuple(path[0][1]))

    def arrays(self) -> dict[str, np.ndarray]:
        """Transitions sorted by (state, label), with target and output; which states are final."""
        count = [0] * len(self.final)  # a state's transitions lead to states closed before it
        keys, targets, outputs = [], [], []
        for s, edges in enumerate(self.edges):
            n = int(self.final[s])
            for c, t in edges:
                keys.append(s << 8 | c)
                targets.append(t)
                outputs.append(n)
                n += count[t]
            count[s] = n
        return {"keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "outputs": np.array(outputs, np.int32), "final": np.array(self.final, np.uint8), "root": np.array([self.root], np.int64)}


class Tokenizer:
    """The arrays of a tokenizer file and of a lexicon, and how to encode and decode with them."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        for k, v in arrays.items():
            setattr(self, k, v)
        self.specials = json.loads(bytes(arrays["special"])) if len(arrays["special"]) else {}
        self.split_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.specials:
            self.index = {s: k for k, s in enumerate(self.specials)}
            self.flat, self.lengths = np.array(list(self.specials.values()), np.int32), np.ones(len(self.specials), np.int64)

    # encoding

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon, or -1: all words step through the automaton together."""
        size = np.array([len(w) for w in words], np.int64)
        out, state = np.zeros(len(words), np.int64), np.full(len(words), self.root[0], np.int64)
        if not len(self.keys):
            return np.full(len(words), -1)
        data, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        step = 0
        while len(live):
            key = state[live] << 8 | data[at[live] + step]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[e] == key
            state[live[~hit]] = -1
            live, e = live[hit], e[hit]
            out[live] += self.outputs[e]
            state[live] = self.targets[e]
            step += 1
            live = live[size[live] > step]
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] > 0) & (size > 0), out, -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of many words at once, one merge a word and round: all ids, and how many each word has."""
        size = np.array([len(w) for w in words], np.int64)
        long = np.flatnonzero(size > LONG_WORD).tolist()
        whole = {i: self.merge_long(words[i]) for i in long}
        size[long] = 0
        sym = self.byte_id[np.frombuffer(b"".join(w for w in words if len(w) <= LONG_WORD), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [np.concatenate([np.zeros(0, np.int64), *whole.values()])], [np.repeat(np.array(long, np.int64), [len(x) for x in whole.values()])]
        while len(sym):
            key = sym[:-1] * len(self.byte_start) + sym[1:]
            e = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where((self.pairs[e] == key) & (word[:-1] == word[1:]), self.ranks[e], NO_RANK)
            rank = np.append(rank, NO_RANK).astype(np.int64)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat((rank << 32) + np.arange(len(sym)), first)
            going = best >> 32 < NO_RANK
            stay = ~np.repeat(going, np.diff(np.append(first, len(sym))))
            done_sym.append(sym[stay])
            done_word.append(word[stay])
            at = best[going] & 0xFFFFFFFF
            sym[at] = self.merged[np.searchsorted(self.pairs, sym[at] * len(self.byte_start) + sym[at + 1])]
            stay[at + 1] = True
            sym, word = sym[~stay], word[~stay]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))

    def merge_long(self, w: bytes) -> np.ndarray:
        """Merges of one long word with a heap."""
        sym = [int(x) for x in self.byte_id[np.frombuffer(w, np.uint8)]]
        after, before = list(range(1, len(sym))) + [-1], [-1, *range(len(sym) - 1)]
        known: dict[tuple[int, int], tuple[int, int] | None] = {}

        def pair(i: int):
            j = after[i]
            if j < 0:
                return None
            key = (sym[i], sym[j])
            if key not in known:
                e = int(np.searchsorted(self.pairs, key[0] * len(self.byte_start) + key[1]))
                known[key] = (int(self.ranks[e]), int(self.merged[e])) if e < len(self.pairs) and self.pairs[e] == key[0] * len(self.byte_start) + key[1] else None
            return known[key]

        heap = [(p[0], i, sym[i], sym[after[i]]) for i in range(len(sym) - 1) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = pair(i)[1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, (p[0], k, sym[k], sym[after[k]]))
        return np.array([s for s in sym if s >= 0], np.int32)

    def learn(self, words: list[str]) -> None:
        """Put words into the cache: from the lexicon, else merged."""
        for i in range(0, len(words), 100_000):
            raw = [w.encode() for w in words[i : i + 100_000]]
            number = self.look_up(raw)
            known, unseen = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
            merged, counts = self.merge([raw[k] for k in unseen.tolist()])
            begin = self.word_start[number[known]]
            size = self.word_start[number[known] + 1] - begin
            self.index |= zip(np.array(words[i : i + 100_000], object)[np.concatenate([known, unseen])].tolist(), range(len(self.lengths), len(self.lengths) + len(raw)), strict=True)
            self.flat = np.concatenate([self.flat, self.word_ids[spread(begin, size)], merged])
            self.lengths = np.concatenate([self.lengths, size, counts])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        words: list[list[str]] = []
        for t in texts:
            if not t:
                words.append([])
            elif self.split_special and self.split_special.search(t):
                parts = self.split_special.split(t)
                words.append([w for k, p in enumerate(parts) for w in ((p,) if k % 2 else split_words(p))])
            else:
                words.append(split_words(t))
        unknown = list(set().union(*words) - self.index.keys()) if words else []
        if len(self.index) + len(unknown) > CACHE and len(self.index) > len(self.specials):
            self.forget()
            return self.encode(texts)
        self.learn(unknown)
        index = self.index
        at = np.array([index[w] for t in words for w in t], np.int64)
        lengths = self.lengths
        start = np.cumsum(lengths) - lengths
        ids = self.flat[spread(start[at], lengths[at])]
        per_word = np.array([len(t) for t in words], np.int64)
        total = np.concatenate([[0], np.cumsum(lengths[at])])
        end = np.cumsum(per_word)
        return ids, total[end] - total[end - per_word]

    # decoding

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of consecutive runs of ids; ids outside the vocabulary stand for nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.byte_start) - 1), ids, len(self.byte_start) - 1)
        start, size = self.byte_start, np.append(np.diff(self.byte_start), 0)
        data = self.bytes[spread(start[ids], size[ids])].tobytes()
        total = np.concatenate([[0], np.cumsum(size[ids])])
        end = np.cumsum(counts)
        return [data[i:j].decode("utf-8", "replace") for i, j in zip(total[end - counts].tolist(), total[end].tolist(), strict=True)]


def tokenizer_arrays(path: str) -> dict[str, np.ndarray]:
    """What a tokenizers file of a byte-level BPE says, as arrays."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter = byte_letters()
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = {i: bytes(letter[c] for c in w) for w, i in spec["model"]["vocab"].items() if w not in specials} | {i: s.encode() for s, i in specials.items()}
    size = max(strings) + 1
    vocab = spec["model"]["vocab"]
    ordered = [strings.get(i, b"") for i in range(size)]
    start = np.concatenate([[0], np.cumsum([len(x) for x in ordered])]).astype(np.int64)
    byte_id = np.zeros(256, np.int32)
    for c, b in letter.items():
        byte_id[b] = vocab[c]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    pair = np.array([vocab[a] * len(start) + vocab[b] for a, b in merges], np.int64)
    order = np.argsort(pair)
    return {
        "byte_start": start, "bytes": np.frombuffer(b"".join(ordered), np.uint8), "byte_id": byte_id, "pairs": pair[order],
        "ranks": order.astype(np.int32), "merged": np.array([vocab[a + b] for a, b in merges], np.int32)[order],
        "special": np.frombuffer(json.dumps(specials).encode(), np.uint8),
    }


def lexicon_arrays(base: dict[str, np.ndarray], words: list[str]) -> dict[str, np.ndarray]:
    """The automaton of the words and their ids."""
    raw = sorted({w.encode() for w in words})
    none = {"keys": np.zeros(0, np.int64), "targets": np.zeros(0, np.int32), "outputs": np.zeros(0, np.int32), "final": np.zeros(1, np.uint8), "root": np.zeros(1, np.int64)}
    ids, counts = Tokenizer(base | none).merge(raw)
    return (Automaton(raw).arrays() if raw else none) | {"word_start": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), "word_ids": ids}


def _word_counts(batches):
    for b in batches:
        words = pc.utf8_split_whitespace(b.column(0).fill_null("")).flatten()
        c = pc.value_counts(words)
        yield pa.RecordBatch.from_arrays([c.field(0), c.field(1)], ["word", "n"])


def frequent_words(docs: DataFrame, text: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The commonest words with the space before them, by counts over all documents, at most limit of them."""
    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(released(_word_counts), "word string, n long")
    counts = saved(counts.where("octet_length(word) BETWEEN 1 AND 64").groupBy("word").agg(F.sum("n").alias("n")))
    # the count from which at most `limit` words are left, from a histogram of counts in steps of an eighth octave
    step = F.floor(F.log2("n") * 8).cast("int")
    least, total = 1 << 30, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > limit:
            break
        least = r["step"]
    return [p for r in counts.where(step >= least).orderBy("word").collect() for p in split_words(" " + r["word"])]


def save_lexicon(arrays: dict[str, np.ndarray]) -> str:
    """Write arrays into one file: a header line with their names, types, lengths and places, then their bytes."""
    head, body, at = {}, [], 0
    for k, v in arrays.items():
        head[k] = [v.dtype.str, len(v), at]
        raw = v.tobytes()
        body.append(raw + b"\0" * (-len(raw) % 16))
        at += len(body[-1])
    raw = json.dumps(head).encode()
    raw += b" " * (-(len(raw) + 1) % 16) + b"\n"
    data = raw + b"".join(body)
    path = os.path.join(tempfile.mkdtemp(prefix="barloom-"), f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin")
    with open(path, "wb") as f:
        f.write(data)
    return path


def map_lexicon(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    with open(path, "rb") as f:
        line = f.readline()
    return {k: data[len(line) + at : len(line) + at + np.dtype(t).itemsize * n].view(t) for k, (t, n, at) in json.loads(line).items()}


_loaded: dict[str, Tokenizer] = {}
_given: set[tuple[str, str]] = set()


def _tokenizer(name: str) -> Tokenizer:
    """The worker's tokenizer over the memory-mapped file."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Tokenizer(map_lexicon(SparkFiles.get(name)))
    return _loaded[name]


def build_lexicon(spark: SparkSession, docs: DataFrame, tokenizer_path: str, text: str = "text") -> str:
    """Compile the lexicon and give it to all executors; the name of its file."""
    base = tokenizer_arrays(tokenizer_path)
    path = tidy(save_lexicon(base | lexicon_arrays(base, frequent_words(docs, text))))
    name = os.path.basename(path)
    if (spark.sparkContext.applicationId, name) not in _given:  # equal content has one name and is given once
        spark.sparkContext.addFile(path)
        _given.add((spark.sparkContext.applicationId, name))
    return name


def _sizes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = pc.binary_length(col.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    return ends - size, ends


def _encoded(tok: Tokenizer, b: pa.RecordBatch, text: str, pieces_of: int):
    """Slices of a batch with their ids and counts."""
    col = b.column(b.schema.get_field_index(text))
    for i, j in pieces(*_sizes(col), pieces_of):
        yield b.slice(i, j - i), *tok.encode(col.slice(i, j - i).to_pylist())


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def bpe_encode(docs: DataFrame, lexicon: str, text: str = "text", name: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the token ids of the text and, if asked for, the text decoded from these ids again; they replace columns of their names."""
    if text in (name, decoded):
        raise ValueError(f"the text's column {text} can't be replaced")
    docs = docs.drop(*(c for c in (name, decoded) if c))
    schema = StructType([*docs.schema, StructField(name, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])])

    def run(batches):
        tok = _tokenizer(lexicon)
        for b in batches:
            for part, ids, counts in _encoded(tok, b, text, PIECE):
                tab = pa.Table.from_batches([part]).append_column(name, _lists(ids, counts))
                yield from (tab.append_column(decoded, pa.array(tok.decode(ids, counts), pa.string())) if decoded else tab).to_batches()
        tok.forget()  # the worker goes on to other stages

    return docs.mapInArrow(released(run), schema)


def bpe_decode(encoded: DataFrame, lexicon: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The frame with the text that the ids stand for (null: none); it replaces a column of its name."""
    encoded = encoded.drop(name)

    def run(batches):
        tok = _tokenizer(lexicon)
        for b in batches:
            col = b.column(b.schema.get_field_index(ids))
            size = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            for i, j in pieces(ends - size, ends, PIECE // 4):
                part = col.slice(i, j - i)
                texts = tok.decode(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), size[i:j])
                yield from pa.Table.from_batches([b.slice(i, j - i)]).append_column(name, pa.array(texts, pa.string())).to_batches()

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField(name, StringType())]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    lexicon = build_lexicon(spark, docs, tokenizer_path)
    out = bpe_encode(docs.select("doc_id", "text"), lexicon, decoded="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
