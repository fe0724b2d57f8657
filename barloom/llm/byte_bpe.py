"""Byte-level BPE by recursive DuckDB queries inside each task: token ids out of texts, and texts out of token ids.

The ranks of a vocabulary file become two small tables: a token's bytes by id, and each pair of tokens whose joined
bytes are a token. A task cuts its texts into words by the vocabulary's pattern and lays the bytes of its different words
out as rows (word, position, token). A recursive query joins neighbouring rows with the pair table and contracts each
word's leftmost pair of least rank until no pair is left; a word that is a token itself is that token at once. Words of
more than LONG bytes are cut where no token spans the two bytes, and what is still long is contracted pair by pair for
all its places in one step, unless a pair made on the way has a lesser rank (then only the leftmost place). Decoding
joins (text, position, id) with the tokens' bytes and aggregates them in order.

Only the vocabulary (bounded by its file) is broadcast; a query takes WORDS words, a worker remembers some KNOWN words; texts are worked on whole,
CHUNK bytes of them at a time.

Defined results: a null or empty text has no tokens and decodes to no bytes; texts of any length count whole; rows are
answered one by one, so repeated rows, ties and null ids change nothing; extra columns stay, and a new column gets as
many _ as it takes to differ from them; an empty table gives no rows. Ids that the vocabulary lacks are an error.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, pieces, released, spread, table, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, LONG, KNOWN, WORDS = 4 << 20, 64, 400_000, 65_536

#: Words of at most LONG bytes: k is word << 20 | position; one pair of every word goes in each step.
MERGE_SHORT = """
WITH RECURSIVE state(k, tok, step) AS (
  SELECT k, tok, 0 FROM letters
  UNION ALL (
    WITH near AS (SELECT k, tok, step, lead(tok) OVER o AS nxt, lead(k) OVER o AS after, lag(k) OVER o AS before FROM state WINDOW o AS (ORDER BY k)),
    best AS (
      SELECT k >> 20 AS word, min((p.id::BIGINT << 20) | (k & 1048575)) AS b FROM near JOIN pair p ON p.lr = (tok::BIGINT << 32 | nxt)
      WHERE after >> 20 = k >> 20 GROUP BY 1
    )
    SELECT k, CASE WHEN k = (word << 20 | (b & 1048575)) THEN (b >> 20)::INT ELSE tok END, step + 1
    FROM near JOIN best ON k >> 20 = word WHERE before IS DISTINCT FROM (word << 20 | (b & 1048575))
  )
)
SELECT k, tok, step FROM state
"""
#: Words of any length: all places of the word's best pair go in one step where that is safe. A row without token is gone.
MERGE_LONG = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM letters
  UNION ALL (
    WITH near AS (
      SELECT word, pos, tok, row_number() OVER o AS i, lag(tok) OVER o AS prev, lead(tok) OVER o AS nxt, lead(tok, 2) OVER o AS nxt2
      FROM state WHERE tok IS NOT NULL WINDOW o AS (PARTITION BY word ORDER BY pos)
    ),
    ranked AS (SELECT near.*, min(p.id) OVER (PARTITION BY word) AS best, p.id FROM near LEFT JOIN pair p ON p.lr = (tok::BIGINT << 32 | nxt)),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY word ORDER BY i) AS run FROM ranked WHERE id = best),
    every_other AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY i) AS place FROM runs) WHERE place % 2 = 1),
    sides AS (SELECT *, CASE WHEN lag(i) OVER o = i - 2 THEN best ELSE prev END AS lhs FROM every_other WINDOW o AS (PARTITION BY word ORDER BY i)),
    risky AS (
      SELECT s.word, s.i, min(s.i) OVER (PARTITION BY s.word) AS first, bool_or(coalesce(a.id < s.best, false) OR coalesce(b.id < s.best, false)) OVER (PARTITION BY s.word) AS bad
      FROM sides s LEFT JOIN pair a ON a.lr = (s.lhs::BIGINT << 32 | s.best) LEFT JOIN pair b ON b.lr = (s.best::BIGINT << 32 | s.nxt2)
    ),
    go AS (SELECT word, i FROM risky WHERE NOT bad OR i = first)
    SELECT r.word, r.pos, CASE WHEN e.i IS NOT NULL THEN NULL WHEN g.i IS NOT NULL THEN r.best ELSE r.tok END
    FROM ranked r LEFT JOIN go g ON g.word = r.word AND g.i = r.i LEFT JOIN go e ON e.word = r.word AND e.i = r.i - 1
    WHERE r.best IS NOT NULL
  )
)
SELECT word, pos, tok FROM state WHERE tok IS NOT NULL
"""
DECODE = "SELECT doc, from_hex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM ids JOIN token USING (id) GROUP BY doc ORDER BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens: lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """The tables of a vocabulary in this process's DuckDB, and the words it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks, self.known = ranks, {}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        self.spanned = np.zeros(65536, bool)  # byte pairs inside a token
        whole = np.frombuffer(b"".join(ranks), np.uint8).astype(np.int64)
        inside = np.ones(max(len(whole) - 1, 0), bool)
        inside[np.cumsum([len(t) for t in ranks])[:-1] - 1] = False
        self.spanned[(whole[:-1] * 256 + whole[1:])[inside]] = True
        pairs = np.array([(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], np.int64).reshape(-1, 2)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.gettempdir(), "preserve_insertion_order": False})
        self._table("pair", lr=pairs[:, 0], id=pairs[:, 1].astype(np.int32))
        self._table("token", id=np.array(list(ranks.values()), np.int32), hex=[t.hex() for t in ranks])

    def _table(self, name: str, **columns) -> None:
        self.db.register("columns_of", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM columns_of")
        self.db.unregister("columns_of")

    def _merged(self, words: list[bytes], query: str) -> list[bytes]:
        """Each word's ids, packed."""
        length = np.array([len(w) for w in words], np.int64)
        word, pos = np.repeat(np.arange(len(words)), length), spread(np.zeros(len(words)), length)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        self._table("letters", tok=tok, **({"k": word << 20 | pos} if query is MERGE_SHORT else {"word": word, "pos": pos}))
        got = self.db.sql(query).fetchnumpy()
        word, pos, tok = (got["k"] >> 20, got["k"], got["tok"]) if query is MERGE_SHORT else (got["word"], got["pos"], got["tok"])
        if query is MERGE_SHORT:  # a word's last step is its fixpoint
            last = np.zeros(len(words), got["step"].dtype)
            np.maximum.at(last, word, got["step"])
            here = got["step"] == last[word]
            word, pos, tok = word[here], pos[here], tok[here]
        order = np.lexsort((pos, word))
        flat = np.asarray(tok[order], np.int32).tobytes()
        ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]) * 4
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _cut(self, word: bytes) -> list[bytes]:
        """The parts of a word between which no token lies."""
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(~self.spanned[b[:-1] * 256 + b[1:]]) + 1, [len(b)]])
        return [word[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed as 32-bit integers."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        parts: dict[bytes, bytes] = {}
        for b in raw:
            if b not in self.ranks:
                for part in [b] if len(b) <= LONG else self._cut(b):
                    parts[part] = b""
        for some, query in (([p for p in parts if len(p) <= LONG], MERGE_SHORT), ([p for p in parts if len(p) > LONG], MERGE_LONG)):
            for i in range(0, len(some), WORDS):
                parts.update(zip(some[i : i + WORDS], self._merged(some[i : i + WORDS], query), strict=True))
        here = {}
        for w, b in zip(new, raw, strict=True):
            rank = self.ranks.get(b)
            here[w] = rank.to_bytes(4, "little") if rank is not None else parts[b] if len(b) <= LONG else b"".join(parts[p] for p in self._cut(b))
        out = [here[w] if w in here else self.known[w] for w in words]
        self.known.update((w, ids) for w, ids in here.items() if len(ids) <= 4 * LONG)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text starts and the last one ends."""
        found = [self.pattern.findall(text) for text in texts]
        counts = [len(x) for x in found]
        seen = pa.array(list(chain.from_iterable(found)), pa.large_string()).dictionary_encode()
        code = np.asarray(seen.indices)
        packed = self.words(seen.dictionary.to_pylist())
        length = np.array([len(x) // 4 for x in packed], np.int64)
        flat = np.frombuffer(b"".join(packed), np.int32)
        ids = flat[spread((np.cumsum(length) - length)[code], length[code])] if len(code) else flat
        word_ends = np.concatenate([[0], np.cumsum(length[code])]) if len(code) else np.zeros(1, np.int64)
        return ids, word_ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Each text's bytes."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id that the vocabulary lacks")
        length = np.diff(ends)
        self._table("ids", doc=np.repeat(np.arange(len(length)), length), pos=np.arange(len(ids)), id=ids)
        got = self.db.sql(DECODE).to_arrow_table()
        out = [b""] * len(length)
        for doc, text in zip(got.column("doc").to_pylist(), got.column("bytes").to_pylist(), strict=True):
            out[doc] = text
        return out


@lru_cache(maxsize=2)
def _opened(shared: Broadcast, pattern: str) -> Vocabulary:
    return Vocabulary(shared.value, pattern)


class Tokenizer:
    """A vocabulary on its way to the workers."""

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str | None = None):
        import public_tokenizers as P

        self.shared = spark.sparkContext.broadcast(read_ranks(path or P.path(VOCABULARY)))
        self.pattern = pattern or P.PATTERN

    def open(self) -> Vocabulary:
        return _opened(self.shared, self.pattern)


def _lots(batch: pa.RecordBatch, text: str) -> Iterator[pa.Table]:
    tab = pa.Table.from_batches([batch])
    _, starts, ends = texts_of(tab, text)
    for i, j in pieces(starts, ends, CHUNK):
        yield tab.slice(i, j - i)


def encode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with an array column of token ids."""
    name = free_name(name, docs.columns)
    return _added(docs, tokenizer, text, [T.StructField(name, T.ArrayType(T.IntegerType()))], lambda v, texts: [_lists(*v.encode(texts))])


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def _added(docs: DataFrame, tokenizer: Tokenizer, text: str, fields: list[T.StructField], work) -> DataFrame:
    """docs with columns that follow from the texts of a lot."""

    @released
    def run(batches):
        vocabulary = tokenizer.open()
        for batch in batches:
            for tab in _lots(batch, text):
                for field, column in zip(fields, work(vocabulary, [t or "" for t in tab.column(text).to_pylist()]), strict=True):
                    tab = tab.append_column(field.name, column)
                yield from tab.to_batches()

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + fields))


def decode(docs: DataFrame, tokenizer: Tokenizer, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """docs with a binary column: the bytes of the ids (none where there are none)."""
    name = free_name(name, docs.columns)
    schema = T.StructType(docs.schema.fields + [T.StructField(name, T.BinaryType())])

    @released
    def run(batches):
        vocabulary = tokenizer.open()
        for batch in batches:
            tab = pa.Table.from_batches([batch])
            length = np.array([len(x or ()) for x in tab.column(ids)], np.int64)
            for i, j in pieces(np.cumsum(length) - length, np.cumsum(length), CHUNK // 4):
                some = tab.slice(i, j - i)
                lists = some.column(ids).combine_chunks()
                flat = np.asarray(lists.flatten().cast(pa.int32()), np.int32)
                texts = vocabulary.decode(flat, np.concatenate([[0], np.cumsum(length[i:j])]))
                yield from some.append_column(name, pa.array(texts, pa.binary())).to_batches()

    return docs.mapInArrow(run, schema)


def both_ways(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """docs with n_tokens, and digests of the ids (decimal, joined by commas) and of the bytes that they decode to; both ways in one task."""
    names = [free_name(c, docs.columns) for c in ("n_tokens", "ids_sha256", "decoded_sha256")]

    def digests(vocabulary: Vocabulary, texts: list[str]) -> list[pa.Array]:
        ids, ends = vocabulary.encode(texts)
        numbers = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids).cast(pa.string())), ",")
        sha = lambda rows: pa.array([sha256(x).hexdigest() for x in rows])
        return [pa.array(np.diff(ends), pa.int64()), sha(numbers.cast(pa.binary()).to_pylist()), sha(vocabulary.decode(ids, ends))]

    return _added(docs, tokenizer, text, [T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.StringType(), T.StringType()), strict=True)], digests)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens each whole text of documents has, and digests of its ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return both_ways(docs, Tokenizer(spark)).drop("text")
