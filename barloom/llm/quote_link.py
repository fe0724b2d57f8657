"""Chat formatting: link quoted passages to the messages they quote, give each message without its quotes, in reply order.

Native: DataFrame functions only. A line's quote level is the number of > in its prefix. Lines of one level that follow
one another are a run, and its stretches between blank lines passages. Passages, runs and lines are normalised (A-Z
lower-cased, line breaks and other white space runs one space) and hashed, so a quote that was wrapped anew has the hash
of what it quotes. A message's own passages, lines and whole text (level 0) are hashed alike and joined: a quoted
passage comes from the first message of its conversation that wrote it, else that wrote its whole run, else from the
latest of those that wrote one of its lines. A message replies to the latest origin of its shallowest linked passages,
else to the turn before it. All of these are earlier turns, so `position`, the number of messages of the conversation at
earlier turns and one, puts no message before the one it replies to.

Defined results: null text is empty; rows without conv_id or turn keep their place but link to nothing and have no
position; repeated rows each give a row, at one position; a passage quoted before anyone wrote it stays unlinked; a
message of quotes only has an empty body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX, QUOTED = r"^(?:[ \t]*>)+", r"(?:^|\n)[ \t]*>"
KEY = ["conv_id", "turn", "digest"]
#: Parts that equal keys are split into where they meet one row; turns of a conversation that are counted at once.
PARTS, TURNS = 16, 1024


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def _norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(line, PREFIX, ""), UPPER, LOWER), r"[ \t\r\n\f\x0B]+", " "))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\n", -1), lambda x: F.struct(_level(x).alias("level"), _norm(x).alias("words")))


def _cut(lines: Column, starts: Column) -> Column:
    """The lines from each start (from 1) up to the next."""
    return F.transform(starts, lambda s, k: F.slice(lines, s, F.coalesce(F.get(starts, k + 1), F.size(lines) + 1) - s))


def _starts(lines: Column, new) -> Column:
    """Places (from 1) where a part begins: the first, and those where new(line before, line)."""
    return F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | new(F.get(lines, i - 2), F.get(lines, i - 1)))


def _hash(lines: Column) -> Column:
    return F.xxhash64(F.array_join(F.filter(F.transform(lines, lambda x: x["words"]), lambda w: w != ""), " "))


def _passages(lines: Column) -> Column:
    """Of lines of one level those between blank ones, as arrays."""
    parts = _cut(lines, _starts(lines, lambda a, b: (a["words"] == "") != (b["words"] == "")))
    return F.filter(parts, lambda p: F.get(p, F.lit(0))["words"] != "")


def _runs(lines: Column) -> Column:
    return _cut(lines, _starts(lines, lambda a, b: a["level"] != b["level"]))


def _quotes(messages: DataFrame) -> DataFrame:
    """(KEY, place, level, rank, hash): what each quoted passage may be found by, the best rank first."""
    run = messages.select(*KEY, _lines(F.col("text")).alias("lines")).select(*KEY, F.posexplode(_runs(F.col("lines"))).alias("r", "run")).where(F.get("run", F.lit(0))["level"] > 0)
    passage = run.select(*KEY, "r", _hash(F.col("run")).alias("whole"), F.posexplode(_passages(F.col("run"))).alias("p", "passage"))
    keys = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), _hash(F.col("passage")).alias("hash")), F.struct(F.lit(1).alias("rank"), F.col("whole").alias("hash"))),
        F.array_distinct(F.transform("passage", lambda x: F.struct(F.lit(2).alias("rank"), F.xxhash64(x["words"]).alias("hash")))),
    )
    level = F.get("passage", F.lit(0))["level"].alias("level")
    return passage.select(*KEY, "r", "p", level, F.explode(keys).alias("k")).select(*KEY, "r", "p", "level", "k.rank", "k.hash")


def _own(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of what the messages wrote themselves: lines, passages, and all of it."""
    lines = messages.select("conv_id", "turn", _lines(F.col("text")).alias("lines"))
    own = lambda c: F.filter(c, lambda x: x["level"] == 0)
    runs = F.filter(_runs(F.col("lines")), lambda r: F.get(r, F.lit(0))["level"] == 0)
    passages = F.flatten(F.transform(runs, lambda r: F.transform(_passages(r), _hash)))
    single = F.transform(F.filter(own(F.col("lines")), lambda x: x["words"] != ""), lambda x: F.xxhash64(x["words"]))
    return lines.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(passages, single, F.array(_hash(own(F.col("lines"))))))).alias("hash"))


def _positions(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, position): counted per turn and per TURNS turns first, so no conversation comes into one task whole."""
    part = F.floor(F.col("turn") / TURNS).alias("part")
    turns = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn", part).agg(F.count("*").alias("n"))
    before = lambda *keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = turns.groupBy("conv_id", "part").agg(F.sum("n").alias("n")).select("conv_id", "part", before("conv_id", order="part").alias("earlier"))
    inside = turns.select("conv_id", "turn", "part", before("conv_id", "part", order="turn").alias("inside"))
    return inside.join(parts, ["conv_id", "part"]).select("conv_id", "turn", (F.col("earlier") + F.col("inside") + 1).alias("position"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, n_quoted, n_linked, reply_to, position)"""
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", "turn", "role", text.alias("text"), F.xxhash64(text).alias("digest"))
    quoting = rows.where(F.col("text").rlike(QUOTED))
    # equal messages ask once; what a passage hashes to meets its first author, so no passage or conversation makes a large group
    asked = _quotes(quoting.select(*KEY, "text").distinct())
    wanted = asked.select("conv_id", "hash").distinct()
    own = _own(rows.select("conv_id", "turn", "text").join(wanted.select("conv_id").distinct(), "conv_id", "left_semi"))
    first = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")).join(wanted, ["conv_id", "hash"])
    linked = asked.join(first, ["conv_id", "hash"]).where("origin < turn")
    same = [F.col("conv_id").eqNullSafe(F.col("c")), F.col("turn").eqNullSafe(F.col("t")), F.col("digest") == F.col("d")]
    best = linked.groupBy(*KEY, "r", "p", "level").agg(F.max(F.struct((-F.col("rank")).alias("rank"), "origin"))["origin"].alias("origin"))
    links = best.groupBy(*KEY).agg(F.count("*").alias("n_linked"), (-F.min(F.struct("level", (-F.col("origin")).alias("late")))["late"]).alias("origin"))
    quoted = asked.where("rank = 0").groupBy(*KEY).agg(F.count("*").alias("n_quoted"))
    quoted = quoted.join(links, KEY, "left").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d"), "n_quoted", "n_linked", "origin")
    # rows alike meet their links and position in parts
    lines = F.filter(F.split("text", r"\n", -1), lambda x: ~x.rlike(PREFIX))
    body = F.trim(F.array_join(lines, "\n"), F.lit(" \t\r\n"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("salt")
    zero = F.lit(0).cast("long")
    plain = rows.where(~F.col("text").rlike(QUOTED)).select("conv_id", "turn", "role", F.trim("text", F.lit(" \t\r\n")).alias("body"), zero.alias("n_quoted"), zero.alias("n_linked"), F.lit(None).cast("long").alias("origin"), salt)
    cited = quoting.select(*KEY, "role", body.alias("body"), salt).alias("q").join(_salted(quoted).withColumnRenamed("salt", "s"), [*same, F.col("salt") == F.col("s")], "left")
    cited = cited.select("conv_id", "turn", "role", "body", F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"), F.col("origin").cast("long").alias("origin"), "salt")
    before = F.when(F.col("turn") > 0, F.col("turn") - 1)
    placed = plain.unionByName(cited).join(_salted(_positions(rows)), ["conv_id", "turn", "salt"], "left")
    return placed.select("conv_id", "turn", "role", "body", "n_quoted", "n_linked", F.coalesce("origin", before).cast("long").alias("reply_to"), "position")


def query(spark, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH l AS (
  SELECT row_number() OVER () AS row_id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations
), e AS (
  SELECT row_id, conv_id, turn, i, lines[i] AS line, length(regexp_replace(regexp_extract(lines[i], '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(translate(regexp_replace(lines[i], '^(?:[ \t]*>)+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ') AS words
  FROM l, unnest(range(1, len(lines) + 1)) AS u(i)
), m AS (
  SELECT *, CASE WHEN level <> lag(level, 1, level) OVER w THEN 1 ELSE 0 END AS new_run,
         CASE WHEN level <> lag(level, 1, level) OVER w OR (words = '') <> (lag(words, 1, words) OVER w = '') THEN 1 ELSE 0 END AS new_part
  FROM e WINDOW w AS (PARTITION BY row_id ORDER BY i)
), n AS (
  SELECT *, sum(new_run) OVER w AS run, sum(new_part) OVER w AS part FROM m WINDOW w AS (PARTITION BY row_id ORDER BY i)
), runs AS (SELECT row_id, run, string_agg(words, ' ' ORDER BY i) AS words FROM n WHERE words <> '' GROUP BY ALL
), parts AS (SELECT row_id, conv_id, turn, run, part, level, string_agg(words, ' ' ORDER BY i) AS words FROM n WHERE words <> '' GROUP BY ALL
), own AS (
  SELECT conv_id, turn, words FROM n WHERE level = 0 AND words <> ''
  UNION ALL SELECT conv_id, turn, words FROM parts WHERE level = 0
  UNION ALL SELECT conv_id, turn, string_agg(words, ' ' ORDER BY i) FROM n WHERE level = 0 AND words <> '' GROUP BY row_id, conv_id, turn
), origin AS (SELECT conv_id, words, min(turn) AS origin FROM own GROUP BY ALL
), keys AS (
  SELECT row_id, conv_id, turn, part, level, 0 AS rank, words FROM parts WHERE level > 0
  UNION ALL SELECT p.row_id, conv_id, turn, part, level, 1, r.words FROM parts p JOIN runs r ON p.row_id = r.row_id AND p.run = r.run WHERE level > 0
  UNION ALL SELECT row_id, conv_id, turn, part, level, 2, words FROM n WHERE level > 0 AND words <> ''
), best AS (
  SELECT row_id, part, level, max_by(origin, (-rank, origin)) AS origin
  FROM keys JOIN origin USING (conv_id, words) WHERE origin < turn GROUP BY ALL
), linked AS (SELECT row_id, count(*) AS n_linked, arg_min(origin, (level, -origin)) AS origin FROM best GROUP BY ALL
), quoted AS (SELECT row_id, count(*) AS n_quoted FROM parts WHERE level > 0 GROUP BY ALL
), b AS (SELECT row_id, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), ' ' || chr(9) || chr(13) || chr(10)) AS body FROM e GROUP BY row_id
), turns AS (SELECT conv_id, turn, count(*) AS n FROM l WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), place AS (SELECT conv_id, turn, 1 + coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM turns)
SELECT l.conv_id, l.turn, l.role, b.body, coalesce(quoted.n_quoted, 0)::BIGINT AS n_quoted, coalesce(linked.n_linked, 0)::BIGINT AS n_linked,
       coalesce(linked.origin, CASE WHEN l.turn > 0 THEN l.turn - 1 END)::BIGINT AS reply_to, place.position::BIGINT AS position
FROM l JOIN b USING (row_id) LEFT JOIN quoted USING (row_id) LEFT JOIN linked USING (row_id)
LEFT JOIN place ON l.conv_id = place.conv_id AND l.turn = place.turn
"""
