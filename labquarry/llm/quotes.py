"""Quotation linking: conversations in reply order, without the quotes, in DataFrame functions only.

A line's quote level is the number of `>` it starts with. A passage is a line, or a run of lines of one level with
none blank among them; it is normalised (lower case, white space as single spaces) and hashed. A quoted passage is
joined to the earliest message of its conversation that has it as its own words. A message replies to the one that its
least nested quotes come from; following replies upwards gives the thread. In reply order a conversation's threads
follow by the turn of their first message, and in a thread every message comes after the one it replies to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, numbered, read, stored

QUOTED = r"(?m)^[\x20\t]*>"
MARKS = r"^(?:[\x20\t]*>)+"
#: A line that says who wrote what is quoted next; it is no one's own words.
ATTRIBUTION = r"(?i)^[\x20\t]*(on|am|le|el) .*(wrote|schrieb.*|a écrit|escribió)[\x20\t]*:[\x20\t]*$"


def _lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, of, i, level, line, norm) of each line; `of` tells apart rows of one turn."""
    rows = messages.select("conv_id", "turn", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    rest = F.regexp_replace("line", MARKS, "")
    rows = rows.withColumns({"level": F.length(F.regexp_replace(marks, "[^>]", "")), "norm": F.lower(F.trim(F.regexp_replace(rest, r"[\x20\t\r]+", " ")))})
    order = Window.partitionBy("conv_id", "turn", "of").orderBy("i")
    said = (F.col("level") == 0) & F.col("line").rlike(ATTRIBUTION) & (F.lead("level").over(order) > 0)
    return rows.withColumn("said", F.coalesce(said, F.lit(False)))


def _passages(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, weight): each line that is not blank, and each run of two lines or more."""
    key = ["conv_id", "turn", "of"]
    lines = lines.where("not said")
    order = Window.partitionBy(*key).orderBy("i")
    blank = F.col("norm") == ""
    starts = blank | F.coalesce(F.lag("level").over(order) != F.col("level"), F.lit(True)) | F.coalesce(F.lag("norm").over(order) == "", F.lit(True))
    runs = lines.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(order)).where(~blank)
    single = runs.select("conv_id", "turn", "level", F.xxhash64("norm").alias("hash"), F.lit(1).alias("weight"))
    # A run is part of one message.
    whole = runs.groupBy(*key, "run", "level").agg(F.array_sort(F.collect_list(F.struct("i", "norm"))).alias("all"))
    whole = whole.where(F.size("all") > 1).select("conv_id", "turn", "level", F.xxhash64(F.array_join(F.col("all.norm"), " ")).alias("hash"), F.size("all").alias("weight"))
    return single.union(whole)


def _ancestors(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) for parents (conv_id, turn, parent_turn): pointers double until all are roots."""
    now = stored(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("depth")))
    while True:
        higher = now.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        joined = now.join(higher, (F.col("conv_id") == F.col("_c")) & (F.col("up") == F.col("_t")), "left")
        if joined.where("_t is not null").isEmpty():
            return now.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")
        after = stored(joined.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
        drop_stored(now)
        now = after


def threads(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with the quotes and attributions out of the text, and

    n_quotes: lines quoted; n_linked: those of them, and runs of them, found in an earlier message; parent_turn: the
    message replied to, null if none; root_turn and depth: the thread's first message and the steps to it; position: the
    place in reply order, gapless from 0.

    A message is known by conversation and turn; rows that share both share their links, and each keeps its text.
    Messages without a conversation or a turn link with nothing and have null root_turn, depth and position. Null and
    empty texts quote nothing and stay. Further columns are ignored; an empty table gives an empty result.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    quotes = F.coalesce(F.col("text").rlike(QUOTED), F.lit(False))
    quoting = m.where(quotes)
    known = m.where("conv_id is not null and turn is not null and text is not null")
    concerned = known.join(quoting.where("conv_id is not null").select(F.col("conv_id").alias("_c")).distinct(), F.col("conv_id") == F.col("_c"), "left_semi")
    passages = stored(_passages(_lines(concerned)))
    # One row for each passage of a conversation: the earliest message that says it.
    first = passages.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("said_turn"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h"), "said_turn")
    quoted = passages.where("level > 0")
    linked = quoted.join(first, (F.col("conv_id") == F.col("_c")) & (F.col("hash") == F.col("_h")) & (F.col("said_turn") < F.col("turn")))
    by_message = linked.groupBy("conv_id", "turn", "said_turn").agg(F.min("level").alias("level"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "weight", "said_turn"))["said_turn"]
    parents = stored(by_message.groupBy("conv_id", "turn").agg(best.alias("parent_turn"), F.sum("n").alias("n_linked")))
    above = _ancestors(parents).select(F.col("conv_id").alias("_ac"), F.col("turn").alias("_at"), "root_turn", "depth")
    links = parents.select(F.col("conv_id").alias("_pc"), F.col("turn").alias("_pt"), "parent_turn", "n_linked")
    links = stored(links.join(above, (F.col("_pc") == F.col("_ac")) & (F.col("_pt") == F.col("_at"))).drop("_ac", "_at"))
    lines = F.split(F.col("text"), "\n")
    # A line goes if it is quoted, or if it says who wrote the quote that follows.
    own = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("next"))), lambda p: ~p["x"].rlike(QUOTED) & ~(p["x"].rlike(ATTRIBUTION) & p["next"].rlike(QUOTED)))
    clean = F.regexp_replace(F.array_join(F.transform(own, lambda p: p["x"]), "\n"), r"^[\x20\t\r\n]+|[\x20\t\r\n]+$", "")
    n_quotes = F.size(F.filter(lines, lambda x: x.rlike(QUOTED)))
    out = m.withColumns({"n_quotes": F.when(quotes, n_quotes).otherwise(0).cast("long"), "text": F.when(quotes, clean).otherwise(F.col("text"))})
    out = out.join(links, (F.col("conv_id") == F.col("_pc")) & (F.col("turn") == F.col("_pt")), "left").drop("_pc", "_pt")
    in_order = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    out = out.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "root_turn": F.when(in_order, F.coalesce("root_turn", "turn")), "depth": F.when(in_order, F.coalesce("depth", F.lit(0)))})
    # _text orders rows that share their turn and role.
    out = stored(out.withColumns({"_text": F.xxhash64("text"), "_in_order": in_order}))
    placed = numbered(out.where("_in_order"), ["conv_id"], ["root_turn", "turn", "role", "_text"], "position")
    rest = out.where("not _in_order").withColumn("position", F.lit(None).cast("long"))
    return placed.union(rest).drop("_text", "_in_order")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(read(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, i, l[i] AS line,
         length(regexp_replace(regexp_extract(l[i], '^([ \t]*>)+', 0), '[^>]', '', 'g')) AS level,
         lower(trim(regexp_replace(regexp_replace(l[i], '^([ \t]*>)+', ''), '[ \t\r]+', ' ', 'g'))) AS norm
  FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations))
), told AS (
  SELECT *, level = 0 AND regexp_matches(line, '(?i)^[ \t]*(on|am|le|el) .*(wrote|schrieb.*|a écrit|escribió)[ \t]*:[ \t]*$')
         AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) > 0 AS said
  FROM lines
), marked AS (
  SELECT *, CASE WHEN norm = '' OR coalesce(lag(level) OVER w, -1) <> level OR coalesce(lag(norm) OVER w, '') = '' THEN 1 ELSE 0 END AS starts
  FROM told WHERE NOT said WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM marked
), passages AS (
  SELECT conv_id, turn, level, norm AS passage, 1 AS weight FROM runs WHERE norm <> ''
  UNION ALL
  SELECT conv_id, turn, level, string_agg(norm, ' ' ORDER BY i), count(*) FROM runs WHERE norm <> ''
  GROUP BY conv_id, turn, run, level HAVING count(*) > 1
), firsts AS (
  SELECT conv_id, passage, min(turn) AS said_turn FROM passages WHERE level = 0 GROUP BY 1, 2
), by_message AS (
  SELECT q.conv_id, q.turn, f.said_turn, min(q.level) AS level, sum(q.weight) AS weight, count(*) AS n
  FROM passages q JOIN firsts f ON q.conv_id = f.conv_id AND q.passage = f.passage AND f.said_turn < q.turn
  WHERE q.level > 0 GROUP BY 1, 2, 3
), parents AS (
  SELECT conv_id, turn, said_turn AS parent_turn, n_linked FROM (
    SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS n_linked,
           row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, weight DESC, said_turn DESC) AS r FROM by_message)
  WHERE r = 1
), up AS (
  SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM parents
  UNION ALL
  SELECT u.conv_id, u.turn, p.parent_turn, u.depth + 1 FROM up u JOIN parents p ON p.conv_id = u.conv_id AND p.turn = u.root_turn
), tops AS (
  SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM up GROUP BY 1, 2
), clean AS (
  SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quotes,
         regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT said), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS text
  FROM told GROUP BY 1, 2
), rows AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN coalesce(k.n_quotes, 0) > 0 THEN k.text ELSE c.text END AS text,
         CAST(coalesce(k.n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(p.n_linked, 0) AS BIGINT) AS n_linked,
         p.parent_turn, coalesce(t.root_turn, c.turn) AS root_turn, CAST(coalesce(t.depth, 0) AS INTEGER) AS depth
  FROM conversations c LEFT JOIN clean k ON k.conv_id = c.conv_id AND k.turn = c.turn
  LEFT JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.turn
  LEFT JOIN tops t ON t.conv_id = c.conv_id AND t.turn = c.turn
)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn, turn, role, text) - 1 AS position FROM rows
"""
