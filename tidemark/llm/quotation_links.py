"""Chat formatting by quotation linking, in DataFrame expressions only.

A message's lines have a quote level: the number of ``>`` before their text.  Lines of one level without a blank line
between them are a passage.  Quoted passages, normalised and hashed, are joined to the message of the same
conversation that first says them in its own words: as its whole text, as a passage, or as consecutive lines of its own.  The latest message
so linked at the first level (else at any level) is what a message replies to.  Threads come from pointer doubling,
a join for each doubling of the depth; (root_turn, turn) is reply order, since a reply's turn is larger.

Runs of lines are hashed for the numbers of lines that quotes have (a set of small numbers, no larger than the longest quote), so
quotes and originals meet by equal hashes and no pairs of lines are made.  Messages are parsed once, and stored as hashes.
The originals are reduced to one row for each conversation and passage before they are joined, so that a line that
all messages share is one row.  No window or list holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .session import stored

PREFIX = r"^((?:[ \t]*>)+)"
ATTRIBUTION = r"^On .+ wrote:\s*$"


def _lines(text: Column) -> Column:
    """level (-1: blank), raw and norm of each line."""
    def line(raw: Column) -> Column:
        prefix = F.regexp_extract(raw, PREFIX, 1)
        norm = F.lower(F.trim(F.regexp_replace(F.substring(raw, F.length(prefix) + 1, F.length(raw)), r"\s+", " ")))
        level = F.length(F.regexp_replace(prefix, "[^>]", ""))
        return F.struct(F.when(norm == "", -1).otherwise(level).alias("level"), level.alias("depth"), raw.alias("raw"), norm.alias("norm"))

    return F.transform(F.split(text, "\r?\n"), line)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, passages (level, norm) and own lines of every row, and body: the text without quotes."""
    rows = messages.select("conv_id", "turn", "role", "text", _lines(F.col("text")).alias("lines"))
    n = F.size("lines")
    at = F.sequence(F.lit(0), n - 1)
    heads = F.filter(at, lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    rows = rows.withColumn("heads", F.when(n > 0, heads))
    follows = lambda i: F.coalesce(F.get("lines", i + 1)["depth"] > 0, F.lit(False))
    # an attribution line belongs to the quote below it
    own = F.filter("lines", lambda x, i: (x["depth"] == 0) & ~(x["raw"].rlike(ATTRIBUTION) & follows(i)))
    quoted = F.exists("lines", lambda x: x["depth"] > 0)
    rows = rows.withColumn("own", own).withColumn("quoted", F.coalesce(quoted, F.lit(False)))
    body = F.regexp_replace(F.array_join(F.transform("own", lambda x: x["raw"]), "\n"), r"^\s+|\s+$", "")
    passages = F.transform(
        F.sequence(F.lit(0), F.size("heads") - 1),
        lambda k: F.struct(
            F.get("lines", F.get("heads", k))["level"].alias("level"), (F.coalesce(F.get("heads", k + 1), n) - F.get("heads", k)).alias("n"),
            F.transform(F.slice("lines", F.get("heads", k) + 1, F.coalesce(F.get("heads", k + 1), n) - F.get("heads", k)), lambda x: x["norm"]).alias("norms"),
        ),
    )
    rows = rows.select(
        "conv_id", "turn", "role", F.when(F.col("quoted"), body).otherwise(F.col("text")).alias("body"), F.filter(passages, lambda p: p["level"] >= 0).alias("passages"),
        F.filter(F.transform("own", lambda x: x["norm"]), lambda x: x != "").alias("own"),
    )
    whole = lambda norms: F.xxhash64(F.array_join(norms, " "))
    quotes = F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: F.struct(p["level"].alias("level"), p["n"].alias("n"), whole(p["norms"]).alias("whole"), F.xxhash64(F.transform(p["norms"], lambda x: F.xxhash64(x))).alias("lines")))
    said = F.concat(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: whole(p["norms"])), F.array(whole(F.col("own"))))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.select(
        "conv_id", "turn", "role", "body", F.coalesce(quotes, none("struct<level:int,n:int,whole:long,lines:long>")).alias("quotes"),
        F.coalesce(F.array_distinct(said), none("long")).alias("said"), F.coalesce(F.transform("own", lambda x: F.xxhash64(x)), none("long")).alias("own"),
    )


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level and original: a row for each different quoted passage of a message that has an original."""
    quotes = rows.select("conv_id", "turn", F.inline("quotes")).distinct()
    sizes = sorted(r["n"] for r in quotes.select("n").distinct().collect())
    none = F.array()

    def runs_of(n: int) -> Column:
        at = F.when(F.size("own") >= n, F.sequence(F.lit(1), F.size("own") - (n - 1))).otherwise(none.cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.slice("own", i, n)))

    runs = F.flatten(F.array(*map(runs_of, sizes))) if sizes else none.cast("array<long>")
    kinds = (("whole", F.col("said")), ("lines", F.array_distinct(runs)))
    for name, said in kinds:
        own = rows.select("conv_id", "turn", F.explode(said).alias(name)).groupBy("conv_id", name).agg(F.min("turn").alias(f"first_{name}"))
        quotes = quotes.join(own.join(quotes.select("conv_id", name).distinct(), ["conv_id", name], "left_semi"), ["conv_id", name], "left")
    first = F.least(*(F.when(F.col(f"first_{name}") < F.col("turn"), F.col(f"first_{name}")) for name, _ in kinds))
    return quotes.select("conv_id", "turn", "level", first.alias("original")).where("original is not null")


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn and depth of every message with a parent."""
    state = stored(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("steps")), "quote-threads")
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        step = state.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"))
        step = stored(step, "quote-threads")
        state = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return state.select("conv_id", "turn", F.col("up").alias("root_turn"), F.col("steps").alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """A row for each message, without its quotes: conv_id, turn, role, body, n_quotes, n_linked, parent_turn,
    root_turn, depth and formatted (role and body).

    A null text has a null body and no quotes.  Rows with a null conv_id or turn are linked to nothing.  Rows that
    share conv_id and turn are one message of a thread, which replies to the latest that any of them quotes.
    Repeated rows give repeated results.  Texts of any length are read whole.  Other columns aren't read.
    """
    rows = stored(parsed(messages), "quote-messages")
    found = stored(links(rows), "quote-links")
    first = F.max(F.when(F.col("level") == 1, F.col("original")))
    parents = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.coalesce(first, F.max("original")).alias("parent_turn"))
    parents = stored(parents, "quote-parents")
    known = parents.join(threads(parents), ["conv_id", "turn"])
    return rows.withColumn("n_quotes", F.size("quotes").cast("long")).join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("body", F.lit(""))).alias("formatted"),
    )


def assembled(found: DataFrame, turns: int = 1000) -> DataFrame:
    """conv_id, root_turn, part and text: the messages of each thread of :func:`conversations` in reply order, without quotes.

    A reply's turn is larger than that of the message it replies to, so turns are reply order.  A part holds the messages of
    ``turns`` turns, so that no row holds a conversation of any length.  Messages without a turn stand last, those without a body are empty.
    """
    part = F.floor(F.col("turn") / turns).alias("part")
    lines = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "formatted")))
    return found.groupBy("conv_id", "root_turn", part).agg(F.array_join(F.transform(lines, lambda m: m["formatted"]), "\n").alias("text"))


ORACLE_SQL = r"""
WITH RECURSIVE raws AS (
  SELECT row_number() OVER () AS m, conv_id, turn, role, text FROM conversations
), lines AS (
  SELECT m, i, l AS raw, regexp_extract(l, '^((?:[ \t]*>)+)', 1) AS prefix
  FROM (SELECT m, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (SELECT m, regexp_split_to_array(text, '\r?\n') AS ls FROM raws WHERE text IS NOT NULL))
), leveled AS (
  SELECT m, i, raw, length(regexp_replace(prefix, '[^>]', '', 'g')) AS depth, lower(trim(regexp_replace(substr(raw, length(prefix) + 1), '\s+', ' ', 'g'))) AS norm FROM lines
), marked AS (
  SELECT *, CASE WHEN norm = '' THEN -1 ELSE depth END AS level, coalesce(lead(depth) OVER (PARTITION BY m ORDER BY i) > 0, false) AS above FROM leveled
), numbered AS (
  SELECT *, sum(turned) OVER (PARTITION BY m ORDER BY i) AS block FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY m ORDER BY i) THEN 1 ELSE 0 END AS turned FROM marked)
), passages AS (
  SELECT m, level, string_agg(norm, ' ' ORDER BY i) AS norm, list(norm ORDER BY i) AS norms FROM numbered WHERE level >= 0 GROUP BY m, block, level
), own AS (
  SELECT m, i, raw, norm FROM marked WHERE depth = 0 AND NOT (regexp_matches(raw, '^On .+ wrote:\s*$') AND above)
), bodies AS (
  SELECT m, regexp_replace(string_agg(raw, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS body, string_agg(norm, ' ' ORDER BY i) FILTER (norm <> '') AS whole FROM own GROUP BY m
), quoted AS (
  SELECT m, count(*) FILTER (level > 0) AS n_quotes FROM passages GROUP BY m
), hasquote AS (
  SELECT m, bool_or(depth > 0) AS q FROM leveled GROUP BY m
), said AS (
  SELECT m, norm FROM passages WHERE level = 0 UNION SELECT m, coalesce(whole, '') FROM bodies
), originals AS (
  SELECT conv_id, norm, min(turn) AS original FROM said JOIN raws USING (m) WHERE conv_id IS NOT NULL GROUP BY conv_id, norm
), owned AS (
  SELECT m, list(norm ORDER BY i) FILTER (norm <> '') AS ls FROM own GROUP BY m
), starts AS (
  SELECT m, ls, n, unnest(range(1, len(ls) - n + 2)) AS i FROM owned, (SELECT DISTINCT len(norms) AS n FROM passages WHERE level > 0) WHERE len(ls) >= n
), runs AS (
  SELECT conv_id, ls[i : i + n - 1] AS norms, min(turn) AS run FROM starts JOIN raws USING (m) WHERE conv_id IS NOT NULL GROUP BY ALL
), links AS (
  SELECT conv_id, turn, level, norm, norms, least(CASE WHEN original < turn THEN original END, CASE WHEN run < turn THEN run END) AS original
  FROM (SELECT DISTINCT conv_id, turn, level, norm, norms FROM passages JOIN raws USING (m) WHERE level > 0) LEFT JOIN originals USING (conv_id, norm) LEFT JOIN runs USING (conv_id, norms)
  WHERE least(CASE WHEN original < turn THEN original END, CASE WHEN run < turn THEN run END) IS NOT NULL
), parents AS (
  SELECT conv_id, turn, count(*) AS n_linked, coalesce(max(original) FILTER (level = 1), max(original)) AS parent_turn FROM links GROUP BY conv_id, turn
), walk AS (
  SELECT conv_id, turn, parent_turn AS up, 1 AS depth FROM parents
  UNION ALL
  SELECT w.conv_id, w.turn, p.parent_turn, w.depth + 1 FROM walk w JOIN parents p ON p.conv_id = w.conv_id AND p.turn = w.up
), threads AS (
  SELECT conv_id, turn, min(up) AS root_turn, max(depth) AS depth FROM walk GROUP BY conv_id, turn
)
SELECT r.conv_id, r.turn, r.role, CASE WHEN coalesce(h.q, false) THEN coalesce(b.body, '') ELSE r.text END AS body, coalesce(q.n_quotes, 0)::BIGINT AS n_quotes, coalesce(p.n_linked, 0)::BIGINT AS n_linked,
  p.parent_turn, coalesce(t.root_turn, r.turn) AS root_turn, coalesce(t.depth, 0)::BIGINT AS depth,
  '<|' || coalesce(r.role, '') || '|>' || chr(10) || coalesce(CASE WHEN coalesce(h.q, false) THEN coalesce(b.body, '') ELSE r.text END, '') AS formatted
FROM raws r LEFT JOIN hasquote h USING (m) LEFT JOIN bodies b USING (m) LEFT JOIN quoted q USING (m)
LEFT JOIN parents p ON p.conv_id = r.conv_id AND p.turn = r.turn LEFT JOIN threads t ON t.conv_id = r.conv_id AND t.turn = r.turn
"""
