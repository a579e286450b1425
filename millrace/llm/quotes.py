"""Quotation linking for message threads, in DataFrame functions only.

Lines that open with quote marks form passages by nesting level; attribution
lines that lead to a quote go with it. Passages, their paragraphs, lines and
sentences are normalised and hashed, and so are the unquoted bodies of all
messages; sentences run over line ends, so a part that was wrapped anew still
meets its original. A quoted passage links to the latest earlier message of its
conversation that holds it, else to the first message elsewhere that does; a
short line or sentence links inside its conversation only.
Replies follow the message that they quote first: each message gets its thread's
root and its depth, found by pointer doubling, and its body without quotes.

Rows: null text is the empty message; a message without quotes has no parent
and is its own root; repeated (conversation, turn) rows are one message if
equal, and each keeps its row; rows without a conversation or turn keep their
body and have no links; texts are read whole; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm.shared import written

MARKS = r"^(?:[ \t]{0,3}>)+[ \t]?"
ATTRIBUTION = r"(?i)^[ \t]*(?:on .+ wrote:|.+ wrote:|am .+ schrieb.*:|le .+ a écrit ?:|el .+ escribió:)[ \t]*$"
#: Least characters of a normalised line or sentence that links to another conversation by itself.
LEAST_LINE = 16
#: Parts that a hash of very many conversations is joined in.
SALTS = 16


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\p{Punct}]+", " "))


def parsed_lines(text: Column) -> Column:
    """level and content of each line."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("content"))

    return F.transform(lines, line)


def passages(lines: Column) -> Column:
    """level and text of runs of lines of one level."""
    at = F.sequence(F.lit(1), F.size(lines))
    level = lambda i: F.element_at(lines, i).level
    starts = F.filter(at, lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))
    # each start with the next one, or the end
    bounds = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines) + 1)).alias("b"))
    return F.transform(bounds, lambda x: F.struct(level(x.a).alias("level"), F.array_join(F.transform(F.slice(lines, x.a, x.b - x.a), lambda y: y.content), "\n").alias("text")))


def units(text: Column) -> Column:
    """rank (0 whole, 1 paragraph, 2 line, 3 sentence), hash, and whether it may link to another conversation, of each normalised part."""

    def ranked(rank: int, parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(F.lit(rank).alias("rank"), normalised(p).alias("part")))

    every = F.concat(ranked(0, F.array(text)), ranked(1, F.split(text, r"\n[ \t]*\n")), ranked(2, F.split(text, "\n")), ranked(3, F.split(text, r"[.!?]+[ \t\n]+")))
    kept = F.filter(every, lambda u: u.part != "")
    return F.transform(kept, lambda u: F.struct(u["rank"].alias("rank"), F.sha2(u.part, 256).alias("hash"), ((u["rank"] < 2) | (F.length(u.part) >= LEAST_LINE)).alias("wide")))


def body_of(lines: Column) -> Column:
    """Unquoted lines, without attributions that stand before a quote."""
    at = F.sequence(F.lit(1), F.size(lines))
    line = lambda i: F.element_at(lines, i)
    leads = lambda i: line(i).content.rlike(ATTRIBUTION) & (F.try_element_at(lines, i + 1).level > 0)
    kept = F.filter(at, lambda i: (line(i).level == 0) & ~F.coalesce(leads(i), F.lit(False)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda i: line(i).content), "\n"), r"^\s+|\s+$", "")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv, turn, n (passage), level, rank, source_conv, source_turn of every quoted passage; sources are null where nothing matches."""
    quoted = F.coalesce(F.col(text), F.lit("")).contains(">")
    some = messages.where(quoted & F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("c"), F.col(turn).alias("t"), passages(parsed_lines(F.col(text))).alias("p")).distinct()
    quotes = some.select("c", "t", F.posexplode("p").alias("n", "q")).where("q.level > 0").select("c", "t", "n", "q.level", F.posexplode(units(F.col("q.text"))).alias("pos", "u")).select("c", "t", "n", "level", "pos", "u.rank", "u.hash", "u.wide")
    asked = written(quotes, "quotes")
    originals = messages.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.explode(units(body_of(parsed_lines(F.col(text))))).alias("u")).groupBy("c", "t", "u.hash").agg(F.max("u.wide").alias("wide"))
    wanted = asked.select("hash").distinct()
    originals = written(originals.join(wanted, "hash", "left_semi"), "originals")
    # the latest earlier message of the conversation: both sides in one order, no pairs
    both = originals.select("c", "hash", "t", F.lit(1).alias("from"), F.col("t").alias("src"), *[F.lit(None).cast(k).alias(x) for x, k in (("n", "int"), ("level", "int"), ("pos", "int"), ("rank", "int"), ("wide", "boolean"))]).unionByName(
        asked.select("c", "hash", "t", F.lit(0).alias("from"), F.lit(None).cast(dict(originals.dtypes)["t"]).alias("src"), "n", "level", "pos", "rank", "wide")
    )
    before = W.Window.partitionBy("hash", "c").orderBy("t", "from").rowsBetween(W.Window.unboundedPreceding, -1)
    near = both.withColumn("here", F.last("src", ignorenulls=True).over(before)).where("from = 0")
    broad = originals.where("wide")
    # the two least conversations of each hash: one of them is another than the asking one
    first = broad.groupBy("hash", "c").agg(F.min("t").alias("t"))
    low = first.groupBy("hash").agg(F.min(F.struct("c", "t")).alias("low"))
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    other = first.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"]).where(F.col("c") != F.col("low.c"))
    ends = low.join(other.groupBy("hash").agg(F.min(F.struct("c", "t")).alias("next")), "hash", "left")
    away = F.when(~F.col("wide"), None).when(F.col("low.c") != F.col("c"), F.col("low")).otherwise(F.col("next"))
    found = near.join(ends, "hash", "left").select("c", "t", "n", "level", "pos", "rank", F.when(F.col("here").isNotNull(), F.struct(F.col("c").alias("c"), F.col("here").alias("t"))).otherwise(away).alias("source"))
    best = found.groupBy("c", "t", "n").agg(F.first("level").alias("level"), F.min(F.when(F.col("source").isNotNull(), F.struct("rank", "pos", "source"))).alias("m"))
    return best.select(F.col("c").alias(conv), F.col("t").alias(turn), "n", "level", "m.rank", F.col("m.source.c").alias("source_conv"), F.col("m.source.t").alias("source_turn"))


def order_replies(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", keep: tuple[str, ...] = ("role",)) -> DataFrame:
    """Each message with its body without quotes, n_quotes, n_linked, parent_turn, the source of its first linked quote (least level, then place), root_turn and depth; sorted by conversation, thread and turn.

    Parents come before their replies. A sort by ranges of all three keys deals
    even one conversation with most of the messages to many tasks.
    """
    links = written(link_quotes(messages, conv, turn, text), "links")
    same = F.col("source_conv") == F.col(conv)
    facts = links.groupBy(conv, turn).agg(
        F.count("*").alias("n_quotes"), F.count("source_conv").alias("n_linked"),
        F.min(F.when(same, F.struct("level", "n", F.col("source_turn").alias("t")))).alias("p"),
        F.min(F.when(F.col("source_conv").isNotNull(), F.struct("level", "n", "source_conv", "source_turn"))).alias("s"),
    ).select(conv, turn, "n_quotes", "n_linked", F.col("p.t").alias("parent_turn"), "s.source_conv", "s.source_turn")
    facts = written(facts, "facts")
    now = written(facts.where("parent_turn is not null").select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:  # each round doubles the distance looked back: as many rounds as the depth has binary digits
        above = now.select("c", F.col("t").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        ahead = now.join(above, ["c", "up"], "left")
        if ahead.where("further is not null").isEmpty():
            break
        now = written(ahead.select("c", "t", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")
    roots = now.select(F.col("c").alias(conv), F.col("t").alias(turn), F.col("up").alias("root_turn"), "depth")
    body = messages.select(conv, turn, *keep, body_of(parsed_lines(F.col(text))).alias("body"))
    out = body.join(facts.join(roots, [conv, turn], "left"), [conv, turn], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(conv, turn, *keep, zero("n_quotes"), zero("n_linked"), "parent_turn", "source_conv", "source_turn", F.coalesce("root_turn", turn).alias("root_turn"), zero("depth"), "body").orderBy(conv, "root_turn", turn)


def oracle(source: str = "conversations") -> str:
    """The same in DuckDB's SQL, line by line; threads by a recursive walk."""
    part = r"trim(regexp_replace(lower({x}), '[\s\p{{P}}\p{{Z}}]+', ' ', 'g'))"
    units = lambda table, text, keys: f"""(SELECT {keys}, 0 AS rank, {part.format(x=text)} AS part, 0 AS pos FROM {table}
  UNION ALL SELECT {keys}, 1, {part.format(x='x')}, 1 + i FROM (SELECT {keys}, unnest(string_split_regex({text}, '\\n[ \\t]*\\n')) AS x, generate_subscripts(string_split_regex({text}, '\\n[ \\t]*\\n'), 1) AS i FROM {table})
  UNION ALL SELECT {keys}, 2, {part.format(x='x')}, 1000000 + i FROM (SELECT {keys}, unnest(string_split({text}, chr(10))) AS x, generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM {table})
  UNION ALL SELECT {keys}, 3, {part.format(x='x')}, 1000000000 + i FROM (SELECT {keys}, unnest(string_split_regex({text}, '[.!?]+[ \\t\\n]+')) AS x, generate_subscripts(string_split_regex({text}, '[.!?]+[ \\t\\n]+'), 1) AS i FROM {table}))"""  # noqa: E731
    attribution = ATTRIBUTION.replace("'", "''")
    return rf"""WITH RECURSIVE lines AS (SELECT conv_id, turn, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (
  SELECT DISTINCT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS a FROM {source})),
lv AS (SELECT conv_id, turn, i, length(regexp_replace(regexp_extract(line, '{MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(line, '{MARKS}', '') AS content FROM lines),
nx AS (SELECT *, coalesce(lead(level) OVER w, 0) AS nxt, CASE WHEN level <> coalesce(lag(level) OVER w, level) THEN 1 ELSE 0 END AS new FROM lv WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
body AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (nxt > 0 AND regexp_matches(content, '{attribution}'))), ''), '^\s+|\s+$', '', 'g') AS body FROM nx GROUP BY ALL),
pa AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM nx),
q AS (SELECT conv_id, turn, n, level, string_agg(content, chr(10) ORDER BY i) AS text FROM pa GROUP BY conv_id, turn, n, level HAVING level > 0),
o AS (SELECT conv_id, turn, part, bool_or(rank < 2 OR length(part) >= {LEAST_LINE}) AS wide FROM {units('body', 'body', 'conv_id, turn')} WHERE part <> '' GROUP BY ALL),
u AS (SELECT *, rank < 2 OR length(part) >= {LEAST_LINE} AS wide FROM {units('q', 'text', 'conv_id, turn, n, level')} WHERE part <> ''),
f AS (SELECT u.*, (SELECT max(o.turn) FROM o WHERE o.part = u.part AND o.conv_id = u.conv_id AND o.turn < u.turn) AS here, (SELECT min((o.conv_id, o.turn)) FROM o WHERE u.wide AND o.wide AND o.part = u.part AND o.conv_id <> u.conv_id) AS away FROM u),
b AS (SELECT conv_id, turn, n, level, coalesce(here IS NOT NULL, false) AS own, here, CASE WHEN here IS NOT NULL THEN (conv_id, here) ELSE away END AS source, row_number() OVER (PARTITION BY conv_id, turn, n ORDER BY here IS NULL AND away IS NULL, rank, pos) AS r, here IS NOT NULL OR away IS NOT NULL AS linked FROM f),
best AS (SELECT * FROM b WHERE r = 1),
facts AS (SELECT conv_id, turn, count(*) AS n_quotes, count(*) FILTER (linked) AS n_linked, arg_min(here, (level, n)) FILTER (own) AS parent_turn, arg_min(source, (level, n)) FILTER (linked) AS source FROM best GROUP BY ALL),
t AS (SELECT conv_id, turn, turn AS root_turn, 0::BIGINT AS depth FROM (SELECT DISTINCT conv_id, turn FROM {source}) m WHERE NOT EXISTS (SELECT 1 FROM facts x WHERE x.conv_id = m.conv_id AND x.turn = m.turn AND x.parent_turn IS NOT NULL)
  UNION ALL SELECT x.conv_id, x.turn, t.root_turn, t.depth + 1 FROM t JOIN facts x ON x.conv_id = t.conv_id AND x.parent_turn = t.turn)
SELECT m.conv_id, m.turn, m.role, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, parent_turn, facts.source[1] AS source_conv, facts.source[2] AS source_turn, t.root_turn, t.depth, body.body FROM {source} m
JOIN body ON body.conv_id = m.conv_id AND body.turn = m.turn JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn LEFT JOIN facts ON facts.conv_id = m.conv_id AND facts.turn = m.turn"""
