r"""Quotation linking (operator 4).

Messages quote earlier ones in lines that begin with ``>`` marks, nested once
per level. Each message is parsed into lines with their quote level;
consecutive lines of one level are a passage. Passages are normalised line by
line (lower case, runs of white space to one space, trimmed, blank lines out)
and hashed, and joined to the latest earlier message of the conversation that
says the passage itself: as its whole own text, as a run of own lines between
quotes, as a paragraph or as a line. The lines of a passage that no earlier
message says are looked up one by one. A message replies to the message that
most lines of its outermost (level 1) quotes come from, the latest of them on a
tie; the result is the conversation without quotes, in reply order.

Reply order: ``root`` is the first message of the thread and ``depth`` the
number of replies above a message; sorted by (root, depth, turn), every
message comes after the one it answers. Both are found by pointer doubling:
as many rounds as the logarithm of the longest chain, each one join on the
message's key and a written table.

Scale: messages are parsed where they are. The latest message that says a
passage is a running maximum over (conversation, hash) in order of turn
(``rank.running_max``, two-level), so a passage said or quoted a million times
in a conversation is spread over tasks and no pair of messages is ever made;
only hashes and keys move. One conversation may hold any share of the messages.

Defined cases: null text is an empty message. Blank lines and attributions
("... wrote:" before a line quoted deeper) link nothing; attributions are
dropped with the quotes. A message of any length, one character too, can be
quoted. Rows
without conversation or turn link nothing. Rows that repeat (conversation,
turn) are one message: they answer and are answered alike. Only the four
named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from abundance.llm.common import SLICE
from abundance.operators.rank import running_max
from abundance.session import cut_lineage, write_table

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"(?i)^.*\bwrote:\s*$"


def parsed(text: Column) -> Column:
    """array<struct<level:int, body:string>>, one per line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))


def own_text(lines: Column) -> Column:
    """The message's own lines, without attributions of the quotes that follow."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))))
    return F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), F.lit("\n"))


def units(text: str | None) -> tuple[set[int], set[tuple[int, int, frozenset]]]:
    """Hashes of what a message says (whole, runs, paragraphs, lines), and its
    quoted passages as (level, hash, hashes of the lines)."""
    import re

    import xxhash

    def digest(lines):
        return xxhash.xxh64_intdigest("\n".join(lines).encode("utf-8", "surrogatepass")) - (1 << 63)

    mark, attribution, white = re.compile(MARKS), re.compile(ATTRIBUTION), re.compile(r"[ \t-\r]+")
    lines = []
    for line in re.split("\r?\n", text or ""):
        m = mark.match(line)
        lines.append((m[1].count(">"), line[m.end():]) if m else (0, line))
    runs, last = [], None
    for i, (level, body) in enumerate(lines):
        if i + 1 < len(lines) and lines[i + 1][0] > level and attribution.match(body):
            continue
        if level != last:
            runs.append((level, []))
            last = level
        runs[-1][1].append(white.sub(" ", body.lower()).strip(" "))
    said, quoted, whole = set(), set(), []
    for level, run in runs:
        full = [x for x in run if x]
        if not full:
            continue
        if level:
            quoted.add((level, digest(full), frozenset(digest([x]) for x in full)))
            continue
        whole += full
        said.add(digest(full))
        paragraph = []
        for x in [*run, ""]:
            if x:
                paragraph.append(x)
                said.add(digest([x]))
            elif paragraph:
                said.add(digest(paragraph))
                paragraph = []
    if whole:
        said.add(digest(whole))
    return said, quoted


def told(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """(conv_id, turn, kind, level, passage, hash, lines): kind 1 for a hash
    that the message says, 0 for a quoted passage (hash = passage) or line."""
    src = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(text).alias("text")).where("conv_id is not null and turn is not null")
    kind = T.StructType([src.schema["conv_id"], src.schema["turn"], T.StructField("kind", T.IntegerType()), T.StructField("level", T.IntegerType()),
                         T.StructField("passage", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("lines", T.LongType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                rows = []
                for c, t, text in zip(*(b.column(i).slice(k, SLICE).to_pylist() for i in range(3))):
                    said, quoted = units(text)
                    rows += [(c, t, 1, 0, None, h, 0) for h in said]
                    for level, passage, lines in quoted:
                        rows.append((c, t, 0, level, passage, passage, len(lines)))
                        rows += [(c, t, 0, level, passage, h, 1) for h in lines if h != passage]
                cols = list(zip(*rows)) or [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return src.mapInArrow(run, kind)


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv_id, turn, level, hash, lines, origin): each quoted passage (its
    lines, if no earlier message says the passage) with the message it comes
    from (null: unknown). One row per distinct passage or line, level and
    message."""
    events = told(messages, conv, turn, text).distinct()
    # At equal turns quotes come before what is said, so only earlier messages are origins.
    seen = running_max(events.withColumn("said", F.when(F.col("kind") == 1, F.col("turn"))), ["conv_id", "hash"],
                       [F.col("turn"), F.col("kind"), F.col("level"), F.col("passage")], {"origin": "said"}).where("kind = 0")
    one = F.struct("hash", F.lit(1).cast("long").alias("lines"), "origin")
    passages = seen.groupBy("conv_id", "turn", "level", "passage").agg(
        F.max(F.when(F.col("hash") == F.col("passage"), F.col("origin"))).alias("origin"),
        F.max("lines").alias("lines"), F.collect_set(F.when(F.col("hash") != F.col("passage"), one)).alias("parts"))
    whole = F.array(F.struct(F.col("passage").alias("hash"), "lines", "origin"))
    found = F.explode(F.when(F.col("origin").isNotNull() | (F.size("parts") == 0), whole).otherwise(F.col("parts")))
    return passages.select("conv_id", "turn", "level", found.alias("f")).select("conv_id", "turn", "level", "f.*").distinct()


def replies(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_quotes): what each quoting message answers
    and the quoted lines that were found."""
    outer = links.where("level = 1 and origin is not null").groupBy("conv_id", "turn", "origin").agg(F.sum("lines").alias("n"))
    return outer.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "origin")).alias("best"), F.sum("n").alias("n_quotes")).select(
        "conv_id", "turn", F.col("best.origin").alias("reply_to"), "n_quotes")


def threads(reply: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of every message that answers another.
    Only messages whose root still answers something take part in a round."""
    cols = ["conv_id", "turn", "root", "depth"]
    active = cut_lineage(reply.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")))
    settled = active.limit(0)
    while True:
        above = active.union(settled).select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        joined = write_table(active.join(above, ["conv_id", "root"], "left"))
        settled = settled.union(joined.where("up is null").select(*cols))
        active = joined.where("up is not null").select("conv_id", "turn", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"))
        if active.isEmpty():
            return settled


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, root, depth,
    n_quotes and text without quotes."""
    reply = cut_lineage(replies(link(messages, conv, turn, text)))
    place = reply.join(threads(reply), ["conv_id", "turn"])
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), parsed(F.col(text)).alias("lines"))
    rows = rows.select("conv_id", "turn", "role", own_text(F.col("lines")).alias("text"))
    return rows.join(place, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), "text")


def quoted_mail(turns: DataFrame, levels: int = 2) -> DataFrame:
    """Mail-like messages derived from a table of turns: each turn's text
    under quotes of up to ``levels`` turns before it, nested. Used to give a
    table of bare turns the form this operator reads."""
    key = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    out = turns.withColumn("__parts", F.array(F.coalesce("text", F.lit(""))))
    for k in range(1, levels + 1):
        up = key.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias("__said"))
        mark = "> " * k
        lines = F.concat(F.lit(mark), F.replace(F.col("__said"), F.lit("\n"), F.lit("\n" + mark)))
        out = out.join(up, ["conv_id", "turn"], "left").withColumn(
            "__parts", F.when(F.col("__said").isNull(), F.col("__parts")).otherwise(F.concat(F.array(lines), F.col("__parts")))).drop("__said")
    return out.withColumn("text", F.array_join("__parts", "\n")).drop("__parts")
