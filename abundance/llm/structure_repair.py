r"""Conversation structure repair (operator 13).

A conversation should begin with at most one system turn and then alternate
user, assistant to its end: role initials ``(s?(ua)+)?``. ``faults`` finds
blank, duplicate and truncated turns; ``repair`` finds the cheapest edits that
give that form: Keep 0, Rerole to user or assistant 3, Delete 4 (required for
blank and duplicate turns), Insert an empty user or assistant turn 3, and 3
more for a truncated turn that is not deleted. Of equally cheap edit lists the
one whose initials are least in ASCII order is taken.

Method: run-length dynamic programming. What a turn can do depends only on its
symbol (its role's class and its fault) and on four states (nothing yet, after
system, after user, after assistant), so a turn is a 4 x 4 min-plus matrix
(with the inserts before it). Equal consecutive symbols are one run; a run of k is advanced by
the cached binary powers of its matrix. The edits are then unrolled from the
costs to the end, a run again by halves: the letters of 2^j equal turns depend
only on the symbol, the state and the relative costs after them, which take
few values, and are cached.

Scale: texts take no part in finding the edits, only a digest and a symbol per
turn do. Turns are numbered by a two-level prefix sum and symbols are written
in chunks of 4,096 turns, so one conversation may hold any share of the
rows: its chunks are multiplied in parallel, one small task joins their
matrices (one per chunk), and its chunks are unrolled in parallel.
First sights of a (role, text) are minima joined back with hot ones dealt out.
The digest of a repaired conversation reads its kept turns in order, one batch
in memory at a time (SHA-256 cannot be split); the audit is one string per
conversation, as its definition says.

Defined cases: rows without conversation id belong to none and are left out.
Rows of one turn are in order of role and then of the digest of their text;
repeated rows are thus neighbours. Null turns come first. Null role or text
is an empty one (``damage`` writes one space). A role counts by its first
character; other initials than s, u, a cannot be kept. Other columns are
ignored, whatever their names. A conversation whose rows are all gone is not
in the result of ``repair``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from abundance.llm.common import SLICE, shuffle_partitions
from abundance.operators.joins import spread_join
from abundance.operators.rank import running_sums
from abundance.session import cut_lineage

CHUNK_BITS = 12
WHITE = " \t\n\x0b\x0c\r"
CLASSES = "sua"             # role classes 0, 1, 2; any other initial is class 3
FAULTS = (None, "truncated", "blank", "duplicate")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
MADE = (USER, USER, ASSISTANT, USER)     # the state a made turn (insert, rerole) leads to
FAR = 1 << 50


def times(a, b):
    """Min-plus product of two 4 x 4 matrices."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def onto(a, v):
    """Min-plus product of a matrix and a vector of costs to the end."""
    return tuple(min(x + v[k] for k, x in enumerate(row)) for row in a)


def insert_costs():
    """Cheapest inserts from state to state."""
    one = tuple(tuple(0 if p == q else INSERT if MADE[p] == q else FAR for q in range(4)) for p in range(4))
    return times(one, one)


INSERTS = insert_costs()
IDENTITY = tuple(tuple(0 if p == q else FAR for q in range(4)) for p in range(4))
END = onto(INSERTS, (0, FAR, FAR, 0))


def kept_state(role: int, state: int) -> int | None:
    """The state after keeping a turn of this role class, if it may stay."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


def options(symbol: int, state: int):
    """(letter, cost, next state) of the edits that use up a turn, by letter."""
    role, fault = symbol & 3, symbol >> 2
    yield "D", DELETE, state
    if fault < 2:
        more = TRUNCATED if fault == 1 else 0
        if (kept := kept_state(role, state)) is not None:
            yield "K", KEEP + more, kept
        yield "R", REROLE + more, MADE[state]


class Repairer:
    """Transitions, their binary powers and unrolled letters, all cached."""

    def __init__(self):
        self.powers, self.blocks = {}, {}

    def power(self, symbol: int, j: int):
        """The matrix of 2^j equal turns."""
        if (symbol, j) not in self.powers:
            if j:
                half = self.power(symbol, j - 1)
                m = times(half, half)
            else:
                m = times(INSERTS, tuple(tuple(min([c for _, c, q in options(symbol, p) if q == to], default=FAR) for to in range(4)) for p in range(4)))
            self.powers[symbol, j] = m
        return self.powers[symbol, j]

    def matrix(self, symbols: str):
        """The matrix of a whole sequence of turns."""
        m = IDENTITY
        for symbol, k in runs(symbols):
            for j in range(k.bit_length()):
                if k >> j & 1:
                    m = times(m, self.power(symbol, j))
        return m

    def step(self, symbol: int, after, state: int):
        """Letters of one turn and the state behind it; ``after`` are the
        costs to the end from each state behind the turn."""
        before, letters = onto(self.power(symbol, 0), after), ""
        while True:
            moves = sorted([(letter, c + after[q], q) for letter, c, q in options(symbol, state)] + [("I", INSERT + before[MADE[state]], MADE[state])])
            letter, _, state = next(m for m in moves if m[1] == before[state])
            letters += letter
            if letter != "I":
                return letters, state

    def block(self, symbol: int, j: int, after, state: int):
        """Letters of 2^j equal turns and the state behind them."""
        least = min(after)
        key = symbol, j, tuple(x - least for x in after), state
        if key not in self.blocks:
            if len(self.blocks) > 20_000:
                self.blocks.clear()
            if j:
                left, middle = self.block(symbol, j - 1, onto(self.power(symbol, j - 1), after), state)
                right, end = self.block(symbol, j - 1, after, middle)
                self.blocks[key] = left + right, end
            else:
                self.blocks[key] = self.step(symbol, after, state)
        return self.blocks[key]

    def unroll(self, symbols: str, after, state: int, last: bool):
        """(edit letters, costs before, state behind) of a sequence from a
        state, given the costs to the end behind it; ``last``: the
        conversation ends there."""
        pieces = [(symbol, j) for symbol, k in runs(symbols) for j in range(k.bit_length()) if k >> j & 1]
        costs = [tuple(after)]
        for symbol, j in reversed(pieces):
            costs.append(onto(self.power(symbol, j), costs[-1]))
        costs.reverse()
        letters = []
        for (symbol, j), behind in zip(pieces, costs[1:]):
            some, state = self.block(symbol, j, behind, state)
            letters.append(some)
        while last and state in (SYSTEM, USER):
            letters.append("I")
            state = MADE[state]
        return "".join(letters), costs[0], state


def runs(symbols: str):
    """(symbol, length) of the runs of equal symbols (hexadecimal digits)."""
    from itertools import groupby

    for digit, same in groupby(symbols):
        yield int(digit, 16), sum(1 for _ in same)


def illegal_pairs(symbols: str, previous: int = -1) -> int:
    """Neighbours whose role classes are not su, ua or au."""
    roles = [int(d, 16) & 3 for d in symbols]
    if previous >= 0:
        roles.insert(0, previous)
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(roles, roles[1:]))


def damage(turns: DataFrame) -> DataFrame:
    """Damaged copies of conversation rows, the kind drawn from the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its ``[.!?]``, 3 repeats it, 4 sets the role user. Nulls are one space."""
    named = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                         F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times_kept = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = named.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times_kept.alias("copies"))
    return out.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).drop("copies", "copy")


def keyed(turns: DataFrame) -> DataFrame:
    """Rows with conversation, role and text present, and ``said``, the digest
    of role and text."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("body", F.md5("text")).withColumn("said", F.md5(F.concat("body", F.col("role"))))


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, role, said, symbol, fault) of each row: its place
    in the conversation (from 1), its first fault (null: none) and its symbol
    (role class and fault)."""
    bare = F.rtrim("text", F.lit(WHITE))
    blank, cut = bare == "", ~F.substring(bare, -1, 1).isin(".", "!", "?")
    rows = keyed(turns).select("conv_id", "turn", "role", "body", "said", F.when(blank, 2).when(cut, 1).otherwise(0).alias("bad"),
                               F.monotonically_increasing_id().alias("row"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "body", "row")]
    placed = cut_lineage(running_sums(rows, ["conv_id"], order, {"pos": F.lit(1)}).drop("body", "row"))
    again = cut_lineage(placed.groupBy("conv_id", "said").agg(F.min("pos").alias("first"), F.count("*").alias("__n")).where("__n > 1"))
    seen = spread_join(placed, again.drop("__n"), ["conv_id", "said"], "left", counts=again.drop("first"))
    fault = F.when(F.col("bad") == 2, 2).when(F.col("pos") > F.col("first"), 3).otherwise(F.col("bad"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    names = F.array(*map(F.lit, FAULTS))
    return seen.select("conv_id", "turn", "pos", "role", "said", (role + 4 * fault).alias("symbol"), F.get(names, fault).alias("fault"))


def chunks(found: DataFrame) -> DataFrame:
    """(conv_id, chunk, symbols): the symbols of up to 2 ** ``CHUNK_BITS``
    neighbouring turns, one hexadecimal digit each."""
    chunk = F.shiftright(F.col("pos") - 1, CHUNK_BITS).alias("chunk")
    rows = F.array_sort(F.collect_list(F.struct("pos", F.lower(F.hex("symbol")).alias("x"))))
    return found.groupBy("conv_id", chunk).agg(F.array_join(F.transform(rows, lambda r: r["x"]), "").alias("symbols"))


def by_rows(df: DataFrame, schema: str, make) -> DataFrame:
    """Rows (tuples) made from each row by ``make(repairer, row) -> list``."""
    kind = T._parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        repairer, arrow = Repairer(), to_arrow_schema(kind)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                rows = [out for row in b.slice(i, SLICE).to_pylist() for out in make(repairer, row)]
                cols = list(zip(*rows)) or [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def long_conversations(parts: DataFrame) -> DataFrame:
    """(conv_id, chunk, after, state, previous, last) of the chunks of
    conversations with several: costs to the end behind the chunk, the state
    it begins in and the role class before it."""
    many = cut_lineage(parts.groupBy("conv_id").agg(F.max("chunk").alias("top")).where("top > 0"))
    mine = cut_lineage(parts.join(many, "conv_id"))        # 2 ** CHUNK_BITS turns a row
    matrices = by_rows(mine, "conv_id long, chunk long, matrix array<long>, role int",
                       lambda r, x: [(x["conv_id"], x["chunk"], sum(r.matrix(x["symbols"]), ()), int(x["symbols"][-1], 16) & 3)])

    def costs(_, x):
        out, after, n = [], END, len(x["list"])
        for k in range(n - 1, -1, -1):
            c = x["list"][k]
            out.append((x["conv_id"], c["chunk"], list(after), x["list"][k - 1]["role"] if k else -1, k == n - 1))
            m = c["matrix"]
            after = onto([m[i:i + 4] for i in range(0, 16, 4)], after)
        return out

    def listed(df, *cols):
        return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", *cols))).alias("list"))

    behind = cut_lineage(by_rows(listed(matrices, "matrix", "role"), "conv_id long, chunk long, after array<long>, previous int, last boolean", costs))
    ends = by_rows(mine.join(behind, ["conv_id", "chunk"]).drop("previous", "top"), "conv_id long, chunk long, ends array<int>",
                   lambda r, x: [(x["conv_id"], x["chunk"], [r.unroll(x["symbols"], x["after"], q, x["last"])[2] for q in range(4)])])

    def states(_, x):
        out, q = [], START
        for c in x["list"]:
            out.append((x["conv_id"], c["chunk"], q))
            q = c["ends"][q]
        return out

    return behind.join(by_rows(listed(ends, "ends"), "conv_id long, chunk long, state int", states), ["conv_id", "chunk"])


def repair(found: DataFrame) -> DataFrame:
    """(conv_id, chunk, state, audit, cost, blank, duplicate, truncated,
    illegal): the cheapest edits of each chunk of each conversation, from the
    result of ``faults``. ``state`` is the one it begins in, ``cost`` that of
    the conversation from there on."""
    parts = cut_lineage(chunks(found))
    spread = parts.join(long_conversations(parts), ["conv_id", "chunk"], "left")

    def solve(r, x):
        s = x["symbols"]
        whole = x["after"] is None
        state = START if whole else x["state"]
        letters, costs, _ = r.unroll(s, END if whole else x["after"], state, whole or x["last"])
        n = [sum(int(d, 16) >> 2 == f for d in s) for f in (2, 3, 1)]
        return [(x["conv_id"], x["chunk"], state, letters, costs[state], *n, illegal_pairs(s, -1 if whole else x["previous"]))]

    return by_rows(spread, "conv_id long, chunk long, state int, audit string, cost long, blank long, duplicate long, truncated long, illegal long", solve)


def edited(found: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, chunk, place, pos, role, said): the turns of each repaired
    conversation in order of (chunk, place). ``pos`` and ``said`` (null for an
    inserted turn) name the row that a turn comes from."""
    def turns(_, x):
        out, state, pos = [], x["state"], x["chunk"] << CHUNK_BITS
        symbols = iter(x["symbols"])
        for k, letter in enumerate(x["audit"]):
            if letter != "I":
                pos, symbol = pos + 1, int(next(symbols), 16)
                if letter == "D":
                    continue
            kept = letter == "K"
            state = kept_state(symbol & 3, state) if kept else MADE[state]
            out.append((x["conv_id"], x["chunk"], k, None if letter == "I" else pos, None if kept else "user" if state == USER else "assistant"))
        return out

    made = by_rows(repairs.join(chunks(found), ["conv_id", "chunk"]), "conv_id long, chunk long, place int, pos long, new string", turns)
    rows = found.select("conv_id", "pos", "role", "said")
    old = made.where("pos is not null").join(rows, ["conv_id", "pos"])
    new = made.where("pos is null").withColumns({"role": F.lit(None).cast("string"), "said": F.lit(None).cast("string")})
    return old.unionByName(new).select("conv_id", "chunk", "place", "pos", F.coalesce("new", "role").alias("role"), "said")


def repaired_turns(turns: DataFrame, found: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, chunk, place, role, text): the repaired conversations. A kept
    turn is the only one of its role and text, as repeats are deleted, so its
    text is found by that."""
    texts = keyed(turns).groupBy("conv_id", "said").agg(F.first("text").alias("text"))
    return edited(found, repairs).join(texts, ["conv_id", "said"], "left").select(
        "conv_id", "chunk", "place", "role", F.coalesce("text", F.lit("")).alias("text"))


def digests(repaired: DataFrame, out: str = "repaired_sha256") -> DataFrame:
    """SHA-256 of each repaired conversation's ``role:text`` lines."""
    kind = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField(out, T.StringType())])

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, now, h = to_arrow_schema(kind), None, None
        for b in batches:
            done = []
            for i in range(0, b.num_rows, SLICE):
                cols = b.slice(i, SLICE).to_pydict()
                for conv, role, text in zip(cols["conv_id"], cols["role"], cols["text"]):
                    if h is not None and conv == now:
                        h.update(b"\n")
                    else:
                        if h is not None:
                            done.append((now, h.hexdigest()))
                        now, h = conv, hashlib.sha256()
                    h.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, h.hexdigest()), arrow)], schema=arrow)

    placed = repaired.repartition(shuffle_partitions(repaired.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    return placed.select("conv_id", "role", "text").mapInArrow(run, kind)


def turn_gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers that are missing between a conversation's
    first and last."""
    seen = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    return seen.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def repair_report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id): gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256."""
    found = cut_lineage(faults(turns))
    repairs = cut_lineage(repair(found))
    numbers = ["blank", "duplicate", "truncated", "illegal"]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda p: p["audit"]), "")
    per_conv = repairs.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in numbers], F.max(F.when(F.col("chunk") == 0, F.col("cost"))).alias("cost"),
                                              audit.alias("audit"))
    shas = digests(repaired_turns(turns, found, repairs))
    zero = F.lit(0).cast("long")

    def filled(c: str, value: Column) -> Column:
        return F.coalesce(c, value).alias(c)

    every = ids.select("conv_id").where("conv_id is not null").distinct()
    return every.join(per_conv, "conv_id", "left").join(turn_gaps(turns), "conv_id", "left").join(shas, "conv_id", "left").select(
        "conv_id", *[filled(c, zero) for c in ["gaps", *numbers, "cost"]], filled("audit", F.lit("")),
        filled("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
