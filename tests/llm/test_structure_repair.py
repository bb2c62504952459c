"""Conversation structure repair: the query against a plain table of costs,
runs of many turns, conversations of many chunks and odd rows."""

import itertools
import random

import brute
from abundance.llm import queries as Q, structure_repair as repair
from test_prefix_trie import TURNS
from test_text_ops import SF

REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*REPORT).collect())


def of_table(spark, tmp_path, rows, parts=3):
    folder = f"{tmp_path}/t{random.random()}"
    spark.createDataFrame(rows, TURNS).repartition(parts).write.parquet(f"{folder}/conversations.parquet")
    return as_rows(Q.op13_repair(spark, folder))


def test_edits_equal_plain_costs():
    rnd, r = random.Random(0), repair.Repairer()
    turn = [("system", None), ("user", None), ("assistant", None), ("tool", None), ("user", "truncated"), ("assistant", "truncated"), ("user", "blank")]
    code = {("s", None): "0", ("u", None): "1", ("a", None): "2", ("t", None): "3", ("u", "truncated"): "5", ("a", "truncated"): "6", ("u", "blank"): "9"}
    lists = [list(x) for n in range(5) for x in itertools.product(turn, repeat=n)]
    lists += [[x for _ in range(rnd.randrange(1, 8)) for x in [rnd.choice(turn)] * rnd.randrange(1, 9)] for _ in range(800)]
    for turns in lists:
        symbols = "".join(code[role[0], fault] for role, fault in turns)
        letters, costs, _ = r.unroll(symbols, repair.END, repair.START, True)
        cost, audit, _ = brute.cheapest_edits([(role, "x", fault) for role, fault in turns])
        assert (costs[0], letters) == (cost, audit), symbols
        # the same through matrices of two halves
        k = len(symbols) // 2
        behind = repair.onto(r.matrix(symbols[k:]), repair.END)
        first, before, state = r.unroll(symbols[:k], behind, repair.START, False)
        assert before[0] == cost and first + r.unroll(symbols[k:], repair.END, state, True)[0] == audit


def test_a_run_of_a_million_equal_turns():
    r = repair.Repairer()
    letters, costs, _ = r.unroll("1" * 1_000_001, repair.END, repair.START, True)
    assert costs[0] == 3 * 500_000 + 3 and letters == "KI" + "KR" * 500_000 and len(r.blocks) < 500


def test_table_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(Q.op13_repair(spark, SF)) == brute.repairs(rows)


def test_odd_rows(spark, tmp_path):
    rnd = random.Random(5)
    roles = ["user", "assistant", "system", "User", "tool", "", None, "user2"]
    texts = ["fine.", "cut", "", " \t\n", None, "Really?", "a!\n", "é.", "long " * 20000 + "."]
    rows = [(c, rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts)) for c in range(120) for _ in range(rnd.randrange(1, 9))]
    rows += [(500, 3, "user", "same."), (500, 3, "user", "same."), (None, 1, "user", "nobody's."), (-4, 0, "assistant", "x.")]
    assert of_table(spark, tmp_path, rows) == brute.repairs(rows)
    assert of_table(spark, tmp_path, []) == []
    drop = next(c for c in range(600, 900) if brute.zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert of_table(spark, tmp_path, [(drop, 0, "user", "gone.")]) == [(drop, 0, 0, 0, 0, 0, 0, "", brute.sha(""))]


def test_conversations_of_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_BITS", 3)
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user"] * 5 + ["assistant", "system"]), rnd.choice(["one.", "two", "x%d." % t, "y%d" % t])) for c in (1, 2, 3) for t in range(90)]
    rows += [(9, t, "user", f"only {t}.") for t in range(64)] + [(10, t, "user", "same.") for t in range(70)]
    assert of_table(spark, tmp_path, rows) == brute.repairs(rows)


def test_repaired_turns_are_whole(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hello.", 1), (1, 1, "assistant", "Again.", 2)], TURNS + ", pos int")
    found = repair.faults(turns)
    out = repair.repaired_turns(turns, found, repair.repair(found)).orderBy("chunk", "place").collect()
    assert [(r.role, r.text) for r in out] == [("user", "Hello."), ("assistant", "Again.")]
