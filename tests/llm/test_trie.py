"""The conversation trie against a plain one, and against SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np

from lattica.llm import queries, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(told):
    """Nodes of {conv_id: [(role, text)]} by dictionaries."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].encode().split()) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    return sorted(
        (min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(children[v]), leaves[v], saved[v], hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest())
        for v, m in members.items()
    )


def own_turns(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in told.items()}


def rebuilt(rows):
    own = own_turns(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def some_rows(seed, convs=60, most=7):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(convs):
        turns = [(str(rng.choice(["user", "bot"])), str(rng.choice(["hi", "a b", "a b c", ""]))) for _ in range(rng.integers(1, most))]
        rows += [(int(c), i, r, t) for i, (r, t) in enumerate(turns)]
    return rows


SCHEMA = "conv_id long, turn int, role string, text string"


def test_rebuilding(spark, tmp_path):
    rows = [r for r in some_rows(0) if not (r[0] % 20 == 0 and r[0] > 30)]  # a lead that isn't there; some are left without turns
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert any(not t for t in rebuilt(rows).values())
    assert got(queries.QUERIES["op12_conversation_trie"](spark, str(tmp_path))) == plain(rebuilt(rows))


def test_chains_copies_and_caterpillars(spark, monkeypatch):
    """Long chains over many segments, conversations that end inside others, and many equal ones."""
    monkeypatch.setattr(trie, "SEGMENT", 7)
    rows = [(1, i, "u", f"x {i % 3}") for i in range(60)] + [(2, i, "u", f"x {i % 3}") for i in range(61)]
    rows += [(c, i, "u", "y") for c in range(10, 40) for i in range(c)]
    rows += [(c, i, "u", f"same {i}") for c in range(100, 160) for i in range(3)]
    assert got(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(own_turns(rows))


def test_given_cases(spark):
    rows = [(1, None, "b", "z"), (1, None, None, None), (1, 0, "b", "a"), (1, 0, "a", "b"), (2, 5, None, ""), (2, 9, "b", "z"), (3, 1, "r", "t"), (3, 1, "r", "t"), (None, 1, "r", "t")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", place string, n_convs int")
    assert got(trie.conversation_trie(df)) == plain(own_turns(rows))
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    ids = spark.createDataFrame([(7,), (8,), (7,), (None,)], "conv_id long")
    assert got(trie.trie_nodes(trie.numbered(spark.createDataFrame([], SCHEMA)), ids)) == plain({7: [], 8: []})


def test_query_against_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{data}/conversations.parquet'")
    rel = con.sql(queries.ORACLES["op12_conversation_trie"])
    assert rel.columns == COLUMNS
    mine = got(queries.QUERIES["op12_conversation_trie"](spark, data))
    assert mine == sorted(rel.fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert mine == plain(rebuilt(rows))
