import random

import pytest
from pyspark.sql import functions as F

from lattica.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                spans.append((i, j))
            i = j
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("v", sorted(suffixes.COVERS))
def test_covers(v):
    d = suffixes.COVERS[v]
    assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("seed,length", [(1, 200), (2, 40), (3, 12)])
def test_same_as_brute_force(spark, monkeypatch, seed, length):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 20_000)
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rnd.randint(2, 90))) for _ in range(12)]
    texts = []
    for _ in range(80):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 6))]
        text = "".join(parts)
        if rnd.random() < 0.3 and len(text) > 5:
            k = rnd.randrange(len(text))
            text = text[:k] + "#" + text[k:]
        texts.append(text)
    texts += [None, "", "ab" * 700, "x" * length, "y" * (length + 1), texts[3], texts[3], "z" * (length - 1), "z" * (length - 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("kept", F.lit(1))
    got = {r.doc_id: (r.n_bytes, list(zip(r.starts, r.ends)), bytes(r.kept)) for r in suffixes.removed_bytes(df, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (None, "short"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffixes.removed_bytes(df).collect()), key=str)
    assert got == sorted([(1, 300, b""), (1, 300, b""), (None, 5, b"short"), (2, 0, b"")], key=str)
    assert suffixes.removed_bytes(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        suffixes.cover_for(5)
