"""Periodic runs against a brute-force search by definition."""

import hashlib
import zlib

import numpy as np
import pytest

from lattica.llm import queries, runs


def brute(words, times=4, least=6):
    """All runs by definition: every start and period, extended word by word; the period must be the smallest of the stretch."""
    out, n = set(), len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                stretch = words[i : j + q]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_names(texts, times=4, least=6):
    got = runs._rows(list(range(len(texts))), [[w.encode() for w in t] for t in texts], times, least, runs.pa.int64())
    return [[(r["start"], r["length"], r["period"]) for r in row["runs"]] for row in got.to_pylist()], got.column("collapsed").to_pylist()


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("times,least", [(4, 6), (2, 2), (3, 5), (7, 6)])
def test_runs_by_definition(times, least):
    rng = np.random.default_rng(times)
    texts = []
    for k in range(150):
        words = list(rng.choice(list("abc")[: 1 + k % 3], rng.integers(0, 40)))
        for _ in range(k % 4):
            unit = list(rng.choice(list("abcdefg"), rng.integers(1, 9)))
            at = rng.integers(0, len(words) + 1)
            words[at:at] = (unit * 9)[: rng.integers(1, 9 * len(unit))]
        texts.append([str(w) for w in words])
    texts += [[], ["a"], ["a"] * 100, list("ab") * 60, list("aab") * 40 + list("ab") * 40]
    found, kept = by_names(texts, times, least)
    for words, some, text in zip(texts, found, kept):
        assert some == brute(words, times, least)
        assert text == collapsed(words, some)


def test_documents_do_not_meet():
    """Equal words on both sides of a border between documents are no run."""
    assert by_names([["a"] * 5, ["a"] * 5, ["a"] * 6])[0] == [[], [], [(0, 6, 1)]]


def test_long_text_of_one_word():
    assert by_names([["x"] * 50_000])[0] == [[(0, 50_000, 1)]]


def test_given_cases(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, " \t\n", "u"), (4, "a b " * 9 + "c", "u"), (4, "a b " * 9 + "c", "u"), (None, "x\x0bx\x0cx\rx\nx x", "u"), (7, "é " * 7, "u")]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    assert got[:3] == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], "")]
    assert got[3] == got[4] == (4, 19, [(0, 18, 2)], "a b c")
    assert got[5] == (None, 6, [(0, 6, 1)], "x") and got[6] == (7, 7, [(0, 7, 1)], "é")
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([], "doc_id int, text string"), times=1)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100_001, None), (100_003, " "), (10_009, "a"), (10_010, "a b")]
    short = [(i, t) for i, t in rows if len((t or "").split()) < 900]
    spark.createDataFrame(short, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(expected(*r) for r in short)
    assert sum(r[1] > 0 for r in got) > 10
