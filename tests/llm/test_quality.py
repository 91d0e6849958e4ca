import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import quality as q


def corpus(n=400):
    rnd = random.Random(1)
    good = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(5, 60))) + "."
    junk = lambda: " ".join("".join(rnd.choice("ABC#$%0123") for _ in range(rnd.randint(2, 12))) + "!!" for _ in range(rnd.randint(5, 60)))
    return [(i, good() if i % 3 else junk(), int(i % 3 > 0)) for i in range(n)]


def test_learns_and_holds_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "x"), (0, rows[0][1]), (9003, "word " * 30_000)], "doc_id long, text string").selectExpr("*", "1 as x", "0 as quality", "'a' as score")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(5, None), (None, 1), (0, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = q.scored(docs, labels).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, _, y in rows}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 9000)
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 9000} == {i for i, y in truth.items() if y}
    flat = q.scored(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in flat} == {0.5}
    assert q.scored(docs.limit(0), labels).collect() == [] and q.accepted(docs.limit(0), labels).collect() == []


def test_forest_fits_what_trees_can():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = q.fit(x, y, trees=60)
    p = f.score(x)
    assert ((p > 0.5) == y).mean() > 0.95
    slow = []
    for row in x[:20]:  # node by node
        total = f.base
        for t in range(len(f.value)):
            node = 0
            while node < f.feature.shape[1]:
                node = 2 * node + 1 + int(row[f.feature[t, node]] > f.threshold[t, node])
            total += f.value[t, node - f.feature.shape[1]]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(slow, p[:20])


def test_statistics_of_small_texts():
    import pyarrow as pa

    x = q.column_statistics(pa.array(["", None, "Ab, c!\nAb, c!\n", "é"]))
    name = {n: i for i, n in enumerate(q.FEATURES)}
    assert np.isfinite(x).all() and x.shape == (4, len(q.FEATURES)) and (x[0] == x[1]).all()
    assert x[2, name["word_mean"]] == 2.5 and x[2, name["distinct_lines"]] == 0.5 and x[2, name["upper"]] == 2 / 14 and x[3, name["wide"]] == 1


def test_repeated_ids_in_any_order(spark):
    """Of several texts of one id the same one is learnt from, however the rows come."""
    rows = [(i, f"{'good prose, and more of it. ' * 3 if (i + k) % 2 else '$$ ## BUY ' * 4} {i}") for i in range(60) for k in (0, 1)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(tuple, q.scored(d, labels).collect())) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(7)))
    assert one == two
