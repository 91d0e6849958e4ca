"""A vote goes over the edges once, for the labels and for their entropy."""

from lattica.operators import labels as lab


def test_edges_are_gone_over_once_a_vote(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    labels = spark.createDataFrame([(i, i % 2 if i < 4 else 1) for i in range(12)], "cell_id long, label int")
    pairs = [(i, (i + d) % 12) for i in range(12) for d in (-2, -1, 1, 2)] + [(99, 3), (3, 98)]  # ends without a label count for nothing
    edges = spark.createDataFrame(pairs, "src long, dst long").mapInArrow(count, "src long, dst long")
    out, entropy, votes = lab.refined(labels, edges, "num_iter", 3)
    assert votes == 3 and read.value == 3 * len(pairs)
    assert entropy == 0.0 and {r.cell_id: r.label for r in out.collect()} == {i: 1 for i in range(12)}
