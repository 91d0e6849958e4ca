"""Folders of counts as instruments write them: compressed or not, old and new names, whole or in parts."""

import gzip

import pytest

from lattica import sources

BARCODES, GENES = ["AAA-1", "CCC-1", "GGG-1"], ["ENS1\tGeneA\tGene Expression", "ENS2\tGeneB\tGene Expression"]
MARKET = ["%%MatrixMarket matrix coordinate integer general", "% by hand", "", "2 3 4", "1 1 5", "2 1 1", "2 2 7", "1 3 2"]
COUNTS = {("AAA-1", "GeneA", 5.0), ("AAA-1", "GeneB", 1.0), ("CCC-1", "GeneB", 7.0), ("GGG-1", "GeneA", 2.0)}


def put(path, lines):
    data = ("\n".join(lines) + "\n").encode()
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else data)


@pytest.mark.parametrize("genes,end", [("features.tsv", ""), ("features.tsv", ".gz"), ("genes.tsv", ""), ("genes.tsv", ".gz")])
def test_10x_folders(spark, tmp_path, genes, end):
    put(tmp_path / f"barcodes.tsv{end}", BARCODES)
    put(tmp_path / f"{genes}{end}", [g.rsplit("\t", 1)[0] for g in GENES] if genes == "genes.tsv" else GENES)
    put(tmp_path / f"matrix.mtx{end}", MARKET)
    cells, names, expr = sources.read_10x(spark, str(tmp_path))
    told = expr.join(cells, "cell_id").join(names, "gene_id").select("barcode", "gene_name", "value")
    assert set(map(tuple, told.collect())) == COUNTS and told.count() == 4


def test_matrix_market_in_parts(spark, tmp_path, monkeypatch):
    """The size line is found by its file, not by the order in which parts happen to be read; large parts come first there."""
    (tmp_path / "m.mtx").mkdir()
    put(tmp_path / "m.mtx" / "part-0.txt", MARKET[:4])
    put(tmp_path / "m.mtx" / "part-1.txt", ["1 1 3"] * 1000)
    put(tmp_path / "m.mtx" / "part-2.txt", ["2 3 4"])
    got = sources.read_matrix_market(spark, str(tmp_path / "m.mtx"))
    assert got.count() == 1001 and got.where("row = 1 and col = 2").count() == 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        put(tmp_path / "n.mtx", [*MARKET[:3], "9 9 900", *["1 1 3"] * 900])
        assert sources.read_matrix_market(spark, str(tmp_path / "n.mtx")).count() == 900
        put(tmp_path / "lines.tsv", [str(i) for i in range(500)])
        assert all(r.at == int(r.value) for r in sources._numbered_lines(spark, str(tmp_path / "lines.tsv")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
