"""Readers and writers of the tables that the operators work on. All paths are Spark's."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators._scale import running
from . import hdf5


def read_matrix_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A gene-by-cell CSV (first column gene names, a column a cell) as genes(gene_id, gene_name), expr(cell_name, gene_id, value).

    Genes are numbered by name; zeros are not stored.
    """
    df = spark.read.csv(path, header=True)
    name, cells = df.columns[0], df.columns[1:]
    genes = df.select(F.col(f"`{name}`").alias("gene_name")).distinct()
    genes = genes.withColumn("gene_id", F.row_number().over(Window.orderBy("gene_name")) - 1)
    # map_from_arrays instead of an unpivot expression for each cell: matrices have many columns
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in cells]).alias("cell_name"), F.array(*[F.col(f"`{c}`").cast("double") for c in cells]).alias("value")))
    long = df.select(F.col(f"`{name}`").alias("gene_name"), pairs.alias("p")).select("gene_name", F.col("p.cell_name").alias("cell_name"), F.col("p.value").alias("value"))
    return genes, long.where("value <> 0").join(F.broadcast(genes), "gene_name").select("cell_name", "gene_id", "value")


def read_locations_csv(spark: SparkSession, path: str, x: str = "xcoord", y: str = "ycoord") -> DataFrame:
    """cells(cell_name, x, y) from a CSV whose first column names the cells."""
    df = spark.read.csv(path, header=True)
    return df.select(F.col(f"`{df.columns[0]}`").alias("cell_name"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def numbered(cells: DataFrame, expr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells and expr with a numeric cell_id in the order of names, made without gathering all cells in one task."""
    ids = cells.select("cell_name").distinct().orderBy("cell_name").select("cell_name", F.monotonically_increasing_id().alias("cell_id"))
    return cells.join(ids, "cell_name"), expr.join(ids, "cell_name").select("cell_id", "gene_id", "value")


def load(spark: SparkSession, matrix: str | None = None, locations: str | None = None, parquet: str | None = None, h5ad: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, genes, expr) from a folder of Parquet tables, an h5ad file, or a matrix and a locations CSV; raises if none is given."""
    if h5ad:
        return read_h5ad(spark, h5ad)
    if parquet:
        return tuple(spark.read.parquet(f"{parquet}/{t}.parquet") for t in ("cells", "genes", "expr"))
    if not matrix or not locations:
        raise ValueError("give a Parquet folder, an h5ad file, or both a matrix and a locations file")
    genes, expr = read_matrix_csv(spark, matrix)
    cells, expr = numbered(read_locations_csv(spark, locations), expr)
    return cells, genes, expr


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Tissue positions: CSV without header of barcode, in-tissue flag, array and pixel coordinates."""
    return spark.read.csv(path, schema="barcode string, x1 int, x_array int, y_array int, x_pixel double, y_pixel double")


def read_annotations(spark: SparkSession, path: str, names: tuple[str, ...] = ("barcode", "sample_no", "layer")) -> DataFrame:
    """A TSV without header."""
    return spark.read.csv(path, sep="\t", schema=", ".join(f"{n} string" for n in names))


def annotated(cells: DataFrame, annotations: DataFrame, key: str = "barcode", fill: str = "other") -> DataFrame:
    """cells with their annotations; those without any get the fill."""
    extra = [c for c in annotations.columns if c != key]
    return cells.join(annotations, key, "left").fillna(fill, extra)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, n, value) of text files' lines; file, at (where the part read begins) and n tell their order, however files were cut and read."""
    places = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    return spark.read.text(path).select(*places, F.monotonically_increasing_id().alias("n"), "value")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a coordinate MatrixMarket file, or folder of parts of which one has the header, counted from 0; also compressed."""
    lines = _lines(spark, path).where("trim(value) <> ''")
    head = lines.where("value like '\\%\\%MatrixMarket%'").select("file").distinct()
    size = lines.where("value not like '\\%%'").join(F.broadcast(head), "file", "left_semi").agg(F.min(F.struct("at", "n", "file")).alias("s")).select("s.*")  # one line
    rows = lines.where("value not like '\\%%'").join(F.broadcast(size), ["file", "at", "n"], "left_anti")
    part = F.split(F.trim("value"), r"\s+")
    value = F.when(F.size(part) > 2, F.try_element_at(part, F.lit(3)).cast("double")).otherwise(1.0)
    return rows.select((part[0].cast("long") - 1).alias("row"), (part[1].cast("long") - 1).alias("col"), value.alias("value"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value) of text files' lines in the order of files' names, counted from 0."""
    told = running(_lines(spark, path), ["file", "at", "n"], F.lit(1), "line")
    return told.select(F.col("line").cast("long").alias("at"), "value")


def read_10x(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells(cell_id, barcode), genes(gene_id, gene_key, gene_name), expr) of a folder with matrix.mtx (genes by barcodes),
    barcodes.tsv and features.tsv (or, in older ones, genes.tsv), each as it is or .gz: what the HDF5 form of the same counts holds."""
    found = lambda *names: f"{folder}/{{{','.join(f'{n}{end}' for n in names for end in ('', '.gz'))}}}"
    part = F.split("value", "\t")
    cells = _numbered_lines(spark, found("barcodes.tsv")).select(F.col("at").alias("cell_id"), part[0].alias("barcode"))
    genes = _numbered_lines(spark, found("features.tsv", "genes.tsv")).select(F.col("at").cast("int").alias("gene_id"), part[0].alias("gene_key"), F.coalesce(F.try_element_at(part, F.lit(2)), part[0]).alias("gene_name"))
    expr = read_matrix_market(spark, found("matrix.mtx")).select(F.col("col").alias("cell_id"), F.col("row").cast("int").alias("gene_id"), "value")
    return cells, genes, expr


def _h5(spark: SparkSession, schema: str, **plan: object) -> DataFrame:
    spark.dataSource.register(hdf5.H5Source)
    return spark.read.format("lattica_h5").schema(schema).option("plan", json.dumps(plan)).load()


def _h5_frame(spark: SparkSession, path: str, columns: list, types: list[str]) -> DataFrame:
    named = ", ".join(f"`{c[0]}` {t}" for c, t in zip(columns, types))
    return _h5(spark, f"at long, {named}", path=path, kind="frame", columns=columns)


def read_h5ad(spark: SparkSession, path: str, x: str = "xcoord", y: str = "ycoord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells(cell_id, cell_name, ...), genes(gene_id, gene_name, ...), expr) of an h5ad file, with its annotations; where cells have the columns x and y
    they are also there as x and y. The path is one that every executor can open (a mounted folder, or a store that pyarrow knows).

    X may be sparse by cells or by genes, or dense (zeros give no row). Tasks read ranges of chunks, as many as make some four million values.
    """
    file = hdf5.File(path)
    matrix = file["X"]
    entry = "cell_id long, gene_id int, value double"
    if "data" in matrix.children:
        kind = str(matrix.attributes.get("encoding-type", matrix.attributes.get("h5sparse_format", "csr")))
        expr = _h5(spark, entry, path=path, kind="sparse", at="X", by="gene" if kind.startswith("csc") else "cell")
    else:
        expr = _h5(spark, entry, path=path, kind="dense", at="X")
    cells = _h5_frame(spark, path, *hdf5.plan_of_frame(file, "obs")).withColumnsRenamed({"at": "cell_id", "name": "cell_name"})
    if {x, y} <= set(cells.columns):
        cells = cells.withColumns({"x": F.col(x).cast("double"), "y": F.col(y).cast("double")})
    genes = _h5_frame(spark, path, *hdf5.plan_of_frame(file, "var"))
    return cells, genes.withColumn("at", F.col("at").cast("int")).withColumnsRenamed({"at": "gene_id", "name": "gene_name"}), expr


def read_10x_h5(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """read_10x()'s tables from the HDF5 form of the same counts, with features (as today) or genes (in older files, whose group is the genome's)."""
    root = hdf5.File(path).root.children
    group = "matrix" if "matrix" in root else next(g for g in sorted(root) if "barcodes" in root[g].children)
    features = [("gene_name", f"{group}/features/name"), ("gene_key", f"{group}/features/id")] if "features" in root[group].children else [("gene_name", f"{group}/gene_names"), ("gene_key", f"{group}/genes")]
    cells = _h5_frame(spark, path, [["barcode", f"{group}/barcodes", None]], ["string"]).select(F.col("at").alias("cell_id"), "barcode")
    genes = _h5_frame(spark, path, [[n, at, None] for n, at in features], ["string", "string"]).select(F.col("at").cast("int").alias("gene_id"), "gene_key", "gene_name")
    return cells, genes, _h5(spark, "cell_id long, gene_id int, value double", path=path, kind="sparse", at=group, by="cell")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """gene_name, upper-cased, from a one-column CSV with header."""
    df = spark.read.csv(path, header=True)
    return df.select(F.upper(F.col(f"`{df.columns[-1]}`")).alias("gene_name"))


def split_wide(df: DataFrame, n_features: int, id_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A wide table whose first n_features columns, next to the id, are values: (cells, genes, expr)."""
    names = [c for c in df.columns if c != id_column][:n_features]
    rest = [c for c in df.columns if c not in names]
    genes = df.sparkSession.createDataFrame(list(enumerate(names)), "gene_id int, gene_name string")
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in range(len(names))]).alias("gene_id"), F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("value")))
    expr = df.select(F.col(id_column).alias("cell_id"), pairs.alias("p")).select("cell_id", F.col("p.gene_id").alias("gene_id"), F.col("p.value").alias("value"))
    return df.select(*[F.col(f"`{c}`") for c in rest]), genes, expr


def write_gene_list(genes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """gene_name, sorted, as a one-column CSV with header that read_gene_list() reads."""
    genes.select("gene_name").orderBy("gene_name").write.mode(mode).csv(path, header=True)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Writes a table as parquet, csv (with header) or json."""
    writer = df.write.mode(mode)
    {"parquet": writer.parquet, "csv": lambda p: writer.csv(p, header=True), "json": writer.json}[kind](path)
