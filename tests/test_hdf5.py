"""h5ad and 10x HDF5 files give the counts of their MatrixMarket form."""

import numpy as np
import pytest

from lattica import sources
from lattica.sources import hdf5

from .h5_files import Writer
from .test_sources import put


def counts(n=40, g=7, seed=0):
    x = np.random.default_rng(seed).integers(0, 9, (n, g)) * (np.random.default_rng(seed + 1).random((n, g)) < 0.3)
    x[3] = 0
    x[n - 1] = 0
    return x


def packed(x):
    """data, indices, indptr by rows."""
    row, col = np.nonzero(x)
    return x[row, col], col, np.searchsorted(row, np.arange(len(x) + 1))


def small_tasks(monkeypatch):
    monkeypatch.setattr(hdf5, "TASK", 20)


def entries(expr):
    return sorted((r.cell_id, r.gene_id, r.value) for r in expr.collect())


def expected(x):
    return sorted((int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x)))


@pytest.mark.parametrize("new,filters", [(False, (2, 1)), (True, (1, 3)), (True, ()), (False, (3,))])
def test_10x_equals_its_matrix_market_form(spark, tmp_path, new, filters):
    x = counts()
    data, index, ends = packed(x)
    w = Writer(new)
    names = [f"gene {j}" for j in range(7)]
    group = {
        "barcodes": w.dataset(np.array([f"B{i}-1" for i in range(40)], "S9"), (16,), filters),
        "data": w.dataset(data.astype(np.int32), (13,), filters),
        "indices": w.dataset(index.astype(np.int64), (11,), filters),
        "indptr": w.dataset(ends.astype(np.int64), (5,), filters),
        "shape": w.dataset(np.array([7, 40], np.int32)),
        "features": w.group({"id": w.dataset(np.array([f"E{j}" for j in range(7)], "S4")), "name": w.dataset(names)}),
    }
    w.save(tmp_path / "c.h5", w.group({"matrix": w.group(group)}))
    put(tmp_path / "barcodes.tsv", [f"B{i}-1" for i in range(40)])
    put(tmp_path / "features.tsv", [f"E{j}\t{n}" for j, n in enumerate(names)])
    put(tmp_path / "matrix.mtx", ["%%MatrixMarket matrix coordinate integer general", f"7 40 {len(data)}", *[f"{j + 1} {i + 1} {int(v)}" for i, j, v in expected(x)]])
    for a, b in zip(sources.read_10x_h5(spark, str(tmp_path / "c.h5")), sources.read_10x(spark, str(tmp_path))):
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))


def annotated(w, x):
    obs = {
        "_index": w.dataset([f"cell {i}" for i in range(len(x))]),
        "xcoord": w.dataset(np.arange(len(x)) * 0.5, (7,), (1,)),
        "ycoord": w.dataset(np.arange(len(x)).astype(">f4")),
        "kind": w.group({"codes": w.dataset((np.arange(len(x)) % 3 - 1).astype(np.int8)), "categories": w.dataset(["α", ""])}, {"encoding-type": "categorical"}),
        "kept": w.dataset(np.arange(len(x)) % 2 == 0),
    }
    return {"obs": w.group(obs, {"_index": "_index"}), "var": w.group({"symbol": w.dataset([f"g{j}" for j in range(x.shape[1])])}, {"_index": "symbol"})}


@pytest.mark.parametrize("form", ["csr_matrix", "csc_matrix", "dense", "dense in chunks"])
@pytest.mark.parametrize("new", [False, True])
def test_h5ad(spark, tmp_path, form, new):
    x, w = counts(), Writer(new)
    parts = annotated(w, x)
    if form.startswith("dense"):
        parts["X"] = w.dataset(x.astype(np.float32), (6, 3) if "chunks" in form else None, (2, 1) if "chunks" in form else ())
    else:
        data, index, ends = packed(x if form == "csr_matrix" else x.T)
        parts["X"] = w.group({"data": w.dataset(data.astype(float), (10,), (1,)), "indices": w.dataset(index.astype(np.uint32), (9,)), "indptr": w.dataset(ends.astype(np.int32))}, {"encoding-type": form, "shape": np.array(x.shape)})
    w.save(tmp_path / "a.h5ad", w.group(parts))
    cells, genes, expr = sources.load(spark, h5ad=str(tmp_path / "a.h5ad"))
    assert entries(expr) == expected(x)
    got = sorted(cells.select("cell_id", "cell_name", "x", "y", "kind", "kept").collect())
    assert got == [(i, f"cell {i}", i * 0.5, float(i), [None, "α", ""][i % 3], i % 2 == 0) for i in range(40)]
    assert sorted(map(tuple, genes.collect())) == [(j, f"g{j}") for j in range(7)]


def test_ranges_of_chunks(tmp_path, monkeypatch):
    """Tasks are whole chunks, and each finds the rows of its own range."""
    monkeypatch.setattr(hdf5, "TASK", 20)
    monkeypatch.setattr(hdf5, "BATCH", 7)
    x, w = counts(3000, 5), Writer()
    data, index, ends = packed(x)
    group = w.group({"data": w.dataset(data, (8,)), "indices": w.dataset(index, (30,)), "indptr": w.dataset(ends, (100,))})
    w.save(tmp_path / "s.h5", w.group({"X": group}))
    reader = hdf5.H5Reader({"path": str(tmp_path / "s.h5"), "kind": "sparse", "at": "X", "by": "cell"})
    parts = reader.partitions()
    assert all(p.lo % 8 == 0 for p in parts) and len(parts) > 100
    some = [row for p in parts[::17] for b in reader.read(p) for row in zip(*(c.to_pylist() for c in b.columns))]
    every = expected(x)
    assert some == [e for p in parts[::17] for e in every[p.lo : p.hi]]


def test_what_is_unknown_raises(tmp_path):
    (tmp_path / "no.h5").write_bytes(b"text")
    with pytest.raises(ValueError):
        hdf5.File(str(tmp_path / "no.h5"))
    for new in (False, True):
        w = Writer(new)
        w.save(tmp_path / "f.h5", w.group({"a": w.dataset(np.arange(9), (4,), (32015,))}))
        with pytest.raises(NotImplementedError, match="32015"):
            hdf5.File(str(tmp_path / "f.h5"))["a"].read()
    w = Writer()
    w.save(tmp_path / "e.h5", w.group({"a": w.dataset(np.zeros(0))}))
    assert len(hdf5.File(str(tmp_path / "e.h5"))["a"].read()) == 0
