"""Counts and annotations from HDF5 files (h5ad, 10x) as a Spark data source.

Only what such files use of the format is read: groups as symbol tables or links, contiguous, compact and version 1 chunked datasets of numbers and
strings, deflate, shuffle and checksums. Anything else raises. The driver looks at headers; tasks are ranges of a dataset's chunks, and each
reads the chunks of its range.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Values of a task, and of a batch that it hands over.
TASK, BATCH = 4_000_000, 500_000
#: Fixed values of the format: kinds of header messages, and of filters.
SPACE, LINKS, TYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = 0xFFFFFFFFFFFFFFFF


class File:
    """An open file; addresses and lengths are of 8 bytes, as in every file of that kind."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        self.source = where.open_input_file(name)
        self.heaps: dict[int, dict[int, bytes]] = {}
        self.base = next((at for at in (0, 512, 1024, 2048) if self.source.read_at(8, at) == b"\x89HDF\r\n\x1a\n"), None)
        if self.base is None:
            raise ValueError(f"{path} is no HDF5 file")
        head = self.bytes(0, 128)
        new = head[8] >= 2
        if head[8] > 3 or (head[9], head[10]) != (8, 8) and new or (head[13], head[14]) != (8, 8) and not new:
            raise NotImplementedError("HDF5 superblock of an unknown version or with addresses not of 8 bytes")
        self.root = Node(self, *struct.unpack_from("<Q", head, 36 if new else 64 + (4 if head[8] == 1 else 0)))

    def bytes(self, at: int, n: int) -> bytes:
        return self.source.read_at(n, self.base + at)

    def heap(self, at: int) -> dict[int, bytes]:
        """The objects of a global heap collection."""
        if at not in self.heaps:
            size = struct.unpack("<Q", self.bytes(at + 8, 8))[0]
            data, out, here = self.bytes(at, size), {}, 16
            while here + 16 <= size:
                number, n = struct.unpack_from("<H6xQ", data, here)
                if number == 0:
                    break
                out[number] = data[here + 16 : here + 16 + n]
                here += 16 + -(-n // 8) * 8
            self.heaps = {at: out} if len(self.heaps) > 64 else self.heaps | {at: out}
        return self.heaps[at]

    def __getitem__(self, path: str) -> Node:
        node = self.root
        for name in path.strip("/").split("/"):
            node = node.children[name]
        return node


class Node:
    """A group or dataset, by its object header."""

    def __init__(self, file: File, at: int):
        self.file, self.at = file, at

    @cached_property
    def messages(self) -> list[tuple[int, bytes]]:
        head, out = self.file.bytes(self.at, 64), []
        if head[:4] == b"OHDR":
            flags, here = head[5], 6 + (16 if head[5] & 0x20 else 0) + (4 if head[5] & 0x10 else 0)
            width = 1 << (flags & 3)
            parts, short = [(self.at + here + width, int.from_bytes(head[here : here + width], "little"))], True
        else:
            parts, short, flags = [(self.at + 16, struct.unpack_from("<I", head, 8)[0])], False, 0
        for at, n in parts:  # grows by continuations
            data, here = self.file.bytes(at, n), 0
            while here + (4 if short else 8) <= len(data):
                kind, size = struct.unpack_from("<BH" if short else "<HH", data, here)
                here += (6 if flags & 4 else 4) if short else 8
                body = data[here : here + size]
                here += size
                if kind == CONTINUED:
                    to, many = struct.unpack_from("<QQ", body)
                    parts.append((to + 4, many - 8) if short else (to, many))
                else:
                    out.append((kind, body))
        return out

    def message(self, kind: int) -> bytes | None:
        return next((m for k, m in self.messages if k == kind), None)

    @cached_property
    def children(self) -> dict[str, Node]:
        out, table = {}, self.message(SYMBOLS)
        if table is not None:
            tree, heap = struct.unpack_from("<QQ", table)
            names = struct.unpack_from("<Q", self.file.bytes(heap, 32), 24)[0]
            size = struct.unpack_from("<Q", self.file.bytes(heap, 32), 8)[0]
            text = self.file.bytes(names, size)
            for node in self._leaves(tree):
                many = struct.unpack_from("<H", self.file.bytes(node, 8), 6)[0]
                for name, at in struct.iter_unpack("<QQ24x", self.file.bytes(node + 8, 40 * many)):
                    out[text[name : text.index(b"\0", name)].decode()] = Node(self.file, at)
        for kind, m in self.messages:
            if kind == LINKS and struct.unpack_from("<Q", m, 2 + (8 if m[1] & 1 else 0))[0] != NOWHERE:
                raise NotImplementedError("HDF5 group with links in a fractal heap")
            if kind == LINK:
                flags, here = m[1], 2
                soft = flags & 8 and m[here] != 0
                here += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                n = int.from_bytes(m[here : here + width], "little")
                if not soft:
                    out[m[here + width : here + width + n].decode()] = Node(self.file, *struct.unpack_from("<Q", m, here + width + n))
        return out

    def _leaves(self, at: int) -> Iterator[int]:
        level, many = struct.unpack_from("<xBH", self.file.bytes(at + 4, 4))
        for _, child in struct.iter_unpack("<QQ", self.file.bytes(at + 24, 16 * many)):
            yield from self._leaves(child) if level else [child]

    @cached_property
    def attributes(self) -> dict[str, object]:
        out = {}
        for kind, m in self.messages:
            if kind == ATTRIBUTE:
                name, typed, space = struct.unpack_from("<HHH", m, 2)
                pad = (lambda n: -(-n // 8) * 8) if m[0] == 1 else (lambda n: n)
                here = 8 + (1 if m[0] == 3 else 0)
                t, s = here + pad(name), here + pad(name) + pad(typed)
                shape = _shape(m[s : s + space])
                values = _Type(m[t : t + typed]).values(m[s + pad(space) :], int(np.prod(shape)), self.file)
                out[m[here : here + name].rstrip(b"\0").decode()] = values[0] if not shape else values
        return out

    @cached_property
    def shape(self) -> tuple[int, ...]:
        return _shape(self.message(SPACE))

    @cached_property
    def type(self) -> _Type:
        return _Type(self.message(TYPE))

    @cached_property
    def filters(self) -> list[tuple[int, tuple[int, ...]]]:
        m, out = self.message(FILTERS), []
        if m is None:
            return out
        here = 8 if m[0] == 1 else 2
        for _ in range(m[1]):
            kind = struct.unpack_from("<H", m, here)[0]
            named = m[0] == 1 or kind >= 256
            name = struct.unpack_from("<H", m, here + 2)[0] if named else 0
            values = struct.unpack_from("<H", m, here + (6 if named else 4))[0]
            here += (8 if named else 6) + (-(-name // 8) * 8 if m[0] == 1 else name)
            if kind not in (DEFLATE, SHUFFLE, CHECKSUM):
                raise NotImplementedError(f"HDF5 filter {kind}")
            out.append((kind, struct.unpack_from(f"<{values}I", m, here)))
            here += 4 * values + (4 if m[0] == 1 and values % 2 else 0)
        return out

    @cached_property
    def layout(self) -> tuple:
        m = self.message(LAYOUT)
        if m[0] == 3 and m[1] == 0:
            return "compact", m[4 : 4 + struct.unpack_from("<H", m, 2)[0]]
        if m[0] in (3, 4) and m[1] == 1:
            return "contiguous", struct.unpack_from("<Q", m, 2)[0]
        if m[0] == 3 and m[1] == 2:
            return "chunked", struct.unpack_from("<Q", m, 3)[0], struct.unpack_from(f"<{m[2] - 1}I", m, 11)
        raise NotImplementedError(f"HDF5 layout version {m[0]}, class {m[1]}")

    @cached_property
    def chunks(self) -> list[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, bytes, filter mask, address) of each chunk, in order of offsets."""
        rank, out = len(self.shape), []

        def walk(at: int) -> None:
            level, many = struct.unpack_from("<xBH", self.file.bytes(at + 4, 4))
            width = 8 + 8 * (rank + 1) + 8
            data = self.file.bytes(at + 24, width * many)
            for i in range(many):
                size, mask, *offsets = struct.unpack_from(f"<II{rank}Q", data, i * width)
                child = struct.unpack_from("<Q", data, i * width + width - 8)[0]
                walk(child) if level else out.append((tuple(offsets), size, mask, child))

        if self.layout[1] != NOWHERE:
            walk(self.layout[1])
        return sorted(out)

    @property
    def step(self) -> int:
        """Rows that are best read together: those of a chunk."""
        return self.layout[2][0] if self.layout[0] == "chunked" else 1

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Rows lo to hi of the first dimension, from the chunks that hold them; numbers, or text as objects."""
        shape = self.shape or (1,)
        hi = shape[0] if hi is None else min(hi, shape[0])
        row = int(np.prod(shape[1:], dtype=np.int64))
        size = self.type.size * row
        if self.layout[0] != "chunked":
            where = self.layout[1]
            data = where[lo * size : hi * size] if self.layout[0] == "compact" else b"" if where == NOWHERE else self.file.bytes(where + lo * size, (hi - lo) * size)
            data = data or bytes((hi - lo) * size)  # never written: zeros
            return self.type.values(data, (hi - lo) * row, self.file).reshape(hi - lo, *shape[1:])
        out = np.zeros((hi - lo, *shape[1:]), self.type.stored)
        cut = self.layout[2]
        for offsets, n, mask, at in self.chunks:
            first, last = max(lo, offsets[0]), min(hi, offsets[0] + cut[0])
            if first < last:
                chunk = np.frombuffer(self._plain(self.file.bytes(at, n), mask), self.type.stored, int(np.prod(cut))).reshape(cut)
                to = (slice(first - lo, last - lo), *(slice(o, min(o + c, s)) for o, c, s in zip(offsets[1:], cut[1:], shape[1:])))
                out[to] = chunk[(slice(first - offsets[0], last - offsets[0]), *(slice(0, t.stop - t.start) for t in to[1:]))]
        return self.type.values(out.tobytes(), out.size, self.file).reshape(out.shape)

    def _plain(self, data: bytes, mask: int) -> bytes:
        for i in range(len(self.filters) - 1, -1, -1):
            kind, values = self.filters[i]
            if mask >> i & 1:
                continue
            if kind == DEFLATE:
                data = zlib.decompress(data)
            elif kind == CHECKSUM:
                data = data[:-4]
            elif values[0] > 1:
                n = len(data) // values[0]
                data = np.frombuffer(data, np.uint8, n * values[0]).reshape(values[0], n).T.tobytes() + data[n * values[0] :]
        return data


class _Type:
    """A datatype: numbers, truth values (an enumeration of bytes), text of fixed or of any length."""

    def __init__(self, m: bytes):
        self.kind, bits, self.size = m[0] & 15, m[1], struct.unpack_from("<I", m, 4)[0]
        order = "<>"[bits & 1]
        if self.kind == 8:
            inner = _Type(m[8:])
            self.stored, self.name = inner.stored, "boolean" if inner.size == 1 else "long"
        elif self.kind == 0:
            self.stored, self.name = np.dtype(f"{order}{'i' if bits & 8 else 'u'}{self.size}"), "long"
        elif self.kind == 1:
            self.stored, self.name = np.dtype(f"{order}f{self.size}"), "double"
        elif self.kind == 3 or self.kind == 9 and bits & 15 == 1:
            self.stored, self.name = np.dtype(f"V{self.size}"), "string"
        else:
            raise NotImplementedError(f"HDF5 datatype of class {self.kind}")

    def values(self, data: bytes, n: int, file: File) -> np.ndarray:
        raw = np.frombuffer(data, self.stored, n)
        if self.name != "string":
            return raw.astype(bool) if self.name == "boolean" else raw.astype(raw.dtype.newbyteorder("="))
        out = np.empty(n, object)
        for i in range(n):
            one = data[i * self.size : (i + 1) * self.size]
            if self.kind == 9:
                size, at, number = struct.unpack("<IQI", one)
                one = file.heap(at)[number][:size] if size else b""
            out[i] = one.rstrip(b"\0").decode()
        return out


def _shape(m: bytes) -> tuple[int, ...]:
    return struct.unpack_from(f"<{m[1]}Q", m, 8 if m[0] == 1 else 4)


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class H5Source(DataSource):
    """spark.read.format("lattica_h5") with the option `plan`, which the readers in lattica.sources make, and its schema."""

    @classmethod
    def name(cls) -> str:
        return "lattica_h5"

    def reader(self, schema) -> H5Reader:
        return H5Reader(json.loads(self.options["plan"]))


class H5Reader(DataSourceReader):
    """plan: path; kind sparse (group, by: what its rows are), dense (at) or frame (columns: name, at, categories or null)."""

    def __init__(self, plan: dict):
        self.plan = plan

    def partitions(self) -> list[InputPartition]:
        file, p = File(self.plan["path"]), self.plan
        node = file[f"{p['at']}/data"] if p["kind"] == "sparse" else file[p["at"]] if p["kind"] == "dense" else file[p["columns"][0][1]]
        n = node.shape[0]
        rows = max(1, TASK // max(1, int(np.prod(node.shape[1:], dtype=np.int64))))
        rows = max(node.step, rows // node.step * node.step)  # whole chunks
        return [_Range(lo, min(lo + rows, n)) for lo in range(0, n, rows)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        file = File(self.plan["path"])
        kind = self.plan["kind"]
        width = int(np.prod(file[self.plan["at"]].shape[1:])) if kind == "dense" else 1
        step = max(1, BATCH // max(1, width))
        for lo in range(partition.lo, partition.hi, step):
            yield from getattr(self, f"_{kind}")(file, lo, min(lo + step, partition.hi))

    def _sparse(self, file: File, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        group = file[self.plan["at"]]
        index, value, ends = group.children["indices"].read(lo, hi), group.children["data"].read(lo, hi), group.children["indptr"]
        # the row that position lo is in: the last whose first position is at most lo; found by halving, chunk by chunk
        a, b = 0, ends.shape[0] - 1
        while b - a > max(ends.step, 1024):
            m = (a + b) // 2
            a, b = (m, b) if ends.read(m, m + 1)[0] <= lo else (a, m)
        at, cuts = a, [ends.read(a, a + 1)]
        while cuts[-1][-1] < hi and at + 1 < ends.shape[0]:
            cuts.append(ends.read(at + 1, at + 1 + max(ends.step, 4096)))
            at += len(cuts[-1])
        major = a + np.searchsorted(np.concatenate(cuts), np.arange(lo, hi), side="right") - 1
        yield self._entries(*((major, index) if self.plan["by"] == "cell" else (index, major)), value)

    def _dense(self, file: File, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        x = file[self.plan["at"]].read(lo, hi)
        row, col = np.nonzero(x)
        yield self._entries(row + lo, col, x[row, col])

    @staticmethod
    def _entries(cell: np.ndarray, gene: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(gene.astype(np.int32)), pa.array(value.astype(float))], names=["cell_id", "gene_id", "value"])

    def _frame(self, file: File, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(np.arange(lo, hi))]
        for _, at, categories in self.plan["columns"]:
            values = file[at].read(lo, hi)
            if categories is not None:
                names = np.append(file[categories].read().astype(str).astype(object), None)
                values = names[values.astype(np.int64)]  # -1 is missing
            kind = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}
            columns.append(pa.array(values.tolist(), pa.string()) if values.dtype == object else pa.array(values).cast(kind[file[at].type.name]))
        yield pa.RecordBatch.from_arrays(columns, names=["at", *(c[0] for c in self.plan["columns"])])


def plan_of_frame(file: File, group: str) -> tuple[list, list[str]]:
    """(name, where, where its categories are or null) of the columns of an annotation table, its index first as `name`; and their types."""
    node = file[group]
    index = node.attributes.get("_index", "_index")
    columns, types = [["name", f"{group}/{index}", None]], ["string"]
    for name, child in node.children.items():
        if name in (index, "__categories"):
            continue
        if "codes" in child.children:
            columns.append([name, f"{group}/{name}/codes", f"{group}/{name}/categories"])
            types.append("string")
        elif child.message(SPACE) is not None and len(child.shape) == 1:
            columns.append([name, f"{group}/{name}", None])
            types.append(child.type.name)
    return columns, types
