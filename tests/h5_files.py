"""Writes small HDF5 files by the format's published description, in its old and its newer form, for the tests of the reader."""

import struct
import zlib

import numpy as np

NOWHERE = 0xFFFFFFFFFFFFFFFF
pad = lambda b: b + bytes(-len(b) % 8)


class Writer:
    """new: version 2 superblock and object headers with links, instead of symbol tables."""

    def __init__(self, new=False):
        self.new, self.data = new, bytearray(96)

    def put(self, b):
        self.data += bytes(-len(self.data) % 8)
        at = len(self.data)
        self.data += b
        return at

    def header(self, messages):
        if self.new:
            # a continuation block holds all but the first message
            more = b"OCHK" + b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages[1:]) + bytes(4)
            at = self.put(more)
            k, m = messages[0]
            first = struct.pack("<BHB", k, len(m), 0) + m + struct.pack("<BHBQQ", 0x10, 16, 0, at, len(more))
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(first)) + first + bytes(4))
        body = b"".join(struct.pack("<HHB3x", k, len(pad(m)), 0) + pad(m) for k, m in messages)
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def space(self, shape):
        return struct.pack(f"<BBBB{len(shape)}Q", 2, len(shape), 0, 1 if shape else 0, *shape) if self.new else struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)

    def typed(self, x):
        """(datatype, bytes) of an array or list of text."""
        if isinstance(x, list):
            blobs = [t.encode() for t in x]
            body = b"".join(struct.pack("<HH4xQ", i + 1, 1, len(b)) + pad(b) for i, b in enumerate(blobs)) + bytes(16)
            at = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(body)) + body)
            base = struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)
            return struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + base, b"".join(struct.pack("<IQI", len(b), at if b else 0, i + 1 if b else 0) for i, b in enumerate(blobs))
        x = np.asarray(x)
        size = x.dtype.itemsize
        if x.dtype.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, size), x.tobytes()
        if x.dtype.kind == "b":
            base = struct.pack("<BBBBIHH", 0x10, 8, 0, 0, 1, 0, 8)
            return struct.pack("<BBBBI", 0x18, 2, 0, 0, 1) + base + pad(b"FALSE\0") + pad(b"TRUE\0") + b"\0\1", x.tobytes()
        big = x.dtype.byteorder == ">"
        if x.dtype.kind == "f":
            return struct.pack("<BBBBIHH4BI", 0x11, 0x20 | big, size * 8 - 1, 0, size, 0, size * 8, *((52, 11, 0, 52) if size == 8 else (23, 8, 0, 23)), 1023 if size == 8 else 127), x.tobytes()
        return struct.pack("<BBBBIHH", 0x10, (8 if x.dtype.kind == "i" else 0) | big, 0, 0, size, 0, size * 8), x.tobytes()

    def attributes(self, attrs):
        out = []
        for name, v in attrs.items():
            kind, data = self.typed([v] if isinstance(v, str) else v)
            shape = () if isinstance(v, str) else np.shape(v)
            space, name = self.space(shape), name.encode() + b"\0"
            if self.new:
                out.append((0x0C, struct.pack("<BBHHHB", 3, 0, len(name), len(kind), len(space), 1) + name + kind + space + data))
            else:
                out.append((0x0C, struct.pack("<BBHHH", 1, 0, len(name), len(kind), len(space)) + pad(name) + pad(kind) + pad(space) + data))
        return out

    def dataset(self, x, chunk=None, filters=(), attrs={}):
        kind, data = self.typed(x)
        shape = (len(x),) if isinstance(x, list) else np.shape(x)
        messages = [(0x01, self.space(shape)), (0x03, kind)]
        if chunk is None:
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(data), len(data))))
        else:
            size = len(data) // int(np.prod(shape))
            raw, keys = np.frombuffer(data, f"V{size}").reshape(shape), []
            for at in np.ndindex(*[-(-s // c) for s, c in zip(shape, chunk)]):
                full = np.zeros(chunk, f"V{size}")
                part = raw[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk))]
                full[tuple(slice(0, n) for n in part.shape)] = part
                b = full.tobytes()
                for f in filters:
                    if f == 2:
                        b = np.frombuffer(b, np.uint8).reshape(-1, size).T.tobytes()
                    elif f == 1:
                        b = zlib.compress(b)
                    elif f == 3:
                        b += b"sum!"
                keys.append((struct.pack(f"<II{len(shape) + 1}Q", len(b), 0, *[i * c for i, c in zip(at, chunk)], 0), self.put(b)))
            end = struct.pack(f"<II{len(shape) + 1}Q", 0, 0, *shape, 0)
            node = lambda level, keys: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(keys), NOWHERE, NOWHERE) + b"".join(k + struct.pack("<Q", a) for k, a in keys) + end)
            halves = [keys[: len(keys) // 2], keys[len(keys) // 2 :]] if len(keys) > 3 else [keys]
            tree = node(0, keys) if len(halves) == 1 else node(1, [(h[0][0], node(0, h)) for h in halves])
            messages.append((0x08, struct.pack(f"<BBBQ{len(chunk) + 1}I", 3, 2, len(chunk) + 1, tree, *chunk, size)))
            if filters:
                value = {1: (4,), 2: (size,), 3: ()}
                if self.new:
                    body = b"".join(struct.pack(f"<HHH{len(value.get(f, ()))}I", f, 0, len(value.get(f, ())), *value.get(f, ())) for f in filters)
                    body = body if all(f < 256 for f in filters) else b"".join(struct.pack("<HHHH", f, 0, 0, 0) for f in filters)
                    messages.append((0x0B, struct.pack("<BB", 2, len(filters)) + body))
                else:
                    name = pad(b"some filter\0")
                    body = b"".join(struct.pack("<HHHH", f, len(name), 0, len(value.get(f, ()))) + name + struct.pack(f"<{len(value.get(f, ()))}I", *value.get(f, ())) + bytes(4 * (len(value.get(f, ())) % 2)) for f in filters)
                    messages.append((0x0B, struct.pack("<BB6x", 1, len(filters)) + body))
        return self.header(messages + self.attributes(attrs))

    def group(self, children, attrs={}):
        if self.new:
            links = [(0x02, struct.pack("<BBQQ", 0, 0, NOWHERE, NOWHERE))]
            links += [(0x06, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", at)) for n, at in children.items()]
            return self.header(links + self.attributes(attrs))
        text, place = bytearray(8), {}
        for n in sorted(children):
            place[n] = len(text)
            text += pad(n.encode() + b"\0")
        names = self.put(bytes(text))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(text), 1, names))
        nodes = []
        for some in (sorted(children)[:3], sorted(children)[3:]):
            if some:
                nodes.append((place[some[-1]], self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(some)) + b"".join(struct.pack("<QQII16x", place[n], children[n], 0, 0) for n in some))))
        tree = self.put(b"TREE" + struct.pack("<BBHQQQ", 0, 0, len(nodes), NOWHERE, NOWHERE, 0) + b"".join(struct.pack("<QQ", at, last) for last, at in nodes))
        return self.header([(0x11, struct.pack("<QQ", tree, heap)), *self.attributes(attrs)])

    def save(self, path, root):
        sign = b"\x89HDF\r\n\x1a\n"
        if self.new:
            head = sign + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, NOWHERE, len(self.data), root, 0)
        else:
            head = sign + struct.pack("<8BHHIQQQQQQII16x", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, NOWHERE, len(self.data), NOWHERE, 0, root, 0, 0)
        self.data[: len(head)] = head
        path.write_bytes(bytes(self.data))
