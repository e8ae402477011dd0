"""Tensor containers as data sources: field and tensor rows, bytes only where they are asked for.

``format("gguf")`` reads the public GGUF container (versions 2 and 3, either byte order);
with option ``tensor`` a single tensor is read. ``safetensors_header`` lists the other
common container. Paths are local to the executors or mounted on all of them."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandline.functions.codecs import SIZES

#: Type codes of the container (fixed values): scalars by struct letter, tensors by codec.
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY = 8, 9
TENSORS = {0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 6: "Q5_0", 7: "Q5_1", 8: "Q8_0", 10: "Q2_K", 11: "Q3_K", 12: "Q4_K", 13: "Q5_K", 14: "Q6_K", 20: "IQ4_NL", 23: "IQ4_XS", 24: "I8", 25: "I16", 26: "I32", 27: "I64", 28: "F64", 30: "BF16", 34: "TQ1_0", 35: "TQ2_0", 39: "MXFP4"}
PLAIN = {"F32": 4, "F16": 2, "I8": 1, "I16": 2, "I32": 4, "I64": 8, "F64": 8}


class _Reader:
    def __init__(self, f):
        self.f = f
        if f.read(4) != b"GGUF":
            raise ValueError("not a GGUF file")
        version = f.read(4)
        self.order = "<" if struct.unpack("<I", version)[0] & 0xFFFF else ">"
        self.version = struct.unpack(self.order + "I", version)[0]
        if self.version not in (2, 3):
            raise ValueError(f"version {self.version}")

    def take(self, kind: str):
        return struct.unpack(self.order + kind, self.f.read(struct.calcsize(kind)))[0]

    def text(self) -> str:
        return self.f.read(self.take("Q")).decode("utf-8", "replace")

    def value(self, code: int):
        if code == STRING:
            return self.text()
        if code == ARRAY:
            inner, n = self.take("I"), self.take("Q")
            return [self.value(inner) for _ in range(n)]
        return self.take(SCALARS[code])

    def header(self) -> tuple[list[tuple], list[tuple]]:
        """(key, type code, value) of the fields, (name, shape, codec, first byte, bytes) of the tensors."""
        n_tensors, n_fields = self.take("Q"), self.take("Q")
        fields, seen = [], set()
        for _ in range(n_fields):
            at, key, code = self.f.tell(), self.text(), self.take("I")
            key = f"{key}_{at}" if key in seen else key  # a repeated key stays, under another name
            seen.add(key)
            fields.append((key, code, self.value(code)))
        align = next((v for k, _, v in fields if k == "general.alignment"), 32)
        infos = []
        for _ in range(n_tensors):
            name = self.text()
            shape = [self.take("Q") for _ in range(self.take("I"))]
            infos.append((name, shape, TENSORS.get(code := self.take("I"), str(code)), self.take("Q")))
        if len({i[0] for i in infos}) < len(infos):
            raise ValueError("two tensors of one name")
        base = -(-self.f.tell() // align) * align
        return fields, [(n, s, c, base + off, self.size(s, c)) for n, s, c, off in infos]

    @staticmethod
    def size(shape: list[int], codec: str) -> int:
        n = 1
        for d in shape:
            n *= d
        if codec in PLAIN:
            return n * PLAIN[codec]
        if codec in SIZES:
            return n // SIZES[codec][0] * SIZES[codec][1]
        return 0


class _Part(InputPartition):
    def __init__(self, name, shape, codec, at, size):
        self.row = (name, shape, codec, at, size)


class _TensorReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.want, self.data = options["path"], options.get("tensor"), options.get("data", "true") == "true"

    def partitions(self):
        with open(self.path, "rb") as f:
            tensors = _Reader(f).header()[1]
        return [_Part(*t) for t in tensors if self.want is None or t[0] == self.want] or [_Part(None, [], "", 0, 0)]

    def read(self, part) -> Iterator[tuple]:
        name, shape, codec, at, size = part.row
        if name is None:
            return
        raw = None
        if self.data:
            with open(self.path, "rb") as f:
                f.seek(at)
                raw = f.read(size)
        yield name, shape, codec, at, size, raw


class GgufSource(DataSource):
    """Options: path, tensor (only that one), data (false: no bytes). One partition for each tensor."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return "name string, shape array<bigint>, codec string, first_byte bigint, n_bytes bigint, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TensorReader(self.options)


def gguf_fields(path: str) -> list[tuple[str, int, str]]:
    """(key, type code, value as JSON) of the key-value fields."""
    with open(path, "rb") as f:
        return [(k, c, json.dumps(v, ensure_ascii=False)) for k, c, v in _Reader(f).header()[0]]


def write_gguf(path: str, fields: list[tuple[str, int, object]], tensors: list[tuple[str, list[int], str, bytes]], align: int = 32) -> None:
    """A container of version 3."""
    codes = {v: k for k, v in TENSORS.items()}
    text = lambda s: struct.pack("<Q", len(b := s.encode())) + b

    def value(code, v):
        if code == STRING:
            return text(v)
        return struct.pack("<" + SCALARS[code], v)

    fields = [*fields, ("general.alignment", 4, align)] if align != 32 else fields
    out = [b"GGUF", struct.pack("<IQQ", 3, len(tensors), len(fields))]
    out += [text(k) + struct.pack("<I", c) + value(c, v) for k, c, v in fields]
    at, blobs = 0, []
    for name, shape, codec, raw in tensors:
        out.append(text(name) + struct.pack(f"<I{len(shape)}QIQ", len(shape), *shape, codes[codec], at))
        pad = -len(raw) % align
        blobs.append(raw + b"\0" * pad)
        at += len(raw) + pad
    head = b"".join(out)
    with open(path, "wb") as f:
        f.write(head + b"\0" * (-len(head) % align) + b"".join(blobs))


def safetensors_header(path: str) -> list[tuple[str, str, list[int], int, int]]:
    """(name, type, shape, first byte, bytes), by name."""
    with open(path, "rb") as f:
        n = struct.unpack("<Q", f.read(8))[0]
        head = json.loads(f.read(n))
    return sorted((k, v["dtype"], v["shape"], 8 + n + v["data_offsets"][0], v["data_offsets"][1] - v["data_offsets"][0]) for k, v in head.items() if k != "__metadata__")


def parameter_count(rows) -> tuple[int, str]:
    """Total of the shapes' products and its short label."""
    total = 0
    for shape in rows:
        n = 1
        for d in shape:
            n *= d
        total += n
    for size, mark in ((1e12, "T"), (1e9, "B"), (1e6, "M")):
        if total >= size:
            return total, f"{total / size:.1f}{mark}"
    return total, f"{total / 1e3:.1f}K"
