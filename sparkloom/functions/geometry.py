"""EWKB geometries: bytes to (srid, WKT) and back; points, lines, polygons and collections of them, in two dimensions."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Geometry types of the format, and the bit that tells of an SRID.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
SRID = 0x20000000


def _number(x: float) -> str:
    return repr(int(x)) if x == int(x) else repr(x)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def points(self, order: str, n: int) -> str:
        return ", ".join(" ".join(map(_number, self.take(order + "2d"))) for _ in range(n))

    def geometry(self) -> tuple[int | None, str, str]:
        order = "<" if self.take("B")[0] else ">"
        code = self.take(order + "I")[0]
        srid = self.take(order + "i")[0] if code & SRID else None
        kind = KINDS[code & 0xFF]
        if code & 0xC0000000 or code & 0x1FFFFF00:
            raise ValueError("only two dimensions")
        if kind == "POINT":
            body = self.points(order, 1)
        else:
            n = self.take(order + "I")[0]
            if kind == "LINESTRING":
                body = self.points(order, n)
            elif kind == "POLYGON":
                body = ", ".join(f"({self.points(order, self.take(order + 'I')[0])})" for _ in range(n))
            else:
                parts = [self.geometry() for _ in range(n)]
                body = ", ".join(f"{k} ({b})" if kind == "GEOMETRYCOLLECTION" else f"({b})" for _, k, b in parts)
        return srid, kind, body


def decode(data: bytes | None) -> tuple[int | None, str] | None:
    """(srid, WKT); None for what is not a geometry."""
    try:
        srid, kind, body = _Reader(bytes(data)).geometry()
    except (TypeError, KeyError, ValueError, struct.error, OverflowError):
        return None
    return srid, f"{kind} ({body})"


def _parts(body: str) -> list[str]:
    """The members of a list, parted at commas outside brackets, without their own brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(body + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(body[last:i].strip())
            last = i + 1
    return [x for x in out if x]


def encode(wkt: str | None, srid: int | None = None) -> bytes | None:
    """Little-endian bytes of a WKT text, with its SRID if there is one; None for what is not WKT."""
    codes = {v: k for k, v in KINDS.items()}

    def points(text: str) -> bytes:
        return b"".join(struct.pack("<2d", *map(float, p.split())) for p in _parts(text))

    def one(text: str, own: int | None) -> bytes:
        kind, _, rest = text.strip().partition("(")
        kind, body = kind.strip().upper(), rest.rstrip()[:-1]
        code = codes[kind]
        head = struct.pack("<BI", 1, code | (SRID if own is not None else 0)) + (struct.pack("<i", own) if own is not None else b"")
        if kind == "POINT":
            return head + points(body)
        parts = _parts(body)
        if kind == "LINESTRING":
            return head + struct.pack("<I", len(parts)) + points(body)
        if kind == "POLYGON":
            return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(_parts(p[1:-1]))) + points(p[1:-1]) for p in parts)
        inner = kind.removeprefix("MULTI")
        return head + struct.pack("<I", len(parts)) + b"".join(one(p if kind == "GEOMETRYCOLLECTION" else f"{inner} {p if p.startswith('(') else f'({p})'}", None) for p in parts)

    try:
        return one(wkt, srid)
    except (AttributeError, KeyError, ValueError, TypeError, struct.error):
        return None


def point_ewkb(x: Column, y: Column, srid: Column) -> Column:
    """A point with its SRID as bytes."""

    @F.pandas_udf("binary")
    def pack(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<BIi2d", 1, 1 | SRID, int(k), p, q) for p, q, k in zip(a, b, s)])

    return pack(x.cast("double"), y.cast("double"), srid.cast("int"))


def from_ewkb(data: Column) -> Column:
    """struct(srid, wkt); nulls for what is not a geometry."""

    @F.pandas_udf("srid int, wkt string")
    def read(values: pd.Series) -> pd.DataFrame:
        found = [decode(v) or (None, None) for v in values]
        return pd.DataFrame({"srid": pd.array([s for s, _ in found], dtype="Int32"), "wkt": [w for _, w in found]})

    return read(data)


def to_ewkb(wkt: Column, srid: int | None = None) -> Column:
    @F.pandas_udf("binary")
    def write(values: pd.Series) -> pd.Series:
        return pd.Series([encode(v, srid) for v in values], dtype=object)

    return write(wkt)
