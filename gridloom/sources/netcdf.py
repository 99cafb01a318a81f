"""Array files: NetCDF classic (all three versions, read here), NetCDF-4 where the optional netCDF4 is installed, NumPy archives."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

#: Types of the classic format by number, big-endian; tags of its lists.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12

#: Microseconds of the units of time, and the calendars of real dates.
MICROSECONDS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000, "minute": 60_000_000, "min": 60_000_000, "hour": 3_600_000_000, "hr": 3_600_000_000, "h": 3_600_000_000, "day": 86_400_000_000, "d": 86_400_000_000}
CALENDARS = ("standard", "gregorian", "proleptic_gregorian")


@dataclass
class Variable:
    """An array with the names of its dimensions and its attributes, as stored."""

    dimensions: tuple[str, ...]
    values: np.ndarray
    attributes: dict = field(default_factory=dict)

    def numbers(self) -> np.ndarray:
        """Doubles, scaled and shifted as the attributes say; fill values and values out of the valid range are NaN."""
        a, raw = self.attributes, self.values
        out = raw.astype(float)
        for name in ("_FillValue", "missing_value"):
            if name in a:
                out[np.isin(raw, np.atleast_1d(a[name]))] = np.nan
        low, high = np.atleast_1d(a["valid_range"]) if "valid_range" in a else (a.get("valid_min"), a.get("valid_max"))
        with np.errstate(invalid="ignore"):
            if low is not None:
                out[out < low] = np.nan
            if high is not None:
                out[out > high] = np.nan
        return out * float(a.get("scale_factor", 1)) + float(a.get("add_offset", 0))

    def times(self) -> np.ndarray:
        """datetime64[us]: ISO texts and datetimes as they are, numbers by "<unit> since <time>", seconds since 1970 without units."""
        if self.values.dtype.kind in "MU":
            return self.values.astype("datetime64[us]")
        units, calendar = str(self.attributes.get("units", "seconds since 1970-01-01")), str(self.attributes.get("calendar", "standard"))
        found = re.fullmatch(r"\s*([a-z]+?)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T\s]+(\d+):(\d+)(?::(\d+)(?:\.\d*)?)?)?\s*(?:Z|UTC|[+-]?0?0:?00)?\s*", units, re.IGNORECASE)
        unit = MICROSECONDS.get(found[1].lower(), MICROSECONDS.get(found[1].lower() + "s")) if found else None
        if unit is None or calendar.lower() not in CALENDARS:
            raise ValueError(f"times in {units!r} of calendar {calendar!r} aren't known")
        year, month, day, hour, minute, second = (int(v or 0) for v in found.groups()[1:])
        start = np.datetime64(f"{year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}", "us")
        if self.values.dtype.kind in "iu":
            return start + (self.values.astype("int64") * unit).astype("timedelta64[us]")
        known = np.isfinite(offsets := self.numbers())
        return np.where(known, start + np.rint(np.where(known, offsets, 0) * unit).astype("int64").astype("timedelta64[us]"), np.datetime64("NaT", "us"))


class _Header:
    """A cursor over the header; counts and places are 4 or 8 bytes wide by version."""

    def __init__(self, content: bytes):
        self.content, self.at = content, 4
        self.count = ">q" if content[3] == 5 else ">i"
        self.place = ">i" if content[3] == 1 else ">q"

    def take(self, kind: str) -> int:
        (value,) = struct.unpack_from(kind, self.content, self.at)
        self.at += struct.calcsize(kind)
        return value

    def block(self, size: int) -> bytes:
        """``size`` bytes; the cursor goes on at a multiple of four."""
        part = self.content[self.at : self.at + size]
        self.at += -(-size // 4) * 4
        return part

    def name(self) -> str:
        return self.block(self.take(self.count)).decode("utf-8")

    def items(self, tag: int) -> range:
        found, n = self.take(">i"), self.take(self.count)
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("a damaged NetCDF header")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(ATTRIBUTES):
            name, kind, n = self.name(), np.dtype(TYPES[self.take(">i")]), self.take(self.count)
            raw = self.block(n * kind.itemsize)
            value = np.frombuffer(raw, kind)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind.kind == "S" else value[0] if n == 1 else value
        return out


def classic(content: bytes) -> dict[str, Variable]:
    """The variables of a NetCDF file of the classic format: versions 1, 2 (64-bit places) and 5 (64-bit counts)."""
    h = _Header(content)
    records = h.take(h.count)
    dimensions = [(h.name(), h.take(h.count)) for _ in h.items(DIMENSIONS)]
    h.attributes()  # of the file
    found = []
    for _ in h.items(VARIABLES):
        name, own = h.name(), [dimensions[h.take(h.count)] for _ in range(h.take(h.count))]
        attributes, kind = h.attributes(), np.dtype(TYPES[h.take(">i")])
        h.take(h.count)  # its size, which the shape tells too
        found.append((name, own, attributes, kind, h.take(h.place)))
    # A dimension of length 0 is that of the records; these hold a part of every variable that has it.
    by_record = [bool(own) and own[0][1] == 0 for _, own, *_ in found]
    sizes = [int(np.prod([n for _, n in own[r:]], dtype=np.int64)) * kind.itemsize for (_, own, _, kind, _), r in zip(found, by_record)]
    padded = [-(-s // 4) * 4 for s in sizes]
    lone = sum(by_record) == 1  # then records follow each other without padding
    step = sum(s if lone else p for s, p, r in zip(sizes, padded, by_record) if r)
    if any(by_record) and records < 0:  # not written by a writer that streamed: as many as the file holds
        first = min(begin for (*_, begin), r in zip(found, by_record) if r)
        records = (len(content) - first) // step if step else 0
    out = {}
    for (name, own, attributes, kind, begin), size, record in zip(found, sizes, by_record):
        shape = tuple(n for _, n in own)
        if record:
            shape = (records, *shape[1:])
            values = np.ndarray(shape, kind, content, begin, (step, *np.ndarray(shape[1:], kind, b"\0" * size).strides)) if records and size else np.empty(shape, kind)
        else:
            values = np.frombuffer(content, kind, size // kind.itemsize, begin).reshape(shape)
        out[name] = Variable(tuple(d for d, _ in own), values, attributes)
    return out


def opened(content: bytes) -> dict[str, Variable]:
    """The variables of an array file, by what it begins with; ValueError for other files."""
    if content[:3] == b"CDF" and content[3:4] in (b"\1", b"\2", b"\5"):
        return classic(content)
    if content[:4] == b"\x89HDF":
        import netCDF4

        with netCDF4.Dataset("memory", memory=content) as d:
            d.set_auto_maskandscale(False)
            return {k: Variable(v.dimensions, np.asarray(v[...]), {a: v.getncattr(a) for a in v.ncattrs()}) for k, v in d.variables.items()}
    if content[:2] == b"PK":
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            sizes = {k: z[k] for k in z.files}
        # Archives name no dimensions: coordinates are their own, arrays lie over time, latitude and longitude.
        grid = tuple(next(n for n in names if n in sizes) for names in (("time", "valid_time"), ("latitude", "lat"), ("longitude", "lon")) if any(n in sizes for n in names))
        return {k: Variable((k,) if k in grid else grid if v.ndim == len(grid) else tuple(f"{k}_{i}" for i in range(v.ndim)), v) for k, v in sizes.items()}
    raise ValueError("neither NetCDF nor a NumPy archive")


def encoded(dimensions: Mapping[str, int], variables: Mapping[str, tuple[Sequence[str], np.ndarray, Mapping]], record: str | None = None) -> bytes:
    """A NetCDF file of version 2 with these variables: dimensions, array and attributes; ``record`` names the unlimited dimension."""
    kinds = {np.dtype(v): k for k, v in TYPES.items()}
    names = [*dimensions]
    pad = lambda raw: raw + b"\0" * (-len(raw) % 4)
    name = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())
    tagged = lambda tag, parts: struct.pack(">ii", tag if parts else 0, len(parts)) + b"".join(parts)

    def attribute(key: str, value) -> bytes:
        values = np.frombuffer(value.encode(), "S1") if isinstance(value, str) else np.atleast_1d(value)
        stored = values if values.dtype.kind == "S" else values.astype(values.dtype.newbyteorder(">"))
        return name(key) + struct.pack(">ii", kinds[stored.dtype], len(stored)) + pad(stored.tobytes())

    arrays = {k: v if v.dtype.kind == "S" else v.astype(v.dtype.newbyteorder(">")) for k, (_, v, _) in variables.items()}
    moving = {k for k, (own, _, _) in variables.items() if own and own[0] == record}
    lone = len(moving) == 1
    parts = {k: [v[i : i + 1].tobytes() if lone else pad(v[i : i + 1].tobytes()) for i in range(len(v))] if k in moving else [pad(v.tobytes())] for k, v in arrays.items()}

    def header(begins: Mapping[str, int]) -> bytes:
        listed = [name(k) + struct.pack(">i", len(own)) + struct.pack(f">{len(own)}i", *map(names.index, own)) + tagged(ATTRIBUTES, [attribute(*a) for a in more.items()]) + struct.pack(">iiq", kinds[arrays[k].dtype], -(-len(parts[k][0]) // 4) * 4 if parts[k] else 0, begins[k]) for k, (own, _, more) in variables.items()]
        sizes = [name(d) + struct.pack(">i", 0 if d == record else n) for d, n in dimensions.items()]
        return b"CDF\2" + struct.pack(">i", dimensions[record] if record else 0) + tagged(DIMENSIONS, sizes) + tagged(ATTRIBUTES, []) + tagged(VARIABLES, listed)

    begins, at = {}, len(header(dict.fromkeys(variables, 0)))
    for k in sorted(variables, key=lambda k: k in moving):  # records come last
        begins[k] = at
        at += len(parts[k][0]) if parts[k] else 0
    fixed = b"".join(parts[k][0] for k in variables if k not in moving)
    return header(begins) + fixed + b"".join(parts[k][i] for i in range(dimensions[record] if record else 0) for k in variables if k in moving)
