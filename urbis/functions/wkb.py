"""ISO WKB of polyhedra: encoding, decoding, and measures of solids, in Arrow batches.

Geometries of a batch are grouped by layout (equal length and equal counts at the same places), so each
group is one array of coordinates and is decoded and measured without a loop over rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.model import ddl

# ISO WKB type codes with z.
POINT_Z, LINE_Z, POLYGON_Z, MULTIPOINT_Z, MULTILINE_Z, MULTIPOLYGON_Z, COLLECTION_Z, SURFACE_Z, TRIANGLE_Z = 1001, 1002, 1003, 1004, 1005, 1006, 1007, 1015, 1017
_FACES = (MULTIPOLYGON_Z, SURFACE_Z)


class WkbError(ValueError):
    """Bytes that are no supported geometry."""


@dataclass(frozen=True)
class Layout:
    """Where the coordinates of a geometry stand: byte offset and size of each ring, and the rings of each face."""

    rings: tuple[tuple[int, int], ...]
    faces: tuple[tuple[int, ...], ...]
    counts: tuple[int, ...]  # byte offsets of headers and counts, equal throughout a group


def read_layout(wkb: bytes) -> Layout:
    """Layout of a little-endian MultiPolygon Z, PolyhedralSurface Z, or collection of them."""
    rings: list[tuple[int, int]] = []
    faces: list[tuple[int, ...]] = []
    counts: list[int] = []

    def word(at: int) -> int:
        counts.append(at)
        if at + 4 > len(wkb):
            raise WkbError("truncated geometry")
        return struct.unpack_from("<I", wkb, at)[0]

    def header(at: int) -> tuple[int, int]:
        if at >= len(wkb) or wkb[at] != 1:
            raise WkbError("not little-endian")
        return word(at + 1), at + 5

    def surface(at: int) -> int:
        kind, at = header(at)
        if kind == COLLECTION_Z:
            n, at = word(at), at + 4
            for _ in range(n):
                at = surface(at)
            return at
        if kind not in _FACES:
            raise WkbError(f"unsupported type {kind}")
        n, at = word(at), at + 4
        for _ in range(n):
            kind, at = header(at)
            if kind not in (POLYGON_Z, TRIANGLE_Z):
                raise WkbError(f"unsupported face type {kind}")
            own, at, mine = word(at), at + 4, []
            for _ in range(own):
                size, at = word(at), at + 4
                if at + 24 * size > len(wkb):
                    raise WkbError("truncated ring")
                mine.append(len(rings))
                rings.append((at, size))
                at += 24 * size
            faces.append(tuple(mine))
        return at

    if surface(0) != len(wkb):
        raise WkbError("bytes after the geometry")
    return Layout(tuple(rings), tuple(faces), tuple(counts))


#: Layouts met last, by length: with the places of headers and counts and what stands there.
_LAYOUTS: dict[int, tuple[Layout, np.ndarray, bytes]] = {}


def known_layout(data: bytes) -> Layout:
    """read_layout(), at once where the geometry before of this length had the same headers and counts."""
    held = _LAYOUTS.get(len(data))
    if held is not None and np.frombuffer(data, np.uint8)[held[1]].tobytes() == held[2]:
        return held[0]
    layout = read_layout(data)
    where = np.array([at + k for at in layout.counts for k in range(-1, 4)])  # with the byte order before a header
    if len(_LAYOUTS) > 1000:
        _LAYOUTS.clear()
    _LAYOUTS[len(data)] = layout, where, np.frombuffer(data, np.uint8)[where].tobytes()
    return layout


def grouped(values: list[bytes | None], strict: bool = False) -> Iterator[tuple[np.ndarray, Layout, np.ndarray]]:
    """(rows, layout, bytes as rows x length) for each layout; malformed rows raise if strict, else are left out."""
    sizes = np.array([-1 if v is None else len(v) for v in values])
    for size in np.unique(sizes[sizes >= 0]):
        rest = np.flatnonzero(sizes == size)
        block = np.frombuffer(b"".join(values[i] for i in rest), np.uint8).reshape(len(rest), size)
        while len(rest):
            try:
                layout = read_layout(values[rest[0]])
            except WkbError:
                if strict:
                    raise
                rest, block = rest[1:], block[1:]
                continue
            where = np.array([at + k for at in layout.counts for k in range(4)])
            same = (block[:, where] == block[0, where]).all(axis=1)
            yield rest[same], layout, block[same]
            rest, block = rest[~same], block[~same]


def ring_points(layout: Layout, block: np.ndarray, ring: int) -> np.ndarray:
    """Points of a ring in all rows of a group (rows x points x 3), without the closing one."""
    at, size = layout.rings[ring]
    points = np.ascontiguousarray(block[:, at : at + 24 * size]).view("<f8").reshape(len(block), size, 3)
    return points[:, :-1] if size > 1 else points


def newell(points: np.ndarray) -> np.ndarray:
    """Newell's vector of each row's ring: normal direction, twice the area long."""
    after = np.roll(points, -1, axis=1)
    d, s = points - after, points + after
    return np.stack([(d[..., 1] * s[..., 2]).sum(1), (d[..., 2] * s[..., 0]).sum(1), (d[..., 0] * s[..., 1]).sum(1)], axis=1)


def _signed_volume(points: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Sum of the signed tetrahedra from the origin over a ring's fan."""
    p = points - origin[:, None, :]
    a, b, c = p[:, :1], p[:, 1:-1], p[:, 2:]
    return (a * np.cross(b, c)).sum(axis=(1, 2)) / 6 if p.shape[1] > 2 else np.zeros(len(p))


def _closed(layout: Layout, block: np.ndarray) -> np.ndarray:
    """Whether every directed edge is met by its reverse exactly once."""
    starts, ends = [], []
    for ring in range(len(layout.rings)):
        p = ring_points(layout, block, ring)
        starts.append(p)
        ends.append(np.roll(p, -1, axis=1))
    if not starts:
        return np.zeros(len(block), bool)
    a, b = np.concatenate(starts, axis=1), np.concatenate(ends, axis=1)
    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def code(p: np.ndarray) -> np.ndarray:
        bits = (np.ascontiguousarray(p) + 0.0).view(np.uint64)  # -0.0 and 0.0 alike
        h = ((bits ^ (bits >> np.uint64(29))) * mix).sum(axis=2, dtype=np.uint64)
        return h ^ (h >> np.uint64(32))

    ca, cb = code(a), code(b)
    forward = np.sort(ca * np.uint64(0xD6E8FEB86659FD93) + cb, axis=1)
    backward = np.sort(cb * np.uint64(0xD6E8FEB86659FD93) + ca, axis=1)
    return (forward == backward).all(axis=1) & (forward[:, 1:] != forward[:, :-1]).all(axis=1)


# The functions below are marked non-deterministic so that a filter on their result stays above them:
# pushed below, it would evaluate them once more.

MEASURES = ddl.struct(
    "volume double, surface_area double, footprint_area double, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double, cx double, cy double, cz double, n_faces int, n_rings int, n_vertices int, is_closed boolean"
)


def measures(values: list[bytes | None], strict: bool = False) -> dict[str, np.ndarray]:
    """All measures of each geometry; rows that are null or (unless strict) malformed are masked.

    Volume is null unless the solid is closed; shells of cavities wind inwards and so subtract. The
    footprint is the area of the downward faces' plan; the centroid is the mean of the bounds' corners.
    """
    n = len(values)
    out = {f.name: np.zeros(n) for f in MEASURES}
    known = np.zeros(n, bool)
    for rows, layout, block in grouped(values, strict):
        if not layout.rings:
            continue
        known[rows] = True
        points = np.concatenate([ring_points(layout, block, r) for r in range(len(layout.rings))], axis=1)
        low, high = points.min(axis=1), points.max(axis=1)
        area, foot, volume = (np.zeros(len(rows)) for _ in range(3))
        for face in layout.faces:
            normal = newell(ring_points(layout, block, face[0]))
            size = np.linalg.norm(normal, axis=1) / 2
            plan = normal[:, 2] / 2
            volume += _signed_volume(ring_points(layout, block, face[0]), low)
            for hole in face[1:]:
                inner = newell(ring_points(layout, block, hole))
                size = size - np.linalg.norm(inner, axis=1) / 2
                plan = plan + inner[:, 2] / 2
                volume += _signed_volume(ring_points(layout, block, hole), low)
            area += np.maximum(size, 0)
            foot += np.maximum(-plan, 0)
        out["volume"][rows], out["surface_area"][rows], out["footprint_area"][rows] = volume, area, foot
        for k, axis in enumerate("xyz"):
            out[f"{axis}min"][rows], out[f"{axis}max"][rows], out[f"c{axis}"][rows] = low[:, k], high[:, k], (low[:, k] + high[:, k]) / 2
        out["n_faces"][rows], out["n_rings"][rows] = len(layout.faces), len(layout.rings)
        out["n_vertices"][rows] = sum(max(size - 1, 0) for _, size in layout.rings)
        out["is_closed"][rows] = _closed(layout, block)
    out["known"] = known
    return out


def _measures_array(column: pa.Array, strict: bool) -> pa.Array:
    found = measures(column.to_pylist(), strict)
    known, closed = found.pop("known"), found["is_closed"].astype(bool)
    arrays = []
    for field in MEASURES:
        v = found[field.name]
        mask = ~known | (~closed if field.name == "volume" else False)
        kind = {"int": pa.int32(), "boolean": pa.bool_()}.get(field.dataType.simpleString(), pa.float64())
        arrays.append(pa.array(v.astype(bool) if kind == pa.bool_() else v.astype(np.int32) if kind == pa.int32() else v, kind, mask=mask))
    return pa.StructArray.from_arrays(arrays, names=[f.name for f in MEASURES], mask=pa.array(~known))


@F.arrow_udf(MEASURES)
def solid_measures(wkb: pa.Array) -> pa.Array:
    """Struct of MEASURES of a solid; null for null and malformed input (the "try" form)."""
    return _measures_array(wkb, False)


solid_measures = solid_measures.asNondeterministic()


@F.arrow_udf(MEASURES)
def solid_measures_strict(wkb: pa.Array) -> pa.Array:
    """As solid_measures, but malformed input raises."""
    return _measures_array(wkb, True)


solid_measures_strict = solid_measures_strict.asNondeterministic()


@F.arrow_udf(T.DoubleType())
def solid_volume(wkb: pa.Array) -> pa.Array:
    """Volume of a solid; null for null, but malformed input and a solid that is not closed raise."""
    values = wkb.to_pylist()
    found = measures(values, strict=True)
    open_ones = found["known"] & ~found["is_closed"].astype(bool)
    if open_ones.any():
        raise WkbError(f"{int(open_ones.sum())} solids are not closed")
    return pa.array(found["volume"], mask=~found["known"])


solid_volume = solid_volume.asNondeterministic()

REPORT = ddl.struct("is_valid boolean, code string, message string")


def _shells_nested(layout: Layout, block: np.ndarray, shells: list[list[int]]) -> bool:
    """Whether the boxes of each solid's inner shells lie in that of its outer one."""
    face = 0
    for solid in shells:
        outer = None
        for n in solid:
            points = [ring_points(layout, block, f[0])[0] for f in layout.faces[face : face + n]]
            face += n
            if not points:
                return False
            every = np.concatenate(points)
            low, high = every.min(axis=0), every.max(axis=0)
            if outer is None:
                outer = low, high
            elif (low < outer[0]).any() or (high > outer[1]).any():
                return False
    return True


@F.arrow_udf(REPORT)
def validation_report(wkb: pa.Array, shells: pa.Array) -> pa.Array:
    """Struct is_valid, code, message of a solid with its shells (face counts; null: one shell); null for null.

    Codes: ok, malformed, shell-count (shells do not add up to the faces), not-closed, not-nested.
    """
    values, given = wkb.to_pylist(), shells.to_pylist()
    out: list[tuple[str, str] | None] = [None if v is None else ("malformed", "no supported geometry") for v in values]
    for rows, layout, block in grouped(values):
        closed = _closed(layout, block)
        for k, row in enumerate(rows.tolist()):
            counts = given[row]
            if counts is not None and sum(map(sum, counts)) != len(layout.faces):
                out[row] = "shell-count", "the shells do not add up to the faces"
            elif not closed[k]:
                out[row] = "not-closed", "an edge is not met by its reverse exactly once"
            elif counts is not None and not _shells_nested(layout, block[k : k + 1], counts):
                out[row] = "not-nested", "an inner shell leaves the outer one"
            else:
                out[row] = "ok", ""
    rows = [None if o is None else {"is_valid": o[0] == "ok", "code": o[0], "message": o[1]} for o in out]
    return pa.array(rows, pa.struct([("is_valid", pa.bool_()), ("code", pa.string()), ("message", pa.string())]))


validation_report = validation_report.asNondeterministic()


FACE = ddl.struct("face_idx int, nx double, ny double, nz double, tilt_deg double, azimuth_deg double, area_m2 double, cx double, cy double, cz double")


#: A ring smaller than this share of its squared extent counts as a line; a normal flatter than this has no azimuth.
THIN, UPRIGHT = 1e-14, 1e-9


def _plane_moments(points: np.ndarray, origin: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed area of a ring in the plane (origin; u, v), and its first moments along u and v (Green's theorem)."""
    p = points - origin[:, None, :]
    s, t = (p * u[:, None, :]).sum(axis=2), (p * v[:, None, :]).sum(axis=2)
    s2, t2 = np.roll(s, -1, axis=1), np.roll(t, -1, axis=1)
    turn = s * t2 - s2 * t
    return turn.sum(axis=1) / 2, (turn * (s + s2)).sum(axis=1) / 6, (turn * (t + t2)).sum(axis=1) / 6


def face_columns(layout: Layout, block: np.ndarray, face: tuple[int, ...]) -> list[np.ndarray]:
    """FACE's values but the index, for one face in all rows of a group.

    Rings are measured in the plane of the outer one: its moments less those of the holes, whichever way they
    wind. A face without area has the mean of its outer ring's points as centroid.
    """
    outer = ring_points(layout, block, face[0])
    normal = newell(outer)
    length = np.linalg.norm(normal, axis=1, keepdims=True)
    unit = np.divide(normal, length, out=np.zeros_like(normal), where=length > 0)
    helper = np.eye(3)[np.abs(unit).argmin(axis=1)]  # the axis most aslant to the normal
    u = np.cross(unit, helper)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    v, origin = np.cross(unit, u), outer.mean(axis=1)
    area, along_u, along_v = _plane_moments(outer, origin, u, v)
    total = area.copy()
    for hole in face[1:]:
        inner, inner_u, inner_v = _plane_moments(ring_points(layout, block, hole), origin, u, v)
        way = np.sign(inner)
        total, along_u, along_v = total - way * inner, along_u - way * inner_u, along_v - way * inner_v
    extent = np.ptp(outer, axis=1).max(axis=1)
    solid = total > THIN * extent * extent
    share = np.where(solid, 1 / np.where(solid, total, 1), 0)
    centroid = origin + (along_u * share)[:, None] * u + (along_v * share)[:, None] * v
    tilt = np.degrees(np.arctan2(np.hypot(unit[:, 0], unit[:, 1]), unit[:, 2]))
    tilt = np.where(length[:, 0] > 0, tilt, 90.0)
    azimuth = np.where(np.hypot(unit[:, 0], unit[:, 1]) < UPRIGHT, np.nan, np.degrees(np.arctan2(unit[:, 0], unit[:, 1])) % 360)
    return [*unit.T, tilt, azimuth, np.maximum(total, 0), *centroid.T]


AREAS = ddl.struct("roof_flat double, roof_pitched double, wall double, ground double, other double")


@F.arrow_udf(AREAS)
def class_areas(wkb: pa.Array, surface_codes: pa.Array, face_semantics: pa.Array, flat_tilt: pa.Array) -> pa.Array:
    """Areas of a geometry's faces by class: one small struct a solid; null for null and malformed input.

    surface_codes: class of each surface (0 roof, 1 wall, 2 ground, 3 other); face_semantics: surface of each
    face. Faces without a surface are other.
    """
    values, flat = wkb.to_pylist(), np.asarray(flat_tilt, float)
    out, known = np.zeros((len(values), 5)), np.zeros(len(values), bool)

    def entries(lists: pa.Array, missing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        flat_values = np.asarray(pc.fill_null(lists.flatten(), missing)).astype(np.int64)
        return np.append(flat_values, missing), np.cumsum(sizes) - sizes, sizes

    codes, code_at, n_codes = entries(surface_codes, 3)
    faces, face_at, n_faces = entries(face_semantics, -1)
    for rows, layout, block in grouped(values):
        known[rows] = True
        for k, face in enumerate(layout.faces):
            columns = face_columns(layout, block, face)
            surface = np.where(k < n_faces[rows], faces[np.where(k < n_faces[rows], face_at[rows] + k, -1)], -1)
            inside = (surface >= 0) & (surface < n_codes[rows])
            code = np.where(inside, codes[np.where(inside, code_at[rows] + surface, -1)], 3)
            place = np.where(code == 0, np.where(columns[3] <= flat[rows], 0, 1), code + 1)
            np.add.at(out, (rows, place), columns[5])
    return pa.StructArray.from_arrays([pa.array(c) for c in out.T], names=[f.name for f in AREAS], mask=pa.array(~known))


class_areas = class_areas.asNondeterministic()


@F.arrow_udf(T.ArrayType(FACE))
def face_metrics(wkb: pa.Array) -> pa.Array:
    """Array of FACE, in face order; null for null and malformed input."""
    values = wkb.to_pylist()
    sizes = np.full(len(values), -1)
    pieces = []
    for rows, layout, block in grouped(values):
        sizes[rows] = len(layout.faces)
        for k, face in enumerate(layout.faces):
            pieces.append((rows, np.full(len(rows), k), *face_columns(layout, block, face)))
    offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    total = int(offsets[-1])
    out = [np.zeros(total) for _ in range(10)]
    for rows, k, *columns in pieces:
        at = offsets[rows] + k
        for target, source in zip(out, [k, *columns], strict=True):
            target[at] = source
    arrays = [pa.array(out[0].astype(np.int32)), *(pa.array(v, pa.float64(), mask=np.isnan(v) if i == 4 else None) for i, v in enumerate(out[1:]))]
    flat = pa.StructArray.from_arrays(arrays, names=[f.name for f in FACE])
    starts = pa.array(offsets.astype(np.int32), mask=np.append(sizes < 0, False))
    return pa.ListArray.from_arrays(starts, flat)


face_metrics = face_metrics.asNondeterministic()


FACES = ddl.parse("array<array<array<struct<x: double, y: double, z: double>>>>")


@F.arrow_udf(FACES)
def decode_faces(wkb: pa.Array) -> pa.Array:
    """Faces, rings and points (closing points included) of each geometry; null for null and malformed input."""
    out: list = [None] * len(wkb)
    values = wkb.to_pylist()
    for rows, layout, block in grouped(values):
        for k, row in enumerate(rows):
            line = block[k].tobytes()
            rings = [np.frombuffer(line, "<f8", 3 * size, at).reshape(size, 3).tolist() for at, size in layout.rings]
            out[row] = [[[dict(zip("xyz", p, strict=True)) for p in rings[r]] for r in face] for face in layout.faces]
    return pa.array(out, pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])))))


decode_faces = decode_faces.asNondeterministic()


def encode(faces: list[list[list[tuple[float, float, float]]]], kind: int = SURFACE_Z) -> tuple[bytes, list[int]]:
    """WKB of faces (rings of points, closed here if need be), and the positions of faces dropped as degenerate.

    A ring with fewer than three different points is dropped; with its outer ring, the face is.
    """
    out, dropped, written = [], [], 0
    for position, face in enumerate(faces):
        rings = []
        for number, ring in enumerate(face):
            points = [tuple(map(float, p)) for p in ring]
            points = [p for i, p in enumerate(points) if not i or p != points[i - 1]]
            if len(points) > 1 and points[0] == points[-1]:
                points.pop()
            if len(set(points)) < 3:
                if number == 0:
                    break
                continue
            points.append(points[0])
            rings.append(struct.pack("<I", len(points)) + b"".join(struct.pack("<3d", *p) for p in points))
        if not rings:
            dropped.append(position)
            continue
        written += 1
        out.append(struct.pack("<BII", 1, POLYGON_Z, len(rings)) + b"".join(rings))
    return struct.pack("<BII", 1, kind, written) + b"".join(out), dropped


def encode_parts(parts: list[list[tuple[float, float, float]]], kind: int) -> bytes:
    """WKB of points (MULTIPOINT_Z, one point a part) or lines (MULTILINE_Z)."""
    out = [struct.pack("<BII", 1, kind, len(parts))]
    for part in parts:
        head = struct.pack("<BI", 1, POINT_Z) if kind == MULTIPOINT_Z else struct.pack("<BII", 1, LINE_Z, len(part))
        out.append(head + b"".join(struct.pack("<3d", *map(float, p)) for p in part))
    return b"".join(out)


def decode_parts(data: bytes) -> list[list[tuple[float, float, float]]]:
    """Points of each part of a point, points or lines; inverse of encode_parts()."""

    def part(at: int) -> tuple[list[tuple], int]:
        if len(data) < at + 5 or data[at] != 1:
            raise WkbError("not little-endian")
        (kind,), at, n = struct.unpack_from("<I", data, at + 1), at + 5, 1
        if kind == LINE_Z:
            (n,), at = struct.unpack_from("<I", data, at), at + 4
        elif kind != POINT_Z:
            raise WkbError(f"unsupported part type {kind}")
        if len(data) < at + 24 * n:
            raise WkbError("truncated geometry")
        return [struct.unpack_from("<3d", data, at + 24 * k) for k in range(n)], at + 24 * n

    if len(data) < 9:
        raise WkbError("truncated geometry")
    kind, n = struct.unpack_from("<II", data, 1)
    if kind == POINT_Z:
        return [part(0)[0]]
    if kind not in (MULTIPOINT_Z, MULTILINE_Z):
        raise WkbError(f"unsupported type {kind}")
    out, at = [], 9
    for _ in range(n):
        points, at = part(at)
        out.append(points)
    if at != len(data):
        raise WkbError("bytes after the geometry")
    return out


def point(xyz: tuple[float, float, float]) -> bytes:
    return struct.pack("<BI3d", 1, POINT_Z, *map(float, xyz))


def box_template() -> tuple[bytes, np.ndarray, np.ndarray]:
    """WKB of the unit cube, the byte places of its coordinates, and which corner (0/1 per axis) each takes."""
    c = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    faces = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (1, 3, 7, 5), (3, 2, 6, 7), (2, 0, 4, 6)]  # ground, roof, walls; outward
    wkb, _ = encode([[[c[i] for i in face]] for face in faces])
    layout = read_layout(wkb)
    places = np.concatenate([np.arange(at, at + 24 * size, 8) for at, size in layout.rings])
    corner = np.array([struct.unpack_from("<d", wkb, p)[0] for p in places], int)
    return wkb, places, corner


_BOX, _PLACES, _CORNER = box_template()


@F.arrow_udf(T.BinaryType())
def box_wkb(x: pa.Array, y: pa.Array, z: pa.Array, dx: pa.Array, dy: pa.Array, dz: pa.Array) -> pa.Array:
    """WKB of an axis-parallel box: faces ground, roof, then four walls."""
    low = [np.asarray(v.to_numpy(zero_copy_only=False), float) for v in (x, y, z)]
    size = [np.asarray(v.to_numpy(zero_copy_only=False), float) for v in (dx, dy, dz)]
    n = len(x)
    block = np.tile(np.frombuffer(_BOX, np.uint8), (n, 1))
    for k, place in enumerate(_PLACES):
        axis = k % 3
        value = low[axis] + size[axis] * _CORNER[k]
        block[:, place : place + 8] = value.astype("<f8").view(np.uint8).reshape(n, 8)
    whole = pa.py_buffer(block.tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * len(_BOX)).astype(np.int32).tobytes()), whole])


#: A geometry as its form (layout, headers, and which number stands where) and the bits of its distinct coordinates.
PACKED = ddl.struct("form binary, numbers array<bigint>")
_RAW, _FORM = b"\0", b"\1"


def _places(layout: Layout) -> np.ndarray:
    """Byte places of all coordinates."""
    return np.concatenate([np.arange(at, at + 24 * size, 8) for at, size in layout.rings] or [np.zeros(0, int)]).astype("<u4")


def _form(block: np.ndarray, places: np.ndarray, number: np.ndarray) -> bytes:
    rest = block.copy()
    rest[places[:, None] + np.arange(8)] = 0
    return _FORM + zlib.compress(struct.pack("<I", len(places)) + places.tobytes() + number.astype("<u4").tobytes() + rest.tobytes(), 9)


def pack(values: list[bytes | None]) -> pa.StructArray:
    """PACKED of each geometry, bit by bit the same after unpack(); other bytes are kept raw.

    Geometries of a layout that repeat coordinates at the same places share one form; a box has six numbers left.
    """
    forms: list[bytes] = []
    which, sizes, found = np.full(len(values), -1), np.zeros(len(values), np.int64), []
    for rows, layout, block in grouped(values):
        places = _places(layout)
        bits = np.ascontiguousarray(block[:, places[:, None] + np.arange(8)]).reshape(len(rows), -1).view("<i8")
        rest = np.arange(len(rows))
        while len(rest):
            same = np.zeros(len(rest), bool)
            for k in {len(rest) * i // 8 for i in range(8)}:  # some rows repeat a number by chance: the form that most rows have
                _, at, which_one = np.unique(bits[rest[k]], return_index=True, return_inverse=True)
                order = np.argsort(at)  # numbers by their first place
                at, which_one = at[order], np.argsort(order)[which_one]
                fits = (bits[rest] == bits[rest][:, at][:, which_one]).all(axis=1)
                if fits.sum() > same.sum():
                    same, first, number = fits, at, which_one
                if same.sum() * 2 > len(rest):
                    break
            if same.sum() * 16 < len(rest):  # hardly any share one: each coordinate for itself
                first = number = np.arange(bits.shape[1])
                same = np.ones(len(rest), bool)
            mine = rest[same]
            which[rows[mine]], sizes[rows[mine]] = len(forms), len(first)
            forms.append(_form(block[mine[0]], places, number))
            found.append((rows[mine], bits[mine][:, first]))
            rest = rest[~same]
    for i in np.flatnonzero(which < 0):
        if values[i] is not None:
            which[i] = len(forms)
            forms.append(_RAW + values[i])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.zeros(ends[-1], np.int64)
    for rows, numbers in found:
        flat[ends[rows][:, None] + np.arange(numbers.shape[1])] = numbers
    missing = pa.array(which < 0)
    column = pa.array(forms, pa.binary()).take(pa.array(which, mask=which < 0))
    return pa.StructArray.from_arrays([column, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], names=["form", "numbers"], mask=missing)


def unpack(column: pa.StructArray) -> pa.Array:
    """The geometries behind PACKED."""
    coded = pc.struct_field(column, "form").dictionary_encode()
    lists = pc.struct_field(column, "numbers")
    starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    which = coded.indices.fill_null(-1).to_numpy()
    out: list[bytes | None] = [None] * len(column)
    for k, form in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(which == k)
        if form[:1] == _RAW:
            for i in rows:
                out[i] = form[1:]
            continue
        text = zlib.decompress(form[1:])
        n = struct.unpack_from("<I", text)[0]
        places, number = (np.frombuffer(text, "<u4", n, 4 + 4 * n * j) for j in (0, 1))
        block = np.tile(np.frombuffer(text, np.uint8, -1, 4 + 8 * n), (len(rows), 1))
        if n:
            bits = np.ascontiguousarray(flat[starts[rows][:, None] + number], "<i8")
            block[:, (places[:, None] + np.arange(8)).ravel()] = bits.view(np.uint8).reshape(len(rows), -1)
        data, size = block.tobytes(), block.shape[1]
        for j, i in enumerate(rows.tolist()):
            out[i] = data[j * size : (j + 1) * size]
    return pa.array(out, pa.binary())


@F.arrow_udf(PACKED)
def packed(wkb: pa.Array) -> pa.Array:
    """PACKED of a geometry; null for null."""
    return pack(wkb.to_pylist())


@F.arrow_udf(T.BinaryType())
def unpacked(column: pa.Array) -> pa.Array:
    """The geometry behind PACKED; null for null."""
    return unpack(column)
