"""LoD 0 footprints from solids: ground faces by semantics, else the lowest connected downward faces.

The footprint is the set of those faces, flattened to their lowest height; overlapping faces are not
united (no polygon union is available), so its area is exact where ground faces do not overlap.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.functions import wkb

#: Largest tilt from straight down, largest distance from a face's plane, largest step between joined faces.
MAX_TILT, MAX_OFF_PLANE, MAX_STEP = 20.0, 0.5, 1.5


def ground_faces(geometry: bytes, surfaces: str | None, index: list | None) -> list[int]:
    """Positions of the ground faces (empty if there are none)."""
    layout = wkb.read_layout(geometry)
    block = np.frombuffer(geometry, np.uint8)[None, :]
    try:
        types = [s.get("type") if isinstance(s, dict) else None for s in json.loads(surfaces)] if surfaces else []
    except (ValueError, TypeError, AttributeError):
        types = []
    if types and index:
        named = [k for k, i in enumerate(index[: len(layout.faces)]) if i is not None and 0 <= i < len(types) and types[i] == "GroundSurface"]
        if named:
            return named
    rings, down = {}, []
    for k, face in enumerate(layout.faces):
        points = wkb.ring_points(layout, block, face[0])
        normal = wkb.newell(points)[0]
        size = np.linalg.norm(normal)
        if not size:
            continue
        unit = normal / size
        off = np.abs((points[0] - points[0].mean(axis=0)) @ unit).max()
        if np.degrees(np.arccos(np.clip(-unit[2], -1, 1))) <= MAX_TILT and off <= MAX_OFF_PLANE:
            down.append(k)
            rings[k] = points[0]
    if not down:
        return []
    edges: dict[tuple, list[int]] = {}
    for k in down:
        plan = [tuple(np.round(p[:2], 6)) for p in rings[k]]
        for a, b in zip(plan, plan[1:] + plan[:1], strict=True):
            edges.setdefault((min(a, b), max(a, b)), []).append(k)
    joined: dict[int, set[int]] = {k: set() for k in down}
    for near in edges.values():
        for a in near:
            joined[a] |= {b for b in near if b != a and abs(rings[a][:, 2].mean() - rings[b][:, 2].mean()) <= MAX_STEP}
    start = min(down, key=lambda k: (rings[k][:, 2].min(), k))
    seen, todo = {start}, [start]
    while todo:
        for b in joined[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return sorted(seen)


@F.arrow_udf(T.BinaryType())
def footprint(geometry: pa.Array, surfaces: pa.Array, index: pa.Array) -> pa.Array:
    """MultiPolygon Z of the ground faces at their lowest height; null without any, and for malformed input."""
    out: list[bytes | None] = []
    for g, s, i in zip(geometry.to_pylist(), surfaces.to_pylist(), index.to_pylist(), strict=True):
        try:
            chosen = ground_faces(g, s, i) if g is not None else []
        except wkb.WkbError:
            chosen = []
        if not chosen:
            out.append(None)
            continue
        layout, block = wkb.read_layout(g), np.frombuffer(g, np.uint8)[None, :]
        faces = [[wkb.ring_points(layout, block, r)[0] for r in layout.faces[k]] for k in chosen]
        level = min(r[:, 2].min() for f in faces for r in f)
        out.append(wkb.encode([[[(x, y, level) for x, y, _ in r] for r in f] for f in faces], wkb.MULTIPOLYGON_Z)[0])
    return pa.array(out, pa.binary())
