"""Spark types of the object tables and sidecars, and the lattice of attribute types."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.model import ddl

AXES = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")
BBOX = T.StructType([T.StructField(a, T.DoubleType(), False) for a in AXES])
PROPERTIES = ddl.struct("type string, surfaces string, face_semantics array<int>, shells array<array<int>>")
MATERIAL = T.MapType(T.StringType(), T.ArrayType(T.LongType()))
TEXTURE = ddl.parse("map<string, array<array<struct<id: bigint, uv: array<array<double>>>>>>")
ADDRESS = ddl.parse("array<struct<street: string, house_number: string, po_box: string, zip_code: string, city: string, state: string, country: string, free_text: string, location: binary>>")
IMPLICIT = ddl.struct("id bigint, point binary, transformationMatrix array<double>")

FIXED_TYPES = {
    "id": T.StringType(), "feature_id": T.StringType(), "object_type": T.StringType(), "parents": T.ArrayType(T.StringType()),
    "children": T.ArrayType(T.StringType()), "children_roles": T.ArrayType(T.StringType()), "address": ADDRESS, "bbox": BBOX,
    "implicit_geometry": IMPLICIT, "other": T.StringType(),
}
LOD_TYPES = {"geometry": T.BinaryType(), "geometry_properties": PROPERTIES, "material": MATERIAL, "texture": TEXTURE}

SIDECARS = {
    "materials": ddl.struct("id bigint not null, name string, ambientIntensity double, diffuseColor array<double>, specularColor array<double>, emissiveColor array<double>, transparency double, shininess double, isSmooth boolean, other string"),
    "textures": ddl.struct("id bigint not null, image_uri string, image_data binary, image_type string, wrapMode string, textureType string, borderColor array<double>, other string"),
    "implicit_geometries": ddl.struct("id bigint not null, name string"),
}

#: Attribute kinds and their Spark types.
KINDS: dict[str, T.DataType] = {
    "Boolean": T.BooleanType(), "Int64": T.LongType(), "Float64": T.DoubleType(), "Date": T.DateType(), "Timestamp": T.TimestampType(),
    "String": T.StringType(), "StringList": T.ArrayType(T.StringType()), "Json": T.StringType(),
}


def _is_timestamp(text: str) -> bool:
    if not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", text):
        return False
    try:
        dt.datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


def _is_date(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", text)) and bool(dt.date.fromisoformat(text))
    except ValueError:
        return False


def kind_of(value: object) -> str | None:
    """Kind of one parsed JSON value; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "Boolean"
    if isinstance(value, int):
        return "Int64" if -(2**63) <= value < 2**63 else "Float64"
    if isinstance(value, float):
        return "Float64"
    if isinstance(value, str):
        return "Timestamp" if _is_timestamp(value) else "Date" if _is_date(value) else "String"
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return "StringList"
    return "Json"


def promote(kinds: Iterable[str | None]) -> str:
    """Kind of a column from the kinds of its values, in any order; all null: String."""
    found = {k for k in kinds if k}
    if not found:
        return "String"
    if len(found) == 1:
        return found.pop()
    if found == {"Int64", "Float64"}:
        return "Float64"
    if found == {"Date", "Timestamp"}:
        return "Timestamp"
    if found <= {"Date", "Timestamp", "String"}:
        return "String"
    return "Json"


def promote_column(kinds: Column) -> Column:
    """promote() of an array of kinds, as an expression."""
    found = F.array_distinct(F.filter(kinds, lambda k: k.isNotNull()))

    def only(*names: str) -> Column:
        return F.size(F.array_except(found, F.array(*map(F.lit, names)))) == 0

    return (
        F.when(F.size(found) == 0, "String").when(F.size(found) == 1, F.get(found, F.lit(0))).when(only("Int64", "Float64"), "Float64")
        .when(only("Date", "Timestamp"), "Timestamp").when(only("Date", "Timestamp", "String"), "String").otherwise("Json")
    )


def coerce(value: object, kind: str) -> tuple[object, bool]:
    """(value for the column, whether it failed): what does not fit becomes null and counts as a failure."""
    own = kind_of(value)
    if own is None:
        return None, False
    if kind == "Json":
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False), False
    if kind == "Float64" and own in ("Int64", "Float64"):
        return (float(value), False) if math.isfinite(float(value)) else (None, True)
    if kind == "String" and isinstance(value, str):
        return value, False
    if kind != own:
        return None, True
    if kind == "Date":
        return dt.date.fromisoformat(value), False
    if kind == "Timestamp":
        return dt.datetime.fromisoformat(value.upper().replace("Z", "+00:00")), False
    return value, False
