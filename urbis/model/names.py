"""Names of the object model: reserved columns, levels of detail, classes and modules, extensions."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Reserved columns, per-LoD prefixes, and (class in documents, class stored, module, parent class).
RESERVED = ("id", "feature_id", "object_type", "parents", "children", "children_roles", "address", "bbox", "implicit_geometry", "other")
# Address members of documents and their columns.
ADDRESS = {"thoroughfareName": "street", "thoroughfareNumber": "house_number", "postcode": "zip_code", "locality": "city", "administrativeArea": "state", "country": "country", "postBox": "po_box", "freeText": "free_text"}
DOCUMENT_TYPE, FEATURE_TYPE = "CityJSON", "CityJSONFeature"
LOD_PREFIXES = ("geometry_properties", "geometry", "material", "texture")
CLASSES = (
    ("Building", "Building", "building", "AbstractBuilding"),
    ("BuildingPart", "BuildingPart", "building", "AbstractBuilding"),
    ("BuildingInstallation", "BuildingInstallation", "building", "AbstractInstallation"),
    ("BuildingConstructiveElement", "BuildingConstructiveElement", "building", "AbstractConstructiveElement"),
    ("BuildingFurniture", "BuildingFurniture", "building", "AbstractFurniture"),
    ("BuildingStorey", "Storey", "building", "AbstractBuildingSubdivision"),
    ("BuildingRoom", "BuildingRoom", "building", "AbstractUnoccupiedSpace"),
    ("BuildingUnit", "BuildingUnit", "building", "AbstractBuildingSubdivision"),
    ("Bridge", "Bridge", "bridge", "AbstractBridge"),
    ("BridgePart", "BridgePart", "bridge", "AbstractBridge"),
    ("BridgeInstallation", "BridgeInstallation", "bridge", "AbstractInstallation"),
    ("BridgeConstructiveElement", "BridgeConstructiveElement", "bridge", "AbstractConstructiveElement"),
    ("BridgeRoom", "BridgeRoom", "bridge", "AbstractUnoccupiedSpace"),
    ("BridgeFurniture", "BridgeFurniture", "bridge", "AbstractFurniture"),
    ("Tunnel", "Tunnel", "tunnel", "AbstractTunnel"),
    ("TunnelPart", "TunnelPart", "tunnel", "AbstractTunnel"),
    ("TunnelInstallation", "TunnelInstallation", "tunnel", "AbstractInstallation"),
    ("TunnelConstructiveElement", "TunnelConstructiveElement", "tunnel", "AbstractConstructiveElement"),
    ("TunnelHollowSpace", "HollowSpace", "tunnel", "AbstractUnoccupiedSpace"),
    ("TunnelFurniture", "TunnelFurniture", "tunnel", "AbstractFurniture"),
    ("OtherConstruction", "OtherConstruction", "construction", "AbstractConstruction"),
    ("Road", "Road", "transportation", "AbstractTransportationSpace"),
    ("Railway", "Railway", "transportation", "AbstractTransportationSpace"),
    ("Waterway", "Waterway", "transportation", "AbstractTransportationSpace"),
    ("TransportSquare", "Square", "transportation", "AbstractTransportationSpace"),
    ("PlantCover", "PlantCover", "vegetation", "AbstractVegetationObject"),
    ("SolitaryVegetationObject", "SolitaryVegetationObject", "vegetation", "AbstractVegetationObject"),
    ("TINRelief", "TINRelief", "relief", "AbstractReliefComponent"),
    ("WaterBody", "WaterBody", "water_body", "AbstractOccupiedSpace"),
    ("LandUse", "LandUse", "land_use", "AbstractThematicSurface"),
    ("CityFurniture", "CityFurniture", "city_furniture", "AbstractOccupiedSpace"),
    ("CityObjectGroup", "CityObjectGroup", "generics", "AbstractLogicalSpace"),
    ("GenericCityObject", "GenericOccupiedSpace", "generics", "AbstractOccupiedSpace"),
)

MODULES = tuple(dict.fromkeys(module for _, _, module, _ in CLASSES))
STORED_CLASS = {source: stored for source, stored, _, _ in CLASSES}
SOURCE_CLASS = {stored: source for source, stored, _, _ in CLASSES}
MODULE_OF = {name: module for source, stored, module, _ in CLASSES for name in (source, stored)}
PARENT_CLASS = {stored: parent for _, stored, _, parent in CLASSES}


class SchemaError(ValueError):
    """Input that the object model does not allow."""


@dataclass(frozen=True, order=True)
class Lod:
    """A level of detail; LoD "2" is 2.0, and columns always carry the minor number."""

    major: int
    minor: int = 0

    @classmethod
    def parse(cls, text: str) -> Lod:
        found = re.fullmatch(r"(\d{1,3})(?:\.(\d{1,3}))?", text)
        if not found or max(int(found[1]), int(found[2] or 0)) > 255:
            raise SchemaError(f"not a level of detail: {text!r}")
        return cls(int(found[1]), int(found[2] or 0))

    @classmethod
    def of_column(cls, column: str) -> Lod | None:
        """The LoD of a column name that ends in lod<major>_<minor>, both in canonical decimal."""
        found = re.search(r"_lod(0|[1-9]\d{0,2})_(0|[1-9]\d{0,2})$", column)
        return cls(int(found[1]), int(found[2])) if found else None

    @property
    def suffix(self) -> str:
        return f"lod{self.major}_{self.minor}"

    def column(self, prefix: str = "geometry") -> str:
        return f"{prefix}_{self.suffix}"


def geometry_columns(columns: list[str], prefix: str = "geometry") -> list[str]:
    """Columns of the prefix for all LoDs, highest LoD first (by number, not by text)."""
    found = [(lod, c) for c in columns if (lod := Lod.of_column(c)) is not None and c == lod.column(prefix)]
    return [c for _, c in sorted(found, reverse=True)]


def is_reserved(name: str) -> bool:
    """Whether a name collides with a reserved column, ignoring case."""
    low = name.lower()
    if low in RESERVED:
        return True
    lod = Lod.of_column(low)
    return lod is not None and any(low == lod.column(p) for p in LOD_PREFIXES)


def escape_attribute(name: str) -> str:
    """Column of a source attribute: one more leading underscore if the name without any is reserved."""
    return f"_{name}" if is_reserved(name.lstrip("_")) else name


def restore_attribute(column: str) -> str:
    """Source name of an attribute column; inverse of escape_attribute."""
    if not is_reserved(column.lstrip("_")):
        return column
    if not column.startswith("_"):
        raise SchemaError(f"attribute column {column!r} has a reserved name")
    return column[1:]


def encode_class(source: str, namespace: str | None = None) -> str:
    """Stored class of a source class: renamed core classes, and `+Name` of an extension as <namespace>_Name."""
    if source.startswith("+"):
        if not namespace or "_" in namespace:
            raise SchemaError(f"extension class {source!r} needs a namespace without underscore")
        return f"{namespace}_{source[1:]}"
    return STORED_CLASS.get(source, source)


def decode_class(stored: str, namespaces: tuple[str, ...] = ()) -> str:
    """Source class of a stored class; inverse of encode_class for the given namespaces."""
    head, _, tail = stored.partition("_")
    return f"+{tail}" if tail and head in namespaces else SOURCE_CLASS.get(stored, stored)


def snake_case(name: str) -> str:
    """CamelCase as snake_case; a run of capitals is one word."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def module_of(name: str, declared: dict[str, tuple[str, str | None, str | None]] | None = None, namespace: str | None = None) -> str:
    """File name of a class's module.

    declared: extension classes as name -> (namespace, own module or None, parent class or None). A class
    with neither, or known only by its namespace, goes to the extension's own file; an unknown class and a
    cycle of parents are errors.
    """
    declared, seen, name = declared or {}, set(), name.lstrip("+")
    while name not in MODULE_OF:
        if name in seen:
            raise SchemaError(f"cyclic parents of class {name!r}")
        seen.add(name)
        if name not in declared:
            if namespace and len(seen) == 1:
                return namespace
            raise SchemaError(f"class {name!r} has no module")
        space, own, parent = declared[name]
        if own:
            return f"{space}_{snake_case(own)}"
        parent = (parent or "").lstrip("+")
        if parent == "_AbstractBuilding":
            return "building"
        if parent == "_AbstractTransportationComplex":
            return "transportation"
        if parent not in MODULE_OF and parent not in declared:
            return space
        name = parent
    return MODULE_OF[name]
