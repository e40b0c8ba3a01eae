import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st

from urbis.model import names, schema
from urbis.sinks import recipe


def test_lod_grammar():
    assert names.Lod.parse("2") == names.Lod(2, 0) and names.Lod.parse("2.2").suffix == "lod2_2"
    assert names.geometry_columns(["geometry_lod1_0", "geometry_lod10_0", "geometry_lod2_2", "geometry_lod02_2", "geometry_properties_lod2_2"]) == ["geometry_lod10_0", "geometry_lod2_2", "geometry_lod1_0"]
    for bad in ("", "2.2.2", "x", "300"):
        with pytest.raises(names.SchemaError):
            names.Lod.parse(bad)


@given(st.text(alphabet="_idIDbBoxX", max_size=8))
def test_escape_is_reversible(name):
    assert names.restore_attribute(names.escape_attribute(name)) == name


def test_reserved_names():
    assert names.is_reserved("BBox") and names.is_reserved("material_lod2_2")
    assert not names.is_reserved("geometry_lod3") and not names.is_reserved("material_lod03_0")
    assert names.escape_attribute("ID") == "_ID" and names.escape_attribute("height") == "height"


def test_modules():
    assert names.module_of("BuildingStorey") == names.module_of("Storey") == "building"
    declared = {"Pump": ("energy", "BuildingPhysics", None), "Boiler": ("energy", None, "Pump"), "Wall2": ("energy", None, "+Building"), "A": ("x", None, "B"), "B": ("x", None, "A"), "Own": ("energy", None, None)}
    assert names.module_of("+Pump", declared) == names.module_of("Boiler", declared) == "energy_building_physics"
    assert names.module_of("Wall2", declared) == "building" and names.module_of("Own", declared) == "energy"
    assert names.module_of("Unknown", {}, "noise") == "noise"
    for bad in ("A", "Nothing"):
        with pytest.raises(names.SchemaError):
            names.module_of(bad, declared)
    assert names.decode_class(names.encode_class("+Pump", "energy"), ("energy",)) == "+Pump"
    assert names.decode_class(names.encode_class("BuildingStorey")) == "BuildingStorey"


def test_value_kinds():
    cases = [(True, "Boolean"), (3, "Int64"), (2**70, "Float64"), (2.5, "Float64"), ("2020-01-31", "Date"), ("2020-02-31", "String"), ("2020-01-01T00:00:00Z", "Timestamp"), ([], "StringList"), (["a"], "StringList"), ([1], "Json"), ({}, "Json"), (None, None)]
    for value, kind in cases:
        assert schema.kind_of(value) == kind


def test_promotion_needs_no_order():
    expected = {frozenset(("Int64", "Float64")): "Float64", frozenset(("Date", "Timestamp")): "Timestamp", frozenset(("Date", "String")): "String", frozenset(("Boolean", "Int64")): "Json"}
    for pair, kind in expected.items():
        for order in itertools.permutations(pair):
            assert schema.promote(order) == kind
    assert schema.promote([None]) == "String" and schema.promote(["StringList", None]) == "StringList"


def test_coercion_counts_failures():
    assert schema.coerce("x", "Int64") == (None, True)
    assert schema.coerce("2020-01-01", "Timestamp") == (None, True)
    assert schema.coerce(3, "Float64") == (3.0, False) and schema.coerce({"a": 1}, "Json") == ('{"a":1}', False)


def test_recipe_grammar():
    r = recipe.parse("default+rg1000+gzip+nobloom+source")
    assert (r.row_group_rows, r.codec, r.bloom, r.hilbert) == (1000, "gzip", False, False)
    for bad in ("none", "default+rg0", "default+x"):
        with pytest.raises(names.SchemaError):
            recipe.parse(bad)
