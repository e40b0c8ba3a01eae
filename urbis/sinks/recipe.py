"""Writer recipes: codecs, row groups, Bloom filters, and the grammar that names them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.model.names import SchemaError

#: A string column gets a Bloom filter from this share of distinct values.
DISTINCT_SHARE = 0.2
ALWAYS = ("id", "feature_id")


@dataclass(frozen=True)
class Recipe:
    codec: str = "zstd"
    level: int | None = 3
    row_group_rows: int = 65_536
    hilbert: bool = True
    bloom: bool = True
    dictionary: bool = True
    false_positives: float = 0.01
    #: Geometries are stored as functions.wkb.PACKED; the manifest says so, and open_package() gives WKB.
    packed: bool = False
    columns: tuple[str, ...] = field(default=())


# The named presets.
PRESETS = {
    "default": Recipe(),
    "source": Recipe(hilbert=False),
    "plain": Recipe(codec="none", level=None, bloom=False, dictionary=False),
    "fast": Recipe(codec="snappy", level=None),
    "small": Recipe(level=15, row_group_rows=262_144),
    "lookup": Recipe(row_group_rows=8_192),
    "packed": Recipe(packed=True),
}


def parse(text: str) -> Recipe:
    """<preset>[+source][+rg<rows>][+<codec>[level]][+nobloom][+packed], in any order after the preset."""
    name, *options = text.split("+")
    if name not in PRESETS:
        raise SchemaError(f"no preset {name!r}")
    recipe = PRESETS[name]
    for option in options:
        if option == "source":
            recipe = replace(recipe, hilbert=False)
        elif option == "nobloom":
            recipe = replace(recipe, bloom=False)
        elif option == "packed":
            recipe = replace(recipe, packed=True)
        elif found := re.fullmatch(r"rg([1-9]\d*)", option):
            recipe = replace(recipe, row_group_rows=int(found[1]))
        elif found := re.fullmatch(r"(zstd|gzip|snappy|lz4|none)(\d+)?", option):
            recipe = replace(recipe, codec=found[1], level=int(found[2]) if found[2] else None)
        else:
            raise SchemaError(f"no option {option!r}")
    return recipe


def bloom_candidates(df: DataFrame) -> DataFrame:
    """One row: for each scalar string column, whether it is distinct enough (HyperLogLog estimate)."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.agg(*((F.approx_count_distinct(n, 0.016) >= DISTINCT_SHARE * F.count(n)).alias(n) for n in names))


def writer_options(recipe: Recipe, bloom_columns: list[str], bytes_per_row: int = 512) -> dict[str, str]:
    """Spark's Parquet options of a recipe; a row group's rows become bytes through the mean row size."""
    options = {"compression": "uncompressed" if recipe.codec == "none" else recipe.codec, "parquet.block.size": str(max(1 << 20, recipe.row_group_rows * bytes_per_row)), "parquet.enable.dictionary": str(recipe.dictionary).lower()}
    if recipe.codec == "zstd" and recipe.level:
        options["parquet.compression.codec.zstd.level"] = str(recipe.level)
    for name in bloom_columns if recipe.bloom else ():
        options[f"parquet.bloom.filter.enabled#{name}"] = "true"
        options[f"parquet.bloom.filter.fpp#{name}"] = str(recipe.false_positives)
        options["parquet.bloom.filter.adaptive.enabled"] = "true"  # as large as the values of a row group need, not 1 MB each
    return options
