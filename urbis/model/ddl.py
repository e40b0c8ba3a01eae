"""Spark types from DDL text without a running session."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_ATOMS = {"string": T.StringType, "binary": T.BinaryType, "boolean": T.BooleanType, "int": T.IntegerType, "bigint": T.LongType, "long": T.LongType, "double": T.DoubleType, "date": T.DateType, "timestamp": T.TimestampType}


def parse(text: str) -> T.DataType:
    """One type, such as array<struct<x: double, y: double>>."""
    tokens = re.findall(r"[A-Za-z_0-9]+|[<>,:]", text)
    at = 0

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def one() -> T.DataType:
        name = take()
        if name in _ATOMS:
            return _ATOMS[name]()
        take()  # <
        if name == "array":
            out: T.DataType = T.ArrayType(one())
        elif name == "map":
            key = one()
            take()
            out = T.MapType(key, one())
        else:
            fields = []
            while True:
                label = take()
                take()  # :
                fields.append(T.StructField(label, one()))
                if tokens[at] == ">":
                    break
                take()
            out = T.StructType(fields)
        take()  # >
        return out

    return one()


def struct(text: str) -> T.StructType:
    """A struct type from "name type, name type"; "not null" after a type is honoured."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    fields = []
    for part in parts:
        name, kind = part.split(" ", 1)
        required = kind.endswith(" not null")
        fields.append(T.StructField(name, parse(kind.removesuffix(" not null")), not required))
    return T.StructType(fields)
