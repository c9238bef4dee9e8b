"""NumPy element types and the Spark types that hold them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

#: One step wider where Spark has no unsigned or half type.
_PLAIN = {"b1": T.BooleanType, "i1": T.ByteType, "i2": T.ShortType, "i4": T.IntegerType, "i8": T.LongType, "u1": T.ShortType, "u2": T.IntegerType, "u4": T.LongType, "f2": T.FloatType, "f4": T.FloatType, "f8": T.DoubleType}


def spark_type(dtype) -> T.DataType:
    """The Spark type of a NumPy type; object types are rejected."""
    d = np.dtype(dtype)
    if d.hasobject:
        raise TypeError("arrays of objects can't be stored")
    if d.subdtype:
        out = spark_type(d.subdtype[0])
        for _ in d.subdtype[1]:
            out = T.ArrayType(out, False)
        return out
    if d.names:
        return T.StructType([T.StructField(n, spark_type(d.fields[n][0])) for n in d.names])
    key = d.kind + str(d.itemsize)
    if key in _PLAIN:
        return _PLAIN[key]()
    if key == "u8":
        return T.DecimalType(20, 0)
    if d.kind == "c":
        part = T.FloatType() if d.itemsize == 8 else T.DoubleType()
        return T.StructType([T.StructField("re", part), T.StructField("im", part)])
    if d.kind == "M":
        return T.TimestampNTZType()
    if d.kind == "m":
        return T.DayTimeIntervalType()
    return {"S": T.BinaryType, "V": T.BinaryType, "U": T.StringType}[d.kind]()


#: The NumPy type of a Spark type's items.
_BACK = {"boolean": "?", "tinyint": "i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}


def numpy_type(kind: T.DataType) -> np.dtype:
    """The NumPy type of the items that a Spark type holds."""
    if isinstance(kind, T.StructType):
        return np.dtype([(f.name, numpy_type(f.dataType)) for f in kind.fields])
    try:
        return np.dtype(_BACK[kind.simpleString()])
    except KeyError:
        return np.dtype(object)
