"""A row of native columns as the value of a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RowColumns:
    """Stands for the struct of all fields without building it, so scans stay pruned."""

    def __init__(self, schema: T.StructType):
        self._names = set(schema.names)
        self._schema = schema

    def getField(self, name: str) -> Column:  # noqa: N802 - the name of Column's method
        return F.col(f"`{name}`")

    def isNotNull(self) -> Column:  # noqa: N802
        return F.lit(True)

    def whole(self) -> Column:
        return F.struct(*[F.col(f"`{n}`") for n in self._schema.names])
