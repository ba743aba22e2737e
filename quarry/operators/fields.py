"""One resolver for the fields that samplers name: a column, a synonym of a canonical column, a
dotted path into a struct, map, JSON string or VARIANT, or a key that the JSON readers put into
``extra``. Every sampler reads fields through it, so JSON rows and typed tables behave alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import _falsy, canonical_key

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
FALSE_STRINGS = ("", "false", "0", "no")


@dataclass
class Field:
    """A value with its type; ``variant`` values keep JSON's own types."""

    col: Column
    typ: str

    @property
    def is_variant(self) -> bool:
        return self.typ == "variant"

    def get(self, typ: str) -> Column:
        """The value as ``typ``, NULL where it does not fit."""
        if self.is_variant:
            return F.try_variant_get(self.col, "$", typ)
        return self.col if self.typ == typ else self.col.try_cast(typ)

    def number(self) -> Column:
        """Numbers and booleans, strings that parse; else NULL."""
        if self.is_variant or self.typ in (*NUMERIC, "boolean", "string") or self.typ.startswith("decimal"):
            return self.get("double")
        return F.lit(None).cast("double")

    def truthy(self) -> Column:
        """Booleans and numbers as they are, lists and objects by size, strings unless '', 'false',
        '0' or 'no'; NULL is false."""
        if self.is_variant:
            text = F.lower(F.trim(F.try_variant_get(self.col, "$", "string")))
            return F.coalesce(~(_falsy(self.col) | F.coalesce(text.isin(*FALSE_STRINGS), F.lit(False))), F.lit(False))
        if self.typ == "boolean":
            return F.coalesce(self.col, F.lit(False))
        if self.typ in NUMERIC or self.typ.startswith("decimal"):
            return F.coalesce(self.col != 0, F.lit(False))
        if self.typ.startswith(("array", "map")):
            return F.coalesce(F.size(self.col) > 0, F.lit(False))
        if self.typ.startswith("struct"):
            return self.col.isNotNull()
        return F.coalesce(~F.lower(F.trim(self.col.cast("string"))).isin(*FALSE_STRINGS), F.lit(False))

    def numbers(self) -> Column:
        """A list of numbers as ARRAY<DOUBLE>; NULL if it is none."""
        if self.is_variant:
            return F.try_variant_get(self.col, "$", "array<double>")
        return self.col.cast("array<double>") if self.typ.startswith("array") else F.lit(None).cast("array<double>")

    def strings(self) -> Column:
        """The values of an object as ARRAY<STRING>; NULL if it is none."""
        if self.is_variant:
            return F.map_values(F.try_variant_get(self.col, "$", "map<string,string>"))
        if self.typ.startswith("map"):
            return F.transform(F.map_values(self.col), lambda x: x.cast("string"))
        return F.lit(None).cast("array<string>")


def _json_path(parts: list[str]) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in parts)


def _inside(df: DataFrame, root: str, parts: list[str]) -> Field:
    """The value at ``parts`` inside column ``root``."""
    typ = dict(df.dtypes)[root]
    col = F.col(f"`{root}`")
    for i, p in enumerate(parts):
        if typ == "variant":
            return Field(F.try_variant_get(col, _json_path(parts[i:]), "variant"), "variant")
        if typ == "string":
            return Field(F.try_variant_get(F.try_parse_json(col), _json_path(parts[i:]), "variant"), "variant")
        if not typ.startswith(("struct", "map")):
            return MISSING
        col = col.getField(p) if typ.startswith("struct") else F.try_element_at(col, F.lit(p))
        try:
            typ = df.select(col.alias("x")).dtypes[0][1]
        except Exception:  # noqa: BLE001  the struct has no such field
            return MISSING
    return Field(col, typ)


#: Stands for a path that a type does not have.
MISSING = Field(None, "void")


def resolve(df: DataFrame, name: str | None) -> Field:
    """The field of that name; a NULL field if there is none. Rows of JSON sources that lack the
    key have NULL there."""
    null = Field(F.lit(None), "void")
    if not name:
        return null
    types = dict(df.dtypes)
    candidates = [name, canonical_key(name), *[c for c in df.columns if c.lower() == name.lower()]]
    for c in candidates:
        if c in types:
            return Field(F.col(f"`{c}`"), types[c])
    parts = name.split(".")
    if len(parts) > 1 and parts[0] in types:
        found = _inside(df, parts[0], parts[1:])
        return null if found is MISSING else found
    if types.get("extra") == "variant":
        return _inside(df, "extra", parts)
    return null


def absent_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Per dataset the names without any value, as ARRAY<STRING>: for the audit."""
    gone = [F.when(F.count(resolve(df, n).col) == 0, F.lit(n)) for n in names]
    return df.groupBy("dataset").agg(F.array_compact(F.array(*gone)).alias("absent_fields"))
