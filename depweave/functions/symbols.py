"""Symbol expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of callable symbols: fixed values (function, method, constructor and their variants).
CALLABLE_KINDS = [17, 26, 9, 66, 80, 68, 69, 70, 71, 67, 76]

#: Names of symbol kinds: fixed values.
KIND_NAMES = {7: "Class", 17: "Function", 26: "Method", 9: "Constructor", 11: "Enum", 21: "Interface", 53: "Trait", 8: "Constant", 15: "Field", 29: "Module"}

DEFINITION, IMPORT = 1, 2


def is_local(symbol: str = "symbol") -> Column:
    return F.startswith(F.col(symbol), F.lit("local "))


def is_definition(roles: str = "symbol_roles") -> Column:
    return F.coalesce(F.col(roles), F.lit(0)).bitwiseAND(DEFINITION) != 0


def is_import(roles: str = "symbol_roles") -> Column:
    return F.coalesce(F.col(roles), F.lit(0)).bitwiseAND(IMPORT) != 0


def is_callable(kind: str = "kind", symbol: str = "symbol") -> Column:
    """By kind where one is known, else by a method suffix such as ``(a).`` or ``().``."""
    known = F.coalesce(F.col(kind), F.lit(0))
    return F.when(known != 0, known.isin(CALLABLE_KINDS)).otherwise(F.coalesce(F.col(symbol).rlike(r"\([^)]*\)\.$"), F.lit(False)))


def with_symbol_flags(df: DataFrame) -> DataFrame:
    """is_local, is_definition, is_import, is_callable (P7); needs symbol, symbol_roles, kind."""
    return df.withColumns({"is_local": is_local(), "is_definition": is_definition(), "is_import": is_import(), "is_callable": is_callable()})


def symbol_name(symbol: str = "symbol") -> Column:
    """The readable name (P8): dots at the end go first, so a method suffix that needs one stays."""
    plain = F.rtrim(F.col(symbol), F.lit("."))
    last = F.regexp_replace(F.substring_index(plain, "/", -1), r"\([^)]*\)\.$", "")
    name = F.rtrim(last, F.lit("#"))
    return F.when(name == "", F.col(symbol)).otherwise(name)


def kind_name(kind: str = "kind") -> Column:
    """The kind's name (P9); null for kinds without one."""
    names = F.create_map(*(F.lit(x) for pair in KIND_NAMES.items() for x in pair))
    return F.element_at(names, F.col(kind).cast("int"))


def symbol_module(symbol: str = "symbol") -> Column:
    """The module part of a symbol (P10): the text between its first two backticks, if it has a ``/``."""
    return F.when(F.instr(F.col(symbol), "/") > 0, F.nullif(F.get(F.split(F.col(symbol), "`"), F.lit(1)), F.lit("")))
