"""The code's own value for a documented slot, or null where it can't be proven. Null always means unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exists_value(present: Column, known: Column, chain: Column) -> Column:
    """``true`` if present; ``false`` only if every ancestor up to the module is present and closed.

    ``chain`` is an array of structs (kind, present, closed), nearest first,
    that ends with the first module or unknown ancestor.
    """
    proven = (F.size(chain) > 0) & (F.element_at(chain, -1)["kind"] == "module") & F.forall(chain, lambda x: F.coalesce(x["present"] & x["closed"], F.lit(False)))
    return F.when(present, "true").when(known & present.isNull(), F.lit(None)).when(F.coalesce(proven, F.lit(False)), "false")


def deprecated_value(present: Column, kind: Column, flag: Column) -> Column:
    return F.when(present & kind.isin("function", "method", "class"), flag.cast("string"))


def param_exists_value(names: Column, param: Column) -> Column:
    """Named, or starred under its bare name: true. Any other starred parameter: unknown. Else false."""
    named = F.exists(names, lambda n: F.ltrim(n, F.lit("*")) == param)
    return F.when(named, "true").when(F.exists(names, lambda n: n.startswith("*")), F.lit(None)).when(names.isNotNull(), "false")


def default_withheld(code: Column, documented: Column) -> Column:
    """A code default of None may stand for any documented one."""
    return (code == "None") & F.exists(documented, lambda d: d != "None")
