"""Merging and containment of JSON of any shape, on variants: column expressions, without Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How deep objects within objects are merged by ``merged_deeply``; below, the new value stands for the old one.
DEPTH = 4


def members(value: Column) -> Column:
    """The members of an object as a map of variants; null for what is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column) -> Column:
    """The elements of an array as variants; null for what is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def _object(pairs: Column) -> Column:
    # a fixed order of the keys, so that equal objects are equal texts
    return F.to_variant_object(F.map_from_entries(F.array_sort(F.map_entries(pairs), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))))


def merged(old: Column, new: Column) -> Column:
    """Two variants as one. Of two objects the members of both, a new one (null, too) in place of an old one, whole. Otherwise their arrays one after the other,
    where a value that is no array is an array of one. Null if either is null."""
    a, b = members(old), members(new)
    both = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    listed = lambda x: F.coalesce(elements(x), F.array(x))
    chained = F.to_variant_object(F.concat(listed(old), listed(new)))
    return F.when(old.isNull() | new.isNull(), None).otherwise(F.when(a.isNotNull() & b.isNotNull(), _object(both)).otherwise(chained))


def merged_deeply(old: Column, new: Column, depth: int = DEPTH) -> Column:
    """As ``merged`` for objects, where members that are objects on both sides are merged in turn, down to ``depth``; of anything else the new value (null, too) stands.
    Without a new value the old one stays, and the other way round."""
    a, b = members(old), members(new)
    if depth <= 0:
        return F.coalesce(new, old)
    each = F.map_zip_with(a, b, lambda k, x, y: merged_deeply(x, y, depth - 1))
    return F.when(a.isNotNull() & b.isNotNull(), _object(each)).otherwise(F.coalesce(new, old))


def _same(value: Column, wanted) -> Column:
    kind = F.schema_of_variant(value)
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    if isinstance(wanted, int):
        exact = F.try_variant_get(value, "$", "decimal(38,10)") == F.lit(str(wanted)).cast("decimal(38,10)")
    else:
        exact = F.try_variant_get(value, "$", "double") == F.lit(float(wanted))
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & exact


def _holding(wanted):
    return lambda x: contains(x, wanted, False)


def contains(value: Column, wanted, top: bool = True) -> Column:
    """Whether a variant contains ``wanted`` (dicts, lists, texts, numbers, truth values, None): an object every wanted member with a value that contains the wanted one,
    an array for every wanted element one that contains it, in any order and repeats apart; other values if they are equal, numbers by value.
    At the top an array also contains a plain value that is an element. False for a null variant."""
    if isinstance(wanted, dict):
        m = members(value)
        found = m.isNotNull()
        for key, own in wanted.items():
            found = found & F.coalesce(contains(F.try_element_at(m, F.lit(key)), own, False), F.lit(False))
    elif isinstance(wanted, list):
        e = elements(value)
        found = e.isNotNull()
        for own in wanted:
            found = found & F.exists(e, _holding(own))
    else:
        found = F.coalesce(_same(value, wanted), F.lit(False))
        if top:
            found = found | F.coalesce(F.exists(elements(value), lambda x: F.coalesce(_same(x, wanted), F.lit(False))), F.lit(False))
    return F.coalesce(found, F.lit(False))
