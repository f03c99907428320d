"""Small dictionaries as Column expressions.

A dimension of checked size (lexicon, lemma table, gazetteer, language profile) becomes a
hashed array-of-maps literal. A lookup then costs one hash and a scan of about one entry,
needs no join, and leaves the job that uses it map-only: no shuffle, hence no skew.
"""

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LOOKUP_ROWS = 100_000
MAX_LOOKUP_BYTES = 8 << 20


def unique_keys(dim: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` with one row for each key: of several values of a key the least counts."""
    known = dim.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(key).agg(F.min(value).alias(value))


class Lookup:
    """Constant dictionary with string keys; ``get`` maps a key column to its value or NULL."""

    def __init__(self, entries: dict[str, str], value_type: str):
        """``entries`` maps a key to its value as JSON text."""
        self.size = len(entries)
        self._entries = entries
        self._slots = max(1, self.size)
        slots = [[] for _ in range(self._slots)]
        for key, value in entries.items():
            slot = zlib.crc32(key.encode("utf-8")) % self._slots
            slots[slot].append(f"{json.dumps(key)}:{value}")
        text = "[" + ",".join("{" + ",".join(slot) + "}" for slot in slots) + "]"
        # Foldable: the optimizer parses it once per plan.
        self._table = F.from_json(F.lit(text), f"array<map<string,{value_type}>>")

    @classmethod
    def of(cls, mapping: dict, value_type: str) -> "Lookup":
        return cls({k: json.dumps(v) for k, v in mapping.items()}, value_type)

    @classmethod
    def from_frame(cls, dim: DataFrame, key: str, value: str, max_rows=MAX_LOOKUP_ROWS):
        """The dimension as a lookup, or None when it has more than ``max_rows`` rows or
        ``MAX_LOOKUP_BYTES`` of text.

        Its size is measured before any row reaches the driver. See :func:`unique_keys` for keys
        that repeat.
        """
        value_type = dim.schema[value].dataType.simpleString()
        if not max_rows:
            return None
        texts = unique_keys(dim, key, value).select(
            F.col(key).alias("k"), F.to_json(F.struct(F.col(value).alias("v"))).alias("v")
        )
        size = texts.agg(F.count("*"), F.sum(F.octet_length("k") + F.octet_length("v"))).first()
        if size[0] > max_rows or (size[1] or 0) > MAX_LOOKUP_BYTES:
            return None
        rows = texts.collect()
        # to_json gives {"v":...}: the value text is what stands between.
        return cls({row.k: row.v[len('{"v":'):-1] for row in rows}, value_type)

    def mapping(self) -> dict:
        """The entries as plain values, for work on batches of rows."""
        return {key: json.loads(value) for key, value in self._entries.items()}

    def get(self, key: Column) -> Column:
        slot = F.crc32(key) % F.lit(self._slots)
        return F.element_at(F.get(self._table, slot.cast("int")), key)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, *columns: Column, keep=()) -> DataFrame:
    """``df.select(*keep, *columns)``, where filters that follow do not compute the columns again below."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
