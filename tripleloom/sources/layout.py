"""Stored order and filters of a table, so that a look-up reads little of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """How a table's rows lie in its files.

    ``order`` are the columns that rows are sorted by over all files: a range of
    the first one is in few files, and in few row groups of them.  ``filters``
    are columns with a Bloom filter per row group, for look-ups by value of what
    is not in order.  ``row_group_bytes`` is what a look-up reads at least.
    """

    order: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    row_group_bytes: int | None = None

    def rows(self, frame: DataFrame) -> DataFrame:
        """The rows dealt and sorted for storage.

        Ranges end at a hash of the whole row, so a value that very many rows
        have is spread over several tasks and files.
        """
        self._check(frame)
        if not self.order:
            return frame
        return frame.repartitionByRange(*self.order, F.xxhash64(*frame.columns)).sortWithinPartitions(*self.order)

    def options(self) -> dict[str, str]:
        """Options of a Parquet writer; other formats have their own layouts and ignore them."""
        made = {f"parquet.bloom.filter.enabled#{name}": "true" for name in self.filters}
        if self.filters:
            made["parquet.bloom.filter.adaptive.enabled"] = "true"
        if self.row_group_bytes:
            made["parquet.block.size"] = str(self.row_group_bytes)
        return made

    def _check(self, frame: DataFrame) -> None:
        missing = [name for name in (*self.order, *self.filters) if name not in frame.columns]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} to lay the table out by")


def parse_layout(text: str) -> Layout:
    """``COLUMN,...`` to order by, then after a colon columns to filter: ``CNPJ_BASICO:EMAIL,CEP``."""
    order, _, filters = text.partition(":")
    return Layout(tuple(filter(None, order.split(","))), tuple(filter(None, filters.split(","))))
