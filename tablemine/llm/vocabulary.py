"""Words as bytes, and the exactly counted frequent ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.llm.common import written

#: Distinct entries a task counts before it hands them on; bounds its memory, never the counts.
OPEN_COUNTS = 200_000
#: Bytes of the longest word that may count as frequent.
LONGEST = 64


def word_table(keep: Callable[[str], bool], lower: bool) -> bytes:
    """Table for ``bytes.translate``: ASCII characters that ``keep`` refuses become blanks; A-Z become a-z if ``lower``."""
    kept = lambda c: keep(c.lower() if lower else c)
    return bytes(i if i > 127 else ord(chr(i).lower() if lower else chr(i)) if kept(chr(i)) else 32 for i in range(256))


def counted(df: DataFrame, entries: Callable[[bytes], list[bytes]], *, text: str = "text") -> DataFrame:
    """(entry, n): how often each of ``entries(text)`` occurs in all rows of ``df``, exactly. NULL texts are empty.

    Tasks count before anything is shuffled, so a very common entry is one row per task.
    """
    rows = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

        for b in parts:
            for x in b.column(0):
                seen.update(entries(x.as_py()))
                if len(seen) > OPEN_COUNTS:
                    yield out()
                    seen.clear()
        yield out()

    return rows.mapInArrow(sums, "entry binary, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, share: int, label: str) -> list[bytes]:
    """The entries that make up 1 / ``share`` of all counted ones or more, most frequent first: never more than ``share``.

    Entries longer than LONGEST bytes are left out.
    """
    counts = written(counts, label)
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.where((F.col("n") * share >= total) & (F.length("entry") <= LONGEST)).collect()
    return [bytes(r.entry) for r in sorted(top, key=lambda r: (-r.n, bytes(r.entry)))]
