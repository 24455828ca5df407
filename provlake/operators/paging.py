"""Pages by order statistics (SRT01-03): a deep page is sought by counts of key ranges, not by dragging all rows before it to one task.

Rows are a key and an id. A page near the start is a bounded top list. A deep one narrows the rows down: SPLITS splitters
from a sample of bounded size cut the key into ranges, a count of each tells in which range the page begins, and only that range's
rows go on, until DIRECT or fewer are left before the page. Where one key holds more than that, its ids are cut the same
way. A poor sample costs another pass and never a wrong page; a page that runs past its range takes from the next ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import stored

#: Rows up to the page's end that a top list may hold; ranges of a pass; rows of the sample that splitters come from.
DIRECT, SPLITS, SAMPLE = 10_000, 64, 1024


def _order(key: str, id: str, descending: bool, nulls_last: bool) -> list[Column]:
    c = F.col(key)
    by = (c.desc_nulls_last() if nulls_last else c.desc_nulls_first()) if descending else (c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
    return [by, F.col(id).asc()]


def _ranges(rows: DataFrame, column: str, id: str) -> tuple[Column, int]:
    """The number of the range that a row's column lies in, ascending and null for nulls, and how many there are."""
    drawn = rows.where(F.col(column).isNotNull()).select(column, F.xxhash64(column, id).alias("h")).orderBy("h", column).limit(SAMPLE).collect()  # SAMPLE rows at most
    values = sorted({r[0] for r in drawn})
    if isinstance(values[0] if values else None, str):
        values.sort(key=lambda v: v.encode())  # as Spark compares
    picked = values if len(values) <= SPLITS else [values[i * len(values) // SPLITS] for i in range(1, SPLITS)]
    if not picked:
        return F.lit(None).cast("int"), 0
    # two ranges for each splitter: below it, and equal to it, so that a frequent value has one to itself
    cuts = F.array(*(F.lit(v) for v in picked))
    below = F.size(F.filter(cuts, lambda s: s < F.col(column)))
    return F.when(F.col(column).isNotNull(), 2 * below + F.array_contains(cuts, F.col(column)).cast("int")), 2 * len(picked) + 1


def seek(rows: DataFrame, key: str, id: str, offset: int, size: int, descending: bool = False, nulls_last: bool = True, direct: int = DIRECT) -> DataFrame:
    """The rows offset to offset + size of rows ordered by key and id, in order; key and id are all that rows should have.

    Ids are ascending under either order of the key, and not null.
    """
    if offset + size <= direct:
        return rows.orderBy(*_order(key, id, descending, nulls_last)).offset(offset).limit(size)
    rows = stored(rows.select(key, id))
    parts, skip, want, column, falling = [], offset, size, key, descending
    while True:
        bucket, n = _ranges(rows, column, id)
        counts = {r.b: (r.n, r.one) for r in rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(column).eqNullSafe(F.max(column)).alias("one")).collect()}  # 2 * SPLITS + 2 rows at most
        numbers = sorted((b for b in counts if b is not None), reverse=falling)
        if None in counts:
            numbers = [*numbers, None] if nulls_last else [None, *numbers]
        before, first = 0, None
        for at, b in enumerate(numbers):
            if before + counts[b][0] > skip:
                first = at
                break
            before += counts[b][0]
        if first is None:
            break
        here, (held, one) = numbers[first], counts[numbers[first]]
        after, rest = [], want - (before + held - skip)
        for b in numbers[first + 1 :]:
            if rest <= 0:
                break
            after.append(b)
            rest -= counts[b][0]
        if after:
            parts.append(rows.where(F.coalesce(bucket, F.lit(-1)).isin([-1 if b is None else b for b in after])))
        inside = rows.where(bucket.eqNullSafe(F.lit(here).cast("int")))
        skip -= before
        if skip + want <= direct or held <= direct or (one and column == id):
            parts.append(inside)
            break
        if one and column == key:  # nulls too
            column, falling = id, False
        rows = stored(inside) if held < before else inside
    if not parts:
        return rows.limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.orderBy(*_order(key, id, descending, nulls_last)).offset(skip).limit(size)
