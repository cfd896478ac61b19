"""Row frames over one series: lags, trailing and centred statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def trailing(column: str, width: int, stat: str, w: WindowSpec) -> Column:
    """``stat`` over the last ``width`` rows; NULL until the frame is full."""
    frame = w.rowsBetween(-(width - 1), 0)
    return F.when(F.count(column).over(frame) == width, _stat(stat)(column).over(frame))


def centred(column: str, width: int, stat: str, w: WindowSpec, min_rows: int) -> Column:
    """``stat`` over a centred frame; an even width leans one row to the past."""
    lo, hi = centred_bounds(width)
    frame = w.rowsBetween(lo, hi)
    return F.when(F.count(column).over(frame) >= min_rows, _stat(stat)(column).over(frame))


def centred_bounds(width: int) -> tuple[int, int]:
    return -(width // 2), (width - 1) // 2


def add_centred_means(
    df: DataFrame, plan: Mapping[str, tuple[str, int, int]], w: WindowSpec
) -> DataFrame:
    """Centred means over partial frames: output -> (source, width, least present rows).

    A frame is the rows up to this one and those after it. Both halves are put together
    from block sums and counts as in ``add_trailing``, with nothing for rows beyond the
    ends, for every width alike.
    """
    keep = df.columns
    halves: dict[str, dict[int, set[int]]] = {}
    for source, width, _ in plan.values():
        lo, hi = centred_bounds(width)
        own = halves.setdefault(source, {1: set(), -1: set()})
        own[1].add(1 - lo)
        own[-1].add(hi)
    for source, own in halves.items():
        df = df.withColumns({
            f"_v1_{source}": F.coalesce(F.col(source).cast("double"), F.lit(0.0)),
            f"_c1_{source}": F.col(source).isNotNull().cast("double")})
        for way, widths in own.items():
            df = _add_blocks(df, source, max(widths), way, w)

    def total(kind: str, source: str, width: int) -> Column:
        lo, hi = centred_bounds(width)
        parts = [_shifted(f"_{kind}{size}_{source}", size, way, offset + (way < 0), w)
                 for way, n in ((1, 1 - lo), (-1, hi)) for size, offset in _blocks(n)]
        return sum(parts[1:], parts[0])

    sums = {f"_{kind}_{out}": total(kind, source, width)
            for out, (source, width, _) in plan.items() for kind in ("v", "c")}
    df = df.withColumns(sums)
    return df.select(*keep, *(
        F.when(F.col(f"_c_{out}") >= least, F.col(f"_v_{out}") / F.col(f"_c_{out}")).alias(out)
        for out, (_, _, least) in plan.items()))


def _add_blocks(df: DataFrame, source: str, width: int, way: int, w: WindowSpec) -> DataFrame:
    """Sums and counts of 2, 4, ... rows up to each row (way 1) or from it on (way -1)."""
    size = 1
    while 2 * size <= width:
        df = df.withColumns({
            _block(f"_{k}{2 * size}_{source}", 2 * size, way):
                F.col(_block(f"_{k}{size}_{source}", size, way)) + _shifted(f"_{k}{size}_{source}", size, way, size, w)
            for k in ("v", "c")})
        size *= 2
    return df


def _block(name: str, size: int, way: int) -> str:
    return name if size == 1 or way > 0 else f"{name}_on"


def _shifted(name: str, size: int, way: int, by: int, w: WindowSpec) -> Column:
    """A block ``by`` rows back (way 1) or on (way -1); 0 beyond the ends."""
    column = _block(name, size, way)
    if by == 0:
        return F.col(column)
    return F.coalesce((F.lag if way > 0 else F.lead)(column, by).over(w), F.lit(0.0))


def _stat(name: str):
    return {"avg": F.avg, "std": F.stddev_samp, "sum": F.sum}[name]


def add_trailing(
    df: DataFrame,
    means: Mapping[str, tuple[str, int]],
    stds: Mapping[str, tuple[str, int]],
    w: WindowSpec,
) -> DataFrame:
    """Trailing means and sample stds over full frames, in O(log width) per row.

    ``means`` / ``stds`` map an output column to (source column, width). Spark
    re-reads a sliding frame for every row; instead the sum and the squared
    deviation of blocks of 1, 2, 4, ... rows are merged from two neighbours
    (the pairwise variance update, free of cancellation), and each width is
    composed from its binary blocks. Every step is a plain lag over the same
    ordering, so no exchange or sort is added. A NULL anywhere in the frame, or
    a frame that is not full, gives NULL.
    """
    widths: dict[str, set[int]] = {}
    spread: set[str] = set()
    for plan in (means, stds):
        for source, width in plan.values():
            widths.setdefault(source, set()).add(width)
    spread.update(source for source, _ in stds.values())
    keep = df.columns

    def s(c: str, k: int) -> str:
        return c if k == 1 else f"_s{k}_{c}"

    def m(c: str, k: int) -> Column:
        return F.lit(0.0) if k == 1 else F.col(f"_m{k}_{c}")

    k = 1
    while 2 * k <= max(n for ns in widths.values() for n in ns):
        wide = [c for c, ns in widths.items() if max(ns) >= 2 * k]
        back = {f"_bs_{c}": F.lag(s(c, k), k).over(w) for c in wide}
        if k > 1:
            back |= {f"_bm_{c}": F.lag(f"_m{k}_{c}", k).over(w) for c in wide if c in spread}
        df = df.withColumns(back)
        merged = {}
        for c in wide:
            now, old = F.col(s(c, k)).cast("double"), F.col(f"_bs_{c}")
            merged[s(c, 2 * k)] = now + old
            if c in spread:
                old_m = F.col(f"_bm_{c}") if k > 1 else F.lit(0.0)
                merged[f"_m{2 * k}_{c}"] = m(c, k) + old_m + (now - old) * (now - old) / (2 * k)
        df = df.withColumns(merged).drop(*back)
        k *= 2

    back = {}
    for c, ns in widths.items():
        for n in ns:
            for size, offset in _blocks(n)[1:]:
                back[f"_ps{size}_{offset}_{c}"] = F.lag(s(c, size), offset).over(w)
                if c in spread and size > 1:
                    back[f"_pm{size}_{offset}_{c}"] = F.lag(f"_m{size}_{c}", offset).over(w)
    df = df.withColumns(back) if back else df

    def total(c: str, n: int) -> tuple[Column, Column]:
        (size, _), *rest = _blocks(n)
        count, acc, dev = size, F.col(s(c, size)).cast("double"), m(c, size)
        for size, offset in rest:
            part = F.col(f"_ps{size}_{offset}_{c}")
            if c in spread:
                part_dev = F.col(f"_pm{size}_{offset}_{c}") if size > 1 else F.lit(0.0)
                gap = acc / count - part / size
                dev = dev + part_dev + gap * gap * (count * size / (count + size))
            count, acc = count + size, acc + part
        return acc, dev

    out = {name: total(c, n)[0] / n for name, (c, n) in means.items()}
    out |= {name: F.sqrt(total(c, n)[1] / (n - 1)) for name, (c, n) in stds.items()}
    return df.withColumns(out).select(*keep, *out)


def _blocks(width: int) -> list[tuple[int, int]]:
    """Binary blocks (size, offset into the past) that tile a frame of ``width`` rows."""
    blocks, offset = [], 0
    for bit in reversed(range(width.bit_length())):
        if width >> bit & 1:
            blocks.append((1 << bit, offset))
            offset += 1 << bit
    return blocks
