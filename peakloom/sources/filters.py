"""What filters on contig and place leave to be read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

_KNOWN = EqualTo | In | LessThan | LessThanOrEqual | GreaterThan | GreaterThanOrEqual
#: Beyond all places of a contig.
FAR = 1 << 40


def wanted_by(filters: Iterable[Filter]) -> dict[str, tuple[int, int]] | None:
    """The contigs, with ranges of bases that spans overlap, which filters on chrom, start and end leave; none where all contigs stay."""
    names: set[str] | None = None
    low, high = 0, FAR
    for f in filters:
        if not isinstance(f, _KNOWN):
            continue
        column = f.attribute[0] if len(f.attribute) == 1 else ""
        if column == "chrom" and isinstance(f, EqualTo | In):
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            names = own if names is None else names & own
        elif column == "start" and isinstance(f, LessThan | LessThanOrEqual):
            high = min(high, f.value + isinstance(f, LessThanOrEqual))
        elif column == "start" and isinstance(f, GreaterThan | GreaterThanOrEqual):
            low = max(low, f.value)
        elif column == "end" and isinstance(f, GreaterThan | GreaterThanOrEqual):
            low = max(low, f.value - isinstance(f, GreaterThanOrEqual))
        elif column in ("start", "end") and isinstance(f, EqualTo):
            low, high = max(low, f.value - (column == "end")), min(high, f.value + 1)
    if names is None:
        return None
    return {n: (max(low, 0), high) for n in names if n is not None and low < high}
