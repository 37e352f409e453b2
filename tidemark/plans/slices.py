"""Slicing of a time range into the coarsest clean tiers and raw rests, by interval arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.functions.frames import Frame

RAW = "raw"
Range = tuple[int, int]


@dataclass(frozen=True)
class Segment:
    source: str
    start: int
    end: int


def unify(ranges: list[Range]) -> list[Range]:
    """Sorted disjoint ranges; those that overlap or touch become one."""
    out: list[Range] = []
    for a, b in sorted(r for r in ranges if r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def subtract(whole: Range, holes: list[Range]) -> list[Range]:
    at, out = whole[0], []
    for a, b in unify(holes):
        if b <= whole[0] or a >= whole[1]:
            continue
        if a > at:
            out.append((at, a))
        at = max(at, b)
    if at < whole[1]:
        out.append((at, whole[1]))
    return out


def core(frame: Frame, part: Range) -> Range | None:
    """The whole buckets of frame inside a range."""
    a, b = frame.ceil(part[0]), frame.floor(part[1])
    return (a, b) if a < b else None


def slice_range(whole: Range, tiers: list[Frame], dirty: list[Range], covered: dict[str, Range] | None = None) -> list[Segment]:
    """Segments that tile the range, in order. Dirty ranges, and what a tier doesn't cover, come from raw rows."""
    out = [Segment(RAW, max(a, whole[0]), min(b, whole[1])) for a, b in unify(dirty) if a < whole[1] and b > whole[0]]

    def cut(part: Range, frames: list[Frame]) -> None:
        if part[0] >= part[1]:
            return
        if not frames:
            out.append(Segment(RAW, *part))
            return
        frame, rest = frames[0], frames[1:]
        known = (covered or {}).get(frame.name, part)
        usable = (max(part[0], known[0]), min(part[1], known[1]))
        inner = core(frame, usable) if usable[0] < usable[1] else None
        if inner is None:
            cut(part, rest)
            return
        cut((part[0], inner[0]), rest)
        out.append(Segment(frame.name, *inner))
        cut((inner[1], part[1]), rest)

    for clean in subtract(whole, dirty):
        cut(clean, sorted(tiers, reverse=True))
    joined: list[Segment] = []
    for s in sorted(out, key=lambda s: s.start):
        if joined and joined[-1].source == s.source and joined[-1].end == s.start:
            joined[-1] = Segment(s.source, joined[-1].start, s.end)
        else:
            joined.append(s)
    return joined
