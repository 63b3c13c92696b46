"""Small ordered state machines, used inside tasks by batch scans and by streams.

Each one holds only what is open now, and is fed rows in order by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import hypot

import numpy as np


@dataclass
class Stay:
    key: str
    first_us: int
    first_seq: int
    origin: str
    last_us: int
    x: float = 0.0
    y: float = 0.0
    area: float = 0.0
    came_from: str | None = None
    published_us: int | None = None
    published: int = 0
    event_id: str | None = None


class Stays:
    """Open stays of one zone, rule and class, with hand-over from a lost track to a new one."""

    def __init__(self, expire: int, grace: int, reach: float, low: float, high: float):
        self.expire, self.grace, self.reach, self.low, self.high = expire, grace, reach, low, high
        self.open: dict[str, Stay] = {}

    def forget(self, prev_frame_us: int | None) -> None:
        """Drop stays that were already too old at the frame before this one."""
        if prev_frame_us is not None:
            old = [k for k, s in self.open.items() if prev_frame_us - s.last_us > self.expire]
            for k in old:
                del self.open[k]

    def see(self, key: str, us: int, seq: int, prev_frame_us: int | None, x: float, y: float, area: float) -> Stay:
        self.forget(prev_frame_us)
        stay = self.open.get(key)
        if stay is None:
            stay = self._continue(us, x, y, area)
            if stay is None:
                stay = Stay(key, us, seq, f"{key}@{us}", us)
            else:
                del self.open[stay.key]
                stay.came_from, stay.key = stay.key, key
            self.open[key] = stay
        stay.last_us, stay.x, stay.y, stay.area = us, x, y, area
        return stay

    def _continue(self, us: int, x: float, y: float, area: float) -> Stay | None:
        """Nearest lost stay not seen in this frame so far, of a like size and close by."""
        near = [
            (hypot(s.x - x, s.y - y), i, s)
            for i, s in enumerate(self.open.values())
            if s.last_us < us and us - s.last_us <= self.grace and s.area > 0 and area > 0
            and self.low <= area / s.area <= self.high
        ]
        near = [n for n in near if n[0] <= self.reach]
        return min(near)[2] if near else None


#: From so many pairs of a frame's boxes and open tracks on they are compared as arrays; below it a plain loop is faster.
MANY_PAIRS = 1024


class OpenTracks:
    """Open tracks of one camera and class; each box takes the track it overlaps most."""

    def __init__(self, min_iou: float, max_missing: int):
        self.min_iou, self.max_missing = min_iou, max_missing
        self.open: dict[int, list] = {}  # id -> [box, last sequence]
        self.made = 0
        self.frame: int | None = None
        self.free: list[int] = []

    def _begin(self, seq: int) -> None:
        if seq != self.frame:
            self.frame = seq
            self.open = {i: t for i, t in self.open.items() if seq - t[1] <= self.max_missing}
            self.free = sorted(self.open)

    def see_all(self, seq: int, boxes: list[tuple]) -> list[tuple[int, bool]]:
        """``see`` for several boxes of a frame, surest first; a frame may come in more than one piece."""
        self._begin(seq)
        if len(boxes) * len(self.free) < MANY_PAIRS:
            return [self.see(seq, box) for box in boxes]
        # A frame's own boxes are never free in it, so all pairs are known before the first box takes its track.
        ids = self.free
        old, new = np.array([self.open[i][0] for i in ids]).T, np.array(boxes).T[:, :, None]
        wide = np.minimum(new[2], old[2]) - np.maximum(new[0], old[0])
        high = np.minimum(new[3], old[3]) - np.maximum(new[1], old[1])
        shared = np.where((wide > 0) & (high > 0), wide * high, 0.0)
        size = [np.maximum(0.0, b[2] - b[0]) * np.maximum(0.0, b[3] - b[1]) for b in (new, old)]
        union = size[0] + size[1] - shared
        part = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        out, taken = [], set()
        for k, box in enumerate(boxes):
            at = int(part[k].argmax())
            known = part[k, at] > 0 and part[k, at] >= self.min_iou
            if known:
                part[:, at] = 0.0
                who = ids[at]
                taken.add(who)
            else:
                self.made += 1
                who = self.made
            self.open[who] = [box, seq]
            out.append((who, not known))
        self.free = [i for i in ids if i not in taken]
        return out

    def see(self, seq: int, box: tuple) -> tuple[int, bool]:
        """Track number of a box and whether it is new. Boxes of a frame come surest first."""
        self._begin(seq)
        best, who = 0.0, None
        left, top, right, bottom = box
        size = max(0.0, right - left) * max(0.0, bottom - top)
        for i in self.free:
            a, b, c, d = self.open[i][0]
            if c <= left or a >= right or d <= top or b >= bottom:
                continue
            shared = (min(right, c) - max(left, a)) * (min(bottom, d) - max(top, b))
            union = size + max(0.0, c - a) * max(0.0, d - b) - shared
            if union > 0 and shared / union > best:
                best, who = shared / union, i
        new = who is None or best < self.min_iou
        if new:
            self.made += 1
            who = self.made
        else:
            self.free.remove(who)
        self.open[who] = [box, seq]
        return who, new



def frames_of(seq: np.ndarray, new: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pieces ``[from, to)`` of rows with one sequence number; ``new`` also begins a piece."""
    cut = seq[1:] != seq[:-1]
    if new is not None:
        cut = cut | new[1:]
    ends = [0, *(np.flatnonzero(cut) + 1).tolist(), len(seq)]
    return zip(ends[:-1], ends[1:])
