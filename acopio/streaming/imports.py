"""Incremental imports: the backward walk over windows, page loops and refreshes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Progress:
    complete: bool
    cursor: date | None
    fetched: int
    clean: bool = True


def page_loop(fetch: Callable[[int], list], store: Callable[[list], None], guard: Callable[[], bool], size: int = 100) -> tuple[int, bool]:
    """ST4: pages until a short one; the guard is asked before and after each."""
    offset = 0
    while True:
        if not guard():
            return offset, False
        rows = fetch(offset)
        store(rows)
        offset += len(rows)
        if not guard():
            return offset, False
        if len(rows) < size:
            return offset, True


def backward_walk(fetch: Callable[[date, date, int], list], store: Callable[[list], None], stored: Callable[[], int], total: Callable[[], int], start: date, floor: date, guard: Callable[[], bool] = lambda: True, step: int = 89) -> Progress:
    """ST3: windows back from ``start`` (a cursor when resumed) until everything is stored.

    The cursor is the start of the last window that ended on its last page, else its end.
    """
    end, fetched = start, 0
    while True:
        begin = max(floor, end - timedelta(days=step))
        n, whole = page_loop(lambda offset, a=begin, z=end: fetch(a, z, offset), store, guard)
        fetched += n
        if not whole:
            return Progress(False, end, fetched, False)
        if stored() >= total():
            return Progress(True, begin, fetched)
        if begin <= floor:
            return Progress(False, begin, fetched)
        end = begin


def refresh(fetch, store, floor: date, today: date, guard=lambda: True, step: int = 89) -> bool:
    """ST5: at least one window; true (the mark may move) only if every window was clean."""
    end = today
    while True:
        begin = max(floor, end - timedelta(days=step))
        _, whole = page_loop(lambda offset, a=begin, z=end: fetch(a, z, offset), store, guard)
        if not whole:
            return False
        if begin <= floor:
            return True
        end = begin


def settle(bodies: list[str], work: Callable[[str], None], note: Callable[[str, str, str | None], None]) -> dict[str, str]:
    """ST6: a body's failure is its own; recording progress never fails the data."""
    states = {}
    for b in bodies:
        reason = None
        try:
            work(b)
            states[b] = "SUCCEEDED"
        except Exception as e:  # noqa: BLE001 - any failure of a body is its state
            states[b], reason = "FAILED", (" ".join(str(e).split()) or None)
            reason = reason if reason is None or len(reason) <= 500 else reason[:499] + "…"
        try:
            note(b, states[b], reason)
        except Exception:  # noqa: BLE001
            continue
    return states
