"""Schemas of the engine's tables, constants and row constructors."""

from __future__ import annotations

import random

from quillstack.types import array, struct

NOTE = struct(
    note_id="string", title="string", body="string", created_at="long", updated_at="long", tags=array("string"), links=array("string"),
    pinned="boolean", archived="boolean", locked="boolean", trashed_at="long", rev="int",
)
VERSION = struct(note_id="string", rev="int", at="long", title="string", body="string")
DAY_MS = 86_400_000
RETENTION_MS, HISTORY_KEPT, COMPACT_EVERY, DEBOUNCE_MS = 30 * DAY_MS, 50, 25, 600
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def new_id(now: int, draw=random.random) -> str:
    """Epoch ms in base 36, nine digits, and eight random ones."""
    head = ""
    while now:
        now, r = divmod(now, 36)
        head = _DIGITS[r] + head
    return head.rjust(9, "0") + "-" + "".join(_DIGITS[int(draw() * 36)] for _ in range(8))


def empty_note(note_id: str, now: int) -> dict:
    return {"note_id": note_id, "title": "", "body": "", "created_at": now, "updated_at": now, "tags": [], "links": [], "pinned": False, "archived": False, "locked": False, "trashed_at": None, "rev": 1}
