"""A stand-in for sources that publish an item a day; what is out, and who fails, is in a file that tests write."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import date, timedelta


PATH = os.path.join(tempfile.gettempdir(), f"published-{os.getuid()}.json")  # Spark's workers have an environment of their own


def _state() -> dict:
    with open(PATH) as f:
        return json.load(f)


def clock() -> str:
    return _state()["today"]


def fetch(source: str, lo: str, hi: str):
    state = _state()
    day = date.fromisoformat(lo)
    while day <= date.fromisoformat(hi):
        if source in state["down"]:
            raise OSError(f"{source} is down")
        if day.isoformat() not in state.get("hidden", []):
            yield day.isoformat(), {"id": f"{source}-{day.isoformat()}", "edition": state["edition"]}
        day += timedelta(days=1)
