"""A log file for each session; old ones are removed."""

from __future__ import annotations

import logging
import time
from pathlib import Path

KEEP_DAYS = 7


def clean_old(folder: Path, days: int = KEEP_DAYS, now: float | None = None) -> int:
    """Delete log files not written for ``days``; returns how many."""
    limit, gone = (now or time.time()) - days * 86_400, 0
    for path in folder.glob("*.log"):
        if path.stat().st_mtime < limit:
            path.unlink()
            gone += 1
    return gone


def session_log(folder: str, verbose: bool = False) -> logging.Logger:
    """The package's logger, writing to a new file under ``folder``; with ``verbose`` to the console too."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    clean_old(at)
    log = logging.getLogger("lodestone")
    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    handlers: list[logging.Handler] = [logging.FileHandler(at / f"{time.strftime('%Y%m%d-%H%M%S')}.log")]
    if verbose:
        handlers.append(logging.StreamHandler())
    for handler in handlers:
        handler.setFormatter(form)
        log.addHandler(handler)
    return log
