"""Logging and timing of actions."""

from __future__ import annotations

import functools
import logging
import os
import time
from collections.abc import Callable


def setup_logging(folder: str | None = None, name: str = "floetrack", level: int = logging.INFO) -> logging.Logger:
    """A logger to the console and, with a folder, to a file there; called again it adds nothing."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not logger.handlers:
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if folder:
            os.makedirs(folder, exist_ok=True)
            handlers.append(logging.FileHandler(os.path.join(folder, f"{name}.log")))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            logger.addHandler(h)
    return logger


def timed(action: Callable) -> Callable:
    """Logs the seconds of a call. Meant for calls that run an action; a lazy plan takes no time."""

    @functools.wraps(action)
    def wrapper(*args, **kwargs):
        start = time.perf_counter()
        try:
            return action(*args, **kwargs)
        finally:
            logging.getLogger("floetrack").info("%s took %.2f s", action.__name__, time.perf_counter() - start)

    return wrapper
