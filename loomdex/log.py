"""Logs by category, as lines `time [LEVEL] [component] message`."""

from __future__ import annotations

import logging
import os

CATEGORIES = ("index", "watcher", "error", "debug")
DEFAULT = ("index", "watcher", "error")


class Logs:
    """One file per category in a folder of the driver; categories that are off write nothing."""

    def __init__(self, folder: str, enabled: tuple[str, ...] = DEFAULT):
        self.folder, self._loggers = folder, {}
        os.makedirs(folder, exist_ok=True)
        self.set_enabled(enabled)

    def set_enabled(self, enabled: tuple[str, ...]) -> None:
        self.enabled = tuple(c for c in CATEGORIES if c in enabled)

    def _logger(self, category: str) -> logging.Logger:
        if category not in self._loggers:
            log = logging.Logger(f"loomdex.{category}")
            handler = logging.FileHandler(os.path.join(self.folder, f"{category}.log"), delay=True)
            handler.setFormatter(logging.Formatter("%(asctime)s.%(msecs)03dZ [%(levelname)s] [%(component)s] %(message)s", "%Y-%m-%dT%H:%M:%S"))
            log.addHandler(handler)
            self._loggers[category] = log
        return self._loggers[category]

    def write(self, level: int, category: str, component: str, message: str) -> None:
        if category in self.enabled:
            self._logger(category).log(level, message, extra={"component": component})

    def info(self, category: str, component: str, message: str) -> None:
        self.write(logging.INFO, category, component, message)

    def warn(self, category: str, component: str, message: str) -> None:
        self.write(logging.WARNING, category, component, message)

    def error(self, category: str, component: str, message: str) -> None:
        self.write(logging.ERROR, category, component, message)

    def debug(self, category: str, component: str, message: str) -> None:
        self.write(logging.DEBUG, "debug" if "debug" in self.enabled else category, component, message) if "debug" in self.enabled else None

    def close(self) -> None:
        for log in self._loggers.values():
            for h in log.handlers:
                h.close()
        self._loggers.clear()
