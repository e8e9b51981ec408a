"""Settings in sections, from INI files and the command line."""

from __future__ import annotations

import os
from collections.abc import Iterable
from configparser import ConfigParser

#: Later files win over earlier ones, the command line over all.
FILES = ("/etc/termloom/termloomrc", "~/.termloomrc", "./.termloomrc")


class Settings:
    def __init__(self, files: Iterable[str] = FILES):
        self.values: dict[str, dict[str, str]] = {}
        for file in files:
            self.read(file)

    def read(self, file: str) -> None:
        found = ConfigParser(interpolation=None)
        found.read(os.path.expanduser(file))
        for section in found.sections():
            self.values.setdefault(section, {}).update(found.items(section))

    def get(self, option: str, section: str = "global", default: str | None = None) -> str | None:
        return self.values.get(section, {}).get(option, default)

    def update(self, option: str, value: object, section: str = "global") -> None:
        """Sets an option; None leaves it as it is."""
        if value is not None:
            self.values.setdefault(section, {})[option] = str(value)

    def write(self, file: str) -> None:
        out = ConfigParser(interpolation=None)
        out.read_dict(self.values)
        with open(os.path.expanduser(file), "w") as f:
            out.write(f)
