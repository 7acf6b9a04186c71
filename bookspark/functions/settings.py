"""Settings from several sources: an argument before the environment before files; placeholders count as unset."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Values that stand where one is yet to be filled in.
PLACEHOLDER = re.compile(r"(?i)\A(?:your[_-].*|<.*>|\$\{.*\}|x+|changeme)\Z", re.DOTALL)


def usable(value: str | None) -> bool:
    return bool(value and value.strip()) and not PLACEHOLDER.match(value.strip())


def setting(name: str, argument: str | None = None, env: Mapping[str, str] | None = None, files: Iterable[str] = (), read: Callable[[str], str] | None = None) -> tuple[str | None, str | None]:
    """(value, origin) of the first source with a usable value: "argument", "environment", or the file's path.

    A file has lines `name: value` or `name = value`, with or without quotes; files that cannot be read are passed over.
    """
    env = os.environ if env is None else env
    if usable(argument):
        return argument.strip(), "argument"
    if usable(env.get(name)):
        return env[name].strip(), "environment"
    line = re.compile(rf"""(?m)^[ \t]*{re.escape(name)}[ \t]*[:=][ \t]*["']?([^"'\r\n#]*)""")
    for path in files:
        try:
            body = read(path) if read else open(path, encoding="utf-8").read()
        except OSError:
            continue
        for found in line.findall(body):
            if usable(found):
                return found.strip(), path
    return None, None


def first_setting(rows: DataFrame, key: str, value: str, origin: str, order: Column, rank: Column) -> DataFrame:
    """key, value, origin: of each key's rows that hold a usable value the one with the least rank, then the least order."""
    trimmed = T.strip(F.col(value))
    rows = rows.where((trimmed != "") & ~trimmed.rlike(PLACEHOLDER.pattern.replace(r"\Z", r"\z")))
    by = F.struct(rank.alias("r"), order.alias("o"))
    return rows.groupBy(key).agg(F.min_by(value, by).alias("value"), F.min_by(origin, by).alias("origin"))
