"""Recognising text in images: a plug-in interface, run over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from importlib.util import find_spec
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .functions.settings import setting


class OcrBackend(Protocol):
    """Something that reads images.  It is pickled to the workers, so heavy parts are loaded on first use."""

    def recognize(self, images: list[bytes]) -> list[str]:
        """A text for each image, in order; '' where there is none."""


class NullBackend:
    """Reads nothing: images become links or notes."""

    def recognize(self, images: list[bytes]) -> list[str]:
        return [""] * len(images)


class FallbackBackend:
    """Asks each backend in turn for the images that have no text yet; a backend that fails has read nothing."""

    def __init__(self, *backends: OcrBackend) -> None:
        self.backends = backends

    def recognize(self, images: list[bytes]) -> list[str]:
        out = [""] * len(images)
        for b in self.backends:
            left = [i for i, t in enumerate(out) if not t]
            if not left:
                break
            try:
                texts = b.recognize([images[i] for i in left])
            except Exception:  # noqa: BLE001  whatever a plug-in raises, the next one is asked
                continue
            for i, t in zip(left, [*texts, *[""] * len(left)]):
                out[i] = t or ""
        return out


_built: dict[str, OcrBackend] = {}


class LazyBackend:
    """A backend that `make` builds on first use, once in each worker process; names tell such backends apart."""

    def __init__(self, name: str, make: Callable[[], OcrBackend]) -> None:
        self.name, self.make = name, make

    def recognize(self, images: list[bytes]) -> list[str]:
        if self.name not in _built:
            _built[self.name] = self.make()
        return _built[self.name].recognize(images)


@dataclass(frozen=True)
class Engine:
    """What can make a backend, if the setting and the module that it needs are there."""

    name: str
    make: Callable[[], OcrBackend]
    needs_setting: str | None = None
    needs_module: str | None = None

    def ready(self, env: Mapping[str, str] | None = None, files: Iterable[str] = ()) -> bool:
        if self.needs_setting and setting(self.needs_setting, env=env, files=files)[0] is None:
            return False
        return not self.needs_module or find_spec(self.needs_module) is not None


def choose(engines: Iterable[Engine], first: str | None = None, env: Mapping[str, str] | None = None, files: Iterable[str] = ()) -> OcrBackend:
    """The engines that are ready, each built when it is first asked: in the given order, but the one named `first` before all.

    An image that one engine cannot read goes to the next.  Without any engine nothing is read.  Modules are looked for on the
    driver, so workers must have the same ones; an engine that fails on a worker has read nothing there.
    """
    engines, files = list(engines), list(files)
    if first is not None and first not in (e.name for e in engines):
        raise ValueError(f"no engine {first!r}")
    ready = [LazyBackend(e.name, e.make) for e in sorted(engines, key=lambda e: e.name != first) if e.ready(env, files)]
    return FallbackBackend(*ready) if ready else NullBackend()


def recognise(images: DataFrame, backend: OcrBackend, data: str = "data", into: str = "text", batch: int = 32) -> DataFrame:
    """images with a column of recognised text; a backend gets up to `batch` images at a time."""
    schema = StructType([*images.schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                raw = part.column(part.schema.get_field_index(data)).to_pylist()
                some = [k for k, r in enumerate(raw) if r]
                texts = [""] * len(raw)
                for k, t in zip(some, backend.recognize([raw[k] for k in some])):
                    texts[k] = t
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return images.mapInArrow(run, schema)
