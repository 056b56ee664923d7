"""Bytes of stored files for the model slots, opened by path inside the task that needs them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd

MISSING = "media_missing"
NO_ASSET = "no_media"
BATCH_BYTES = 64 << 20


def open_shared(path: str) -> BinaryIO:
    """A file of a local folder or of any store that Arrow knows by its URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_stream(place)


@dataclass(frozen=True)
class Payloads:
    """Where the files of assets lie, and how a task reads them.

    ``opener`` turns a path into a stream; give another one for stores that Arrow does not know. At most about
    ``batch_bytes`` of files are held at a time, and a larger file alone.
    """

    root: str
    path_col: str = "source_relative_path"
    batch_bytes: int = BATCH_BYTES
    opener: Callable[[str], BinaryIO] = open_shared

    def read(self, path: str | None) -> tuple[bytes | None, str | None]:
        """(bytes, error) of one file; the error is the row's own."""
        if not isinstance(path, str) or not path:
            return None, NO_ASSET
        try:
            with self.opener(f"{self.root.rstrip('/')}/{path}") as stream:
                return stream.read(), None
        except FileNotFoundError:
            return None, MISSING
        except Exception as error:  # noqa: BLE001
            return None, str(error) or type(error).__name__

    def pieces(self, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """A batch cut into pieces with ``payload`` and ``payload_error``; a piece is given on before the next is read."""
        start, held, found = 0, 0, []
        for number, path in enumerate(batch[self.path_col].tolist()):
            payload, error = self.read(path)
            if found and held + len(payload or b"") > self.batch_bytes:
                yield self._piece(batch, start, found)
                start, held, found = number, 0, []
            held += len(payload or b"")
            found.append((payload, error))
        if found:
            yield self._piece(batch, start, found)

    def _piece(self, batch: pd.DataFrame, start: int, found: list[tuple]) -> pd.DataFrame:
        piece = batch.iloc[start : start + len(found)]
        return piece.assign(
            payload=pd.Series([p for p, _ in found], index=piece.index, dtype=object),
            payload_error=pd.Series([e for _, e in found], index=piece.index, dtype=object),
        )
