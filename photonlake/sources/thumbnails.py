"""The sink of thumbnails: one JPEG file for each photo, replaced as a whole."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.functions.columns import canonical_id


def path_for(folder: str, photo_id: str) -> Path:
    """Where the thumbnail of a photo lies; its id names the file, so it has to be canonical (:func:`write` checks that)."""
    return Path(folder) / photo_id[:2] / f"{photo_id}.jpg"


def replace(path: Path, data: bytes) -> None:
    """Write a file beside its place, bring it to disk and rename it, so that it is there whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=f".tmp-{path.stem}-", dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        Path(name).replace(path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write(rows: DataFrame, folder: str) -> DataFrame:
    """(photo_id, path, thumbnail_width, thumbnail_height, thumbnail_bytes): the files written from rows with ``thumbnail``.

    The folder has to be one that all executors share.  A task that is repeated writes the same files again.
    Rows without a thumbnail write nothing; an id that isn't canonical is an error.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for key, data in zip(batch.column("photo_id").to_pylist(), batch.column("thumbnail").to_pylist(), strict=True):
                path = path_for(folder, key)
                replace(path, data)
                paths.append(str(path))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("photo_id"), pa.array(paths, pa.string()), batch.column("thumbnail_width"), batch.column("thumbnail_height"), pa.array(sizes, pa.int32())], names=["photo_id", "path", "thumbnail_width", "thumbnail_height", "thumbnail_bytes"])

    checked = F.when(canonical_id(F.col("photo_id")), F.col("photo_id")).otherwise(F.raise_error(F.lit("the photo id is not canonical")).cast("string"))
    made = rows.where("thumbnail is not null").select(checked.alias("photo_id"), "thumbnail", "thumbnail_width", "thumbnail_height")
    return made.mapInArrow(store, "photo_id string, path string, thumbnail_width int, thumbnail_height int, thumbnail_bytes int")
