"""Image files as a sink of a table, and back.

`write_images` sends rows (image_path, content) through a Python data source: each task writes its own rows' files below a
folder that all executors share. A path holds the content's hash, so files never change: one that is there with the same
size is left alone, and a task that is run again, or twice at once, writes the same bytes. A file appears at its place
only when it is whole, by a rename. `read_images` gives them back by Spark's binary reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    files: int
    skipped: int


class ImageWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        written = skipped = 0
        for row in iterator:
            content = bytes(row["content"])
            place = f"{base}/{row['image_path']}"
            found = store.get_file_info(place)
            if found.type == fs.FileType.File and found.size == len(content):
                skipped += 1
                continue
            store.create_dir(place.rpartition("/")[0], recursive=True)
            part = f"{place}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(content)
            store.move(part, place)
            written += 1
        return Written(written, skipped)

    def commit(self, messages: list[Written | None]) -> None:
        pass  # files are whole and named by what they hold

    def abort(self, messages: list[Written | None]) -> None:
        pass  # what is there is right; the next run leaves it alone


class ImageFiles(DataSource):
    """Sink `image_files` with the option `path`."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "image_path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"])


def write_images(images: DataFrame, folder: str) -> None:
    """Write images(image_path, content); of rows with one path, which have the same content, one is written.

    Rows without a path or without bytes are left out.
    """
    images.sparkSession.dataSource.register(ImageFiles)
    once = images.filter("image_path is not null and length(content) > 0").groupBy("image_path").agg(F.first("content").alias("content"))
    once.write.format("image_files").mode("append").option("path", folder).save()


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """image_path, content, length of all whole files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,png,gif,webp}").load(folder)
    return found.select(F.substring_index("path", "/", -2).alias("image_path"), "content", "length")
