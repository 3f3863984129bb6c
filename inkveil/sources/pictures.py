"""Picture files: read by Spark's image source, saved as PNG by a data source whose job leaves all files or none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from inkveil.sources.office import CommittedWriter
from inkveil.sources.raster import png

PICTURE = "path string, height int, width int, nChannels int, data binary"
ROWS = f"{PICTURE}, output_path string"


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """path, height, width, nChannels, data (rows of pixels from the top, blue first) of the pictures; one that cannot be decoded has a height of -1."""
    found = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(list(paths))
    # the image source writes local addresses with three slashes, other file sources with one
    return found.selectExpr("regexp_replace(image.origin, '^file:/+', 'file:/') as path", "image.height as height", "image.width as width", "image.nChannels as nChannels", "image.data as data")


class PictureWriter(CommittedWriter):
    def made(self, row: Row) -> bytes:
        if row.height <= 0 or row.width <= 0:
            raise ValueError("no picture that can be decoded")
        return png(np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels))


class PictureDataSource(DataSource):
    """df.write.format("pictures"): rows of ROWS become PNG files."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(PictureDataSource)
