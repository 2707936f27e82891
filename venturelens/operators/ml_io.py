"""Storage of this library's ``pyspark.ml`` stages.

A stage that mixes in ``StoredStage`` is written and read like any other of
``pyspark.ml``: alone, or as part of a ``Pipeline`` or ``PipelineModel``.  Its
params go to the usual metadata file; tables and inner stages go below the same
path (``_write_data``), and small facts about them into the metadata (``_extra``).
"""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import SparkSession


class StageWriter(MLWriter):
    def __init__(self, stage: StoredStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"extra": self.stage._extra()})
        self.stage._write_data(path)


class StageReader(MLReader):
    def __init__(self, kind: type[StoredStage]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> StoredStage:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind._read_data(self.sparkSession, path, metadata["extra"])
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class StoredStage(MLWritable, MLReadable):
    """Mix-in of stages that can be stored."""

    def write(self) -> StageWriter:
        return StageWriter(self)

    @classmethod
    def read(cls) -> StageReader:
        return StageReader(cls)

    def _extra(self) -> dict:
        return {}

    def _write_data(self, path: str) -> None:
        pass

    @classmethod
    def _read_data(cls, spark: SparkSession, path: str, extra: dict) -> StoredStage:
        return cls()
