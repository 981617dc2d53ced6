"""Messages sent from the executors: a Python data source that is written to, whose committed outcomes are a table.

A task claims each message by a small file in the outbox's folder before it sends it, and
leaves the outcome beside it. A task that is tried again, or a job that is run again with
the same folder, passes over what is claimed and tells the outcome that was left; a
message that was claimed and has none counts as failed, as it may have gone. Tasks must not
run twice at the same time (spark.speculation off, the default). Only the names of the
tasks' outcome files go to the driver.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from plinth.session import shared_dir, workers_find_package


def _folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(store, path: str, text: str) -> None:
    with store.open_output_stream(path, compression=None) as out:
        out.write(text.encode())


def _get(store, path: str) -> str | None:
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path, compression=None) as source:
        return source.read().decode()


@dataclass
class _Told(WriterCommitMessage):
    file: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.sink = options["folder"], options["sink"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _folder(self.folder)
        store.create_dir(root)
        sink, told = cloudpickle.loads(base64.b64decode(self.sink)), []
        for row in iterator:
            name = f"{root}/{hashlib.sha256(row.message_id.encode()).hexdigest()}"
            if _get(store, f"{name}.claim") is None:
                _put(store, f"{name}.claim", row.message_id)
                try:
                    ok = bool(sink.send(row.channel, row.target, row.body))
                except Exception:  # noqa: BLE001  a sink may fail in any way; delivery goes on
                    ok = False
                _put(store, f"{name}.done", json.dumps(ok))
            told.append(json.dumps({"message_id": row.message_id, "ok": json.loads(_get(store, f"{name}.done") or "false")}))
        file = f"told-{uuid.uuid4().hex}.json"
        _put(store, f"{root}/{file}", "\n".join(told))
        return _Told(file)

    def commit(self, messages: list) -> None:
        store, root = _folder(self.folder)
        store.create_dir(root)
        _put(store, f"{root}/committed", json.dumps([m.file for m in messages if m]))


class Outbox(DataSource):
    """Rows of message_id, channel, target, body, each sent once by the pickled sink."""

    @classmethod
    def name(cls) -> str:
        return "plinth_outbox"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def sent(messages: DataFrame, sink: Any, folder: str | None = None) -> DataFrame:
    """message_id, ok of each row of ``messages`` (message_id, channel, target, body): whether ``sink.send`` took it.

    ``sink`` is pickled for the executors. Rows with the same message_id are sent once.
    ``folder`` (a new one in shared storage by default) remembers what was sent.
    """
    spark = messages.sparkSession
    workers_find_package(spark)
    folder = folder or shared_dir(spark, "outbox")
    spark.dataSource.register(Outbox)
    rows = messages.select(F.col("message_id").cast("string").alias("message_id"), "channel", "target", "body").where("message_id IS NOT NULL")
    packed = base64.b64encode(cloudpickle.dumps(sink)).decode()
    rows.write.format("plinth_outbox").mode("append").options(folder=folder, sink=packed).save()
    store, root = _folder(folder)
    files = json.loads(_get(store, f"{root}/committed") or "[]")  # a name for each task
    kind = "message_id string, ok boolean"
    return spark.read.schema(kind).json([f"{folder}/{f}" for f in files]) if files else spark.createDataFrame([], kind)
