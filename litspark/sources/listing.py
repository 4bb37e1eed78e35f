"""File inventories listed by tasks.

Folders are dealt to tasks, which list them; the folders found there are dealt in the next round, until
there are none. The driver holds no file names and lists nothing. Works on stores that Arrow reads (local,
HDFS, S3, GCS); :func:`litspark.sources.readers.read_file_inventory` takes any path that Spark reads.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.session import materialize
from litspark.sources.readers import file_parts

_KIND = "path string, file_name string, length bigint, modificationTime timestamp, folder boolean"
_HIDDEN = ("_", ".")
READ_ROWS, READ_BYTES = 1000, 4 << 20


def list_files(spark: SparkSession, folders: list[str], recursive: bool = False, per_task: int = 100) -> DataFrame:
    """Files of folders, as ``read_file_inventory`` gives them: names that begin with ``_`` or ``.`` are left out.

    ``per_task`` folders go to one task.
    """

    def listed(batches):
        from pyarrow import fs

        schema = pa.schema(
            [("path", pa.string()), ("file_name", pa.string()), ("length", pa.int64()),
             ("modificationTime", pa.timestamp("us", "UTC")), ("folder", pa.bool_())]
        )
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, base = fs.FileSystem.from_uri(folder)
                scheme = folder[: folder.index(":") + 1] + "//" if ":" in folder.split("/")[0] else "file://"
                found = [
                    (f"{scheme}{f.path}", f.base_name, f.size or 0, f.mtime, f.type == fs.FileType.Directory)
                    for f in files.get_file_info(fs.FileSelector(base))
                    if not f.base_name.startswith(_HIDDEN)
                ]
                for at in range(0, len(found), 10_000):
                    columns = list(zip(*found[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema)], schema=schema)

    level = spark.createDataFrame(pa.table({"path": pa.array(folders, pa.string())}))
    files = []
    while True:
        n = level.count()
        if not n:
            break
        dealt = level.repartition(max(1, -(-n // per_task)))
        met = materialize(dealt.mapInArrow(listed, _KIND))
        files.append(met.where("NOT folder"))
        if not recursive:
            break
        level = met.where("folder").select("path")
    if not files:
        return file_parts(spark.createDataFrame([], _KIND).drop("folder"))
    whole = files[0]
    for more in files[1:]:
        whole = whole.unionAll(more)
    return file_parts(whole.drop("folder"))


def read_texts(files: DataFrame, per_task: int = 2000) -> DataFrame:
    """``file_name, value`` of the files that :func:`list_files` found, read by tasks of ``per_task`` files.

    A task holds some 4 MB of texts at a time, or one text that is larger. Bytes that are not UTF-8 become
    replacement signs.
    """

    def read(batches):
        from pyarrow import fs

        schema = pa.schema([("file_name", pa.string()), ("value", pa.string())])
        stores: dict[str, fs.FileSystem] = {}
        for batch in batches:
            names, values, held = [], [], 0
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Whatever stands in a name, the part after the scheme is the path in its store.
                scheme, _, rest = path.partition("://")
                if scheme not in stores:
                    stores[scheme] = fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(path)[0]
                with stores[scheme].open_input_stream(rest, compression=None) as f:
                    content = f.read()
                names.append(name)
                values.append(content.decode("utf-8", "replace"))
                held += len(content)
                if len(names) >= READ_ROWS or held >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], schema=schema)
                    names, values, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], schema=schema)

    paths = files.select("path", "file_name")
    dealt = paths.repartition(max(1, -(-paths.count() // per_task)))
    return dealt.mapInArrow(read, "file_name string, value string")
