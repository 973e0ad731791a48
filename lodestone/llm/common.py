"""What the operators of this subpackage share: reading, cutting lineage by tables in the shared folder, words and hashes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from lodestone.sources.shared import materialized as cut  # noqa: F401  (the operators take it from here)
from lodestone.sources.shared import read_table

#: Texts longer than this are worked on in slices cut at white space, so that one huge text needs no huge word list.
SLICE_BYTES = 1 << 20
WHITE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, fixed=True)


#: What tells documents apart and orders them: doc_id (nulls last), then a hash of the text. Rows alike in both are one document.
KEY = ("__null", "__id", "__hash")


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the columns KEY. Numbers and strings keep their type; ids of other types are compared as strings."""
    kind = docs.schema[id_column].dataType
    own = F.col(id_column) if isinstance(kind, (NumericType, StringType)) else F.col(id_column).cast("string")
    none = F.lit(0).cast(kind) if isinstance(kind, NumericType) else F.lit("")
    return docs.withColumns(dict(zip(KEY, (F.col(id_column).isNull(), F.coalesce(own, none), F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))))))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def binary_list(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def binary_lists(column, size: int = 256):
    """binary_list of a few values at a time, so that a batch of long texts is not held twice."""
    return (binary_list(column.slice(at, size)) for at in range(0, len(column), size))


def values(column, size: int = 256):
    """The Python values of an Arrow column, a few at a time, so that a batch of long texts is not held twice."""
    for at in range(0, len(column), size):
        yield from column.slice(at, size).to_pylist()


def slices(text: bytes):
    """text in slices of about SLICE_BYTES cut at ASCII white space; most texts are one slice."""
    if len(text) <= SLICE_BYTES:
        yield text
        return
    at = 0
    while at < len(text):
        end = at + SLICE_BYTES
        while end < len(text) and text[end] not in WHITE:
            end += 1
        yield text[at:end]
        at = end


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
