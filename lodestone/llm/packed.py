"""Arrays as compressed bytes, to send through shuffles."""

from __future__ import annotations

import numpy as np


def packed(values: np.ndarray) -> bytes:
    """Integers as bytes: planes of equal bytes together, compressed."""
    import pyarrow as pa

    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def pa_bytes(array) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([array], ["x"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack_parts(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def parts_of(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out
