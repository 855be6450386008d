"""Block files: a text header, then records of fixed width, compressed with gzip or plain.

The header's lines give the bytes of each field: a namespace if there is one, then id and property together, then x, y
and z. Numbers are little-endian; coordinates are stored as sign and magnitude. A compressed file cannot be split, so a
task streams a file; a table of many blocks is kept as many files in a folder, one for each partition written.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import inferred_widths

# The names of header lines, in order.
HEADER = {"ns": "namespace bytes", "code": "id/prop bytes", "x": "x coord bytes", "y": "y coord bytes", "z": "z coord bytes"}
# End of fixed values.
_LABELS = {label: field for field, label in HEADER.items()}
_STEP = 1 << 20
_GZIP = b"\x1f\x8b"
COLUMNS = "file string, pos long, ns int, id int, prop int, x int, y int, z int"
_ROWS = pa.schema([("file", pa.string()), ("pos", pa.int64())] + [(c, pa.int32()) for c in ("ns", "id", "prop", "x", "y", "z")])
_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _chunks(file):
    """A file's content in steps, inflated if it is gzip (of one or several members)."""
    head = file.read(_STEP)
    if not head.startswith(_GZIP):
        while head:
            yield head
            head = file.read(_STEP)
        return
    press = zlib.decompressobj(31)
    while head:
        while head:
            got = press.decompress(head, 4 * _STEP)
            if got:
                yield got
            if press.eof:
                head, press = press.unused_data, zlib.decompressobj(31)
            else:
                head = press.unconsumed_tail
        head = file.read(_STEP)


def _layout(chunks) -> tuple[dict[str, int], bytes]:
    """Byte widths by field (ns only if the file has it), and what was read beyond the header."""
    held, widths = b"", {}
    for chunk in chunks:
        held += chunk
        while "z" not in widths and b"\n" in held:
            line, held = held.split(b"\n", 1)
            label, _, number = line.decode("ascii", "replace").partition(":")
            if label.strip() not in _LABELS or not number.strip().isdigit():
                raise ValueError(f"not a block file's header: {line[:80]!r}")
            widths[_LABELS[label.strip()]] = int(number)
        if "z" in widths:
            break
    if [f for f in HEADER if f in widths] != list(widths) or not {"code", "x", "y", "z"} <= set(widths):
        raise ValueError(f"a block file's header lacks lines: it has {list(widths)}")
    return widths, held


def world_layout(path: str) -> dict[str, int]:
    """Byte widths by field of one file: code (id and property each), x, y, z and, where the file has namespaces, ns."""
    system, own = _system(path)
    with system.open_input_stream(own, compression=None) as file:
        return _layout(_chunks(file))[0]


def _number(raw: np.ndarray, at: int, width: int) -> np.ndarray:
    out = np.zeros(len(raw), np.int64)
    for k in range(width):
        out |= raw[:, at + k].astype(np.int64) << (8 * k)
    return out


def _coordinate(raw: np.ndarray, at: int, width: int) -> np.ndarray:
    value, top = _number(raw, at, width), 1 << (8 * width - 1)
    return np.where(value & top, -(value & (top - 1)), value)


def _decoded(raw: np.ndarray, widths: dict[str, int]) -> list[pa.Array]:
    at, out = 0, []
    for field, width in ({"ns": 0} | widths).items():
        if field == "ns" and not width:
            out.append(pa.nulls(len(raw), pa.int32()))
            continue
        for _ in range(2 if field == "code" else 1):
            value = _coordinate(raw, at, width) if field in "xyz" else _number(raw, at, width)
            out.append(pa.array(value.astype(np.int32)))
            at += width
    return out


def read_world(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, ns, id, prop, x, y, z): the records of the files at a path (a file, a folder or a glob).

    pos is a record's place in its file: of records with one place in the world the last counts (see last_wins). ns is
    null in files without namespaces. A file of a header alone has no rows; one without a header, or that ends inside a
    record, is an error.
    """

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, own = _system(name)
                with system.open_input_stream(own, compression=None) as file:
                    chunks = _chunks(file)
                    widths, held = _layout(chunks)
                    size, pos = sum(widths.values()) + widths["code"], 0
                    for chunk in chain([b""], chunks):
                        held += chunk
                        if n := len(held) // size:
                            raw = np.frombuffer(held, np.uint8, n * size).reshape(n, size)
                            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(pos, pos + n)), *_decoded(raw, widths)], schema=_ROWS)
                            held, pos = held[n * size :], pos + n
                    if held:
                        raise ValueError(f"{name} ends inside a record")

    files = spark.read.format("binaryFile").load(path).select("path")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(read, COLUMNS)


def encoded_records(columns: dict[str, np.ndarray], widths: dict[str, int]) -> bytes:
    """Records of columns (ns, id, prop, x, y, z) as bytes; a number that its width cannot hold is an error."""
    parts = []
    for field, width in widths.items():
        for name in ("id", "prop") if field == "code" else (field,):
            value = columns[name].astype(np.int64)
            limit = 1 << (8 * width - (field in "xyz"))
            if len(value) and (np.abs(value).max() >= limit or field not in "xyz" and value.min() < 0):
                raise ValueError(f"{name} does not fit into {width} bytes")
            raw = np.where(value < 0, -value | (1 << (8 * width - 1)), value) if field in "xyz" else value
            parts.append(raw.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width])
    return np.concatenate(parts, axis=1).tobytes() if parts else b""


def write_world(rows: DataFrame, folder: str, widths: dict[str, int] | None = None) -> DataFrame:
    """Writes rows (id, prop, x, y, z and, if there, ns) to a folder, a compressed file per partition that has any.

    Returns the files: path, records, bytes. Widths are inferred by one aggregate unless given. Each file has its own
    header. Writing is retried safely: a file gets its name when it is whole. The files' table is evaluated here. A null in
    any column is an error.
    """
    from ..functions.storage import stored

    spaces = "ns" in rows.columns
    if widths is None:
        widths = inferred_widths(rows)
        if spaces:
            most = rows.agg(F.max("ns")).first()[0] or 0
            widths = {"ns": max(1, (most.bit_length() + 7) // 8)} | widths
    names = ["ns"] * spaces + ["id", "prop", "x", "y", "z"]
    header = "".join(f"{label}: {widths[field]}\n" for field, label in HEADER.items() if field in widths).encode()

    def write(batches):
        part, n, file, path = TaskContext.get().partitionId(), 0, None, None
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                path = f"{folder.rstrip('/')}/part-{part:06d}.world"
                system, own = _system(path)
                system.create_dir(posixpath.dirname(own), recursive=True)
                draft = f"{own}.{uuid.uuid4().hex}.draft"
                file = system.open_output_stream(draft, compression=None)
                file.write(press.compress(header))
            if missing := [c for k, c in enumerate(names) if batch.column(k).null_count]:
                raise ValueError(f"rows without {', '.join(missing)}: their names or properties are in no dictionary")
            columns = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
            file.write(press.compress(encoded_records(columns, widths)))
            n += batch.num_rows
        if file is not None:
            file.write(press.flush())
            size = file.tell()
            file.close()
            system.move(draft, own)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])], schema=_FILES)

    return stored(rows.select(*names).mapInArrow(write, "path string, records long, bytes long"), "world-files")
