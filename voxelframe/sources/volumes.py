"""Volume rows to voxel rows, crop rows, and the bulk ingest of gzipped NIfTI files."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators.tiles import TILE_SIZE

VOLUME_SCHEMA = "case_id string, shape array<int>, spacing array<double>, image array<float>, label array<smallint>"
# NIfTI-1 voxel type codes and their numpy types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def voxels_of(volumes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode volume rows (dense arrays in z, y, x order) to case_id, z, y, x, intensity, label_id (+ ``keep``)."""
    rows = volumes.select("case_id", "shape", *[c for c in keep if c != "shape"], F.expr("posexplode(arrays_zip(image, label)) as (pos, cell)"))
    return rows.selectExpr(
        "case_id", *keep,
        "int(pos div (shape[1] * shape[2])) as z", "int((pos div shape[2]) % shape[1]) as y", "int(pos % shape[2]) as x",
        "cast(cell.image as double) as intensity", "cast(cell.label as int) as label_id",
    )


def crop_rows(cropped: DataFrame) -> DataFrame:
    """Crop voxels (case_id, label_id, z, y, x, intensity, inside) packed to one row per region, z, y, x order."""
    packed = cropped.groupBy("case_id", "label_id").agg(
        F.expr("array_sort(collect_list(struct(z, y, x, intensity, inside))) as cells"),
        F.expr("array(max(z) + 1, max(y) + 1, max(x) + 1) as shape"),
    )
    return packed.selectExpr(
        "case_id", "label_id", "shape", "transform(cells, c -> cast(c.intensity as float)) as image",
        "transform(cells, c -> cast(c.inside as tinyint)) as mask",
    )


def direction(raw: bytes, order: str) -> np.ndarray:
    """What one step along voxel axis x, y, z (columns) adds to the right, anterior, superior position (rows).

    The matrix of the header comes first, then its quaternion; a header with neither has its axes in that order.
    """
    q_code, s_code = np.frombuffer(raw, f"{order}i2", 2, 252)
    if s_code > 0:
        return np.frombuffer(raw, f"{order}f4", 12, 280).reshape(3, 4)[:, :3].astype(float)
    if q_code <= 0:
        return np.eye(3)
    v = np.frombuffer(raw, f"{order}f4", 3, 256).astype(float)
    w = np.sqrt(max(0.0, 1.0 - v @ v))
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    turn = (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * cross
    return turn * [1, 1, -1 if np.frombuffer(raw, f"{order}f4", 1, 76)[0] < 0 else 1]


def axis_code(matrix: np.ndarray) -> tuple[list[int], list[bool]]:
    """For right, anterior, superior: the voxel axis closest to it, and whether that axis runs the other way."""
    length = np.linalg.norm(matrix, axis=0)
    share = np.abs(matrix) / np.where(length > 0, length, 1.0)
    axes, flips = [0, 0, 0], [False, False, False]
    for _ in range(3):
        world, axis = (int(i) for i in np.unravel_index(share.argmax(), share.shape))
        axes[world], flips[world] = axis, bool(matrix[world, axis] < 0)
        share[world, :], share[:, axis] = -1.0, -1.0
    return axes, flips


def decode_nifti(content: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Array and spacing of one .nii or .nii.gz file, both in z, y, x order.

    Axes are permuted and flipped so that x runs to the right, y to the front and z upwards.
    """
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if int.from_bytes(raw[0:4], "little") == 348 else ">"
    dims = np.frombuffer(raw, f"{order}i2", 8, 40)
    kind = NIFTI_TYPES[int(np.frombuffer(raw, f"{order}i2", 1, 70)[0])]
    steps = np.frombuffer(raw, f"{order}f4", 8, 76)
    start, slope, shift = (float(v) for v in np.frombuffer(raw, f"{order}f4", 3, 108))
    nx, ny, nz = (int(d) for d in dims[1:4])
    values = np.frombuffer(raw, order + kind, nx * ny * nz, int(start)).reshape(nz, ny, nx)
    if slope not in (0.0, 1.0) or (shift != 0.0 and slope != 0.0):
        values = values * (slope or 1.0) + shift
    axes, flips = axis_code(direction(raw, order))
    turned = values.transpose(2, 1, 0).transpose(axes)[tuple(slice(None, None, -1 if f else 1) for f in flips)]
    return turned.transpose(2, 1, 0), tuple(float(steps[1 + a]) for a in reversed(axes))


@dataclass
class Header:
    """What a file's first bytes tell: types and sizes as stored, and how its axes turn to z, y, x."""

    kind: str
    dims: tuple[int, int, int]  # x, y, z as stored
    start: int
    slope: float
    shift: float
    axes: list[int]
    flips: list[bool]
    steps: tuple[float, ...]

    @property
    def shape(self) -> list[int]:
        return [self.dims[a] for a in reversed(self.axes)]

    @property
    def spacing(self) -> list[float]:
        return [self.steps[a] for a in reversed(self.axes)]


class _Bytes:
    """The bytes of a .nii or .nii.gz file in order; a gzipped one is unpacked as far as it is read."""

    def __init__(self, content: bytes):
        self.content, self.at = memoryview(content), 0
        self.unpack = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
        self.rest = b""

    def read(self, size: int) -> bytes:
        if self.unpack is None:
            self.at += size
            out = bytes(self.content[self.at - size : self.at])
        else:
            parts, missing = [], size
            while missing and (self.rest or self.at < len(self.content)) and not self.unpack.eof:
                if not self.rest:
                    self.rest = bytes(self.content[self.at : self.at + (1 << 18)])
                    self.at += len(self.rest)
                parts.append(self.unpack.decompress(self.rest, missing))
                self.rest = self.unpack.unconsumed_tail
                missing -= len(parts[-1])
            out = b"".join(parts)
        if len(out) < size:
            raise ValueError("the file ends early")
        return out


def read_header(raw: bytes) -> Header:
    order = "<" if int.from_bytes(raw[0:4], "little") == 348 else ">"
    if int.from_bytes(raw[0:4], "little" if order == "<" else "big") != 348:
        raise ValueError("no volume header")
    dims = np.frombuffer(raw, f"{order}i2", 8, 40)
    code = int(np.frombuffer(raw, f"{order}i2", 1, 70)[0])
    if code not in NIFTI_TYPES or min(dims[1:4]) < 1:
        raise ValueError("unknown voxel type or size")
    start, slope, shift = (float(v) for v in np.frombuffer(raw, f"{order}f4", 3, 108))
    axes, flips = axis_code(direction(raw, order))
    steps = tuple(float(v) for v in np.frombuffer(raw, f"{order}f4", 3, 80))
    return Header(order + NIFTI_TYPES[code], tuple(int(d) for d in dims[1:4]), int(start), slope, shift, axes, flips, steps)


HEADER_BYTES = 352


def blocks_in(content: bytes, block: tuple[int, int, int] = TILE_SIZE) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """((z, y, x) of its first voxel, voxels) of every block of a file, turned as ``decode_nifti`` turns it.

    The file is unpacked slab by slab along its slowest axis; what is held is the packed file and one slab.
    """
    source = _Bytes(content)
    head = read_header(raw := source.read(HEADER_BYTES))
    if head.start > len(raw):
        source.read(head.start - len(raw))
    nx, ny, nz = head.dims
    world = head.axes.index(2)
    slow = 2 - world  # the slowest stored axis among z, y, x
    thick = block[slow]
    first = nz - (nz - 1) // thick * thick if head.flips[world] else min(thick, nz)  # from the far end, the odd slab comes first
    done = 0
    while done < nz:
        size = min(first if not done else thick, nz - done)
        values = np.frombuffer(source.read(size * nx * ny * np.dtype(head.kind).itemsize), head.kind).reshape(size, ny, nx)
        if head.slope not in (0.0, 1.0) or (head.shift != 0.0 and head.slope != 0.0):
            values = values * (head.slope or 1.0) + head.shift
        turned = values.transpose(2, 1, 0).transpose(head.axes)[tuple(slice(None, None, -1 if f else 1) for f in head.flips)]
        slab = turned.transpose(2, 1, 0)
        corner = [0, 0, 0]
        corner[slow] = nz - done - size if head.flips[world] else done
        for z, y, x in product(*(range(0, n, b) for n, b in zip(slab.shape, block))):
            part = slab[z : z + block[0], y : y + block[1], x : x + block[2]]
            yield (corner[0] + z, corner[1] + y, corner[2] + x), part
        done += size


def _blocks_or_none(content: bytes) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """No block of a file without a header, which ``_paired`` reports; a file that ends early is an error."""
    try:
        read_header(_Bytes(content).read(HEADER_BYTES))
    except (ValueError, zlib.error):
        return
    yield from blocks_in(content)


def _case(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".nii")[0].removesuffix("_0000")


def headers_of(files: DataFrame) -> DataFrame:
    """case_id, shape, spacing, error of files (path, content), from the first bytes of each: nothing else reaches Python."""
    schema = "case_id string, shape array<int>, spacing array<double>, error string"

    def heads(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    head = read_header(_Bytes(content).read(HEADER_BYTES))
                    rows.append((_case(path), head.shape, head.spacing, None))
                except (ValueError, zlib.error) as error:
                    rows.append((_case(path), None, None, str(error)))
            yield pd.DataFrame(rows, columns=["case_id", "shape", "spacing", "error"])

    return files.selectExpr("path", "substring(content, 1, 4096) as content").mapInPandas(heads, schema)


def block_rows(files: DataFrame) -> DataFrame:
    """case_id, z0, y0, x0, sizes, cells of the blocks of files (path, content); a block has at most a tile's voxels."""
    schema = pa.schema([
        ("case_id", pa.string()), ("z0", pa.int32()), ("y0", pa.int32()), ("x0", pa.int32()), ("sizes", pa.list_(pa.int32())), ("cells", pa.list_(pa.float64())),
    ])

    def cut(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for corner, cells in _blocks_or_none(content.as_py()):
                    flat = pa.array(cells.astype(float).ravel())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_case(path)]), *(pa.array([c], pa.int32()) for c in corner), pa.array([list(cells.shape)], pa.list_(pa.int32())),
                         pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], schema=schema,
                    )

    return files.select("path", "content").mapInArrow(cut, "case_id string, z0 int, y0 int, x0 int, sizes array<int>, cells array<double>")


def _paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Header of every case's pair with its ``violation``, NULL for a good one; spacing comes from the label header."""
    image = headers_of(images).selectExpr("case_id", "true as image", "shape", "error")
    label = headers_of(labels).selectExpr("case_id", "true as label", "shape as label_shape", "spacing", "error as label_error")
    return image.join(label, "case_id", "full_outer").selectExpr("*", """case when image is null then 'no_image'
        when label is null then 'no_label' when error is not null then 'unreadable_image' when label_error is not null then 'unreadable_label'
        when shape <> label_shape then 'unequal_grids' end as violation""")


def ingest_violations(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases that cannot be ingested, by their headers alone: case_id, violation (no_image, no_label, unreadable_image,
    unreadable_label, unequal_grids)."""
    return _paired(images, labels).where("violation is not null").select("case_id", "violation")


def blocks_of(images: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Block rows of image and label files (path, content): case_id, shape, spacing, z0, y0, x0, sizes, image, label.

    No row holds more than a block, whatever the size of the volume. A violation fails the job; without ``strict`` its case is
    left out, to be looked up in ``ingest_violations``. A file that ends before its header says fails the job in any case.
    """
    good = "if(violation is null, true, raise_error(concat(case_id, ': ', violation)))" if strict else "violation is null"
    pairs = _paired(images, labels).where(good).select("case_id", "shape", "spacing")
    at = ["case_id", "z0", "y0", "x0"]
    image = block_rows(images).selectExpr(*at, "sizes", "transform(cells, v -> cast(v as float)) as image")
    label = block_rows(labels).selectExpr(*at, "transform(cells, v -> cast(v as smallint)) as label")
    return image.join(label, at).join(pairs, "case_id").select("case_id", "shape", "spacing", *at[1:], "sizes", "image", "label")


def voxels_of_blocks(blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Block rows to case_id, z, y, x, intensity, label_id (+ ``keep``), as ``voxels_of`` gives them for volume rows."""
    rows = blocks.select("case_id", "z0", "y0", "x0", "sizes", *keep, F.expr("posexplode(arrays_zip(image, label)) as (pos, cell)"))
    return rows.selectExpr(
        "case_id", *keep, "z0 + int(pos div (sizes[1] * sizes[2])) as z", "y0 + int((pos div sizes[2]) % sizes[1]) as y", "x0 + int(pos % sizes[2]) as x",
        "cast(cell.image as double) as intensity", "cast(cell.label as int) as label_id",
    )


def read_blocks(spark: SparkSession, images: str, labels: str, strict: bool = True) -> DataFrame:
    """``blocks_of`` the files of two folders, paired as in ``read_volumes``."""
    return blocks_of(file_rows(spark, images, "*_0000.nii*"), file_rows(spark, labels, "*.nii*"), strict)


def volumes_of(images: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Volume rows of image and label files (path, content), put together from their blocks: for volumes that fit into a row.

    Violations are treated as in ``blocks_of``.
    """
    at = "((z0 + i div (sizes[1] * sizes[2])) * shape[1] + y0 + (i div sizes[2]) % sizes[1]) * shape[2] + x0 + i % sizes[2]"
    cells = f"transform(sequence(0, size(image) - 1), i -> named_struct('at', {at}, 'image', image[i], 'label', label[i]))"
    parts = blocks_of(images, labels, strict).groupBy("case_id", "shape", "spacing").agg(F.expr(f"array_sort(flatten(collect_list({cells}))) as cells"))
    return parts.selectExpr("case_id", "shape", "spacing", "transform(cells, c -> c.image) as image", "transform(cells, c -> c.label) as label")


def file_rows(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def read_volumes(spark: SparkSession, images: str, labels: str, strict: bool = True) -> DataFrame:
    """Pair ``<case>_0000.nii.gz`` images with ``<case>.nii.gz`` labels by name; see ``volumes_of``."""
    return volumes_of(file_rows(spark, images, "*_0000.nii*"), file_rows(spark, labels, "*.nii*"), strict)
