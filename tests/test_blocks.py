"""Volumes cut into blocks while they are unpacked, against whole decoded arrays; checks by headers alone."""

import gzip
import tracemalloc
from itertools import permutations, product

import numpy as np
import pytest

from voxelframe.catalog.jobs import nifti_bytes
from voxelframe.sources.volumes import (
    _Bytes, block_rows, blocks_in, decode_nifti, file_rows, headers_of, ingest_violations, read_blocks, read_header, read_volumes, voxels_of, voxels_of_blocks,
)


def turned(values, spacing, axes, signs, packed=True):
    """A file of a (z, y, x) array whose stored axis i runs along world axis axes[i] with signs[i]."""
    raw = bytearray(gzip.decompress(nifti_bytes(values, spacing)))
    matrix = np.zeros((3, 4))
    for i, (axis, sign) in enumerate(zip(axes, signs)):
        matrix[axis, i] = sign
    raw[254:256] = np.array([1], "<i2").tobytes()
    raw[280:328] = matrix.astype("<f4").tobytes()
    return gzip.compress(bytes(raw), 1) if packed else bytes(raw)


def together(content, shape, block):
    out, seen = np.full(shape, np.nan), np.zeros(shape, int)
    for (z, y, x), cells in blocks_in(content, block):
        assert all(c % b == 0 for c, b in zip((z, y, x), block)) and all(n <= b for n, b in zip(cells.shape, block))
        spot = tuple(slice(c, c + n) for c, n in zip((z, y, x), cells.shape))
        out[spot], seen[spot] = cells, seen[spot] + 1
    assert (seen == 1).all()
    return out


@pytest.mark.parametrize("axes", list(permutations(range(3))))
@pytest.mark.parametrize("block", [(2, 3, 4), (4, 2, 3), (16, 32, 32)])
def test_blocks_make_up_the_volume(axes, block):
    values = np.arange(7 * 8 * 5, dtype=np.float32).reshape(7, 8, 5)
    for signs, packed in product(product((1, -1), repeat=3), (True, False)):
        content = turned(values, (1.0, 0.5, 0.25), axes, signs, packed)
        whole, spacing = decode_nifti(content)
        head = read_header(_Bytes(content).read(352))
        assert tuple(head.shape) == whole.shape and tuple(head.spacing) == spacing
        assert (together(content, whole.shape, block) == whole).all()


def test_scaled_values():
    raw = bytearray(gzip.decompress(nifti_bytes(np.arange(24, dtype=np.int16).reshape(2, 3, 4), (1, 1, 1))))
    raw[112:120] = np.array([0.5, -3], "<f4").tobytes()
    content = gzip.compress(bytes(raw))
    assert (together(content, (2, 3, 4), (2, 2, 2)) == decode_nifti(content)[0]).all()


def test_a_large_volume_is_never_held():
    """512 x 512 x 512 voxels of two bytes are 256 MB; a slab of 16 slices is 8 MB."""
    raw = bytearray(gzip.decompress(nifti_bytes(np.zeros((1, 1, 1), np.int16), (1, 1, 1)))[:352])
    raw[40:56] = np.array([3, 512, 512, 512, 1, 1, 1, 1], "<i2").tobytes()
    packed = gzip.compress(bytes(raw) + bytes(2 * 512**3), 1)
    tracemalloc.start()
    voxels = sum(cells.size for _, cells in blocks_in(packed))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert voxels == 512**3 and peak < 60 << 20


def test_files_that_end_early():
    content = nifti_bytes(np.zeros((4, 4, 4), np.float32), (1, 1, 1))
    short = gzip.compress(gzip.decompress(content)[:-1])
    for bad in (short, content[:-20], gzip.decompress(content)[:-1], b"", b"\x1f\x8b", b"no header" * 100):
        with pytest.raises((ValueError, Exception)):
            list(blocks_in(bad))


@pytest.fixture()
def folders(tmp_path):
    """Cases: a good, b with unequal grids, c without label, d without image, e and f without a header."""
    (tmp_path / "images").mkdir(), (tmp_path / "labels").mkdir()
    rng = np.random.default_rng(0)
    for case in "abcef":
        (tmp_path / "images" / f"{case}_0000.nii.gz").write_bytes(nifti_bytes(rng.normal(size=(20, 35, 40)).astype(np.float32), (1, 0.5, 0.25)) if case != "e" else b"junk")
    for case in "abdef":
        label = rng.integers(0, 3, (20 - (case == "b"), 35, 40)).astype(np.int16)
        (tmp_path / "labels" / f"{case}.nii.gz").write_bytes(nifti_bytes(label, (1, 0.5, 0.25)) if case != "f" else b"\x1f\x8bjunk")
    return f"file:{tmp_path}/images", f"file:{tmp_path}/labels"


def test_violations_by_headers(spark, folders):
    images, labels = file_rows(spark, folders[0], "*_0000.nii*"), file_rows(spark, folders[1], "*.nii*")
    assert {tuple(r) for r in ingest_violations(images, labels).collect()} == {
        ("b", "unequal_grids"), ("c", "no_label"), ("d", "no_image"), ("e", "unreadable_image"), ("f", "unreadable_label"),
    }
    heads = {r.case_id: r for r in headers_of(images).collect()}
    assert heads["a"].shape == [20, 35, 40] and heads["a"].spacing == [1.0, 0.5, 0.25] and heads["e"].error
    plan = ingest_violations(images, labels)._jdf.queryExecution().executedPlan().toString()
    assert "substring(content" in plan  # the voxels do not reach Python


def test_blocks_of_files(spark, folders):
    with pytest.raises(Exception, match="unequal_grids|no_|unreadable"):
        read_blocks(spark, *folders).count()
    blocks = read_blocks(spark, *folders, strict=False)
    rows = blocks.selectExpr("case_id", "z0", "y0", "x0", "size(image) as n", "size(label) as m").collect()
    assert {(r.z0, r.y0, r.x0) for r in rows} == set(product((0, 16), (0, 32), (0, 32))) and all(r.n == r.m <= 16 * 32 * 32 for r in rows)
    volumes = read_volumes(spark, *folders, strict=False)
    a = sorted(map(tuple, voxels_of_blocks(blocks, ("spacing",)).selectExpr("case_id", "z", "y", "x", "intensity", "label_id", "spacing[1]").collect()))
    b = sorted(map(tuple, voxels_of(volumes, ("spacing",)).selectExpr("case_id", "z", "y", "x", "intensity", "label_id", "spacing[1]").collect()))
    assert a == b and len(a) == 20 * 35 * 40
    assert block_rows(file_rows(spark, folders[0], "e_*")).count() == 0
