import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelframe.catalog.jobs import nifti_bytes
from voxelframe.operators import augment, filters, geometry, morphology, shape
from voxelframe.operators.tiles import AXES
from voxelframe.plans import jobs, maps, planning
from voxelframe.plans.preprocess import preprocess_regions
from voxelframe.sources.volumes import decode_nifti, file_rows, ingest_violations, read_volumes, voxels_of

KEYS = ["case_id", "label_id"]


def mask_rows(spark, mask):
    sizes = tuple(int(n) for n in mask.shape)
    rows = [(1, 1, *sizes, int(z), int(y), int(x)) for z, y, x in np.argwhere(mask)]
    return spark.createDataFrame(rows, "case_id bigint, label_id int, sz int, sy int, sx int, z int, y int, x int")


def dense(frame, shape_):
    out = np.zeros(shape_, dtype=bool)
    for r in frame.select(*AXES).collect():
        out[r.z, r.y, r.x] = True
    return out


def brute_dilate(mask):
    out = np.zeros_like(mask)
    for z, y, x in np.argwhere(mask):
        out[max(0, z - 1):z + 2, max(0, y - 1):y + 2, max(0, x - 1):x + 2] = True
    return out


def brute_erode(mask):
    padded = np.pad(mask, 1)
    out = np.zeros_like(mask)
    for z, y, x in np.ndindex(mask.shape):
        out[z, y, x] = padded[z:z + 3, y:y + 3, x:x + 3].all()
    return out


def test_morphology(spark):
    mask = np.random.default_rng(2).random((20, 35, 34)) < 0.02
    mask = brute_dilate(mask)
    rows = mask_rows(spark, mask)
    for function, want in (
        (morphology.dilate, brute_dilate(mask)), (morphology.erode, brute_erode(mask)),
        (morphology.opening, brute_dilate(brute_erode(mask))), (morphology.closing, brute_erode(brute_dilate(mask))),
    ):
        got = function(rows, KEYS)
        assert got.count() == want.sum()
        assert (dense(got, mask.shape) == want).all()


def test_perturbation_keeps_every_region(spark):
    rows = mask_rows(spark, np.ones((1, 1, 1), dtype=bool))
    got = morphology.perturb(rows, KEYS, 12).groupBy("repeat").count().collect()
    assert len(got) == 13 and all(r["count"] == 1 for r in got)


def test_shape_of_one_voxel(spark):
    one = shape.shape(mask_rows(spark, np.ones((1, 1, 1), dtype=bool)), KEYS).first()
    assert one["SurfaceArea"] == pytest.approx(3**0.5)
    assert one["MeshVolume"] == pytest.approx(1 / 6)
    assert one["Maximum3DDiameter"] == pytest.approx(1)


def test_shape_of_a_ball(spark):
    grid = np.indices((21, 21, 21)) - 10
    ball = (grid**2).sum(axis=0) <= 81
    got = shape.shape(mask_rows(spark, ball), KEYS).first()
    assert got["MeshVolume"] == pytest.approx(ball.sum(), rel=0.03)
    assert got["Sphericity"] > 0.9
    assert got["Elongation"] == pytest.approx(1, abs=1e-6)


def test_mesh_is_closed_for_random_regions(spark):
    # Moving a closed surface must not change its volume.
    mask = np.random.default_rng(4).random((5, 6, 7)) < 0.5
    moved = np.zeros((9, 16, 12), dtype=bool)
    moved[3:8, 9:15, 4:11] = mask
    a, b = (shape.mesh(mask_rows(spark, m), KEYS).first() for m in (mask, moved))
    assert a["MeshVolume"] == pytest.approx(b["MeshVolume"])
    assert a["SurfaceArea"] == pytest.approx(b["SurfaceArea"])


def test_diameters_brute_force(spark):
    mask = np.random.default_rng(6).random((6, 5, 7)) < 0.2
    rows = mask_rows(spark, mask)
    points = np.array([tuple(r) for r in shape.surface_points(rows, KEYS).select(*AXES).collect()])
    gaps = points[:, None, :] - points[None, :, :]
    size = np.sqrt((gaps**2).sum(axis=2)) / 2
    got = shape.diameters(rows, KEYS).first()
    assert got["Maximum3DDiameter"] == pytest.approx(size.max())
    for axis, name in enumerate(("Slice", "Column", "Row")):
        assert got[f"Maximum2DDiameter{name}"] == pytest.approx(size[gaps[:, :, axis] == 0].max())


def test_plan_of_the_toy_dataset(spark, toy, tmp_path):
    labels = spark.createDataFrame([(20,), (21,)], "label_id int")
    plan = jobs.plan(toy, labels, "toy", "CT", str(tmp_path / "plan")).first()
    assert plan["label_coverage"] == {20: 5, 21: 4}
    assert all(size % 8 == 0 for size in plan["crop_size"])
    assert plan["bbox_percentiles"][20]["p50"] == [5, 5, 5]
    assert plan["target_spacing"] == [1.0, 1.0, 1.0]


def test_crops_of_the_toy_dataset(spark, toy, tmp_path):
    labels = spark.createDataFrame([(20,), (21,)], "label_id int")
    plan = jobs.plan(toy, labels, "toy", "MR", str(tmp_path / "plan"))
    crops = jobs.prepare(toy, plan, str(tmp_path / "crops")).collect()
    assert len(crops) == 9
    assert all(list(c["shape"]) == [5, 5, 5] and len(c["image"]) == 125 and sum(c["mask"]) == 125 for c in crops)


def test_resampling_to_the_same_grid_changes_nothing(toy):
    rows = voxels_of(toy, ("spacing",)).where("case_id = 'case001'")
    got = geometry.resample_spline(rows, (1.0, 1.0, 1.0)).join(rows.drop("spacing").withColumnRenamed("intensity", "old"), ["case_id", *AXES])
    assert got.where("abs(intensity - old) > 1e-6").count() == 0


def test_nearest_resampling_against_the_formula(spark):
    label = np.arange(1, 25).reshape(2, 3, 4)
    rows = [(1, [2, 3, 4], [1.0, 0.9, 1.3], [0.0] * 24, label.ravel().tolist())]
    volume = spark.createDataFrame(rows, "case_id bigint, shape array<int>, spacing array<double>, image array<float>, label array<smallint>")
    target = (0.4, 1.1, 0.7)
    got = {(r.z, r.y, r.x): r.label_id for r in geometry.resample_nearest(voxels_of(volume, ("shape", "spacing")).drop("intensity"), target, ["label_id"]).collect()}
    sizes = [max(1, round(n * s / t)) for n, s, t in zip((2, 3, 4), (1.0, 0.9, 1.3), target)]
    assert len(got) == np.prod(sizes)
    for spot in np.ndindex(*sizes):
        at = [k * t / s for k, t, s in zip(spot, target, (1.0, 0.9, 1.3))]
        inside = all(a < n - 0.5 for a, n in zip(at, (2, 3, 4)))
        assert got[spot] == (label[tuple(int(np.floor(a + 0.5)) for a in at)] if inside else 0)


def test_nifti_round_trip():
    values = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    decoded, spacing = decode_nifti(nifti_bytes(values, (1.0, 0.5, 0.25)))
    assert (decoded == values).all() and spacing == (1.0, 0.5, 0.25)


def oriented(values, spacing, matrix=None, quaternion=None):
    """A NIfTI file whose header holds a direction matrix or a quaternion."""
    raw = bytearray(gzip.decompress(nifti_bytes(values, spacing)))
    if matrix is not None:
        raw[254:256] = np.array([1], "<i2").tobytes()
        raw[280:328] = np.array(np.hstack([matrix, np.zeros((3, 1))]), "<f4").tobytes()
    if quaternion is not None:
        raw[252:254] = np.array([1], "<i2").tobytes()
        raw[256:268] = np.array(quaternion, "<f4").tobytes()
    return gzip.compress(bytes(raw))


@pytest.mark.parametrize("axes", [(0, 1, 2), (2, 0, 1), (1, 0, 2)])
@pytest.mark.parametrize("signs", [(1, 1, 1), (-1, 1, 1), (1, -1, -1)])
def test_files_are_turned_to_right_front_up(axes, signs):
    """Voxel axis i of the file runs along world axis axes[i] with signs[i]; a slight tilt changes nothing."""
    world = np.arange(24, dtype=np.float32).reshape(2, 3, 4)  # right, front, up
    steps = (0.5, 0.75, 2.0)
    stored = world.transpose(axes)[tuple(slice(None, None, s) for s in signs)]
    matrix = np.zeros((3, 3))
    for i, (axis, sign) in enumerate(zip(axes, signs)):
        matrix[axis, i] = sign * steps[axis]
    tilt = np.array([[1, -0.1, 0], [0.1, 1, 0], [0, 0, 1]])
    content = oriented(np.ascontiguousarray(stored.transpose(2, 1, 0)), [steps[a] for a in axes[::-1]], tilt @ matrix)
    decoded, spacing = decode_nifti(content)
    assert (decoded.transpose(2, 1, 0) == world).all() and spacing == steps[::-1]


def test_half_turn_by_quaternion():
    values = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    decoded, _ = decode_nifti(oriented(values, (1.0, 1.0, 1.0), quaternion=(0, 0, 1)))  # about the vertical axis
    assert (decoded == values[:, ::-1, ::-1]).all()


def test_unequal_grids_fail_or_are_reported(spark, tmp_path):
    (tmp_path / "images").mkdir(), (tmp_path / "labels").mkdir()
    for case, depth in (("a", 2), ("b", 1)):
        (tmp_path / "images" / f"{case}_0000.nii.gz").write_bytes(nifti_bytes(np.zeros((2, 3, 4), np.float32), (1, 1, 1)))
        (tmp_path / "labels" / f"{case}.nii.gz").write_bytes(nifti_bytes(np.zeros((depth, 3, 4), np.int16), (1, 1, 1)))
    folders = f"file:{tmp_path}/images", f"file:{tmp_path}/labels"
    with pytest.raises(Exception, match="b: unequal_grids"):
        read_volumes(spark, *folders).count()
    assert [r.case_id for r in read_volumes(spark, *folders, strict=False).collect()] == ["a"]
    found = ingest_violations(file_rows(spark, folders[0], "*_0000.nii*"), file_rows(spark, folders[1], "*.nii*"))
    assert [tuple(r) for r in found.collect()] == [("b", "unequal_grids")]


def test_all_sigmas_in_one_pass_are_those_of_single_passes(spark):
    values = np.random.default_rng(3).random((5, 6, 7))
    rows = spark.createDataFrame(
        [(1, int(z), int(y), int(x), float(v)) for (z, y, x), v in np.ndenumerate(values)], "case_id bigint, z int, y int, x int, intensity double"
    )
    together = {(r.channel, r.z, r.y, r.x): r.value for r in filters.log_filters(rows, ["case_id"], (1.0, 2.0)).collect()}
    for sigma in (1.0, 2.0):
        for r in filters.log_filter(rows, ["case_id"], sigma).collect():
            assert together[f"log_{sigma:g}", r.z, r.y, r.x] == pytest.approx(r.value, abs=1e-12)


def filtered(spark, line, taps: dict, dilation=1):
    rows = spark.createDataFrame([(1, 0, 0, i, float(v)) for i, v in enumerate(line)], "case_id bigint, z int, y int, x int, a double")
    sql = {name: filters.taps_wrapped("a", t, dilation) for name, t in taps.items()}
    got = {r.x: r for r in filters.along_axis(rows, ["case_id"], "x", ["a"], sql).collect()}
    return {name: [got[i][name] for i in range(len(line))] for name in taps}


def test_wavelet_direction_against_published_values(spark):
    """A published two-level Haar example, and the impulse response: the taps themselves, in order, from half their number on."""
    s = 0.5**0.5
    one = filtered(spark, [3, 7, 1, 3, -2, 6, 4, 6], {"low": [s, s], "high": [-s, s]})
    assert one["low"] == pytest.approx([7.07106781, 5.65685425, 2.82842712, 0.70710678, 2.82842712, 7.07106781, 7.07106781, 6.36396103])
    assert one["high"] == pytest.approx([-2.82842712, 4.24264069, -1.41421356, 3.53553391, -5.65685425, 1.41421356, -1.41421356, 2.12132034])
    assert filtered(spark, one["low"], {"low": [s, s]}, 2)["low"] == pytest.approx([7, 4.5, 4, 5.5, 7, 9.5, 10, 8.5])
    for dilation in (1, 2):
        pulse = filtered(spark, [1.0] + [0.0] * 15, {"low": filters.COIF1_LOW}, dilation)["low"]
        assert [pulse[(t - 3) * dilation % 16] for t in range(6)] == filters.COIF1_LOW


def test_wavelet_energy_and_odd_size(spark):
    line = np.random.default_rng(0).random(8)
    rows = spark.createDataFrame([(1, 0, 0, i, float(v)) for i, v in enumerate(line)], "case_id bigint, z int, y int, x int, intensity double")
    got = filters.along_axis(rows.withColumnRenamed("intensity", "a"), ["case_id"], "x", ["a"],
                             {"lo": filters.taps_wrapped("a", filters.COIF1_LOW, 1), "hi": filters.taps_wrapped("a", filters.COIF1_HIGH, 1)})
    energy = got.selectExpr("sum(lo * lo + hi * hi)").first()[0]
    assert energy == pytest.approx(2 * (line**2).sum(), rel=1e-6)
    assert filters.swt_bands(rows.where("x < 7"), ["case_id"]).count() == 7 * 8
    assert filters.swt_bands(rows, ["case_id"], levels=2).select("band").distinct().count() == 15


def test_geometry_augmentation_is_stable_and_leaves_variant_zero(spark):
    image = np.random.default_rng(0).random(60).astype(np.float32).tolist()
    rows = spark.createDataFrame(
        [(1, 1, v, [3, 4, 5], image, [1] * 60) for v in (0, 1)], "case_id bigint, label_id int, variant int, shape array<int>, image array<float>, mask array<tinyint>"
    )
    first, second = (augment.augment_geometry(rows).orderBy("variant").collect() for _ in range(2))
    assert first == second
    assert np.allclose(first[0]["image"], image) and not np.allclose(first[1]["image"], image)
    assert set(first[1]["mask"]) == {1}


def test_shape_mismatch(toy):
    other = toy.selectExpr("case_id", "if(case_id = 'case002', array(1, 2, 3), shape) as shape")
    assert [r.case_id for r in geometry.shape_mismatch(toy, other).collect()] == ["case002"]


def test_median_slice_without_foreground(spark):
    rows = spark.createDataFrame([(1, z, 0) for z in range(5)], "case_id bigint, z int, label_id int")
    assert geometry.median_slice(rows, ["case_id"]).first()["slice"] == 2


def test_default_crop_size_without_boxes(spark, toy):
    empty = geometry.label_bbox(voxels_of(toy)).where("label_id > 99")
    assert planning.crop_size(empty).first().asDict() == {"z": 64, "y": 64, "x": 64}


def test_regions_between_target_positions_keep_a_crop(spark):
    """Nearest-neighbour resampling loses label 3, one voxel at y = 1 between target positions 0 and 2 mm."""
    label = np.zeros((1, 4, 1), dtype=np.int16)
    label[0, :, 0] = [2, 3, 2, 2]
    rows = [(1, [1, 4, 1], [1.0, 1.0, 1.0], [5.0, 7.0, 1.0, 3.0], label.ravel().tolist())]
    volume = spark.createDataFrame(rows, "case_id bigint, shape array<int>, spacing array<double>, image array<float>, label array<smallint>")
    target = (1.0, 2.0, 1.0)
    kept = geometry.resample_nearest(voxels_of(volume, ("shape", "spacing")).drop("intensity"), target, ["label_id"])
    assert {r.label_id for r in kept.collect()} == {2}
    got = preprocess_regions(volume, target, "MR").collect()
    assert [(r.z, r.y, r.x, r.inside) for r in got if r.label_id == 3] == [(0, 0, 0, 1)]
    assert sum(r.inside for r in got if r.label_id == 2) == 2


def test_lines_of_one_kind_share_one_solution(monkeypatch):
    solve, calls = np.linalg.solve, []
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: calls.append(1) or solve(a, b))
    generator = np.random.default_rng(3)
    sizes = [1, 2, 5, 9] * 50
    lines = [generator.normal(size=n) for n in sizes]
    got = geometry._spline_lines(pa.array(lines, pa.list_(pa.float64())), np.tile([0.5, 1.0], 100), 0.7).to_pylist()
    assert len(calls) <= 8
    for values, spacing, samples in zip(lines, [0.5, 1.0] * 100, got):
        n = len(values)
        system = np.eye(n) * 4 + np.eye(n, k=1) + np.eye(n, k=-1)
        if n > 1:
            system[0, 1] = system[-1, -2] = 2
        c = solve(system / 6, values) if n > 1 else values
        mirrored = np.concatenate([c, c[-2:0:-1]]) if n > 2 else c
        assert len(samples) == max(1, round(n * spacing / 0.7))
        for k, sample in enumerate(samples):
            at = k * 0.7 / spacing
            taps = [(i, abs(at - i)) for i in range(int(at) - 1, int(at) + 3)]
            weight = [2 / 3 - d * d + d**3 / 2 if d < 1 else max(0, 2 - d) ** 3 / 6 for _, d in taps]
            want = sum(w * mirrored[i % len(mirrored)] for (i, _), w in zip(taps, weight)) if at < n - 0.5 else 0
            assert abs(sample - want) < 1e-9


def test_constant_grids_cause_no_second_shuffle(spark):
    """Rows times 27 stay in their tile's partition, also where the grid size is a constant."""
    rows = spark.range(64).selectExpr("id div 64 as case_id", "int(id div 64) + 1 as label_id", "4 as sz", "4 as sy", "4 as sx", "int(id div 16) as z", "int(id div 4 % 4) as y", "int(id % 4) as x")
    for change, count in ((morphology.erode, 8), (morphology.dilate, 64)):
        got = change(rows, KEYS)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") > 0 and "ENSURE_REQUIREMENTS" not in plan
        assert got.count() == count


@pytest.mark.parametrize("options", [{}, {"levels": 2, "sigmas": (1.5,), "spacing": (1.0, 0.5, 2.0), "mask_mode": "post_pool"}])
def test_packed_bank_equals_lines(spark, monkeypatch, options):
    """Cases of several shapes, one beyond the tile, one without a region, one flat: as the lines, which small cases do not take."""
    shapes = [(4, 4, 4), (4, 4, 4), (3, 5, 2), (1, 1, 1), (2, 3, 33), (4, 4, 4), (3, 3, 3)]
    rows = [(c, z, y, x, 0.5 if c == 6 else float(np.sin(17 * c + 5 * z + 3 * y + 7 * x * x)), int(c != 5 and (z + y * x + c) % 3 != 0))
            for c, shape in enumerate(shapes) for z, y, x in np.ndindex(shape)]
    voxels = spark.createDataFrame(rows, "case_id long, z int, y int, x int, intensity double, inside int")
    lines, seen = maps._spread_features, []
    monkeypatch.setattr(maps, "_spread_features", lambda some, *a, **k: seen.append({r.case_id for r in some.select("case_id").distinct().collect()}) or lines(some, *a, **k))
    got = {(r.case_id, r.channel, r.stat): r.value for r in maps.bank_features(voxels, ["case_id"], **options).collect()}
    want = {(r.case_id, r.channel, r.stat): r.value for r in lines(voxels, ["case_id"], **options).collect()}
    assert seen == [{4}] and got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-6), key


@pytest.mark.parametrize("shape", [(4, 4, 4), (1, 3, 30)])
def test_noise_is_smoothed_by_one_matrix_per_axis(shape):
    """As padding and adding up shifted copies, which took 49 steps an axis."""
    want = np.random.default_rng(5).standard_normal(shape)
    kernel = np.exp(-np.arange(-24, 25) ** 2 / 72.0)
    for axis, n in enumerate(shape):
        padded = np.pad(want, [(24, 24) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        want = sum(w * np.take(padded, range(i, i + n), axis=axis) for i, w in enumerate(kernel / kernel.sum()))
    assert np.allclose(augment._smooth_noise(np.random.default_rng(5), shape, 6.0), want, atol=1e-12)
    assert augment._smoothing(shape[0], 6.0) is augment._smoothing(shape[0], 6.0)
