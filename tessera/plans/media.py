"""Images and waveforms made from table columns, measured against what their making says they must be."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import image as I
from tessera.functions import mesh as G

from .base import dealt, query

SIZE = "(p_size % 5 + 9)"


def _plain(t, height: int = 10):
    """A plain image for each part, with a red that grows with the part's size."""
    s = F.col("p_size").cast("int")
    return dealt(t.part.select("p_partkey", "p_size")).select("p_partkey", s.alias("s"), I.create_image_rgb(s % 5 + 9, F.lit(height), s, F.lit(40), F.lit(200)).alias("img"))


def _ramp(t):
    """A grey image of 16 by 16 whose columns are brighter from left to right, and the frame it came from."""
    grey = F.expr("transform(sequence(0, 255), i -> CAST((i % 16) * 10 + p_size AS DOUBLE) / 255)")
    return dealt(t.part.select("p_partkey", "p_size")).select("p_partkey", F.col("p_size").cast("int").alias("s"), I.tensor_to_image_chw_gray(grey, 16, 16).alias("img"))


def _list(c, digits: int = 3):
    return F.transform(c, lambda x: F.round(x.cast("double"), digits) + 0.0)


@query(f"""SELECT p_partkey, {SIZE}::INT AS w, 10 AS h, 4 AS c, ({SIZE} * 10)::INT AS n, [10, {SIZE}, 4]::INT[] AS d, round(0.299 * p_size + 0.587 * 40 + 0.114 * 200, 3) AS bm, 0.0 AS bs, round((p_size + 240) / 3.0, 3) AS pm, [p_size::DOUBLE, 255.0] AS pc, [0.0] AS ps, 0.0 AS blur, 0.0 AS art, 0.0 AS hash, ({SIZE} * 10)::DOUBLE AS hist FROM part""")
def image_measures(t):
    d = _plain(t)
    m = F.col("img")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return d.select(
        "p_partkey", I.image_width(m).alias("w"), I.image_height(m).alias("h"), I.image_channels(m).alias("c"), I.pixel_count(m).alias("n"), I.dimensions(m, "HWC").alias("d"), F.round(I.image_brightness_mean(m), 3).alias("bm"), F.round(I.image_brightness_std(m), 3).alias("bs"), F.round(I.image_pixel_mean(m), 3).alias("pm"),
        _list(I.image_pixel_mean(m, [0, 3])).alias("pc"), _list(I.image_pixel_std(m, [1])).alias("ps"), F.round(I.detect_blur(m), 3).alias("blur"), F.round(I.compression_artifact_score(m), 3).alias("art"), total(I.perceptual_hash(m)).alias("hash"), total(I.image_brightness_histogram(m)).alias("hist"),
    )


@query(f"""SELECT p_partkey, round((p_size + 240) / 3.0 + 5, 3) AS br, round((p_size + 240) / 3.0 - 0.0 - 1, 3) AS dk, round(0.299 * p_size + 46.28, 0) AS gr, [({SIZE} * 2)::INT, 10] AS cc, [3, 4]::INT[] AS cr, [10, {SIZE}]::INT[] AS tr, [20, 30]::INT[] AS rs, [8, 8]::INT[] AS st, [5, 6]::INT[] AS rc, p_size::DOUBLE AS blur,
    [10, {SIZE}]::INT[] AS ro, [p_size::DOUBLE, 40.0, 200.0] AS co, round(({SIZE} * 40)::DOUBLE, 0) AS by, [round(p_size * p_size / 255.0), round(p_size * 40 / 255.0)] AS mu, 40.0 AS cut FROM part WHERE p_size > 1""")
def image_changes(t):
    d = _plain(t).where("s > 1")
    m = F.col("img")
    wh = lambda x: I.dimensions(x, "WH")
    at = lambda x, c: I.image_pixel_mean(x, c)
    return d.select(
        "p_partkey", F.round(I.image_pixel_mean(I.brighten(m, 5)), 3).alias("br"), F.round(I.image_pixel_mean(I.darken(m, 1)), 3).alias("dk"), F.round(I.image_pixel_mean(I.grayscale(m)), 0).alias("gr"), wh(I.image_concat(m, m)).alias("cc"), wh(I.image_crop(m, 1, 2, 3, 4)).alias("cr"), wh(I.image_transpose(m)).alias("tr"), wh(I.resize(m, 20, 30)).alias("rs"),
        wh(I.image_resize_to_stride(I.resize(m, 9, 9), 8, 4)).alias("st"), wh(I.image_resize_and_crop(m, 5, 6)).alias("rc"), F.round(F.get(at(I.blur(m, 2.0), [0]), F.lit(0)).cast("double"), 3).alias("blur"), wh(I.rotate(m, 90)).alias("ro"), _list(at(I.image_composite_over(m, [9.0, 9.0, 9.0]), [0, 1, 2])).alias("co"), F.octet_length(I.image_to_bytes(m)).cast("double").alias("by"),
        _list(at(I.image_multiply(m, m), [0, 1]), 0).alias("mu"), F.round(F.get(at(I.image_cutout(m, I.create_image_rgb(F.lit(3), F.lit(3), F.lit(40), F.lit(0), F.lit(0))), [3]), F.lit(0)).cast("double"), 3).alias("cut"),
    )


@query("""SELECT p_partkey, true AS png, true AS bmp, true AS ppm, 'GIF89a' AS gif, [p_size::DOUBLE, p_size::DOUBLE + 150] AS ends, 64.0 AS unhashed, round((p_size + 75) / 255.0, 4) AS gray, 768 AS chw, 768 AS hwc, 768 AS bgr, 300 AS box, 300 AS yolo, round(p_size / 255.0, 4) AS back, 0.0 AS edge, 4 AS map FROM part""")
def image_files_and_tensors(t):
    d = _ramp(t)
    m = F.col("img")
    same = lambda f: (I.image_to_bytes(I.image_decode(I.image_encode(m, f))) == I.image_to_bytes(m))
    first = lambda a, i=0: F.get(a, F.lit(i)).cast("double")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    col = lambda k: F.get(I.image_pixel_mean(I.image_crop(m, k, 0, 1, 16), [0]), F.lit(0)).cast("double")
    return d.select(
        "p_partkey", same("png").alias("png"), same("bmp").alias("bmp"), same("ppm").alias("ppm"), F.substring(I.frames_to_gif(F.array(m, m), 10), 1, 6).cast("string").alias("gif"), F.array(col(0), col(15)).alias("ends"), (64 - F.aggregate(I.perceptual_hash(m), F.lit(0.0), lambda x, y: x + y)).alias("unhashed"), F.round(mean(I.image_to_tensor_chw_gray(m, 16)), 4).alias("gray"),
        F.size(I.image_to_tensor_chw(m, 16, [0.0] * 3, [1.0] * 3)).alias("chw"), F.size(I.image_to_tensor_hwc(m, 16)).alias("hwc"), F.size(I.image_to_tensor_chw_bgr(m, 16)).alias("bgr"), F.size(I.image_letterbox_tensor_hwc(m, 10)).alias("box"), F.size(I.yolox_preprocess(m, 10)).alias("yolo"), F.round(first(I.image_letterbox_tensor_chw(m, 16)), 4).alias("back"),
        F.round(first(I.image_pixel_mean(I.image_crop(I.sobel(m), 0, 0, 16, 1), [0])), 3).alias("edge"), I.image_channels(I.apply_colormap(m, "jet")).alias("map"),
    )


@query("""SELECT p_partkey, 16000 AS rate, 0.1 AS dur, 1600 AS n, 800 AS half, 8 AS env, 32 AS ww, 240000 AS mel, true AS mono FROM part WHERE p_size = 7""")
def waveforms(t):
    """A second in ten of a tone for every part of size 7, through a WAV file and back."""
    rows = dealt(t.part.where("p_size = 7").select("p_partkey"))
    wav = I._mapped("binary", lambda k: I.write_wav(16000, I.np.sin(I.np.arange(1600) * (0.01 + k % 7 / 100)) * 0.5), "p_partkey")
    d = rows.select("p_partkey", wav.alias("x")).select("p_partkey", I.audio_decode("x").alias("x"))
    mono = I.audio_samples(16000, "x")
    return d.select("p_partkey", I.audio_sample_rate("x").alias("rate"), F.round(I.audio_duration("x"), 4).alias("dur"), F.size(mono).alias("n"), F.size(I.audio_samples(8000, "x")).alias("half"), F.size(I.audio_waveform_envelope("x", 4)).alias("env"), I.image_width(I.audio_waveform("x", 32, 8)).alias("ww"), F.size(I.audio_to_log_mel(mono, 80)).alias("mel"), (I.audio_to_mono("x") == F.col("x")).alias("mono"))


@query("""SELECT p_partkey, 4 AS w, 3 AS h, true AS org, 12 AS n, 12 AS tri, [-1.5, -1.0, p_size::DOUBLE] AS lo, 12 AS ply, 12 AS obj, 84 + 12 * 50 AS stl, 1.0 AS nz, 6 AS sure, 10 AS mid, 12 AS vox, p_size::DOUBLE AS swapped, 0 AS none FROM part""")
def meshes(t):
    """A level plane seen from above: three rows of four points."""
    depth = F.expr("transform(sequence(1, 12), i -> CAST(p_size AS DOUBLE))")
    tilt = F.expr("transform(sequence(1, 12), i -> CAST(i AS DOUBLE))")
    k = [1.0, 0.0, 1.5, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0]
    g, slope = G.point_cloud_from_depth_orthographic_intrinsics(depth, 4, 3, k), G.point_cloud_from_depth_orthographic_intrinsics(tilt, 4, 3, k)
    d = dealt(t.part.select("p_partkey", "p_size")).select("p_partkey", "p_size", g.alias("g"), slope.alias("s"))
    d = d.withColumn("m", G.mesh_from_organized(F.col("g")))
    g, m = F.col("g"), F.col("m")
    first = lambda p: F.get(p, F.lit(0))
    low = G.mesh_bbox_min(m)
    return d.select(
        "p_partkey", G.point_cloud_width(g).alias("w"), G.point_cloud_height(g).alias("h"), G.point_cloud_is_organized(g).alias("org"), G.mesh_vertex_count(m).alias("n"), G.mesh_triangle_count(m).alias("tri"), F.array(low["x"], low["y"], low["z"]).alias("lo"), F.size(G.pointcloud_from_ply(G.point_cloud_to_ply(g["points"]))).alias("ply"),
        F.regexp_count(G.mesh_to_obj(m).cast("string"), F.lit("v ")).alias("obj"), F.octet_length(G.mesh_to_stl(m)).alias("stl"), F.abs(first(G.mesh_compute_normals(m)["normals"])["z"]).alias("nz"),
        F.size(G.point_cloud_from_depth_pinhole_with_confidence(F.transform(g["points"], lambda p: p["z"]), F.transform(F.col("s.points"), lambda p: p["z"]), 4, 3, 60.0, 7.0)).alias("sure"), F.size(G.pc_filter_depth_percentile(F.col("s.points"), 0.05, 0.95)).alias("mid"), F.size(G.pc_voxel_consensus(g["points"], 0.5, 1)).alias("vox"),
        first(G.mesh_swap_axes(m, [3, 1, 2])["vertices"])["x"].alias("swapped"), F.size(G.pc_empty()).alias("none"),
    )
