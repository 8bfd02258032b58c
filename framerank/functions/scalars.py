"""Scalar functions as Column expressions: names, times, boxes, angles, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Names and paths ------------------------------------------------------------------------------


def part(path: Column | str, back: int = 1) -> Column:
    """The back-th part of a path from its end, backslashes counting as slashes; null if there is none."""
    parts = F.split(F.translate(_c(path), "\\", "/"), "/")
    return F.when(F.size(parts) >= back, F.element_at(parts, -back))


def basename(path: Column | str) -> Column:
    return part(path)


def frame_index(path: Column | str) -> Column:
    """The last number of a file name; null without one."""
    return F.regexp_extract(basename(path), r"(\d+)\D*$", 1).try_cast("bigint")


def concatenated_index(path: Column | str, missing: int | None = None) -> Column:
    """All digits of a file name as one number; `missing` without any."""
    return F.coalesce(F.regexp_replace(basename(path), r"\D", "").try_cast("bigint"), F.lit(missing).cast("bigint"))


def video_id(path: Column | str) -> Column:
    """From /id:start:end/ in an address, else from video_id in the file name; null without either."""
    path = _c(path)
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/(\d+):\d+:\d+/", 1), F.lit("")), F.nullif(F.regexp_extract(basename(path), r"video_(\d+)", 1), F.lit("")))


def video_id_of_keyframe(name: Column | str) -> Column:
    """What stands between video_ and the next underscore of a file name."""
    return F.nullif(F.regexp_extract(basename(name), r"video_([^_]*)", 1), F.lit(""))


def game_of_file(name: Column | str) -> Column:
    """The game in index_game_shot_H1_...; 'unknown' if the name has another form."""
    name = _c(name)
    rest = F.regexp_extract(name, r"^[^_]*_([^_]*_.*)$", 1)
    game = F.regexp_replace(rest, r"(^|_)\d+_H.*$", "")
    return F.when((rest != "") & (game != ""), game).otherwise("unknown")


def safe_label(label: Column | str) -> Column:
    return F.translate(_c(label), " /", "__")


def keyframe_name(video: Column, rank: Column, priority: Column, confidence: Column, score: Column) -> Column:
    """File name of a chosen frame."""
    return F.format_string("video_%s_rank%02d_%s_conf%.2f_score%.3f.jpg", video, rank, F.coalesce(priority, F.lit("NA")), confidence, score)


def segment_folder(number: Column | str, priority: Column | str) -> Column:
    return F.format_string("segment_%03d_%s", _c(number), _c(priority))


# Times and numbers ----------------------------------------------------------------------------


def clock(seconds: Column | str) -> Column:
    """MM:SS; null and 0 give 00:00."""
    s = F.coalesce(_c(seconds).cast("bigint"), F.lit(0))
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def half_of(game_time: Column | str) -> Column:
    """1 or 2 from '1 - 01:02'; null otherwise."""
    half = F.trim(F.get(F.split(_c(game_time), " - "), F.lit(0))).try_cast("int")
    return F.when(half.isin(1, 2), half)


def millis_to_seconds(position: Column | str) -> Column:
    """Seconds from whole milliseconds as text; null if it isn't a whole number."""
    return F.when(F.trim(_c(position)).rlike(r"^[+-]?\d+$"), F.trim(_c(position)).try_cast("bigint") / F.lit(1000.0))


def score_pair(score: Column | str) -> Column:
    """(home, visiting) of '3-0' or '3–0', as trimmed text."""
    sides = F.split(_c(score), "[-–]")
    return F.struct(F.trim(F.get(sides, F.lit(0))).alias("home"), F.trim(F.get(sides, F.lit(1))).alias("visiting"))


def colour(code: Column | str) -> Column:
    """(r, g, b) of '#rgb' or '#rrggbb'."""
    code = F.regexp_replace(_c(code), "^#", "")
    full = F.when(F.length(code) == 3, F.regexp_replace(code, "(.)", "$1$1")).otherwise(code)
    return F.struct(*(F.conv(F.substring(full, 1 + 2 * k, 2), 16, 10).cast("int").alias(c) for k, c in enumerate("rgb")))


def stride(video_fps: Column | str, target_fps: Column | str | float) -> Column:
    """Every how many frames one is kept: the rounded ratio (half to even), at least 1."""
    target = F.lit(target_fps) if isinstance(target_fps, (int, float)) else _c(target_fps)
    return F.greatest(F.lit(1), F.bround(_c(video_fps) / target).cast("int"))


def sample_times(start: Column | str, end: Column | str, factor: Column | str) -> Column:
    """Times to sample within a shot: 1, 2 or 3 times the factor, evenly, in shots under 3, 10 and 30 s;
    else steps of 5 s over the factor (0.5 s at least), 10 times the factor at most."""
    start, end = _c(start), _c(end)
    length = F.greatest(F.lit(0.0), end - start)
    factor = F.greatest(F.lit(0.1), _c(factor).cast("double"))
    base = F.when(length < 3, 1.0).when(length < 10, 2.0).otherwise(3.0)
    count = F.greatest(F.lit(1), F.bround(base * factor).cast("int"))
    spread = F.transform(F.sequence(F.lit(1), count), lambda i: start + i * (length / (count + 1)))
    step = F.greatest(F.lit(0.5), 5.0 / factor)
    most = F.greatest(F.lit(1), F.bround(10 * factor).cast("int"))
    # The remainder is exact, the quotient of doubles is not.
    paced = F.transform(F.sequence(F.lit(0), F.least(most - 1, F.round((length - length % step) / step).cast("int"))), lambda i: start + i * step)
    return F.when(length <= 0, F.array().cast("array<double>")).when(length < 30, spread).otherwise(paced)


def clip01(x: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(x)))


# Vectors --------------------------------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product over the product of lengths, which gets 1e-8 so that zero vectors give 0."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-8)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body's lambdas use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column | str) -> Column:
    """Probabilities of an array of logits."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y)
    shares = lambda p: let(total(p), lambda t: F.transform(p, lambda x: x / t))
    powers = lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    return let(_c(logits), lambda z: let(powers(z), shares))


def argmax(values: Column | str) -> Column:
    """Index from 0 of the first largest value."""
    return (F.array_position(_c(values), F.array_max(_c(values))) - 1).cast("int")


def aesthetic(embedding: Column | str, weights: Column | str, bias: float = 0.0) -> Column:
    """Linear head on an embedding, from the scale 1..10 to 0..1."""
    return clip01((dot(embedding, weights) + bias - 1.0) / 9.0)


# Boxes: structs or array elements with x1, y1, x2, y2 --------------------------------------------


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def clamped(b: Column, right: Column, bottom: Column, whole: bool = False) -> Column:
    """A box within the picture; `whole` cuts its edges to integers first."""
    cut = (lambda x: x.cast("int").cast("double")) if whole else (lambda x: x.cast("double"))
    return F.struct(
        F.greatest(F.lit(0.0), cut(b["x1"])).alias("x1"), F.greatest(F.lit(0.0), cut(b["y1"])).alias("y1"),
        F.least(right.cast("double"), cut(b["x2"])).alias("x2"), F.least(bottom.cast("double"), cut(b["y2"])).alias("y2"),
    )


def iou(a: Column, b: Column) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    size = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return inter / (size(a) + size(b) - inter + 1e-6)


def corners(xywh: Column | str) -> Column:
    """Box of [x, y, width, height]."""
    v = _c(xywh)
    return F.struct(v[0].alias("x1"), v[1].alias("y1"), (v[0] + v[2]).alias("x2"), (v[1] + v[3]).alias("y2"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def closeup_ratio(boxes: Column | str, width: Column | str, height: Column | str) -> Column:
    """Largest box over the picture; 0 without boxes."""
    return F.coalesce(F.array_max(F.transform(_c(boxes), lambda p: area(p["bbox"]))) / (_c(width) * _c(height)), F.lit(0.0))


def _first_best(items: Column, score) -> Column:
    """The first element with the largest score above 0; null if none."""
    scored = F.transform(items, lambda p, i: F.struct(score(p).alias("s"), (-i).alias("order"), p.alias("item")))
    best = F.array_max(F.transform(scored, lambda s: F.struct(s["s"].alias("s"), s["order"].alias("order"))))
    return F.when(best["s"] > 0, F.get(items, -best["order"]))


def dominant_person(people: Column | str, width: Column | str, height: Column | str) -> Column:
    """Of persons (bbox, conf, ...) of at least 4 % of the picture, the one largest by area, centre and confidence."""
    w, h = _c(width).cast("double"), _c(height).cast("double")

    def score(p: Column) -> Column:
        b, share = p["bbox"], area(p["bbox"]) / (w * h)
        off = F.hypot(F.abs((b["x1"] + b["x2"]) / 2 - w / 2) / (w / 2), F.abs((b["y1"] + b["y2"]) / 2 - h / 2) / (h / 2))
        value = 0.40 * F.least(share / 0.25, F.lit(1.0)) + 0.30 * F.greatest(F.lit(0.0), 1.0 - off) + 0.30 * p["conf"]
        return F.when(share >= 0.04, value).otherwise(0.0)

    return _first_best(_c(people), score)


def dominant_faces(faces: Column | str, width: Column | str, height: Column | str, min_coverage: float = 0.01, secondary: float = 0.35) -> Column:
    """Faces that count, best first: those of at least `min_coverage` whose area is at least `secondary` of the
    best's (by area and centre); the largest of all if every face is too small."""
    faces, w, h = _c(faces), _c(width).cast("double"), _c(height).cast("double")

    def described(f: Column, i: Column) -> Column:
        b = clamped(f["bbox"], w - 1, h - 1)
        px = area(b)
        off = F.hypot(F.abs((b["x1"] + b["x2"]) / 2 - w / 2) / F.greatest(w / 2, F.lit(1.0)), F.abs((b["y1"] + b["y2"]) / 2 - h / 2) / F.greatest(h / 2, F.lit(1.0)))
        value = 0.60 * F.least(px / (w * h) / 0.25, F.lit(1.0)) + 0.40 * F.greatest(F.lit(0.0), 1.0 - off)
        return F.struct((-value).alias("order"), i.alias("i"), px.alias("px"))

    all_faces = F.transform(faces, described)
    large = F.array_sort(F.filter(all_faces, lambda f: f["px"] / (w * h) >= min_coverage))
    kept = F.filter(large, lambda f: f["px"] >= F.get(large, F.lit(0))["px"] * secondary)
    raw = F.array_max(F.transform(faces, lambda f, i: F.struct(area(f["bbox"]).alias("px"), (-i).alias("order"))))
    return F.when(F.size(large) > 0, F.transform(kept, lambda f: F.get(faces, f["i"]))).when(F.size(faces) > 0, F.array(F.get(faces, -raw["order"]))).otherwise(F.slice(faces, 1, 0))


def face_visibility(face: Column, width: Column, height: Column) -> Column:
    """How unobstructed a face is, from its five landmarks (eyes, nose, mouth corners): how many lie in the
    box, eye distance, vertical order, spread. 0.5 without landmarks."""
    k = face["kps"]
    b = clamped(face["bbox"], width, height)
    fw, fh = F.greatest(b["x2"] - b["x1"], F.lit(1.0)), F.greatest(b["y2"] - b["y1"], F.lit(1.0))
    inside = F.size(F.filter(k, lambda p: p["x"].between(b["x1"], b["x2"]) & p["y"].between(b["y1"], b["y2"]))) / 5.0
    at = lambda i: F.get(k, F.lit(i))
    eyes = F.hypot(at(1)["x"] - at(0)["x"], at(1)["y"] - at(0)["y"]) / fw
    eye = F.when(eyes < 0.15, eyes / 0.15).when(eyes <= 0.60, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (eyes - 0.60) / 0.40))
    top, nose, mouth = (at(0)["y"] + at(1)["y"]) / 2, at(2)["y"], (at(3)["y"] + at(4)["y"]) / 2
    order = F.when((top < nose) & (nose < mouth), 1.0).when((nose > top) | (nose < mouth), 0.5).otherwise(0.0)

    def deviation(values: Column) -> Column:
        mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(values))

    spread = (deviation(F.transform(k, lambda p: (p["x"] - b["x1"]) / fw)) + deviation(F.transform(k, lambda p: (p["y"] - b["y1"]) / fh))) / 2
    value = clip01(0.35 * inside + 0.30 * eye + 0.20 * order + 0.15 * clip01(spread / 0.25))
    return F.when(k.isNull() | (F.size(k) < 5), F.lit(0.5)).otherwise(value)


def face_quality(face: Column, width: Column, height: Column) -> Column:
    """Struct (coverage, quality, det_score, visibility, area) of a face (bbox, det_score, sharpness as Laplacian
    variance of its crop, kps)."""
    w, h = width.cast("double"), height.cast("double")
    b = clamped(face["bbox"], w - 1, h - 1, whole=True)
    px = area(b)
    share = px / (w * h)
    size = F.when(share.between(0.15, 0.50), 1.0).when(share < 0.15, F.least(share / 0.15, F.lit(1.0))).otherwise(F.greatest(1.0 - (share - 0.50) / 0.30, F.lit(0.5)))
    off = F.hypot((b["x1"] + b["x2"]) / 2 - w / 2, (b["y1"] + b["y2"]) / 2 - h / 2) / F.hypot(w / 2, h / 2)
    det = F.coalesce(face["det_score"], F.lit(0.5))
    seen = face_visibility(face, w, h)
    quality = 0.20 * size + 0.15 * (1.0 - 0.5 * off) + 0.25 * det + 0.25 * F.least(F.coalesce(face["sharpness"], F.lit(0.0)) / 400.0, F.lit(1.0)) + 0.15 * seen
    return F.struct(share.alias("coverage"), quality.alias("quality"), det.alias("det_score"), seen.alias("visibility"), px.alias("area"))


def face_summary(metrics: Column | str) -> Column:
    """Over the face_quality structs of a frame: number, summed coverage (1 at most), area-weighted quality and
    visibility, least detection score."""
    m = _c(metrics)
    total = lambda f: F.aggregate(m, F.lit(0.0), lambda s, x: s + f(x))
    weight = F.coalesce(F.nullif(total(lambda x: x["area"]), F.lit(0.0)), F.lit(1.0))
    return F.struct(
        F.size(m).alias("num_faces"), F.least(total(lambda x: x["coverage"]), F.lit(1.0)).alias("face_area"), (total(lambda x: x["quality"] * x["area"]) / weight).alias("face_quality"),
        F.coalesce(F.array_min(F.transform(m, lambda x: x["det_score"])), F.lit(0.0)).alias("face_det_score"), (total(lambda x: x["visibility"] * x["area"]) / weight).alias("face_visibility"),
    )


def strongest_emotion(faces: Column | str, width: Column | str, height: Column | str, most: int = 5) -> Column:
    """Struct (intensity, label) over the `most` largest faces (bbox, emotion label, scores by name): the largest
    score but Neutral's, times the face's share of a quarter of the picture; (0, none) if nothing is above 0."""
    faces, w, h = _c(faces), _c(width).cast("double"), _c(height).cast("double")
    ordered = F.array_sort(F.transform(faces, lambda f, i: F.struct((-area(f["bbox"])).alias("order"), i.alias("i"))))
    largest = F.transform(F.slice(ordered, 1, most), lambda o: F.get(faces, o["i"]))

    def intensity(f: Column) -> Column:
        b = clamped(f["bbox"], w - 1, h - 1, whole=True)
        top = F.array_max(F.map_values(F.map_filter(f["scores"], lambda k, v: k != "Neutral")))
        share = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) / (w * h)
        return F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), top * F.least(share / 0.25, F.lit(1.0))).otherwise(0.0)

    best = _first_best(largest, intensity)
    return F.struct(F.coalesce(F.when(best.isNotNull(), clip01(intensity(best))), F.lit(0.0)).alias("intensity"), F.coalesce(best["emotion"], F.lit("none")).alias("label"))


# Poses: arrays of 17 structs (x, y, conf) ---------------------------------------------------------


def arm_angle(shoulder: Column, wrist: Column, hip: Column) -> Column:
    """Degrees between arm and torso; 0 if either has no length."""
    tx, ty, ax, ay = hip["x"] - shoulder["x"], hip["y"] - shoulder["y"], wrist["x"] - shoulder["x"], wrist["y"] - shoulder["y"]
    t, a = F.hypot(tx, ty), F.hypot(ax, ay)
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(tx * ax + ty * ay, t * a)))
    return F.when((t < 1e-6) | (a < 1e-6), 0.0).otherwise(F.degrees(F.acos(cos)))


def pose_scores(kps: Column | str) -> Column:
    """Map of pose name to score of one person; empty if shoulders, wrists or torso can't be trusted."""
    k = _c(kps)
    at = lambda i: F.get(k, F.lit(i))
    ls, rs, lw, rw, lh, rh, lk, rk = map(at, (5, 6, 9, 10, 11, 12, 13, 14))
    shoulder, hip = F.greatest(ls["conf"], rs["conf"]), F.greatest(lh["conf"], rh["conf"])
    core = (shoulder + hip) / 2
    sy, hy = (ls["y"] + rs["y"]) / 2, (lh["y"] + rh["y"]) / 2
    torso = F.abs(hy - sy)
    usable = (shoulder >= 0.40) & (F.greatest(lw["conf"], rw["conf"]) >= 0.30) & (core >= 0.50) & (torso >= 1e-6)
    over = lambda x: F.try_divide(x, torso)
    l_up, r_up = over(sy - lw["y"]), over(sy - rw["y"])
    l_angle, r_angle = arm_angle(ls, lw, lh), arm_angle(rs, rw, rh)
    hips = hip >= 0.45
    both = F.when((l_up > 0.20) & (r_up > 0.20) & (l_angle > 100) & (r_angle > 100), 0.6 * clip01(((l_up + r_up) / 2 - 0.45) / 0.5) + 0.4 * F.least((l_angle + r_angle) / 240, F.lit(1.0)))
    knees = F.least(over(hy - lk["y"]), over(hy - rk["y"]))
    jump = F.when(hips & (lk["conf"] > 0.40) & (rk["conf"] > 0.40) & (knees > 0.60), clip01((knees - 0.55) / 0.4))
    slide = F.when((F.least(lk["y"], rk["y"]) > hy + 0.3 * torso) & (F.abs(sy - hy) < 0.3 * torso), 0.85)
    head = F.when((lw["y"] < sy) & (rw["y"] < sy) & (F.abs(lw["x"] - rw["x"]) < F.abs(rs["x"] - ls["x"]) * 0.8) & (lw["conf"] > 0.60) & (rw["conf"] > 0.60), 0.75)
    left = (l_up > 0.35) & (~hips | (l_angle > 80))
    right = (r_up > 0.35) & (~hips | (r_angle > 80))
    height, angle, conf = F.when(left, l_up).otherwise(r_up), F.when(left, l_angle).otherwise(r_angle), F.when(left, lw["conf"]).otherwise(rw["conf"])
    one = F.when((left != right) & (conf > 0.20), (0.6 * clip01((height - 0.40) / 0.6) + 0.4 * F.least((angle - 75) / 90, F.lit(1.0))) * F.least(conf / 0.50, F.lit(1.0)))
    names = F.array(*map(F.lit, ("arms_raised", "jump", "slide", "hands_on_head", "one_arm_up")))
    scores = F.map_from_arrays(names, F.array(*(s * core for s in (both, jump, slide, head, one))))
    return F.when(usable, F.map_filter(scores, lambda n, v: v.isNotNull())).otherwise(F.create_map().cast("map<string,double>"))


def best_pose(scores: Column | str) -> Column:
    """Struct (score, label): the largest, the first named of equals; (0, none) for an empty map."""
    s = _c(scores)
    rank = F.array(*map(F.lit, ("arms_raised", "jump", "slide", "hands_on_head", "one_arm_up")))
    best = F.array_max(F.transform(F.map_entries(s), lambda e: F.struct(e["value"].alias("v"), (-F.array_position(rank, e["key"])).alias("order"), e["key"].alias("label"))))
    return F.struct(F.coalesce(best["v"], F.lit(0.0)).alias("score"), F.coalesce(best["label"], F.lit("none")).alias("label"))


def torso_length(joints: Column | str) -> Column:
    """Distance of shoulder centre and hip centre of a map joint -> (x, y); null if one is missing."""
    j = _c(joints)
    at = lambda n: F.try_element_at(j, F.lit(n))
    a, b, c, d = map(at, ("Left Shoulder", "Right Shoulder", "Left Hip", "Right Hip"))
    return distance((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2, (c["x"] + d["x"]) / 2, (c["y"] + d["y"]) / 2)


# Histograms and pixels ------------------------------------------------------------------------


def uniformity(histogram: Column | str) -> Column:
    """Share of all counts in the top 5 % of the bins (at least one)."""
    h = F.transform(_c(histogram), lambda x: x.cast("double"))
    top = F.slice(F.sort_array(h, asc=False), 1, F.greatest(F.lit(1), F.floor(0.05 * F.size(h)).cast("int")))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return total(top) / (total(h) + 1e-6)


def dominant_colour(pixels: Column | str) -> Column:
    """'#rrggbb' from pixels (r, g, b, a): the mean of the most saturated 30 % (10 at least) of opaque, coloured
    pixels, darkened; navy if fewer than 10 are coloured."""

    def saturation(p: Column) -> Column:
        top, low = F.greatest(p["r"], p["g"], p["b"]) / 255.0, F.least(p["r"], p["g"], p["b"]) / 255.0
        light = (top + low) / 2
        sat = F.when(top == low, 0.0).otherwise(F.try_divide(top - low, 1.0 - F.abs(2 * light - 1)))
        return F.when((p["a"] >= 100) & light.between(0.12, 0.85) & (sat >= 0.25), sat)

    vivid = F.filter(F.transform(_c(pixels), lambda p, i: F.struct((-saturation(p)).alias("order"), i.alias("i"), p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b"))), lambda p: p["order"].isNotNull())
    top = F.slice(F.array_sort(vivid), 1, F.greatest(F.lit(10), F.floor(F.size(vivid) * 0.3).cast("int")))

    def channel(c: str) -> Column:
        mean = F.aggregate(top, F.lit(0.0), lambda s, p: s + p[c]) / F.size(top)
        return F.lower(F.lpad(F.hex(F.floor(F.floor(mean + 0.5) * 0.6 + 0.5)), 2, "0"))

    return F.when(F.size(vivid) < 10, F.lit("#0a1628")).otherwise(F.concat(F.lit("#"), channel("r"), channel("g"), channel("b")))
