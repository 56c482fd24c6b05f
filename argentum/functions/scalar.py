"""Column expressions of the engine: hashes, scores, labels, times and paths. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and limits of the ranking.
SHARPNESS, CLIPPING, FACE_SHARPNESS, EYES, EXPRESSION, EXPOSURE = 0.35, 0.10, 0.25, 0.20, 0.10, 0.05
CONFIDENT_GAP, TIE = 0.06, 0.025
CLOSE_BITS = 8
# Limits of the distance grades.
GRADES = ((4, "near-identical"), (12, "similar"), (24, "related"))
# Eye and expression limits.
EYE_OPEN, EYE_CLOSED, FACE_PIXELS, EXPRESSION_TRUST = 0.52, 0.38, 24.0, 0.45


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hash_bits(h: Column) -> Column:
    """16 hexadecimal digits as a signed 64-bit number, else null."""
    good = F.when(h.rlike("^[0-9a-fA-F]{16}$"), h)
    return F.conv(good, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes in hexadecimal; null where either is malformed."""
    return F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b)))


def grade(distance: Column) -> Column:
    out = F.when(distance.isNull(), F.lit(None).cast("string"))
    for limit, name in GRADES:
        out = out.when(distance <= limit, name)
    return out.otherwise("distinct")


def visual_match(d: Column, p: Column, contrast_a: Column, contrast_b: Column, color_gap: Column) -> Column:
    """Whether two pictures match: by both hashes where known, else by the difference hash alone."""
    flat = (contrast_a < 8.0) | (contrast_b < 8.0)
    both = F.when(flat, (d <= 4) & (p <= 4) & (color_gap <= 20.0)).otherwise((d <= 12) & (p <= 18) | (p <= 8) & (d <= 24))
    return F.coalesce(F.when(d.isNull(), F.lit(False)).when(p.isNull(), d <= 12).otherwise(both), F.lit(False))


def technical_score(sharpness: Column, highlights: Column, shadows: Column) -> Column:
    z = F.lit(0.0)
    return SHARPNESS * clamp(F.coalesce(sharpness, z)) + CLIPPING * (1.0 - clamp(F.coalesce(highlights, z) + F.coalesce(shadows, z)))


def people_score(faces: Column, face_sharpness: Column, expression: Column, first_smile: Column) -> Column:
    """The eyes' term is neutral: eye states don't rank until they are validated."""
    score = FACE_SHARPNESS * F.coalesce(face_sharpness.cast("double"), F.lit(0.0)) + F.lit(EYES * 0.5) + EXPRESSION * F.coalesce(expression.cast("double"), first_smile.cast("double"), F.lit(0.5))
    return F.when(F.coalesce(faces, F.lit(0)) > 0, score).otherwise(0.0)


def exposure_bonus(exposure: Column) -> Column:
    return F.when(F.coalesce(exposure, F.lit(0.5)).between(0.25, 0.85), F.lit(EXPOSURE)).otherwise(0.0)


def junk(sharpness: Column, exposure: Column, contrast: Column, highlights: Column, shadows: Column, saturation: Column, flat: Column) -> Column:
    """struct(category, confidence) of the first rule that holds, else null."""

    def hint(name: str, confidence: Column) -> Column:
        return F.struct(F.lit(name).alias("category"), confidence.alias("confidence"))

    return (
        F.when((highlights >= 0.30) & (contrast <= 0.25), hint("overexposed", F.least(0.55 + highlights * 0.4, F.lit(0.95))))
        .when((shadows >= 0.35) & (exposure <= 0.18), hint("underexposed", F.least(0.55 + shadows * 0.4, F.lit(0.95))))
        .when((flat >= 0.55) & (sharpness >= 0.5) & (saturation <= 0.10), hint("screenshot", F.least(0.60 + flat * 0.25, F.lit(0.9))))
        .when((exposure >= 0.60) & (saturation <= 0.12) & (flat >= 0.40) & (contrast <= 0.40), hint("document", F.lit(0.6)))
    )


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, size: int = 128) -> Column:
    return F.when((F.size(a) == size) & (F.size(b) == size), dot(a, b)).otherwise(-1.0)


def valid_vector(v: Column, size: int = 128) -> Column:
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, structs of x, y, width, height."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(union <= 0, 0.0).otherwise(inter / F.when(union > 0, union))


def eye_state(openness: Column, face_pixels: Column, visibility: Column) -> Column:
    """struct(state, confidence) from the measured openness; small faces stay uncertain."""

    def out(state: str, confidence: Column) -> Column:
        return F.struct(F.lit(state).alias("state"), confidence.cast("double").alias("confidence"))

    return (
        F.when(face_pixels < FACE_PIXELS, out("UNCERTAIN", F.lit(0.2)))
        .when(openness.isNull(), out("UNCERTAIN", F.lit(0.25)))
        .when(openness >= EYE_OPEN, out("OPEN", clamp((openness - EYE_OPEN) / 0.35 + 0.55) * visibility))
        .when(openness <= EYE_CLOSED, out("CLOSED", clamp((EYE_CLOSED - openness) / 0.35 + 0.55) * visibility))
        .otherwise(out("UNCERTAIN", 0.45 * visibility))
    )


def known_state(raw: Column) -> Column:
    """A stored eye state; unknown text is UNCERTAIN, null stays null."""
    return F.when(raw.isin("OPEN", "CLOSED"), raw).when(raw.isNotNull(), "UNCERTAIN")


def expression(width: Column, height: Column, nose_y: Column, left_x: Column, left_y: Column, right_x: Column, right_y: Column, face_pixels: Column) -> Column:
    """struct(smile_score, confidence) from landmarks."""
    mouth = F.sqrt((right_x - left_x) * (right_x - left_x) + (right_y - left_y) * (right_y - left_y))
    lift = clamp((nose_y - (left_y + right_y) * 0.5) / F.greatest(height, F.lit(1.0)), -0.5, 0.5)
    smile = clamp(mouth / F.greatest(width, F.lit(1.0)) * 0.65 + (lift + 0.15) * 0.35)
    trust = clamp(face_pixels / 70.0)
    small = face_pixels < FACE_PIXELS
    return F.struct(F.when(~small, smile).alias("smile_score"), F.when(small, trust * 0.3).otherwise(trust).alias("confidence"))


def photo_time(raw: Column) -> Column:
    """A timestamp (UTC) from the texts that cameras and catalogs use, else null."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), '^"+|"+$', ""), "^'+|'+$", ""))
    rfc = F.when(clean.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.expr("1"))
    colons = F.replace(clean, F.lit("."), F.lit(":"))
    return F.coalesce(
        F.when(rfc.isNotNull(), F.try_to_timestamp(F.upper(clean))),
        F.try_to_timestamp(F.when(colons.rlike(r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$"), colons), F.lit("yyyy:MM:dd HH:mm:ss")),
        F.try_to_timestamp(F.when(clean.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?$"), clean)),
    )


def rfc3339(raw: Column) -> Column:
    """A timestamp from RFC 3339 text only, else null."""
    return F.when(raw.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(F.upper(raw)))


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, cut off towards zero."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return (micros.cast("decimal(20,0)") / 1_000_000).cast("bigint")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot is part of the name."""
    name = file_name(path)
    return F.lower(F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name))


def extension(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def percent_text(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def capped(text: Column, most: int = 500) -> Column:
    return F.substring(text, 1, most)


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def size_bucket(px: Column) -> Column:
    return F.when(px < 40, "<40px").when(px < 80, "40–79px").when(px < 120, "80–119px").when(px < 200, "120–199px").otherwise("200px+")


def confidence_bucket(c: Column) -> Column:
    return F.when(c < 0.5, "<0.50").when(c < 0.6, "0.50–0.60").when(c < 0.7, "0.60–0.70").when(c < 0.8, "0.70–0.80").when(c < 0.9, "0.80–0.90").otherwise("0.90–1.00")


def openness_bucket(score: Column) -> Column:
    low = clamp(F.floor(score * 10) / 10.0, 0.0, 0.9)
    return F.when(score.isNull(), "none").otherwise(F.format_string("%.2f–%.2f", low, F.least(low + 0.1, F.lit(1.0))))


def signature(ids: Column) -> Column:
    """SHA-256 over sorted ids, each behind its byte length as 8 little-endian bytes."""

    def one(x: Column) -> Column:
        big = F.lpad(F.hex(F.octet_length(x).cast("bigint")), 16, "0")
        little = F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)])
        return F.concat(little, F.hex(F.encode(x, "UTF-8")))

    return F.sha2(F.unhex(F.array_join(F.transform(F.sort_array(ids), one), "")), 256)
