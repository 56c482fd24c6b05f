"""Picture formats: registry, lookup by extension, by first bytes, and the choice between both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, label, extensions, family.
FORMATS = [
    ("Jpeg", "JPEG", ("jpg", "jpeg"), "image"),
    ("Png", "PNG", ("png",), "image"),
    ("WebP", "WebP", ("webp",), "image"),
    ("Gif", "GIF", ("gif",), "image"),
    ("Bmp", "BMP", ("bmp",), "image"),
    ("Tiff", "TIFF", ("tiff", "tif"), "image"),
    ("Ico", "ICO", ("ico",), "image"),
    ("Tga", "TGA", ("tga",), "image"),
    ("Pnm", "PNM", ("pnm",), "image"),
    ("Pbm", "PBM", ("pbm",), "image"),
    ("Pgm", "PGM", ("pgm",), "image"),
    ("Ppm", "PPM", ("ppm",), "image"),
    ("Dds", "DDS", ("dds",), "image"),
    ("Hdr", "HDR", ("hdr",), "image"),
    ("Exr", "OpenEXR", ("exr",), "image"),
    ("Qoi", "QOI", ("qoi",), "image"),
    ("Farbfeld", "Farbfeld", ("ff",), "image"),
    ("Cr2", "CR2 (Canon RAW)", ("cr2",), "raw"),
    ("Cr3", "CR3 (Canon RAW)", ("cr3",), "raw"),
    ("Nef", "NEF/NRW (Nikon RAW)", ("nef", "nrw"), "raw"),
    ("Arw", "ARW/SRF (Sony RAW)", ("arw", "srf"), "raw"),
    ("Dng", "DNG (Adobe Digital Negative)", ("dng",), "raw"),
    ("Orf", "ORF (Olympus RAW)", ("orf",), "raw"),
    ("Raf", "RAF (Fujifilm RAW)", ("raf",), "raw"),
    ("Rw2", "RW2 (Panasonic RAW)", ("rw2",), "raw"),
    ("Pef", "PEF (Pentax RAW)", ("pef",), "raw"),
    ("Srw", "SRW (Samsung RAW)", ("srw",), "raw"),
    ("Crw", "CRW (Canon RAW)", ("crw",), "raw"),
    ("Iiq", "IIQ (Phase One RAW)", ("iiq",), "raw"),
    ("Mos", "MOS (Leaf RAW)", ("mos",), "raw"),
    ("Mrw", "MRW (Minolta RAW)", ("mrw",), "raw"),
    ("Erf", "ERF (Epson RAW)", ("erf",), "raw"),
    ("Kdc", "KDC (Kodak RAW)", ("kdc",), "raw"),
    ("Dcs", "DCS (Kodak RAW)", ("dcs",), "raw"),
    ("X3f", "X3F (Sigma RAW)", ("x3f",), "raw"),
    ("Qtk", "QTK (Apple QuickTake RAW)", ("qtk",), "raw"),
    ("Tfr", "TFR (GoPro RAW)", ("tfr",), "raw"),
    ("Ari", "ARI (ARRI RAW)", ("ari",), "raw"),
    ("Nkd", "NKD (Nikon RAW)", ("nkd",), "raw"),
    ("Mef", "MEF (Mamiya RAW)", ("mef",), "raw"),
    ("Avif", "AVIF", ("avif",), "avif"),
    ("Heic", "HEIC", ("heic",), "heif"),
    ("Heif", "HEIF", ("heif",), "heif"),
]
# First bytes (at an offset) and what they tell.
MAGIC = [
    (((0, b"\xff\xd8\xff"),), "Jpeg"),
    (((0, b"\x89PNG\r\n\x1a\n"),), "Png"),
    (((0, b"RIFF"), (8, b"WEBP")), "WebP"),
    (((0, b"GIF87a"),), "Gif"),
    (((0, b"GIF89a"),), "Gif"),
    (((0, b"BM"),), "Bmp"),
    (((0, b"qoif"),), "Qoi"),
    (((0, b"DDS "),), "Dds"),
    (((0, b"v/1\x01"),), "Exr"),
    (((0, b"#?RADIANCE"),), "Hdr"),
    (((0, b"#?RGBE"),), "Hdr"),
]
BRANDS = {"avif": "Avif", "avis": "Avif", "heic": "Heic", "heix": "Heic", "heim": "Heic", "heis": "Heic", "mif1": "Heif", "msf1": "Heif", "hevc": "Heif", "hevx": "Heif", "crx ": "Cr3"}
MAGIC_LATE = [
    (((0, b"FUJIFILMCCD-RAW"),), "Raf"),
    (((0, b"II\x1a\x00\x00\x00HEAPCCDR"),), "Crw"),
    (((0, b"MM\x00*\x00\x00\x00HEAPCCDR"),), "Crw"),
    (((0, b"FOVb"),), "X3f"),
    (((0, b"NRW "),), "Nef"),
]
TIFF_MARKS = {b"CR\x02\x00": "Cr2", b"Niko": "Nef", b"SONY": "Arw", b"MSC\x00": "Arw"}
RAW = tuple(name for name, _, _, family in FORMATS if family == "raw")
EXTENSIONS = {e: name for name, _, extensions, _ in FORMATS for e in extensions}
HEADER = 4096


def registry(spark: SparkSession, heif_decodes: bool = False) -> DataFrame:
    """What can be done with each format, by label. heif_decodes: the platform has a HEIF codec."""
    rows = []
    for name, label, extensions, family in FORMATS:
        full = family != "heif" or heif_decodes
        rows.append((name, label, extensions[0], family == "raw", True, True, full, full, full))
    return spark.createDataFrame(rows, "format string, label string, extension string, is_raw boolean, detect boolean, metadata boolean, preview boolean, full_decode boolean, analyze boolean").orderBy("label")


def format_dim(spark: SparkSession) -> DataFrame:
    """One row for each extension: a dimension of fixed size, for broadcast joins."""
    return spark.createDataFrame([(e, name, name in RAW) for e, name in EXTENSIONS.items()], "extension string, format string, is_raw boolean")


def from_extension(ext: Column) -> Column:
    """The format of an extension, whatever its case and leading dots."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.ltrim(ext, F.lit("."))))


def is_raw(ext: Column) -> Column:
    return F.coalesce(from_extension(ext).isin(*RAW), F.lit(False))


def is_jpeg(ext: Column) -> Column:
    return F.coalesce(F.lower(ext).isin("jpg", "jpeg"), F.lit(False))


def is_photo_path(path: Column) -> Column:
    """Supported extension and no resource-fork twin."""
    from argentum.functions.scalar import extension, file_name

    return F.coalesce(~file_name(path).startswith("._") & from_extension(extension(path)).isNotNull(), F.lit(False))


def sniff(content: Column) -> Column:
    """The format that a file's first bytes tell, else null."""
    head = F.hex(F.substring(content, 1, HEADER))

    def at(places: tuple) -> Column:
        out = F.lit(True)
        for offset, text in places:
            out = out & (F.substring(head, 2 * offset + 1, 2 * len(text)) == text.hex().upper())
        return out

    brand = F.decode(F.unhex(F.substring(head, 17, 8)), "ISO-8859-1")
    brands = F.create_map(*[F.lit(x) for pair in BRANDS.items() for x in pair])
    mark = F.substring(head, 17, 8)
    marks = F.create_map(*[F.lit(x) for mark_, name in TIFF_MARKS.items() for x in (mark_.hex().upper(), name)])
    out = F.when(content.isNull(), F.lit(None).cast("string"))
    for places, name in MAGIC:
        out = out.when(at(places), name)
    out = out.when(at(((4, b"ftyp"),)) & (F.length(head) >= 24), F.try_element_at(brands, brand))
    for places, name in MAGIC_LATE:
        out = out.when(at(places), name)
    return out.when(at(((0, b"II*\x00"),)) | at(((0, b"MM\x00*"),)), F.coalesce(F.try_element_at(marks, mark), F.lit("Tiff")))


def detect(path: Column, content: Column) -> Column:
    """First bytes win, but a RAW extension explains a TIFF header, and HEIC and HEIF go by name."""
    from argentum.functions.scalar import extension

    hint, seen = from_extension(extension(path)), sniff(content)
    return F.when((seen == "Tiff") & hint.isin(*RAW), hint).when(hint.isin("Heic", "Heif") & seen.isin("Heic", "Heif"), hint).otherwise(F.coalesce(seen, hint))
