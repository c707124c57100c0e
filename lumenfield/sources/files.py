"""Image folders and uploads: format classes and upload verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions per format class.
FORMATS = {
    "raw": "cr2 cr3 crw nef nrw arw srf sr2 raf orf rw2 pef dng raw rwl iiq 3fr".split(),
    "fits": "fits fit fts fz".split(),
    "tiff": "tif tiff".split(),
    "jpeg": "jpg jpeg png webp".split(),
}
# Leading bytes (hex) of the accepted formats, in test order.
MAGIC = (
    ("FFD8FF", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("53494D504C4520203D", "image/fits"),
    ("52494646", "image/webp"),
    ("0000000C6A50", "image/jp2"),
    ("46554A4946494C4D", "image/x-fuji-raf"),
    ("49491A0000004845415043434452", "image/x-canon-crw"),
)
HEAD_BYTES = 30
MAX_UPLOAD_BYTES = 512 * 1024 * 1024


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def format_class(path: Column) -> Column:
    """raw, fits, tiff or jpeg by extension; null when the extension is not supported."""
    ext = F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))
    out = F.lit(None).cast("string")
    for name, exts in FORMATS.items():
        out = F.when(ext.isin(exts), name).otherwise(out)
    return out


def supported(paths: DataFrame, column: str = "path") -> DataFrame:
    """Supported, non-hidden files with their class and stem, in stem order."""
    d = paths.withColumns({"format": format_class(F.col(column)), "photo_key": stem(F.col(column))})
    d = d.where(F.col("format").isNotNull() & ~F.startswith(file_name(F.col(column)), F.lit(".")))
    return d.orderBy("photo_key", column)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files under ``folder``; contents are not read because only the path and size are selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return supported(files.select("path", "length"))


def sniff(head_hex: Column) -> Column:
    """Media type from the leading bytes given as hex."""
    out = F.when(
        (F.length(head_hex) >= 24) & (F.substring(head_hex, 9, 8) == "66747970"), "image/x-canon-cr3"
    )
    for signature, mime in reversed(MAGIC):
        out = F.when(F.startswith(head_hex, F.lit(signature)), mime).otherwise(out)
    return out


def verify_uploads(
    uploads: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES, key: str = "key", content: str = "content"
) -> DataFrame:
    """Add ``mime``, ``reason`` and ``action``; a file with a reason goes to quarantine."""
    size = F.octet_length(content)
    parts = F.split(F.col(key), "/")
    mime = sniff(F.hex(F.substring(F.col(content), 1, HEAD_BYTES)))
    reason = (
        F.when(size == 0, "empty")
        .when(size > max_bytes, "too_large")
        .when((F.size(parts) < 3) | (parts[0] != "staging"), "bad_key")
        .when(mime.isNull(), "unknown_format")
    )
    return uploads.select(
        "*", size.alias("size_bytes"), reason.alias("reason"),
        F.when(reason.isNull(), mime).alias("mime"),
        F.when(reason.isNull(), "ingest").otherwise("quarantine").alias("action"),
    )
