"""Images as pixels: files decoded by Spark's image source, and uncompressed bytes read by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions.matrices import let


def codes(data: Column) -> Column:
    """array<int> of the bytes of a binary column."""
    return F.when(F.length(data) > 0, F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Brightness by the usual weights (fixed values), rounded."""
    return F.floor(0.299 * red + 0.587 * green + 0.114 * blue + 0.5).cast("int")


def decoded(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Images under ``root``: (path, height, width, channels, pixels), and the paths of files that are no images.
    Files without a byte are in neither, as Spark's readers pass them over.

    Files are decoded in the JVM. pixels: grey values row by row. Grey images stay as they are; colours (stored blue, green, red, and alpha) are weighed.
    """
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")
    good = rows.where("width > 0 and height > 0")

    def pixels(c: Column) -> Column:
        at = lambda i, k: F.get(c, i * F.col("nChannels") + k)
        every = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
        return F.when(F.col("nChannels") == 1, c).otherwise(F.transform(every, lambda i: grey(at(i, 2), at(i, 1), at(i, 0))))

    images = good.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), let(codes(F.col("data")), pixels).alias("pixels"))
    return images, rows.where("not (width > 0 and height > 0)").select(F.col("origin").alias("path"))


def _number(c: Column, at: int, size: int) -> Column:
    """Little-endian number of a byte array."""
    return sum((F.get(c, F.lit(at + k)) * 256**k for k in range(1, size)), F.get(c, F.lit(at)))


def bitmap(data: Column) -> Column:
    """struct<height, width, pixels> of an uncompressed bitmap of 8 (grey) or 24 bits a pixel; null for other bytes.

    Rows stand from the bottom up, each filled up to four bytes. Header places are fixed values of the format.
    """

    def parsed(c: Column) -> Column:
        bits, first, width, height = _number(c, 28, 2), _number(c, 10, 4), _number(c, 18, 4), _number(c, 22, 4)
        row = F.floor((width * bits + 31) / 32) * 4
        right = (F.get(c, F.lit(0)) == 66) & (F.get(c, F.lit(1)) == 77) & bits.isin(8, 24) & (_number(c, 30, 4) == 0) & (width > 0) & (height > 0) & (F.size(c) >= first + row * height)
        head = F.struct(bits.alias("bits"), first.cast("int").alias("first"), width.cast("int").alias("width"), height.cast("int").alias("height"), row.cast("int").alias("row"))

        def pixels(h: Column) -> Column:
            start = lambda i: h["first"] + (h["height"] - 1 - F.floor(i / h["width"]).cast("int")) * h["row"]
            at = lambda i, k: F.get(c, start(i) + F.pmod(i, h["width"]) * F.floor(h["bits"] / 8).cast("int") + k)
            one = lambda i: F.when(h["bits"] == 8, at(i, 0)).otherwise(grey(at(i, 2), at(i, 1), at(i, 0)))
            return F.struct(h["height"].alias("height"), h["width"].alias("width"), F.transform(F.sequence(F.lit(0), h["height"] * h["width"] - 1), one).alias("pixels"))

        return F.when(right, let(head, pixels))

    return F.when(F.length(data) >= 54, let(codes(data), parsed))


def to_bitmap(pixels: Column, height: int, width: int) -> Column:
    """Bytes of an 8-bit grey bitmap of flat grey values."""
    row = -(-width // 4) * 4
    first = 54 + 1024
    le = lambda x, n: x.to_bytes(n, "little")
    head = b"BM" + le(first + row * height, 4) + bytes(4) + le(first, 4) + le(40, 4) + le(width, 4) + le(height, 4) + le(1, 2) + le(8, 2) + bytes(4) + le(row * height, 4) + bytes(16) + b"".join(bytes([i, i, i, 0]) for i in range(256))
    byte = lambda p: F.lpad(F.hex(p.cast("int")), 2, "0")
    line = lambda y: F.concat(F.array_join(F.transform(F.slice(pixels, (height - 1 - y) * width + 1, F.lit(width)), byte), ""), F.lit("00" * (row - width)))
    return F.unhex(F.concat(F.lit(head.hex()), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), line), "")))
