"""Encoded sections and the digest over them, as expressions over the compiled tables: what a package will hold is known without packing it.

Numbers are little-endian, of fixed width; a section's rows are put together in order by an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.operators.partition import CHUNK_CODES, EXTRA_CODES
from vellumspark.sources.package import PROPERTIES
from vellumspark.sources.package_files import LINKS

from .compile import Corpus


def le(x: Column, size: int) -> Column:
    """A whole number of `size` bytes as hex digits, the lowest byte first."""
    digits = F.lpad(F.hex(x.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def float_bits(x: Column) -> Column:
    """The bits of a 32-bit float as a whole number."""
    bits = F.reflect(F.lit("java.lang.Float"), F.lit("floatToIntBits"), x.cast("float")).cast("long")
    return bits.bitwiseAND(F.lit(0xFFFFFFFF))


def code(kind: Column, codes: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[kind]


def joined(rows: DataFrame, order: list, digits: Column) -> DataFrame:
    """doc_id, n, hex: the digits of each document's rows, one after the other in an order."""
    held = rows.select("doc_id", *order, digits.alias("hex")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, "hex"))).alias("rows"))
    return held.select("doc_id", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["hex"]), "").alias("hex"))


def utf8(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def chunk_digits() -> Column:
    return F.concat(le(F.col("chunk_id"), 4), le(code(F.col("kind"), CHUNK_CODES), 1), le(F.col("flags"), 1), F.lit("0000"), *[le(F.col(x), 4) for x in LINKS])


def extra_digits() -> Column:
    text, size = F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit("")))
    data = (
        F.when(F.col("kind") == "link_target", F.concat(le(size % 65536, 2), utf8(text)))
        .when(F.col("kind") == "cell_span", F.concat(le(F.col("a"), 2), le(F.col("b"), 2)))
        .when(F.col("kind") == "list_item_value", le(F.col("a"), 4))
        .otherwise(utf8(text))
    )
    return F.concat(le(F.col("chunk_id"), 4), le(F.col("kind_code"), 1), F.lit("00"), le(F.length(data) / 2, 2), data)


def property_digits() -> Column:
    value = F.col("value")
    by = {"I": le(value, 4), "f": le(float_bits(value), 4), "H": le(value, 2), "B": le(value, 1), "?": le(value, 1)}
    out = F.lit(None).cast("string")
    for layout, digits in by.items():
        out = F.when(F.col("tag").isin(*[t for t, (_, x) in PROPERTIES.items() if x == layout]), digits).otherwise(out)
    return F.concat(le(F.col("tag"), 2), out)


def sections(corpus: Corpus) -> DataFrame:
    """doc_id, chnk, styl, cont binary: the payloads of these sections, as packages hold them, of the documents that compile."""
    chunks = joined(corpus.chunks, ["chunk_id"], chunk_digits())
    extras = joined(corpus.extras, ["chunk_id", "kind_code", "seq"], extra_digits())
    props = corpus.style_properties.select("doc_id", "style_id", "tag", property_digits().alias("hex"))
    props = props.groupBy("doc_id", "style_id").agg(F.array_sort(F.collect_list(F.struct("tag", "hex"))).alias("rows"))
    styles = corpus.styles.select("doc_id", "style_id").join(props, ["doc_id", "style_id"], "left")
    blob = F.coalesce(F.array_join(F.transform("rows", lambda r: r["hex"]), ""), F.lit(""))
    styles = styles.withColumn("blob", blob).withColumn("k", F.coalesce(F.size("rows"), F.lit(0)))
    styles = joined(styles, ["style_id"], F.concat(le(F.col("style_id"), 4), le(F.col("k"), 2), le(F.length("blob") / 2, 2), F.col("blob")))
    image = F.col("kind") == "image_ref"
    data = F.when(image, le(F.coalesce(F.col("image"), F.lit(0)), 4)).otherwise(utf8(F.coalesce("text", F.lit(""))))
    content = joined(corpus.content, ["payload_id"], F.concat(le(F.col("payload_id"), 4), le(image.cast("int"), 1), F.lit("000000"), le(F.length(data) / 2, 4), data))
    all_ = corpus.meta.where("error is null").select("doc_id")
    for name, df in (("c", chunks), ("x", extras), ("s", styles), ("t", content)):
        all_ = all_.join(df.select("doc_id", F.concat(le(F.col("n"), 4), F.col("hex")).alias(name)), "doc_id", "left")
    part = lambda name: F.coalesce(name, F.lit("00000000"))
    return all_.select("doc_id", F.unhex(F.concat(part("c"), part("x"))).alias("chnk"), F.unhex(part("s")).alias("styl"), F.unhex(part("t")).alias("cont"))


def document_ids(corpus: Corpus, drawn: DataFrame | None = None) -> DataFrame:
    """doc_id, document_id: the id that each document's package will carry, a digest over its sections in order.

    drawn: doc_id, payload: the bytes of a document's sections of atlases and images, one after the other; without any, none are drawn.
    """
    s = sections(corpus)
    none = F.unhex(F.lit("00000000"))
    rest = none if drawn is None else F.coalesce("payload", none)
    s = s if drawn is None else s.join(drawn.select("doc_id", "payload"), "doc_id", "left")
    return s.select("doc_id", F.substring(F.sha2(F.concat("chnk", "styl", "cont", rest), 256), 1, 32).alias("document_id"))
