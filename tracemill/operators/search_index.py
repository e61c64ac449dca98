"""Search without reading every file: a bitmap of trigrams for each block of rows.

Rows are written in blocks, in a folder each or several together, and a block's
bitmap has a bit for each trigram (hashed to BITS) of the text that a search looks at. A search asks
for the bits of its own trigrams, reads the blocks that have all of them, and
tests the rows as a scan would. A bitmap can let a block through for nothing,
but never holds one back that has a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: What one bitmap of Spark's bitmap functions holds.
BITS = 32_768
GRAM = 3
#: Rows in a block.
BLOCK_ROWS = 10_000
BLOCK = "search_block"
#: Folders below path/rows; with more blocks than these, a folder holds several.
FOLDERS = 256
FOLDER = "search_folder"


def _bits(text: Column) -> Column:
    """The bits of a text's trigrams, each once, from 1."""
    # an array of one binds the letters to a name, so that they are computed once
    gram = lambda letters, k: F.concat(*[F.get(letters, k + i) for i in range(GRAM)])
    told = lambda letters: F.transform(F.sequence(F.lit(0), F.size(letters) - GRAM), lambda k: F.pmod(F.xxhash64(gram(letters, k)), F.lit(BITS)) + 1)
    grams = F.get(F.transform(F.array(F.split(text, "")), told), F.lit(0))
    return F.when(F.length(text) >= GRAM, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))


def write(df: DataFrame, path: str, order: str | None = None, block_rows: int = BLOCK_ROWS) -> None:
    """df below path/rows in blocks of about block_rows rows, and their bitmaps below path/bitmaps.

    With order, blocks are ranges of that column, so that rows of a time lie together; else rows are dealt out.
    Up to FOLDERS blocks have a folder each; beyond, folders are ranges that are cut into blocks, so that tasks and
    files don't grow in number with the rows.
    """
    n = max(1, -(-df.count() // block_rows))
    m = min(n, FOLDERS)
    dealt = df.repartitionByRange(m, order) if order else df.repartition(m)
    dealt = dealt.withColumn(FOLDER, F.spark_partition_id())
    if n > m:
        dealt = dealt.sortWithinPartitions(order) if order else dealt
        nth = F.floor(F.monotonically_increasing_id() % 2**33 / block_rows)
        dealt = dealt.withColumn(BLOCK, F.col(FOLDER) * F.lit(2**31) + nth)
    else:
        dealt = dealt.withColumn(BLOCK, F.col(FOLDER).cast("long"))
    dealt.write.mode("overwrite").partitionBy(FOLDER).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    text = rows.select(FOLDER, BLOCK, tables.searched_text(rows.drop(FOLDER, BLOCK)).alias("text"))
    bits = text.select(FOLDER, BLOCK, F.explode(_bits(F.col("text"))).alias("bit")).distinct()
    maps = bits.groupBy(FOLDER, BLOCK).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    maps.write.mode("overwrite").parquet(f"{path}/bitmaps")


def blocks(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(search_folder, search_block): the blocks that may hold a text; every one if it is shorter than a trigram."""
    maps = spark.read.parquet(f"{path}/bitmaps")
    wanted = spark.range(1).select(F.transform(_bits(F.lit(text.strip().lower())), F.bitmap_bit_position)).first()[0]
    for bit in wanted:  # comparisons, which Spark takes for selective and prunes folders by
        byte = F.conv(F.hex(F.substring("bits", bit // 8 + 1, 1)), 16, 10).cast("int")
        maps = maps.where(F.shiftright(byte, bit % 8).bitwiseAND(F.lit(1)) == 1)
    return maps.select(FOLDER, BLOCK)


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Rows in which any cell or name holds text, as tables.search() finds them; only folders of blocks that may hold it are read."""
    rows = spark.read.parquet(f"{path}/rows")
    if text.strip():
        rows = rows.join(blocks(spark, path, text), [FOLDER, BLOCK], "left_semi")
    return tables.search(rows.drop(FOLDER, BLOCK), text)
