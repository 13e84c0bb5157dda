"""Reading items, labels and records, and keeping record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.operators.skew import first_per_group, seeded
from veilscan.settings import ITEMS

MAX_RECORDS = 50  # fixed value
MAX_RECORD_BYTES = 400_000  # fixed value


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines to typed items; absent keys are null."""
    return spark.read.schema(ITEMS).json(path)


def labels_of(json: Column) -> Column:
    """A JSON object id -> {types, reason} as map entries."""
    return F.map_entries(F.from_json(json, "map<string,struct<types:array<string>,reason:string>>"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label file, one JSON object of ids, to one row per id."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(labels_of(F.col("value"))).alias("e")).select(
        F.col("e.key").alias("id"), F.col("e.value.types").alias("types"), F.col("e.value.reason").alias("reason"))


def sample_columns(spark: SparkSession, paths: list[str], columns: list[str], n: int, seed: int, key: str) -> DataFrame:
    """A seeded sample of n rows with only the named columns read, nulls as empty strings."""
    df = spark.read.parquet(*paths).select(*columns)
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != key else F.col(c) for c in columns]
    return df.orderBy(seeded(seed, key), key).limit(n).select(*filled)  # top-k by hash: no full sort


def source_of(context: Column) -> Column:
    return F.when(context.isin("direct_user", "chat_message"), "user").otherwise("email")


def resume(items: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Items with no result yet."""
    return items.join(results.select(*keys).distinct(), keys, "left_anti")


def upsert_keep_newest(records: DataFrame, new: DataFrame, key: str, order: str, n: int = MAX_RECORDS) -> DataFrame:
    """New records replace those of the same id; the newest n stay (a top-k)."""
    both = records.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = first_per_group(both.withColumn("_old", -F.col("_new")).withColumn("_back", -F.col(order)), [key], ["_old", "_back"])
    return latest.orderBy(F.desc(order), F.desc(key)).limit(n).drop("_new", "_old", "_back")


def save_within_limit(records: DataFrame, body: str, limit: int = MAX_RECORD_BYTES) -> DataFrame:
    """Adds the status a record would be refused with, or 200."""
    size = F.octet_length(F.col(body))
    parsed = F.try_parse_json(body)
    has_id = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.id", "variant")) == "STRING", F.lit(False))
    has_jobs = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.jobs", "variant")).startswith("OBJECT"), F.lit(False))
    return records.withColumn("status", F.when(size > limit, 413).when(parsed.isNull(), 400).when(~(has_id & has_jobs), 422).otherwise(200))


def markdown_row(cells: Column, width: Column) -> Column:
    tidy = F.transform(cells, lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")))
    padded = F.concat(tidy, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def rows_to_markdown(rows: DataFrame, key: str, row_no: str, cells: str) -> DataFrame:
    """Table rows (long) to Markdown lines (long): blanks dropped, padded to the widest row, a rule after the first.

    One line per row stays one row, so a table of any length is never gathered into one value.
    """
    solid = rows.filter(F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    shape = solid.groupBy(key).agg(F.max(F.size(cells)).alias("_width"), F.min(row_no).alias("_first"))
    df = solid.join(shape, key)
    line = markdown_row(F.col(cells), F.col("_width"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_width")), " | "), F.lit(" |"))
    lines = F.when(F.col(row_no) == F.col("_first"), F.array(line, rule)).otherwise(F.array(line))
    return df.select(key, row_no, F.posexplode(lines).alias("part", "line"))


def html_table_rows(html: Column) -> Column:
    """Rows and cells of the tables in a page, tags stripped: array<array<string>>."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(
        F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)),
        lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", ""))))


def assemble_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Page texts under page rules, joined in order; a document with at most 30 characters counts as scanned.

    A document's pages make one text, which the check bounds; the pages of one document meet in one task.
    """
    kept = pages.filter(F.col(text) != "")
    block = F.concat(F.lit("--- Page "), F.col(page).cast("string"), F.lit(" ---\n"), F.col(text))
    joined = kept.groupBy(doc).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"),
        F.sum(F.char_length(F.col(text))).alias("chars"))
    return joined.withColumn("method", F.when(F.col("chars") > 30, "digital_pdf").otherwise("scanned_pdf_ocr"))
