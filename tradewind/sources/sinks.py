"""What others read: spreadsheets, a price document for each product, an alert feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.text import csv_quoted, csv_safe


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) for each row of df: its columns as cells that no spreadsheet runs as a formula."""
    cells = [csv_quoted(csv_safe(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))) for c in df.columns]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def write_csv(df: DataFrame, path: str, order: list[Column]) -> None:
    """Files of lines in order, each with the header; a range of rows a file, so no task writes them all."""
    header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in df.columns)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = df.columns
    lines = csv_lines(rows.select(*columns))

    def headed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.types[0])], schema=batch.schema)
                first = False
            yield batch

    lines.mapInArrow(headed, "line string").write.mode("overwrite").text(path)


def price_documents(cards: DataFrame, site: str) -> DataFrame:
    """cards (product_id, slug, name, market, lowest) -> (id, name, prices: map of market to struct of cents and url), priced markets only."""
    url = F.concat(F.lit(f"{site}/"), F.lower(F.replace("market", F.lit(" "), F.lit("-"))), F.lit("/p/"), F.col("slug"))
    entry = F.struct(F.col("market").alias("key"), F.struct(F.col("lowest").alias("cents"), url.alias("url")).alias("value"))
    rows = cards.where("lowest > 0").groupBy(F.col("product_id").alias("id"), "name").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select("id", "name", F.map_from_entries("e").alias("prices"))


def write_price_api(cards: DataFrame, path: str, site: str) -> None:
    """One JSON document a line, by name, over as many files as there are ranges."""
    price_documents(cards, site).repartitionByRange("name", "id").sortWithinPartitions("name", "id").write.mode("overwrite").json(path)


def alert_deals(cards: DataFrame, deal: Column, most: int = 3) -> DataFrame:
    """(market, place, slug, cents, reference): the deals of each market that are furthest under their median."""
    w = Window.partitionBy("market").orderBy((F.col("lowest") / F.col("median_open")).asc(), "product_id")
    rows = cards.where(deal).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return rows.select("market", "place", "slug", F.col("lowest").alias("cents"), F.col("median_open").alias("reference"))
