"""Live crawls: breadth first in waves; the pages of a wave are fetched by tasks and written before the next is planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.sources import links, transports


def site(spark: SparkSession, root: str, *, folder: str, depth: int = 3, most: int = 50, same_host: bool = True, include: str | None = None, exclude: tuple[str, ...] = (), wiki: bool | None = None) -> DataFrame:
    """FILES and `depth` of the pages reached from `root`.

    most: the crawl's page budget, spent in the order of depth and url. wiki: leave out a wiki's own pages; by default
    where the root looks like one. Pages are fetched by their own URLs, and are one page where those are equal but for query,
    fragment and closing slashes. Pages that fail have a message; a root that fails is all there is.
    """
    wiki = wiki if wiki is not None else "/wiki/" in root or "mediawiki" in root
    first = spark.createDataFrame([(root,)], "uri string").select("uri", links.normalized(F.col("uri")).alias("key"))
    host = first.select(F.parse_url("uri", F.lit("HOST"))).first()[0] if same_host else None

    def fetched(urls: DataFrame, d: int) -> DataFrame:
        path = f"{folder}/wave-{d}"
        transports.fetched(urls.select("uri")).withColumn("depth", F.lit(d)).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    pages = wave = fetched(first, 0)
    for d in range(1, depth + 1):
        left = most - pages.count()
        if left <= 0:
            break
        html = wave.where(F.col("data").isNotNull() & F.coalesce(F.contains("mime", F.lit("html")), F.lit(True)))
        html = html.select(F.col("path").alias("url"), F.decode("data", "UTF-8").alias("html"))
        found = links.links(html.withColumn("key", F.col("url")), "key").where(links.visitable(F.col("url"), host, include=include, exclude=exclude, wiki=wiki))
        target = found.groupBy("target").agg(F.min("url").alias("uri"))
        new = target.join(pages.select(links.normalized(F.col("path")).alias("target")), "target", "left_anti").orderBy("target").limit(left)
        wave = fetched(new, d)
        if not wave.limit(1).count():
            break
        pages = pages.unionByName(wave)
    return pages
