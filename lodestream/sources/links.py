"""Links of pages, and crawls over a table of links."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HREF = r"(?i)href\s*=\s*[\"']([^\"'#?][^\"']*)[\"']"
# What a crawl passes over must be the same as elsewhere.
BINARY = "png jpg jpeg gif svg webp ico bmp mp4 mp3 wav ogg avi mov mkv zip tar gz bz2 7z rar exe dmg pkg deb rpm woff woff2 ttf eot css".split()
PATHS = ("/cdn-cgi/", "/wp-json/", "/api/", "/static/", "/assets/", "/media/", "/uploads/", "/fonts/")
WIKI_PATHS = (
    "/wiki/Special:", "/wiki/Help:", "/wiki/Talk:", "/wiki/File:", "/wiki/Category:", "/wiki/Template:", "/wiki/Wikipedia:",
    "/wiki/User:", "/wiki/User_talk:", "/wiki/Project:", "/wiki/Portal:", "/wiki/Module:", "/w/index.php",
)
WIKI_QUERIES = ("action=edit", "action=history", "action=raw", "action=info", "printable=yes", "diff=")
# End of fixed values.


def normalized(url: Column) -> Column:
    """Without fragment, query and trailing slashes; an empty path is /."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    cut = F.regexp_replace(bare, r"(?<!:/)(?<!:)/+$", "")
    return F.when(cut.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(cut, F.lit("/"))).otherwise(cut)


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b or "", h) if h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def hrefs(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, href, place) of every link, as written and counted from 0; script, mail and phone links left out."""
    own = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("place", "href"))
    return own.where(~F.lower("href").rlike(r"^\s*(javascript|mailto|tel):")).select(key, "href", "place")


def links(pages: DataFrame, key: str, *, url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, target): web links of each page to what may be read, absolute (`url`), the first of those whose normalised form (`target`) is the same."""
    own = pages.select(F.struct(F.col(key).alias("k"), F.col(url).alias("u")).alias("_p"), F.col(html).alias("_h"))
    found = hrefs(own, "_p", "_h").select(F.col("_p.k").alias(key), "place", joined(F.col("_p.u"), F.trim("href")).alias("url"))
    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    page = found.where(F.col("url").rlike("^https?://") & ~F.lower(path).rlike(rf"\.({'|'.join(BINARY)})$"))
    for p in PATHS:
        page = page.where(~F.startswith(path, F.lit(p)))
    return page.groupBy(key, normalized(F.col("url")).alias("target")).agg(F.min_by("url", "place").alias("url")).select(key, "url", "target")


def visitable(target: Column, host: str | None = None, *, include: str | None = None, exclude: tuple[str, ...] = (), wiki: bool = False) -> Column:
    keep = F.lit(True)
    if host is not None:
        keep &= F.parse_url(target, F.lit("HOST")).eqNullSafe(F.lit(host))
    if include:
        keep &= target.rlike(include)
    for pattern in exclude:
        keep &= ~target.rlike(pattern)
    if wiki:
        path = F.coalesce(F.parse_url(target, F.lit("PATH")), F.lit(""))
        for p in WIKI_PATHS:
            keep &= ~F.startswith(path, F.lit(p))
        query = F.coalesce(F.parse_url(target, F.lit("QUERY")), F.lit(""))
        for q in WIKI_QUERIES:
            keep &= ~F.contains(query, F.lit(q))
    return keep


def reached(edges: DataFrame, roots: DataFrame, depth: int, *, folder: str, most: int | None = None) -> DataFrame:
    """(url, depth) of the urls reached from `roots` (url) over `edges` (source, target) in at most `depth` steps.

    Breadth first; each wave is a join with the frontier and an anti-join with what has been seen, as a written table.
    most: a crawl's page budget, spent in the order of depth and url.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    seen = written(roots.select("url").distinct().withColumn("depth", F.lit(0)), "d0")
    frontier = seen
    for d in range(1, depth + 1):
        wave = edges.join(frontier, edges.source == frontier.url).select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        frontier = written(wave.withColumn("depth", F.lit(d)), f"d{d}")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen if most is None else seen.orderBy("depth", "url").limit(most)
