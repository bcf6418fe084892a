"""Generated address lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The templates of posting addresses and titles, and of search pages.
POSTING_URL = "https://www.jobkorea.co.kr/Recruit/GI_Read/%d"
POSTING_TITLE = "임시 공고 (%d)"
SEARCH_URL = (
    "https://www.jobkorea.co.kr/Search/?stext=%s&FeatureCode=IDS&tabType=recruit&careerType=1&Page_No=%d"
)


def gen_url_range(
    spark: SparkSession, start: int, end: int, url: str = POSTING_URL, title: str = POSTING_TITLE
) -> DataFrame:
    """One (list_title, url) row per integer in the half-open range."""
    number = F.col("id")
    return spark.range(start, end).select(
        number.alias("number"), F.format_string(title, number).alias("list_title"), F.format_string(url, number).alias("url")
    )


def page_urls(term: Column, pages: Column, template: str = SEARCH_URL) -> Column:
    """Array of the search addresses of a term, pages 1 to ``pages``."""
    numbers = F.sequence(F.lit(1), pages.cast("int"))
    return F.transform(numbers, lambda n: F.format_string(template, term, n))


def gen_page_urls(terms: DataFrame, term: str, pages: Column | int = 10, template: str = SEARCH_URL) -> DataFrame:
    """One (term, page_no, url) row per search page of every term."""
    count = F.lit(pages) if isinstance(pages, int) else pages
    urls = F.posexplode(page_urls(F.col(term), count, template)).alias("position", "url")
    return terms.select(term, urls).select(term, (F.col("position") + 1).alias("page_no"), "url")
