"""What a downloaded file is, by its first bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Results must equal published ones.
XML_MARKERS = ("<osm", "<?xml")
HTML_MARKERS = ("<!doctype", "<html", "<head", "<body", "<title", "<script", "<meta", "<h1", "<div", "<span", "<a href", "<!--", "<?php")
HEAD, MARKED = 512, 256


def file_format(content: Column) -> Column:
    """pbf, xml, html or unknown: after a byte order mark and white space, anything but < is pbf; null is unknown."""
    head = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    head = F.regexp_replace(F.regexp_replace(head, "^ï»¿", ""), r"^[ \t\n\r]+", "")
    low = F.lower(F.substring(head, 1, MARKED))
    any_of = lambda marks: reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in marks))
    return F.when(F.coalesce(head, F.lit("")) == "", "unknown").when(~F.startswith(head, F.lit("<")), "pbf").when(any_of(XML_MARKERS), "xml").when(any_of(HTML_MARKERS), "html").otherwise("unknown")


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", file_format(F.col("content")).alias("format"))
