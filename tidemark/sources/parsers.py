"""Readers of the external formats: JSON with parallel arrays, Atom XML, delimited indexes, HTML tables, snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cols import local_time, next_weekday, ratio
from tidemark.operators.upkeep import keep_last
from tidemark.scratch import ensure_importable

c = F.col
_SERIES = "struct<SERIES_CODE:string,NAME_OF_TIME_SERIES:string,UNIT:string,FREQUENCY:string,VALUES:struct<SURVEY_DATES:array<string>,VALUES:array<string>>>"
#: Values that stand for a missing observation (fixed values).
MISSING = ("", ".", "-")


def series_json(raw: DataFrame, column: str = "value", db: str = "") -> DataFrame:
    """Observations of time series given as parallel arrays of dates and values.

    A result set stands at the root or under data. Missing values are skipped; arrays of
    different length, a blank code or an unreadable observation raise when the row is read.
    """
    root = F.from_json(c(column), f"RESULTSET array<{_SERIES}>, data struct<RESULTSET:array<{_SERIES}>>")
    s = raw.select(F.coalesce(root["RESULTSET"], root["data"]["RESULTSET"]).alias("r")).select(F.explode("r").alias("s")).select("s.*")
    code = F.trim("SERIES_CODE")
    same = F.size("VALUES.SURVEY_DATES") == F.size("VALUES.VALUES")
    good = F.when(F.coalesce(code != "", F.lit(False)) & F.coalesce(same, F.lit(False)), code).otherwise(F.raise_error(F.lit("series without a code or with arrays of different length")))
    each = s.withColumn("series_code", good).withColumn("z", F.explode(F.arrays_zip(c("VALUES.SURVEY_DATES").alias("d"), c("VALUES.VALUES").alias("v"))))
    each = each.where(c("z.v").isNotNull() & ~c("z.v").isin(*MISSING))
    day = F.to_date(F.try_to_timestamp(c("z.d"), F.lit("yyyyMMdd")))
    value = c("z.v").try_cast("double")
    checked = F.when(day.isNotNull() & value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("invalid observation of "), c("series_code"))))
    out = each.select(
        F.lit(db).alias("db"), "series_code", F.trim("NAME_OF_TIME_SERIES").alias("series_name"), F.trim("UNIT").alias("unit"), F.trim("FREQUENCY").alias("frequency"),
        day.alias("observation_date"), checked.alias("value"),
    )
    return out.withColumn("available_at", local_time(next_weekday(c("observation_date")), "15:00:00", "Asia/Tokyo"))


def yield_curve(spark: SparkSession, path: str) -> DataFrame:
    """Daily curve of an Atom feed: tenors, spreads, curvature and their changes over one and five rows; of a day's entries the first."""
    entry = spark.read.option("rowTag", "entry").xml(path, schema="content struct<`m:properties`:struct<`d:NEW_DATE`:string,`d:BC_1MONTH`:string,`d:BC_3MONTH`:string,`d:BC_6MONTH`:string,`d:BC_1YEAR`:string,`d:BC_2YEAR`:string,`d:BC_5YEAR`:string,`d:BC_10YEAR`:string,`d:BC_30YEAR`:string>>")
    names = {"1m": "BC_1MONTH", "3m": "BC_3MONTH", "6m": "BC_6MONTH", "1y": "BC_1YEAR", "2y": "BC_2YEAR", "5y": "BC_5YEAR", "10y": "BC_10YEAR", "30y": "BC_30YEAR"}
    place = F.struct(c("_metadata.file_path"), F.monotonically_increasing_id()).alias("__place")  # a file's rows keep their order in it
    p = entry.select(c("content")["m:properties"].alias("p"), place)
    rows = p.select(F.to_date(F.substring(c("p")["d:NEW_DATE"], 1, 10)).alias("session_date"), *[c("p")[f"d:{v}"].try_cast("double").alias(f"treasury_{k}") for k, v in names.items()], "__place")
    return curve_features(keep_last(rows.where("session_date is not null"), ["session_date"], [c("__place").asc()]).drop("__place"))


def curve_features(rows: DataFrame) -> DataFrame:
    """Spreads, curvature and changes of a curve table; known at 06:00 Tokyo on the next weekday."""
    from pyspark.sql import Window

    t = lambda k: c(f"treasury_{k}")
    rows = rows.withColumns({"treasury_2s10s": t("10y") - t("2y"), "treasury_3m10y": t("10y") - t("3m"), "treasury_curvature_2y5y10y": 2 * t("5y") - t("2y") - t("10y")})
    line = Window.orderBy("session_date")  # one row a day
    names = [x for x in rows.columns if x.startswith("treasury_")]
    rows = rows.withColumns({f"{x}_chg{n}d": c(x) - F.lag(x, n).over(line) for x in names for n in (1, 5)})
    return rows.withColumn("available_at", local_time(next_weekday(c("session_date")), "06:00:00", "Asia/Tokyo"))


def short_volume(raw: DataFrame) -> DataFrame:
    """Short-sale volume per date and symbol, its share, and the disagreement of venues (largest less smallest share)."""
    per = raw.withColumn("__s", ratio(c("short_volume"), c("total_volume")))
    out = per.groupBy("session_date", "symbol").agg(
        F.sum("short_volume").alias("short_volume"), F.sum("short_exempt_volume").alias("short_exempt_volume"), F.sum("total_volume").alias("total_volume"),
        F.coalesce(F.max("__s") - F.min("__s"), F.lit(0.0)).alias("venue_disagreement"),
    )
    out = out.withColumns({"short_ratio": ratio(c("short_volume"), c("total_volume")), "exempt_ratio": ratio(c("short_exempt_volume"), c("short_volume")), "log_volume": F.log1p("total_volume")})
    return out.withColumn("available_at", local_time(F.date_add("session_date", 1), "12:00:00", "Asia/Tokyo"))


def filing_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a pipe-delimited filing index with five fields; headings and rules are passed over."""
    f = F.split("value", r"\|")
    rows = spark.read.text(path).where((F.size(f) == 5) & f[0].rlike(r"^\d+$"))
    return rows.select(f[0].alias("cik"), f[1].alias("company"), f[2].alias("form"), F.to_date(f[3]).alias("filing_date"), f[4].alias("file_name"))


def columnar_arrays(raw: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a JSON object whose fields are parallel arrays; fields maps names to types."""
    schema = ", ".join(f"`{k}` array<string>" for k in fields)
    z = raw.select("*", F.explode(F.arrays_zip(*[F.from_json(c(column), schema)[k].alias(k) for k in fields])).alias("__z"))
    return z.select(*raw.columns, *[c("__z")[k].try_cast(t).alias(k) for k, t in fields.items()])


def quarters(start: Column, end: Column) -> Column:
    """First days of all quarters that meet the interval."""
    return F.sequence(F.trunc(start, "quarter"), F.trunc(end, "quarter"), F.expr("interval 3 months"))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Records of a universe snapshot, one row each, with the time it was taken."""
    schema = "retrieved_at timestamp, records array<struct<symbol:string,name:string,asset_class:string,source_url:string,tradeable:boolean,trade_channels:array<string>>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select("retrieved_at", F.inline("records"))


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.header, self.cells, self.text, self.heading = [], "", None, None, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.text = []
        elif tag in ("h1", "h2", "h3", "h4"):
            self.heading = []

    def handle_endtag(self, tag):
        join = lambda parts: " ".join("".join(parts).split())
        if tag in ("td", "th") and self.text is not None:
            if self.cells is not None:
                self.cells.append(join(self.text))
            self.text = None
        elif tag == "tr" and self.cells:
            self.rows.append((self.header, self.cells))
            self.cells = None
        elif tag in ("h1", "h2", "h3", "h4") and self.heading is not None:
            self.header, self.heading = join(self.heading), None

    def handle_data(self, data):
        for part in (self.text, self.heading):
            if part is not None:
                part.append(data)


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "noscript")
        if tag in ("p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "section", "article"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.silent = max(0, self.silent - 1)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def visible_lines(html: str | None) -> list[str]:
    parser = _Visible()
    parser.feed(html or "")
    parser.close()
    return [x for x in (" ".join(line.split()) for line in "".join(parser.parts).split("\n")) if x]


def table_rows(html: str | None) -> list[tuple[str, list[str]]]:
    parser = _Table()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def html_lines(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, line_no, line) of the visible text, white space collapsed; scripts and styles left out."""
    ensure_importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, x) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, x in enumerate(visible_lines(h))]
            ids, no, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(no, pa.int32()), pa.array(text, pa.string())], names=[id_col, "line_no", "line"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, line_no int, line string")


def html_table_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, row_no, section, cells) of all table rows, with the heading above them."""
    ensure_importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, s, x) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, (s, x) in enumerate(table_rows(h))]
            ids, no, head, cells = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(no, pa.int32()), pa.array(head, pa.string()), pa.array(cells, pa.list_(pa.string()))], names=[id_col, "row_no", "section", "cells"]
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, row_no int, section string, cells array<string>")


def file_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet rows with the file each came from."""
    return spark.read.parquet(*paths).withColumn("file_name", c("_metadata.file_name"))
