"""Readers of filing feeds: search pages, nested ownership forms, event windows, an index joined by company number, and source choice."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import local_time, name_key
from tidemark.operators.upkeep import keep_last
from tidemark.scratch import ensure_importable

c = F.col
#: Parts of a non-derivative transaction that are kept (fixed values).
TRANSACTION = ("transactionDate", "transactionCode", "transactionShares", "transactionPricePerShare", "sharesOwnedFollowingTransaction", "directOrIndirectOwnership")
_HIT = "struct<_id:string,_source:struct<ciks:array<string>,form:string,file_type:string,root_form:string,file_date:string,adsh:string>>"


def end_of_day(day: Column) -> Column:
    """When a filing known by its date alone may be used: the last microsecond of the day in New York."""
    return local_time(day, "23:59:59.999999", "America/New_York")


def padded(cik: Column) -> Column:
    return F.lpad(F.trim(cik.cast("string")), 10, "0")


def search_pages(raw: DataFrame, forms: Sequence[str], start: Column, end: Column, column: str = "value") -> DataFrame:
    """Filings (cik, form, filing_date, accession_number, primary_document, available_at) of full-text search pages.

    A page is a JSON object with hits.hits. Documents that are exhibits (their type is neither
    the form nor the root form) are dropped, as are other forms and dates outside [start,
    end]; a filing that several pages name stands once for each company.
    """
    hits = F.from_json(c(column), f"hits struct<hits:array<{_HIT}>>")["hits"]["hits"]
    h = raw.select(F.explode(hits).alias("h")).select(c("h._id").alias("id"), "h._source.*")
    form, kind = F.trim("form"), F.trim(F.coalesce("file_type", F.lit("")))
    day = F.to_date(F.try_to_timestamp("file_date"))
    number = F.coalesce(F.nullif(F.trim("adsh"), F.lit("")), F.nullif(F.split("id", ":")[0], F.lit("")))
    document = F.when(F.instr("id", ":") > 0, F.substring_index("id", ":", -1))
    root = (kind == "") | (kind == form) | (kind == F.trim(F.coalesce("root_form", F.lit(""))))
    out = h.where(form.isin(*forms) & root & day.between(start, end) & number.isNotNull())
    out = out.select(F.explode("ciks").alias("k"), form.alias("form"), day.alias("filing_date"), number.alias("accession_number"), F.coalesce(document, number).alias("primary_document"))
    out = out.where(F.trim("k") != "").select(padded(c("k")).alias("cik"), "form", "filing_date", "accession_number", "primary_document", end_of_day(c("filing_date")).alias("available_at"))
    return keep_last(out, ["cik", "accession_number"], [c("primary_document").asc()])


def ownership(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, status, owner, transactions) of ownership forms; namespaces are ignored, a value stands in its value element or in itself."""
    ensure_importable(files.sparkSession)
    kind = pa.list_(pa.struct([(x, pa.string()) for x in TRANSACTION]))

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def text(node) -> str:
        inner = [d.text.strip() for d in node.iter() if local(d.tag) == "value" and d.text and d.text.strip()]
        return inner[0] if inner else (node.text or "").strip()

    def read(raw: bytes | None) -> tuple[str, str | None, list[dict]]:
        try:
            root = ElementTree.fromstring(raw or b"")
        except ElementTree.ParseError:
            return "NOT_XML", None, []
        owner = next((e.text.strip() for e in root.iter() if local(e.tag) == "rptOwnerName" and e.text), None)
        found = []
        for one in (e for e in root.iter() if local(e.tag) == "nonDerivativeTransaction"):
            item = {local(e.tag): text(e) for e in one.iter() if local(e.tag) in TRANSACTION and text(e)}
            if item:
                found.append(item)
        return "PARSED", owner, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], kind)], names=[key, "status", "owner", "transactions"]
            )

    parts = ",".join(f"{x}:string" for x in TRANSACTION)
    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, status string, owner string, transactions array<struct<{parts}>>")


def accession(file_name: Column) -> Column:
    """Filing number from the folder that holds a file: eighteen digits get their dashes."""
    parts = F.filter(F.split(file_name, "/"), lambda x: x != "")
    folder = F.get(parts, F.size(parts) - 2)
    dashed = F.concat_ws("-", F.substring(folder, 1, 10), F.substring(folder, 11, 2), F.substring(folder, 13, 6))
    return F.when(folder.rlike(r"^\d{18}$"), dashed).otherwise(F.coalesce(folder, F.lit("")))


def index_symbols(index: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows of a filing index with the symbol of the company: by its number, else by a name that only one company has.

    companies (cik, symbol, name) may list a number once; index (cik, company, ...).
    """
    by_number = companies.groupBy(padded(c("cik")).alias("__c")).agg(F.min("symbol").alias("__s1"))
    by_name = companies.groupBy(name_key(c("name")).alias("__n")).agg(F.min("symbol").alias("__s2"), F.count_distinct("symbol").alias("__k")).where("__k = 1 and __n <> ''").drop("__k")
    out = index.join(by_number, padded(c("cik")) == c("__c"), "left").join(by_name, name_key(c("company")) == c("__n"), "left")
    how = F.when(c("__s1").isNotNull(), "cik").when(c("__s2").isNotNull(), "company")
    return out.withColumns({"symbol": F.coalesce("__s1", "__s2"), "matched_by": how, "accession_number": accession(c("file_name"))}).drop("__c", "__s1", "__n", "__s2")


def event_window(rows: DataFrame, key: str, forms: Sequence[str], cutoff: Column, most: int) -> DataFrame:
    """The most latest filings of each key among the forms and from the cutoff on, latest acceptance first."""
    kept = rows.where(F.trim("form").isin(*forms) & (c("filing_date") >= cutoff))
    w = Window.partitionBy(key).orderBy(c("acceptance_datetime").desc_nulls_last(), c("filing_date").desc(), c("accession_number").desc())
    return kept.withColumn("place", F.row_number().over(w)).where(c("place") <= most).withColumn("event_date", F.coalesce("report_date", "filing_date"))


def dated_view(rows: DataFrame) -> DataFrame:
    """Filings with the time they may be used: acceptance where it is known, else the end of the filing day."""
    known = c("acceptance_datetime").isNotNull()
    return rows.withColumns({
        "acceptance_datetime_is_preserved": known, "available_at": F.coalesce("acceptance_datetime", end_of_day(c("filing_date"))),
        "available_at_method": F.when(known, "acceptance_datetime").otherwise("filing_date_eod_conservative"),
    })


def facts_shard(files: DataFrame, key: str, count: int, index: int) -> DataFrame:
    """One of count parts of raw files, by a hash of the key."""
    return files.where(F.pmod(F.xxhash64(key), F.lit(count)) == index)


def collected(observations: DataFrame, keys: Sequence[str], now: Column, order: Sequence[Column] = ()) -> DataFrame:
    """Observations known by now, the last one of each key."""
    return keep_last(observations.where(c("available_at") <= now), list(keys), [c("available_at").desc(), *order])


def request_windows(start: Column, end: Column, symbols: DataFrame, days: int = 30, batch: int = 500) -> DataFrame:
    """(window_start, window_end, batch, symbols) of requests: spans of days and batches of symbols in order."""
    spans = F.sequence(start, end, F.expr(f"interval {days} days"))
    number = F.floor((F.row_number().over(Window.orderBy("symbol")) - 1) / batch)  # a row an instrument
    dealt = symbols.select("symbol").distinct().withColumn("batch", number).groupBy("batch").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
    each = dealt.withColumn("window_start", F.explode(spans))
    return each.select("window_start", F.least(F.date_add("window_start", days - 1), end).alias("window_end"), "batch", "symbols")


def best_source(parsed: Mapping[str, DataFrame], least: int = 100) -> tuple[str, DataFrame]:
    """Name and rows of the parser that found most rows, the first of equals; an error under least rows."""
    sizes = {name: df.count() for name, df in parsed.items()}
    name = max(sizes, key=sizes.get) if sizes else ""
    if not sizes or sizes[name] < least:
        raise RuntimeError(f"no source has {least} rows: {sizes}")
    return name, parsed[name]


#: Columns of the register of sources.
SOURCE_COLUMNS = "id string, priority int, needs_key boolean, pit_mode string, asset_classes array<string>"


def sources_for(register: DataFrame, asset_class: str, with_keys: bool = False) -> DataFrame:
    """Sources of an asset class in order of priority; those that need a key only where there are keys."""
    fit = F.array_contains("asset_classes", asset_class) & (F.lit(with_keys) | ~F.coalesce("needs_key", F.lit(False)))
    return register.where(fit).orderBy("priority", "id")


def register_faults(register: DataFrame, modes: Sequence[str] = ("timestamped", "end_of_day", "revised")) -> DataFrame:
    """Entries of a register that are named twice, have an unknown dating mode, or serve no asset class."""
    from tidemark.operators.upkeep import violations

    twice = F.count("*").over(Window.partitionBy("id")) > 1
    found = violations(("id_twice", twice), ("unknown_mode", ~F.coalesce(c("pit_mode").isin(*modes), F.lit(False))), ("no_asset_class", F.coalesce(F.size("asset_classes"), F.lit(0)) < 1))
    return register.withColumn("faults", found).where(F.size("faults") > 0)


def scope(df: DataFrame, wanted: str | None, column: str = "asset_class") -> DataFrame:
    """Rows of the asset classes named in a comma-separated setting; all where it is blank."""
    names = [x.strip() for x in (wanted or "").split(",") if x.strip()]
    return df.where(c(column).isin(*names)) if names else df


def config(text: str) -> dict:
    """A settings document: JSON, or YAML where its reader is installed, else its plain subset of nested keys, lists and scalars."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text) or {}


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    plain = {"": None, "null": None, "~": None, "true": True, "false": False}
    if text.lower() in plain:
        return plain[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _plain_yaml(text: str) -> dict:
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    at = 0

    def block(depth: int):
        nonlocal at
        out: dict | list = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("-") == isinstance(out, list):
            line = lines[at][1].split(" #", 1)[0].rstrip()
            at += 1
            deeper = at < len(lines) and (lines[at][0] > depth or (isinstance(out, dict) and lines[at][0] == depth and lines[at][1].startswith("- ")))
            if isinstance(out, list):
                out.append(_scalar(line[1:]))
                continue
            name, _, value = line.partition(":")
            out[str(_scalar(name))] = block(lines[at][0]) if not value.strip() and deeper else _scalar(value)
        return out

    return block(lines[0][0]) if lines else {}


def landed_series(spark: SparkSession, path: str, form: str, **options) -> DataFrame:
    """Rows of landed files with the file each came from: csv and json by Spark's readers, xml by row tag (landing.decoded reads other encodings)."""
    reader = spark.read.options(**{"header": True, "encoding": "UTF-8", **options})
    rows = reader.format(form).load(path)
    return rows.withColumn("file_name", c("_metadata.file_name"))


def provenance(files: DataFrame, source: str, retrieved: Column) -> DataFrame:
    """One row a raw file: source, retrieval time, size, digest and lines, the record that goes with a landing."""
    lines = F.size(F.split(F.decode("content", "ISO-8859-1"), "\n"))
    return files.select(F.lit(source).alias("source"), "path", retrieved.alias("retrieved_at"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("content_sha256"), lines.alias("lines"))
