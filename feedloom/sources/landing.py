"""Scans of landed documents: board results, profiles, stores, data sets, text files.

Documents are read whole (one request, one profile file, one spreadsheet), parsed to
VARIANT and unfolded with typed look-ups, so unknown fields and odd shapes pass through.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import title_case
from feedloom.operators.careers import OUTCOME_STATUSES, STAGES
from feedloom.operators.dedup import number_in_group
from feedloom.operators.profiles import PROFILE_SCHEMA, ProfileError, require_valid
from feedloom.operators.validate import DatasetError, _kind, collect_issues, fail_fast, root_issues
from feedloom.sources.json_split import elements

ENVELOPES = ["results", "jobs", "data"]
POSTING_FIELDS = ["title", "company", "url", "location", "profile", "status"]


def _plain_name(c: str) -> Column:
    """File metadata comes percent-encoded; a literal plus sign must survive decoding."""
    return F.coalesce(F.try_url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B"))), F.col(c))


def _documents(spark: SparkSession, paths: str | list[str], named_by: str = "file") -> DataFrame:
    """Whole files with ``stem``, the name they are known by.

    ``named_by`` the ``file`` (without its ending) or the ``folder`` it lies in; of a folder that a
    partitioned job wrote (``sheet=north``) the value counts.  Spark packs small files into tasks
    by their bytes, and lists them in parallel, so a landing folder may hold very many.
    """
    docs = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True).select(
        F.col("value"),
        _plain_name("_metadata.file_name").alias("file_name"),
        _plain_name("_metadata.file_path").alias("file_path"),
    )
    if named_by == "folder":
        stem = F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1)
        return docs.withColumn("stem", F.regexp_replace(stem, r"^\w+=", ""))
    return docs.withColumn("stem", F.regexp_extract("file_name", r"^(.*?)(?:\.[^.]*)?$", 1))


def _truthy(v: Column) -> Column:
    """Whether a field counts as given: not null, empty, zero or false."""
    rows = v.try_cast("array<variant>")
    return F.when(rows.isNotNull(), F.size(rows) > 0).otherwise(
        F.coalesce(~F.to_json(v).isin("null", "{}", '""', "0", "0.0", "false"), F.lit(False))
    )


def extract_records(payloads: DataFrame) -> DataFrame:
    """Posting rows of result payloads (source_no, portal, payload VARIANT).

    A bare list, or the first given one of results / jobs / data.  Entries that are not
    objects vanish.  A row's own portal wins.  ``arrival`` orders rows by input and
    position; ``extras`` is the whole row.
    """
    doc = F.col("payload")
    fields = [F.try_variant_get(doc, f"$.{e}", "variant") for e in ENVELOPES]
    chosen = F
    for f in fields:
        chosen = chosen.when(_truthy(f), f)
    listed = F.coalesce(doc.try_cast("array<variant>"), chosen.otherwise(F.lit(None)).try_cast("array<variant>"))
    rows = payloads.withColumn("_rows", listed).select("source_no", "portal", F.posexplode("_rows").alias("pos", "row"))
    given = F.try_variant_get("row", "$.portal", "variant")
    own = F.when(_truthy(given), F.try_variant_get("row", "$.portal", "string"))
    return rows.filter(_kind(F.col("row")) == "object").select(
        F.struct("source_no", "pos").alias("arrival"),
        F.coalesce(own, "portal").alias("portal"),
        F.col("portal").alias("asked_portal"),
        *[F.try_variant_get("row", f"$.{f}", "string").alias(f) for f in POSTING_FIELDS],
        F.col("row").alias("extras"),
    )


def read_results(spark: SparkSession, inputs: dict[str, str] | list[str], skip_unreadable: bool = False,
                 named_by: str = "file") -> DataFrame:
    """Posting rows of result files; an unreadable one is an error that names it.

    With ``skip_unreadable`` such files give no rows; ``read_result_log`` lists them.

    ``{portal: path}`` names the source of each path; in a list of paths (or globs) the
    file stem does, or the folder's name.  The order of the inputs is the order of arrival.
    """
    if isinstance(inputs, dict):
        parts = [
            _documents(spark, path).select(F.lit(i).alias("a"), F.col("file_path"), F.col("file_name"), F.lit(p).alias("portal"), "value")
            for i, (p, path) in enumerate(inputs.items())
        ]
    else:
        parts = [
            _documents(spark, path, named_by).select(
                F.lit(i).alias("a"), F.col("file_path"), F.col("file_name"), F.col("stem").alias("portal"), "value")
            for i, path in enumerate(inputs)
        ]
    docs = parts[0]
    for more in parts[1:]:
        docs = docs.unionByName(more)
    payload = F.try_parse_json("value")
    if not skip_unreadable:
        problem = F.concat(F.lit("unparseable output: "), F.col("file_name"))
        payload = F.coalesce(payload, F.when(payload.isNull(), F.raise_error(problem)).cast("variant"))
    return extract_records(docs.select(F.struct("a", "file_name", "file_path").alias("source_no"), "portal", payload.alias("payload")))


def read_result_log(spark: SparkSession, inputs: list[str], named_by: str = "file") -> DataFrame:
    """(portal, error) of each landed file; an unreadable document is an error."""
    return _documents(spark, inputs, named_by).select(
        F.col("stem").alias("portal"),
        F.when(F.try_parse_json("value").isNull(), F.lit("unparseable output")).alias("error"),
    )


def _only_document(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path).select(F.try_parse_json("value").alias("doc"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of a JSON document ``{profiles: [...]}``; the first error in them is raised."""
    doc = _only_document(spark, path)
    listed = F.try_variant_get("doc", "$.profiles", "variant")
    bad = doc.filter(F.col("doc").isNull() | (_kind(listed) != "array")).limit(1).count()
    if bad:
        raise ProfileError(f"{path}: expected an object with a 'profiles' array")
    rows = doc.select(F.posexplode(listed.try_cast("array<variant>")).alias("place", "p"))
    if rows.filter(_kind(F.col("p")) != "object").limit(1).count():
        raise ProfileError(f"{path}: every profile must be an object")
    return require_valid(profile_rows(rows)).drop("ill_typed")


def profile_rows(rows: DataFrame) -> DataFrame:
    """Typed profiles of (place, p VARIANT).

    ``ill_typed`` names the fields that are given but not of their type (they read as null);
    ``profile_issues`` reports them.
    """
    typed = rows.select("place", "p", F.col("p").try_cast(f"struct<{_struct_fields(PROFILE_SCHEMA)}>").alias("t"))
    given = lambda f: F.coalesce(_kind(F.try_variant_get("p", f"$.{f}", "variant")) != "null", F.lit(False))
    fields = [f.split()[0] for f in re.split(r", (?=\w+ [A-Z])", PROFILE_SCHEMA)]
    wrong = F.array_compact(F.array(*[F.when(given(f) & F.col(f"t.{f}").isNull(), F.lit(f)) for f in fields]))
    return typed.select("place", "t.*", wrong.alias("ill_typed"))


def _struct_fields(ddl: str) -> str:
    """DDL column list as struct fields (``name: type``)."""
    return re.sub(r"(^|, )(\w+) ([A-Z])", r"\1\2: \3", ddl)


def read_seen_document(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON store ``{seen: {key: entry}}``; alternates in ``also_on``."""
    doc = _only_document(spark, path)
    seen = F.try_variant_get("doc", "$.seen", "variant")
    if doc.filter(F.col("doc").isNull() | (_kind(seen) != "object")).limit(1).count():
        raise ValueError(f"{path}: expected an object with a 'seen' object")
    return seen_entries(doc.select(F.explode(seen.try_cast("map<string,variant>")).alias("stored_key", "entry")))


def read_large_seen_document(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """The same for a store of any size: entries are found in pieces of the document."""
    found = elements(spark, path, "seen", split_bytes)
    return seen_entries(found.select(F.col("key").alias("stored_key"), F.col("value").alias("entry")))


def seen_entries(rows: DataFrame) -> DataFrame:
    """Typed entries of (stored_key, entry VARIANT)."""
    def text(name: str) -> Column:
        return F.try_variant_get("entry", f"$.{name}", "string").alias(name)

    fit = F.try_variant_get("entry", "$.fit", "variant")
    return rows.select(
        "stored_key", text("title"), text("company"), text("url"), text("first_seen"),
        F.when(_kind(fit) != "null", F.to_json(fit)).alias("fit"),
        text("status"), text("portal"),
        F.try_variant_get("entry", "$.also_on", "array<struct<portal:string,url:string>>").alias("also_on"),
        F.try_variant_get("entry", "$.rank_score", "int").alias("rank_score"),
        text("rank_verdict"),
        F.try_variant_get("entry", "$.strengths", "array<string>").alias("strengths"),
        F.try_variant_get("entry", "$.gaps", "array<string>").alias("gaps"),
    )


def read_dataset_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(document, entries) of a company data set; entries are (pos, entry VARIANT)."""
    doc = _only_document(spark, path)
    if doc.filter(F.col("doc").isNull()).limit(1).count():
        raise DatasetError(f"{path} is not valid JSON")
    listed = F.try_variant_get("doc", "$.companies", "variant").try_cast("array<variant>")
    entries = doc.select(F.posexplode(listed).alias("p", "entry")).select((F.col("p") + 1).cast("bigint").alias("pos"), "entry")
    return doc, entries


def read_large_dataset_entries(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Entries (pos, entry) of a data-set document of any size, found in pieces of it."""
    found = elements(spark, path, "companies", split_bytes)
    return number_in_group(found.select(F.lit(1).alias("one"), "pos", F.to_json("value").alias("entry")), "one", ["pos"]).select(
        (F.col("place") + 1).cast("bigint").alias("pos"), F.parse_json("entry").alias("entry"))


def read_entry_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a data set kept as JSON lines - the form for large ones.

    Lines carry their own ``pos``.
    """
    line = F.try_parse_json("value")
    return spark.read.text(path).select(line.alias("l")).select(
        F.try_variant_get("l", "$.pos", "bigint").alias("pos"), F.try_variant_get("l", "$.entry", "variant").alias("entry")
    )


def companies_of(entries: DataFrame) -> DataFrame:
    """Typed companies (pos, company, city, categories) of valid entries.

    Without categories, other fields that hold objects act as categories.
    """
    e = F.col("entry")
    fields = e.try_cast("map<string,variant>")
    given = F.try_variant_get(e, "$.categories", "variant").try_cast("map<string,variant>")
    loose = F.map_filter(fields, lambda k, v: ~k.isin("company", "city", "categories") & (_kind(v) == "object"))
    chosen = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(loose)
    return entries.select(
        "pos",
        F.try_variant_get(e, "$.company", "string").alias("company"),
        F.try_variant_get(e, "$.city", "string").alias("city"),
        F.transform_values(chosen, lambda _, v: F.struct(
            F.try_variant_get(v, "$.count", "double").alias("count"),
            F.try_variant_get(v, "$.index", "variant").alias("index"),
        )).alias("categories"),
    )


def plain_fields(entries: DataFrame) -> DataFrame:
    """(pos, company, label, value) of entries that have nothing to act as categories."""
    e = F.col("entry")
    fields = F.map_filter(e.try_cast("map<string,variant>"), lambda k, _: ~k.isin("company", "city", "categories"))
    given = F.try_variant_get(e, "$.categories", "variant").try_cast("map<string,variant>")
    bare = (F.coalesce(F.size(given), F.lit(0)) <= 0) & ~F.exists(F.map_values(fields), lambda v: _kind(v) == "object")
    return entries.filter(bare).select(
        "pos", F.try_variant_get(e, "$.company", "string").alias("company"), F.explode(fields).alias("field", "v")
    ).select("pos", "company", title_case(F.replace("field", F.lit("_"), F.lit(" "))).alias("label"), F.col("v").cast("string").alias("value"))


def load_dataset(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(metadata, companies) of a data-set document; raises for the first hard error."""
    doc, entries = read_dataset_entries(spark, path)
    fail_fast(root_issues(doc))
    fail_fast(collect_issues(entries))
    meta = doc.select(
        F.try_variant_get("doc", "$.metadata.source", "string").alias("source"),
        F.coalesce(F.try_variant_get("doc", "$.metadata.index_baseline", "double"), F.lit(100.0)).alias("index_baseline"),
        F.coalesce(F.try_variant_get("doc", "$.metadata.index_label", "string"), F.lit("Index")).alias("index_label"),
        F.try_variant_get("doc", "$.metadata.baseline_description", "string").alias("baseline_description"),
    ).first()
    return meta.asDict(), companies_of(entries)


def read_sheet_records(spark: SparkSession, path: str | list[str], delimiter: str = ",", named_by: str = "file") -> DataFrame:
    """Records of sheets exported as delimited text, one file each: (sheet, row, cells, unclosed).

    A quote opens only at the start of a cell; then delimiters, line breaks and doubled quotes belong
    to the cell, up to the closing quote.  Anywhere else a quote is a character like others, and so
    is one that opens a cell and is never closed: ``unclosed`` numbers such cells of the record.
    Every character belongs to a record, and the text is read once.  A spreadsheet has a fixed
    maximum of rows, so reading one file whole is bounded; the rows are spread right after.
    """
    sep = re.escape(delimiter)
    cell = (rf'(?:"([^"]*+(?:""[^"]*+)*+)"([^{sep}\r\n]*+)|([^{sep}\r\n]*+))({sep}|\r\n|\r|\n|\Z)')

    @F.arrow_udf("array<struct<cells:array<string>,unclosed:array<int>>>")
    def split(texts: pa.Array) -> pa.Array:
        pattern = re.compile(cell)
        kind = pa.list_(pa.struct([("cells", pa.list_(pa.string())), ("unclosed", pa.list_(pa.int32()))]))

        def records(text: str) -> list[dict]:
            out, cells, unclosed, at = [], [], [], 0
            while at < len(text):
                m = pattern.match(text, at)
                at = m.end()
                if m[1] is not None:
                    value = m[1].replace('""', '"') + m[2]
                else:
                    value = m[3]
                    if value.startswith('"'):
                        unclosed.append(len(cells))
                cells.append(value or None)
                if m[4] != delimiter:
                    out.append({"cells": cells, "unclosed": unclosed})
                    cells, unclosed = [], []
            if cells:  # the text ends with a delimiter
                out.append({"cells": [*cells, None], "unclosed": unclosed})
            return out

        return pa.array([records(t.as_py() or "") for t in texts], kind)

    lines = _documents(spark, path, named_by).select(F.col("stem").alias("sheet"), F.posexplode(split("value")).alias("at", "r"))
    return lines.select("sheet", (F.col("at") + 1).alias("row"), "r.cells", "r.unclosed")


def read_sheets(spark: SparkSession, path: str | list[str], delimiter: str = ",", named_by: str = "file") -> DataFrame:
    """Sheets exported as delimited text: (sheet, row, cells); every row has the cells it has."""
    return read_sheet_records(spark, path, delimiter, named_by).drop("unclosed")


def sheet_issues(spark: SparkSession, path: str | list[str], delimiter: str = ",", named_by: str = "file") -> DataFrame:
    """(sheet, row, cell, message) of quotes that are opened and never closed; cells count from 1."""
    found = read_sheet_records(spark, path, delimiter, named_by).select("sheet", "row", F.explode("unclosed").alias("at"))
    return found.select("sheet", "row", (F.col("at") + 1).alias("cell"), F.lit("quote is never closed; read as it stands").alias("message"))


def split_posting_name(df: DataFrame, file_name: str) -> DataFrame:
    """Company and title from ``<company> - <title>.txt``; the title may hold " - " too."""
    pattern = r"^(.*?) - (.*)\.txt$"
    return df.withColumns({
        "company": F.nullif(F.regexp_extract(file_name, pattern, 1), F.lit("")),
        "title": F.nullif(F.regexp_extract(file_name, pattern, 2), F.lit("")),
    })


def read_posting_texts(spark: SparkSession, path: str, named_by: str = "file") -> DataFrame:
    """Posting texts of a drop folder: (company, title, text); the text is untrusted data."""
    docs = _documents(spark, path, named_by)
    if named_by == "folder":
        docs = docs.withColumn("file_name", F.concat("stem", F.lit(".txt")))
    return split_posting_name(docs, "file_name").select("company", "title", F.col("value").alias("text"))


def parse_outcome(df: DataFrame, value: str = "value") -> DataFrame:
    """Add status, date_resolved, stages and status_unknown to outcome documents."""
    raw = F.trim(F.regexp_extract(value, r"(?m)^\*\*Status:\*\*[ \t]*(.*?)[ \t]*$", 1))
    known = raw.isin(OUTCOME_STATUSES)
    day = F.regexp_extract(value, r"(?m)^\*\*Date resolved:\*\*[ \t]*(\d{4}-\d{2}-\d{2})", 1)
    pairs = []
    for stage in STAGES:
        box = F.regexp_extract(value, rf"(?mi)^- \[(.)\] {stage}[ \t]*$", 1)
        pairs += [F.lit(stage), F.lower(box) == "x"]
    return df.withColumns({
        "status": F.when(known, raw),
        "status_unknown": ~known,
        "date_resolved": F.nullif(day, F.lit("")).try_cast("date"),
        "stages": F.create_map(*pairs),
    })


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome documents ``<company>_<role>/outcome.md`` as one row per application."""
    docs = _documents(spark, path, "folder").withColumnRenamed("stem", "application")
    return parse_outcome(docs).drop("value", "file_name", "file_path")
