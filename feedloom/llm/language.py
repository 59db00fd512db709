"""Language of web pages by Bayesian fusion of evidence.

    P(l | page)  ~  P(text | l) * P(declared | l) * P(l | host)

* text: byte trigrams of the visible text under one smoothed table per language, learned from
  a bounded sample of labelled documents (``FIT_DOCUMENTS`` per language).  Trigrams of a text
  are no independent draws, so the mean log likelihood counts for ``EVIDENCE`` trigrams at most.
* declared: how often each value of the markup's ``lang`` stands with each language.
* host: a prior in three levels, each shrunk to the one above: all pages, address suffix, host.

The last two come from grouped aggregations over all pages, weighted by the text alone, without
the page that is judged.  Weights are summed as millionths, so reruns agree exactly.

Defined cases: a page without text, address or markup language lacks that piece of evidence
and is judged by the others (by the prior of all pages if it has none); addresses without a
host form no group; repeated rows count each; an empty table gives no rows; without labelled
documents every language is null.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import attach, scratch

FIT_DOCUMENTS = 1000
FIT_BYTES = 20_000
BUCKETS = 1 << 15
EVIDENCE = 60
HOST_STRENGTH = 4.0
SUFFIX_STRENGTH = 20.0
DECLARED_STRENGTH = 5.0
_UNIT = 1_000_000
_PIECE = 1 << 20

# Comments and elements whose content isn't shown; of an unclosed one of the first three nothing
# after it is, the others' content counts.
_OPEN = re.compile(r"<(?:(!--)|(script|style|nav|template|noscript|head)\b)", re.IGNORECASE)
_CLOSE = {"!--": re.compile("-->")} | {
    n: re.compile(rf"</{n}\s*+>", re.IGNORECASE) for n in ("script", "style", "nav", "template", "noscript", "head")}
_TO_THE_END = frozenset({"!--", "script", "style"})
_HTML, _META = re.compile(r"<html\b", re.IGNORECASE), re.compile(r"<meta\b", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)
_CONTENT = re.compile(r"content\s*+=\s*+[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)
_ABOUT_LANGUAGE = re.compile("content-language", re.IGNORECASE)


def visible_text(page: str | None) -> str:
    """What a reader sees, in one pass: a mark that closes nothing is looked for once."""
    text, out, at, missing = page or "", [], 0, set()
    while True:
        start = text.find("<", at)
        if start < 0:
            out.append(text[at:])
            break
        out.append(text[at:start])
        m = _OPEN.match(text, start)
        name = (m[1] or m[2]).lower() if m else None
        if name and name not in missing:
            close = _CLOSE[name].search(text, m.end())
            if close:
                out.append(" ")
                at = close.end()
                continue
            missing.add(name)
            if name in _TO_THE_END:
                break
        end = text.find(">", start)
        if end < 0:
            out.append(text[start:])
            break
        out.append(" ")
        at = end + 1
    return html.unescape("".join(out))


def declared_language(page: str | None) -> str | None:
    """What the first ``html`` element declares, else the first ``meta`` element about it."""
    text = page or ""
    first = _HTML.search(text)
    if first:
        found = _LANG.search(text, first.end(), _end_of_tag(text, first.end()))
        if found:
            return found[1].lower()
    at = 0
    while meta := _META.search(text, at):
        at = _end_of_tag(text, meta.end())
        about = _ABOUT_LANGUAGE.search(text, meta.end(), at)
        found = about and _CONTENT.search(text, about.end(), at)
        if found:
            return found[1].lower()
    return None


def _end_of_tag(text: str, at: int) -> int:
    end = text.find(">", at)
    return len(text) if end < 0 else end


def _letters() -> np.ndarray:
    """Letters in lower case, bytes of other scripts as they are, a space for the rest."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_LETTER = _letters()


def trigrams(text: str) -> np.ndarray:
    """How often each bucket of byte trigrams occurs (words are set between spaces)."""
    counts = np.zeros(BUCKETS, np.int64)
    data = f" {text.lower()} ".encode("utf-8", "surrogatepass")
    for at in range(0, max(len(data) - 2, 0), _PIECE):
        codes = _LETTER[np.frombuffer(data[at:at + _PIECE + 2], np.uint8)].astype(np.uint32)
        grams = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
        grams = grams[~((codes[:-2] == 32) & (codes[1:-1] == 32)) & ~((codes[1:-1] == 32) & (codes[2:] == 32))]
        counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(17), minlength=BUCKETS)
    return counts


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # buckets x languages

    def evidence(self, text: str) -> list[float]:
        """Log likelihoods up to a constant, tempered; zeros without letters."""
        counts = trigrams(text)
        n = int(counts.sum())
        if not n:
            return [0.0] * len(self.languages)
        used = np.flatnonzero(counts)
        logs = counts[used] @ self.logs[used] / n * min(n, EVIDENCE)
        return [round(float(v), 9) for v in logs - logs.max()]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", documents: int = FIT_DOCUMENTS) -> Model:
    """Trigram tables from at most ``documents`` labelled texts per language.

    One scan counts the texts of every language, one more picks by a hash and adds up trigrams in
    the tasks; only the sums reach the driver.  Texts beyond ``FIT_BYTES`` are picked only where a
    language has no shorter one.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("l"), F.col(text).cast("string").alias("t"),
        (F.octet_length(text) <= FIT_BYTES).alias("short"))
    totals = scratch(rows.groupBy("l").agg(F.count_if("short").alias("n_short"), F.count(F.lit(1)).alias("n")), "languages")
    languages = sorted(r["l"] for r in totals.select("l").collect())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    digest = F.xxhash64("t")
    size = F.when(F.col("n_short") > 0, F.col("n_short")).otherwise(F.col("n"))
    usable = attach(rows, totals, "l").filter(F.col("short") | (F.col("n_short") == 0))
    few = usable.filter((size <= documents) | (F.shiftrightunsigned(digest, 1).cast("double") < documents / size * float(2 ** 63)))
    place = F.row_number().over(Window.partitionBy("l").orderBy(digest))
    picked = few.select("l", "t", place.alias("place")).filter(F.col("place") <= documents).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, value in zip(batch.column(0), batch.column(1), strict=True):
                found = trigrams(value.as_py())
                sums[language.as_py()] = sums.get(language.as_py(), 0) + found
        for language, found in sums.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(found[used], pa.int64())],
                ["l", "bucket", "n"])

    found = picked.mapInArrow(count, "l string, bucket bigint, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((len(languages), BUCKETS), np.float64)
    at = {language: k for k, language in enumerate(languages)}
    rows_at = np.array([at[v] for v in found["l"].to_pylist()], np.int64)
    sums[rows_at, found["bucket"].to_numpy()] = found["n"].to_numpy()
    smooth = sums + 0.5
    return Model(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.copy())


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(F.length(host) > 0, host)


def read_pages(pages: DataFrame, model: Model, url: str = "url", page: str = "html") -> DataFrame:
    """``row``, the pieces of evidence of every page, and the weights the text alone gives."""

    @F.arrow_udf("struct<declared:string,logs:array<double>>")
    def read(values: pa.Array) -> pa.Array:
        out = [{"declared": declared_language(v), "logs": model.evidence(visible_text(v))} for v in values.to_pylist()]
        return pa.array(out, pa.struct([("declared", pa.string()), ("logs", pa.list_(pa.float64()))]))

    host = host_of(F.col(url).cast("string"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != page]).alias("row"), host.alias("host"),
                        F.regexp_extract(host, r"([^.]+)\.?$", 1).alias("suffix"), read(F.col(page).cast("string")).alias("r"))
    likelihood = F.transform("logs", lambda v: F.exp(v))
    whole = F.aggregate("likelihood", F.lit(0.0), lambda a, b: a + b)
    return rows.select("row", "host", F.when(F.length("suffix") > 0, F.col("suffix")).alias("suffix"), "r.*").withColumn(
        "likelihood", likelihood).withColumn(
        "weights", F.transform("likelihood", lambda v: F.round(v / whole * _UNIT).cast("long"))).drop("likelihood")


def _sums(rows: DataFrame, key: str | None, name: str, n: int) -> DataFrame:
    sums = F.array(*[F.coalesce(F.sum(F.col("weights")[k]), F.lit(0)) for k in range(n)]).alias(name)
    if key is None:
        return rows.agg(sums)
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(sums)


def identify(pages: DataFrame, model: Model, url: str = "url", page: str = "html") -> DataFrame:
    """The columns of ``pages`` but the markup, with ``host, suffix, declared, text_lang, lang, prob``.

    ``text_lang`` is what the text alone says (null without letters).
    """
    n = len(model.languages)
    names = [c for c in pages.columns if c != page and c.lower() not in ("host", "suffix", "declared", "text_lang", "lang", "prob")]
    if not n:
        host = host_of(F.col(url).cast("string"))
        declared = F.arrow_udf("string")(lambda values: pa.array([declared_language(v) for v in values.to_pylist()], pa.string()))
        suffix = F.regexp_extract(host, r"([^.]+)\.?$", 1)
        nothing = F.lit(None).cast("string")
        return pages.select(
            *[F.col(f"`{c}`") for c in names], host.alias("host"), F.when(F.length(suffix) > 0, suffix).alias("suffix"),
            declared(F.col(page).cast("string")).alias("declared"), nothing.alias("text_lang"), nothing.alias("lang"),
            F.lit(None).cast("double").alias("prob"))
    rows = scratch(read_pages(pages, model, url, page), "evidence")
    everything = _sums(rows, None, "all", n).first()["all"]
    declared = _sums(rows, "declared", "declared_sums", n)
    joined = attach(rows, scratch(_sums(rows, "host", "host_sums", n), "hosts"), "host", "left")
    joined = attach(joined, scratch(_sums(rows, "suffix", "suffix_sums", n), "suffixes"), "suffix", "left")
    joined = attach(joined, scratch(declared, "declared"), "declared", "left")
    total = F.array(*[F.lit(v).cast("long") for v in everything])
    kinds = max(1, scratch(declared, "kinds").count())

    def shrunk(sums: Column, above: Column, strength: float) -> Column:
        """Shares of a group without the page itself, as if ``strength`` pages of the level above were in it."""
        others = F.zip_with(F.coalesce(sums, F.col("weights")), F.col("weights"), lambda a, b: (a - b) / F.lit(float(_UNIT)))
        size = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(others, above, lambda a, p: (a + strength * p) / (size + strength))

    prior = shrunk(total, F.array(*[F.lit(1.0 / n)] * n), 1.0)
    joined = joined.withColumn("p_all", prior)
    joined = joined.withColumn("p_suffix", shrunk(F.col("suffix_sums"), F.col("p_all"), SUFFIX_STRENGTH))
    joined = joined.withColumn("p_host", shrunk(F.col("host_sums"), F.col("p_suffix"), HOST_STRENGTH))
    # P(declared | l): a value's weight among the pages of the language, without the page itself.
    rates = F.zip_with(
        F.zip_with(F.col("declared_sums"), F.col("weights"), lambda a, b: (a - b) / F.lit(float(_UNIT))),
        F.zip_with(total, F.col("weights"), lambda a, b: (a - b) / F.lit(float(_UNIT))),
        lambda a, b: (a + F.lit(DECLARED_STRENGTH / kinds)) / (b + F.lit(DECLARED_STRENGTH)))
    joined = joined.withColumn("p_declared", F.coalesce(rates, F.array(*[F.lit(1.0)] * n)))
    joined = joined.withColumn("scores", F.zip_with(
        F.zip_with("logs", F.transform("p_declared", lambda v: F.log(v)), lambda a, b: a + b), F.transform("p_host", lambda v: F.log(v)), lambda a, b: a + b))
    joined = joined.withColumn("best", F.array_max("scores"))
    language = F.array(*[F.lit(v) for v in model.languages])
    spoken = F.exists("logs", lambda v: v != 0)
    at = lambda values, top: F.element_at(language, F.array_position(values, top).cast("int"))
    return joined.select(
        *[F.col(f"row.`{c}`") for c in names], "host", "suffix", "declared",
        F.when(spoken, at(F.col("logs"), F.array_max("logs"))).alias("text_lang"),
        at(F.col("scores"), F.col("best")).alias("lang"),
        F.round(1 / F.aggregate(F.transform("scores", lambda s: F.exp(s - F.col("best"))), F.lit(0.0), lambda a, b: a + b), 6).alias("prob"))
