"""Language identification by Bayesian evidence fusion (operator 5).

Four pieces of evidence about a page are multiplied: the likelihood of its text under a model of byte trigrams for each language; of the
language that its markup declares; of its address suffix (top-level domain); and the prior of its host. Host priors are smoothed through a hierarchy:
a host leans on its domain, the domain on its suffix's pages, these on all pages, each by `lean` pages' worth. Declared languages, suffixes and hosts
are weighed by grouped aggregation of the text posteriors over the whole table; a page's own share is taken out of its host's counts.

The likelihood of a long text is tempered to that of `evidence` trigrams: neighbouring trigrams are not independent.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_of

#: Trigram buckets, parts in which their counts are summed, languages a task holds counts of, and the smoothing of the counts.
BUCKETS, PARTS, HELD, ALPHA = 1 << 15, 16, 64, 0.5
EVIDENCE, LEAN = 40.0, 4.0

HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", re.S | re.I)
TAG = re.compile(r"<[^>]*>")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)")


def text_of(markup: str) -> str:
    return html.unescape(TAG.sub(" ", HIDDEN.sub(" ", markup)))


def address(url: str) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix (its last one) of an address; empty where there is none."""
    found = HOST.match(url)
    host = found[1].lower().strip(".") if found else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams; runs of anything but letters are one space."""
    raw = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(BUCKETS, np.int64)
    code = raw[:-2] * np.uint32(65_599) + raw[1:-1] * np.uint32(2_053) + raw[2:]
    return np.bincount((code * np.uint32(2_654_435_769)) >> np.uint32(17), minlength=BUCKETS)


def fit_text(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and a table of trigram log probabilities, from all labelled documents.

    Each task sums its documents' counts by language, these are summed by language and part of the buckets; one table of fixed
    size a language comes to the driver.
    """
    width = BUCKETS // PARTS

    def packed(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        rows = [(lang, k, at, v[k * width + at]) for lang, v in total.items() for k in range(PARTS) if len(at := np.flatnonzero(v[k * width : (k + 1) * width])) or not k]
        columns = [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2].astype(np.uint16).tobytes() for x in rows], pa.binary()), pa.array([x[3].astype(np.int64).tobytes() for x in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "part", "at", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in rows_of(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in total:
                    if len(total) >= HELD:
                        yield packed(total)
                        total = {}
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang] += trigrams(text.as_py())
        if total:
            yield packed(total)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(width, np.int64)
        for at, counts in zip(rows["at"].to_pylist(), rows["counts"].to_pylist(), strict=True):
            out[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.int64)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})

    named = docs.select(F.lower(F.trim(F.col(lang_col))).alias("lang"), F.col(text_col).alias("text")).where("text is not null and lang is not null and lang <> ''")
    summed = named.mapInArrow(run, "lang string, part int, at binary, counts binary").groupBy("lang", "part").applyInArrow(add, "lang string, part int, counts binary")
    total: dict[str, np.ndarray] = {}
    for row in summed.collect():
        total.setdefault(row["lang"], np.zeros(BUCKETS, np.int64))[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    langs = sorted(total)
    counts = np.array([total[x] for x in langs], np.float64).reshape(len(langs), BUCKETS) + ALPHA
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


SEEN = "page_id long, declared string, host string, domain string, suffix string, share array<double>"


def read_pages(pages: DataFrame, langs: list[str], table: np.ndarray, *, id_col: str, url_col: str, html_col: str, evidence: float) -> DataFrame:
    """What each page says: declared language, address parts, and the shares of the languages by its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out: list[tuple] = []
            for page, url, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                markup = markup.as_py() or ""
                counts = trigrams(text_of(markup))
                used = np.flatnonzero(counts)
                many = counts[used]
                loglik = table[:, used].astype(np.float64) @ many * min(1.0, evidence / max(1, many.sum()))
                share = np.exp(loglik - loglik.max())
                found = DECLARED.search(markup)
                declared = found[1].lower() if found else "none"
                if declared not in langs:
                    declared = "none" if not found else "other"
                out.append((page, declared, *address(url or ""), (share / share.sum()).tolist()))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=SEEN.replace(", ", " ").split()[::2])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, SEEN)


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", evidence: float = EVIDENCE, lean: float = LEAN) -> DataFrame:
    """The language of each page, from a text model learnt on the labelled documents and all evidence together.

    Returns page_id, lang, probability, text_lang, declared, host.

    Defined cases: a null or empty page has no text evidence, and its other evidence decides; a null address is the empty
    host; a declared language that no document has counts as 'other', a missing one as 'none', which are evidence too; ties
    go to the first language in alphabetical order; repeated rows are pages of their own; without labelled documents every lang is null; empty tables
    give no rows; other columns are ignored.
    """
    langs, table = fit_text(docs)
    if not langs:
        return pages.select(F.col(id_col).cast("long").alias("page_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))])
    seen = cut(read_pages(pages, langs, table, id_col=id_col, url_col=url_col, html_col=html_col, evidence=evidence))
    each = range(len(langs))
    sums = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in each]
    n = float(lean)

    def counts(*by: str) -> DataFrame:
        return seen.groupBy(*by).agg(*sums)

    total = seen.agg(*sums).first()
    # how likely a declared language, or a suffix, is on pages of each language; smoothed with its share of all pages
    pages_all = sum(total[i] or 0.0 for i in each)

    def given(by: str, name: str) -> DataFrame:
        base = sum(F.col(f"s{i}") for i in each) / max(pages_all, 1e-9)
        return counts(by).select(by, F.array(*[(F.col(f"s{i}") + n * base) / ((total[i] or 0.0) + n) for i in each]).alias(name))

    overall = [((total[i] or 0.0) + 1) / (pages_all + len(langs)) for i in each]
    size = sum(F.col(f"s{i}") for i in each)
    suffixes = counts("suffix").select("suffix", F.array(*[(F.col(f"s{i}") + n * overall[i]) / (size + n) for i in each]).alias("up"))
    domains = counts("domain", "suffix").join(suffixes, "suffix").select("domain", F.array(*[(F.col(f"s{i}") + n * F.col("up")[i]) / (size + n) for i in each]).alias("up"))
    hosts = counts("host", "domain").join(domains, "domain").select("host", F.array(*[F.col(f"s{i}") for i in each]).alias("mine"), size.alias("size"), "up")
    rows = seen.join(given("declared", "p_declared"), "declared").join(given("suffix", "p_suffix"), "suffix").join(hosts, "host")
    weight = [F.col("share")[i] * F.col("p_declared")[i] * F.col("p_suffix")[i] * (F.greatest(F.lit(0.0), F.col("mine")[i] - F.col("share")[i]) + n * F.col("up")[i]) for i in each]
    rows = rows.withColumn("weight", F.array(*weight))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: names[F.array_position(F.col(c), F.array_max(c)).cast("int") - 1]
    sum_of = F.aggregate("weight", F.lit(0.0), lambda a, x: a + x)
    return rows.select("page_id", best("weight").alias("lang"), F.round(F.array_max("weight") / sum_of, 6).alias("probability"), best("share").alias("text_lang"), "declared", "host")
