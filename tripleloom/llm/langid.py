"""Languages of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet in log space: the page's text under a character
trigram model per language, counted over all labelled documents; the language
that its markup declares; its address suffix; and a prior of its host.  How
reliable declarations and suffixes are, and what hosts hold, comes from the
pages themselves, as sums of text posteriors by grouped aggregation.  A host's
prior is smoothed towards its domain's, that towards the overall
share of each language.  A page's own posterior is taken out of every sum that
it is judged by.

A page without text is judged by the rest; one without anything gets the
overall shares.  A null address has no host and suffix.  Ties go to the first
language in order.  Repeated rows are judged one by one; extra columns are not
read.  Documents without a language teach nothing; without any labelled
document there are no languages and the result's language is null.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.store import small_batches, stored
from tripleloom.llm.toxicity import LETTERS, coded

#: Signs of the trigram model, as of ``coded``.
_N = len(LETTERS) + 2
#: Weight of a trigram: neighbours overlap, so each counts for less than a free draw.
TEXT_WEIGHT = 0.3
#: Pages that a parent's distribution counts for in a host's or domain's, and in a declaration's or suffix's.
HOST_STRENGTH, SHARE_STRENGTH = 2.0, 1.0

_OPEN = re.compile(r"<!--|<(script|style|nav|header|footer|aside|noscript|template)\b", re.I | re.A)
_CLOSE = re.compile(r"</(script|style|nav|header|footer|aside|noscript|template|div)\s*>", re.I | re.A)
_DIV, _AD = re.compile(r"<div\b", re.I | re.A), re.compile(r"\bclass=[\"']?ad\b", re.I)
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b", re.I | re.A)
_LANG = re.compile(r"\b(?:xml:)?lang\s*=\s*(?:[\"']\s*)?([a-zA-Z]{2,3})\b", re.I)
_NUMBER = re.compile(r"&#0*([0-9]{1,8})[0-9]*")


def _closers(page: str) -> dict[str, list[tuple[int, int]]]:
    """Bounds of the closing tags in order, per name."""
    found: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSE.finditer(page):
        found.setdefault(m[1].lower(), []).append(m.span())
    return found


def _without_parts(page: str) -> str:
    """The page without comments and without what no reader sees; parts that are never closed stay."""
    closers, last, kept, done, at = _closers(page), page.rfind("-->"), [], 0, 0
    while (m := _OPEN.search(page, at)) is not None:
        if m[1] is None:
            end = page.find("-->", m.end()) + 3 if last >= m.end() else -1
        else:
            own = closers.get(m[1].lower(), [])
            i = bisect_left(own, (m.end(), 0))
            end = own[i][1] if i < len(own) else -1
        at = m.end() if end < 0 else end
        if end >= 0:
            kept.append(page[done:m.start()])
            done = end
    return " ".join([*kept, page[done:]])


def _without_ads(page: str) -> str:
    own, kept, done, at = _closers(page).get("div", []), [], 0, 0
    while (m := _DIV.search(page, at)) is not None:
        end = page.find(">", m.end())
        i = bisect_left(own, (end, 0))
        if end < 0 or i == len(own):  # nothing behind can be a whole part either
            break
        # Openings inside a tag have a part of its text, so what it lacks they lack.
        at = end + 1
        if _AD.search(page, m.end(), end):
            kept.append(page[done:m.start()])
            done = at = own[i][1]
    return " ".join([*kept, page[done:]])


def page_text(page: str | None) -> str:
    """What a reader sees of a page: no markup, menus, scripts or advertisements.

    Every step goes over the page once, whatever is left open in it.
    """
    if not page:
        return ""
    page = _without_ads(_without_parts(page))
    whole = page.rfind(">") + 1  # behind it no tag is closed
    text = _TAG.sub(" ", page[:whole]) + page[whole:]
    # Longer numbers name no character; Python refuses to read very long ones.
    return html.unescape(_NUMBER.sub(r"&#\1", text) if "&#" in text else text)


def declared(page: str | None) -> str:
    page, at = page or "", 0
    while (m := _HTML.search(page, at)) is not None:
        end = page.find(">", m.end())
        at = len(page) if end < 0 else end
        if found := _LANG.search(page, m.end(), at):
            return found[1].lower()
    return ""


def address(url: str | None) -> tuple[str, str, str]:
    """Host, domain (its last three labels at most) and suffix (the last)."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".") if host else []
    if len(labels) < 2 or labels[-1].isdigit():
        return host, host, ""
    return host, ".".join(labels[-3:]), labels[-1]


def trigram_table(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram counts over all labelled documents; a task sends one sum per trigram."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = np.array(batch.column("text").to_pylist(), dtype=object)
            for name in sorted(set(lang)):
                c = coded(texts[lang == name].tolist())[0].astype(np.int64)
                if len(c) > 2:
                    total.setdefault(name, np.zeros(_N**3, dtype=np.int64))
                    total[name] += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()),
                                              pa.array(sums[at])], names=["lang", "k", "n"])

    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        "lang is not null and lang <> '' and text is not null")
    # The table has one row per language and trigram of the fixed sign set.
    rows = known.mapInArrow(run, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), _N**3))
    for i, name in enumerate(languages):
        own = rows[rows["lang"] == name]
        counts[i, own["k"]] = own["n"]
    return languages, counts


def log_trigrams(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the third sign's share after two, smoothed by its share in all languages."""
    table = counts.reshape(len(counts), _N * _N, _N)
    overall = table.sum(axis=(0, 1)) + 1
    smooth = table + 0.5 * overall / overall.sum()
    return np.log(smooth / smooth.sum(axis=2, keepdims=True)).reshape(len(counts), _N**3).astype(np.float32)


def _read(table):
    def run(batches):
        logs = table.value
        for batch in batches:
            pages = batch.column("html").to_pylist()
            code, starts = coded([page_text(p) for p in pages])
            c = code.astype(np.int64)
            text = np.zeros((len(pages), len(logs)))
            if len(c) > 2:
                gram = (c[:-2] * _N + c[1:-1]) * _N + c[2:]
                # A trigram belongs to the page of its middle sign.
                edges = np.clip(starts - 1, 0, len(gram))
                for k, log in enumerate(logs):
                    sums = np.concatenate([[0.0], np.cumsum(log[gram], dtype=np.float64)])
                    text[:, k] = sums[edges[1:]] - sums[edges[:-1]]
            parts = [address(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array([p[k] for p in parts], pa.string()) for k in range(3)),
                 pa.array([declared(p) for p in pages], pa.string()),
                 pa.array((text * TEXT_WEIGHT).tolist(), pa.list_(pa.float64()))],
                names=["page_id", "host", "domain", "suffix", "declared", "text"])
    return run


def _each(n: int, value) -> Column:
    return F.array(*[value(k) for k in range(n)])


def _softmax(x: Column, n: int) -> Column:
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(F.array(shifted), lambda s: F.transform(s, lambda v: v / F.aggregate(
        s, F.lit(0.0), lambda a, b: a + b))).getItem(0)


def _sums(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return rows.where(F.col(key) != "").groupBy(key).agg(_each(n, lambda k: F.sum(F.col("own")[k])).alias(name))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang and probability of every row of ``pages``."""
    spark = pages.sparkSession
    small_batches(spark)
    languages, counts = trigram_table(docs)
    n = len(languages)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    table = spark.sparkContext.broadcast(log_trigrams(counts))
    read = base.mapInArrow(_read(table), "page_id long, host string, domain string, suffix string, declared string, "
                                         "text array<double>")
    if not n:
        return read.select("page_id", "host", "suffix", "declared", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("text_lang", "string"), ("lang", "string"), ("probability", "double"))])
    rows = stored(stored(read, "pages").withColumn("own", _softmax(F.col("text"), n)), "posteriors")
    overall = rows.agg(_each(n, lambda k: F.coalesce(F.sum(F.col("own")[k]), F.lit(0.0))).alias("o")).first()["o"]
    share = [(x + 1) / (sum(overall) + n) for x in overall]
    hosts = stored(_sums(rows.select("host", "own"), "host", n, "of_host"), "hosts")
    domains = stored(_sums(rows.select("domain", "own"), "domain", n, "of_domain"), "domains")
    signs = [stored(_sums(rows.select(k, "own"), k, n, f"of_{k}"), k) for k in ("declared", "suffix")]
    sizes = {k: rows.select(k).where(F.col(k) != "").distinct().count() for k in ("declared", "suffix")}
    for key, sums in (("host", hosts), ("domain", domains), ("declared", signs[0]), ("suffix", signs[1])):
        # Both sides are stored tables, so that Spark can split a host or a suffix with many pages.
        rows = stored(rows.join(sums, key, "left"), f"with-{key}")

    def without(name: str, k: int) -> Column:
        """A sum less the page's own part."""
        return F.greatest(F.coalesce(F.col(name)[k] - F.col("own")[k], F.lit(0.0)), F.lit(0.0))

    def all_without(name: str) -> Column:
        return sum((without(name, k) for k in range(1, n)), without(name, 0))

    def prior(k: int) -> Column:
        domain = (without("of_domain", k) + HOST_STRENGTH * F.lit(share[k])) / (F.col("_domain") + HOST_STRENGTH)
        return (without("of_host", k) + HOST_STRENGTH * domain) / (F.col("_host") + HOST_STRENGTH)

    def sign(name: str, k: int) -> Column:
        """Log share of the page's declaration or suffix among the pages of language k that have any."""
        left = F.lit(float(overall[k])) - F.col("own")[k]
        seen = without(f"of_{name}", k) + F.lit(SHARE_STRENGTH / max(sizes[name], 1))
        return F.when(F.col(name) == "", F.lit(0.0)).otherwise(F.log(seen / (F.greatest(left, F.lit(0.0)) + SHARE_STRENGTH)))

    rows = rows.withColumns({"_domain": all_without("of_domain"), "_host": all_without("of_host")})
    fused = _each(n, lambda k: F.col("text")[k] + F.log(prior(k)) + sign("declared", k) + sign("suffix", k))
    rows = rows.select("page_id", "host", "suffix", "declared", "text", fused.alias("f"))
    rows = rows.select("*", _softmax(F.col("f"), n).alias("p"))
    names = F.array(*map(F.lit, languages))

    def best(x: str) -> Column:
        return F.get(names, (F.array_position(x, F.array_max(x)) - 1).cast("int"))

    return rows.select("page_id", "host", "suffix", "declared", best("text").alias("text_lang"),
                       best("p").alias("lang"), F.array_max("p").alias("probability"))
