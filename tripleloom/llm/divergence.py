"""Quality rules on distributions: Jensen-Shannon distances to language references, with length guards.

All of it is DataFrame expressions.  A document gives a histogram of character
classes and one of common words; summed over all documents of a declared
language they give that language's references, and over all documents those
for documents without a known language.  A document is kept if it passes the
base rules and its distances stay below limits; a histogram with too few
counts decides nothing.

A null text has no words and fails the base rules, as an empty one does.
Repeated rows get equal results; a null or unknown language is compared with
all documents.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.store import stored

# Common words of the four languages (a fixed list; a parameter of ``divergence``).
COMMON_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "en": "the of and to in a is that it for on was with as be by this are from at or which have not an",
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o pero",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec il ce ne se plus",
}
#: Least counts for the two histograms to decide, and the distances that a kept document may have.
CHARS_GUARD, WORDS_GUARD = 200, 30
CHARS_LIMIT, WORDS_LIMIT = 0.32, 0.90
CLASSES = ("lower", "upper", "accented", "digit", "space", "line", "stop", "shout", "symbol", "other")
_WHITE = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def _repeat_words(words: Column) -> Column:
    """Words in runs of three that occur twice or more, the first occurrence included."""
    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.when(k + 1 < F.size(places), F.least(
            F.lit(3), F.get(places, k + 1) - p)).otherwise(F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(runs: Column) -> Column:
        order = F.sort_array(F.transform(runs, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        marked = _let(order, lambda s: F.filter(F.transform(s, lambda e, k: F.when(
            ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)),
            e["k"])), lambda p: p.isNotNull()))
        return _let(F.sort_array(marked), covered)

    def once(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
            F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        # Most texts repeat no run; only others are sorted with their places.
        return _let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(places(r)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(words, once))


def _histogram(words: Column, common: list[str]) -> Column:
    """(word, number) of each common word of a text."""
    found = F.sort_array(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(common)))

    def counted(f: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda k: (k == 0) | (F.get(f, k - 1) != F.get(f, k)))
        return _let(starts, lambda s: F.transform(s, lambda k, i: F.struct(
            F.get(f, k).alias("word"), (F.coalesce(F.get(s, i + 1), F.size(f)) - k).cast("long").alias("n"))))

    none = F.array().cast("array<struct<word:string,n:bigint>>")
    return _let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(counted(f)))


def measures(docs: DataFrame, common: list[str]) -> DataFrame:
    """One row per document: base counts, character classes and common words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("t"))
    trimmed = F.btrim("t", F.lit(_WHITE))
    base = base.withColumns({
        "words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
        # What is left without small letters and blanks is a fraction of the text.
        "r": F.replace(F.regexp_replace("t", "[a-z]+", ""), F.lit(" "), F.lit("")),
        "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "bare": F.regexp_replace("t", "[a-z]+", "")})
    n = F.length("t")
    blanks = F.length("bare") - F.length("r")
    rest = base.select("doc_id", "lang", "words", "lines", n.alias("n"), (n - F.length("bare")).alias("lower"), blanks.alias("blank"),
                       "r", F.regexp_replace("r", "[A-Z]+", "").alias("u"))
    rest = rest.select("*", (F.length("r") - F.length("u")).alias("upper"), F.regexp_replace("u", r"\P{ASCII}+", "").alias("a"))

    def of(signs: str) -> Column:
        return F.length("a") - F.length(_without(F.col("a"), signs))

    rest = rest.select(
        "*", (F.length("u") - F.length("a")).alias("accented"), of("0123456789").alias("digit"), of("\n").alias("line"),
        of("\t\x0b\x0c\r").alias("tab"), of(".,;:'\"()-").alias("stop"), of("!?").alias("shout"), of("#*$%&|<>").alias("symbol"))
    other = F.length("a") - sum((F.col(c) for c in ("digit", "line", "tab", "stop", "shout")), F.col("symbol"))
    rest = rest.select("*", (F.col("blank") + F.col("tab")).alias("space"), other.alias("other"))
    return rest.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        (F.col("n") - F.col("space") - F.col("line")).cast("long").alias("word_chars"),
        F.col("symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.array(*[F.col(c).cast("double") for c in CLASSES]).alias("classes"),
        _histogram(F.col("words"), common).alias("common"))


def _distance(pairs: Column) -> Column:
    """Root of the Jensen-Shannon divergence, in bits, of the shares (p, q) in an array of structs."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + part(x["p"], (x["p"] + x["q"]) / 2)
                        + part(x["q"], (x["p"] + x["q"]) / 2))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def divergence(docs: DataFrame, common_words: dict[str, str] = COMMON_WORDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_chars and js_words.

    A distance is null where its histogram has fewer counts than its guard.
    """
    common = sorted({w for words in common_words.values() for w in words.split()})
    rows = stored(measures(docs, common), "measures")
    # References: sums by language, which is one row for each of the known languages and one for all.
    known = F.when(F.col("lang").isin(list(common_words)), F.col("lang")).otherwise(F.lit(""))
    rows = rows.withColumn("known", known)
    each = rows.select(F.explode(F.array_distinct(F.array("known", F.lit("")))).alias("known"), "classes", "common", "n_words")
    chars = each.groupBy("known").agg(F.array(*[F.sum(F.col("classes")[k]) for k in range(len(CLASSES))]).alias("ref_chars"))
    words = each.select("known", F.explode("common").alias("c")).groupBy("known", "c.word").agg(F.sum("c.n").alias("n"))
    words = words.groupBy("known").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("ref_words"),
                                       F.sum("n").alias("ref_total"))
    # At most one row per known language and one more, so the broadcast is bounded by the parameter.
    reference = F.broadcast(stored(chars.join(words, "known", "left"), "reference"))
    rows = rows.join(reference, "known", "left")

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    n_chars, n_common = total(F.col("classes")), total(F.transform("common", lambda c: c["n"].cast("double")))
    rows = rows.select("*", n_chars.alias("_nc"), n_common.alias("_nw"), total(F.col("ref_chars")).alias("_rc"))
    shares = F.transform(F.arrays_zip("classes", "ref_chars"), lambda z: F.struct(
        (z["classes"] / F.col("_nc")).alias("p"), (z["ref_chars"] / F.col("_rc")).alias("q")))
    # Words that the document lacks add half their share each.
    present = F.transform("common", lambda c: F.struct(
        (c["n"] / F.col("_nw")).alias("p"), (F.col("ref_words")[c["word"]] / F.col("ref_total")).alias("q")))
    missing = F.lit(1.0) - F.aggregate(present, F.lit(0.0), lambda a, x: a + x["q"])
    present = F.concat(present, F.array(F.struct(F.lit(0.0).alias("p"), F.greatest(missing, F.lit(0.0)).alias("q"))))
    rows = rows.select("*", F.when(F.col("_nc") >= CHARS_GUARD, _distance(shares)).alias("js_chars"),
                       F.when(F.col("_nw") >= WORDS_GUARD, _distance(present)).alias("js_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce("js_chars", F.lit(0.0)) <= CHARS_LIMIT) & (F.coalesce("js_words", F.lit(0.0)) <= WORDS_LIMIT)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & near).alias("kept"), "js_chars", "js_words")
