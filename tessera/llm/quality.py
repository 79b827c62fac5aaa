"""Quality rules with distribution divergence, in DataFrame functions only.

A document's character classes and the common words of its language are compared with the references of that
language, summed over all documents, by the Jensen-Shannon distance (base 2, 0 to 1). Documents shorter than the
guards, and languages with too small a reference, are not judged by them.

Defined results: a null text is empty and fails the base rules; a null or unknown language is judged by the
characters of all such documents and by no words; null and repeated doc_ids are kept each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

BLANK = r"[\x20\x09-\x0D]"
WINDOW = 8
COMMON = {
    "en": "the and of to in a is that for it as was with be by on this are or an at from he not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un une du que est dans qui par pour il sur au plus se ne ce".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
}
CLASSES = ("lower", "upper", "digit", "blank", "punct", "symbol", "extra")
#: Largest distances that are kept, and the fewest words of a document that is judged by each. The distance of
#: common words shrinks with the length of a clean text, so its limit is WORD_LIMIT + WORD_SPREAD / sqrt(words).
CHAR_LIMIT, CHAR_WORDS = 0.28, 40
WORD_LIMIT, WORD_SPREAD, WORD_WORDS = 0.165, 1.35, 60
#: Fewest characters of a language's reference.
REFERENCE_CHARS = 20_000


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more."""

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(r: Column) -> Column:
            twice = F.filter(r, lambda s, j: F.coalesce(F.get(r, j - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(r, j + 1)["h"] == s["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda s: s["i"]))

        def total(p: Column) -> Column:
            own = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(ranked, lambda r: let(places(r), total))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def of(h: Column) -> Column:
        some = let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
        return F.when(F.size(h) < WINDOW, F.lit(0).cast("long")).otherwise(some)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _language() -> Column:
    return F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit("other"))


def measured(docs: DataFrame, name: str = "__m") -> DataFrame:
    """``docs`` with a struct of measures, ``name``, which no column of theirs may have."""
    parts = free_name(docs, "text_parts")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, BLANK + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    chars = F.char_length(text).cast("long")
    first = docs.withColumn(parts, F.struct(text.alias("text"), words.alias("words"), chars.alias("chars"), count(BLANK).alias("blank"), count(r"[#*$%&|<>]").alias("marks")))
    t = lambda x: F.col(f"{parts}.{x}")
    lowered = F.array_remove(F.split(F.lower(text), BLANK + "+"), "")
    common = F.coalesce(*[F.when(_language() == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()])
    hits = let(lowered, lambda w: F.transform(common, lambda c: (F.size(w) - F.size(F.array_remove(w, c))).cast("double")))
    upper, digit, punct = count("[A-ZÀ-ÞА-Я]"), count("[0-9]"), count(r"[.,;:!?'\"()\-]")
    symbol = count(r"[=+@/\\^~_{}\[\]`]") + t("marks")
    second = first.withColumn(
        name,
        F.struct(
            _language().alias("language"), F.size(t("words")).cast("long").alias("n_words"), (t("chars") - t("blank")).alias("word_chars"), t("marks").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), _repeat_words(t("words")).alias("n_repeat_words"),
            t("chars").alias("chars"), upper.alias("upper"), digit.alias("digit"), t("blank").alias("blank"), punct.alias("punct"), symbol.alias("symbol"), (F.octet_length(text) - t("chars")).cast("long").alias("extra"),
            hits.alias("hits"),
        ),
    )
    return second.drop(parts)


def _classes(m: str) -> Column:
    c = lambda x: F.col(f"{m}.{x}").cast("double")
    lower = F.greatest(c("chars") - c("blank") - c("upper") - c("digit") - c("punct") - c("symbol"), F.lit(0.0))
    return F.array(lower, *[c(x) for x in CLASSES[1:]])


def _with_rest(hits: Column, words: Column) -> Column:
    return F.concat(hits, F.array(F.greatest(words.cast("double") - F.aggregate(hits, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def references(rows: DataFrame, name: str = "__m") -> dict[str, tuple[list[float], list[float] | None]]:
    """Per language the shares of character classes and of common words; at most one row per known language and one for the others."""
    longest = max(map(len, COMMON.values()))
    wide = rows.select(F.col(f"{name}.language").alias("g"), F.col(f"{name}.n_words").alias("w"), _classes(name).alias("c"), F.col(f"{name}.hits").alias("h"))
    sums = [F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("h", F.lit(i))).alias(f"h{i}") for i in range(longest)]
    out = {}
    for r in wide.groupBy("g").agg(F.sum("w").alias("w"), *sums).collect():
        c = [r[f"c{i}"] or 0.0 for i in range(len(CLASSES))]
        if sum(c) < REFERENCE_CHARS:
            continue
        k = len(COMMON.get(r["g"], ()))
        h = [r[f"h{i}"] or 0.0 for i in range(k)]
        words = [x / r["w"] for x in h] + [max(0.0, 1 - sum(h) / r["w"])] if k and r["w"] else None
        out[r["g"]] = ([x / sum(c) for x in c], words)
    return out


def distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of counts and a distribution."""
    q = F.array(*map(F.lit, shares))

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    def of(total: Column) -> Column:
        terms = F.zip_with(counts, q, lambda x, y: part(x / total, y) + part(y, x / total))
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)) / 2)

    return let(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), lambda t: F.when(t > 0, of(t)))


def distances(refs: dict, name: str = "__m") -> tuple[Column, Column]:
    """A row's distances from its language's references, null where the guards forbid a judgement."""
    g, n = F.col(f"{name}.language"), F.col(f"{name}.n_words")
    none = F.lit(None).cast("double")
    chars = F.coalesce(*[F.when((g == k) & (n >= CHAR_WORDS), distance(_classes(name), c)) for k, (c, _) in refs.items()], none)
    words = F.coalesce(*[F.when((g == k) & (n >= WORD_WORDS), distance(_with_rest(F.col(f"{name}.hits"), n), w)) for k, (_, w) in refs.items() if w], none)
    return chars, words


def _verdict(name: str, chars: Column, words: Column) -> tuple[Column, Column]:
    m = lambda x: F.col(f"{name}.{x}")
    failed = (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))
    near = F.coalesce(chars <= CHAR_LIMIT, F.lit(True)) & F.coalesce(words <= WORD_LIMIT + WORD_SPREAD / F.sqrt(m("n_words")), F.lit(True))
    return failed, ~failed & near


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and both distances for every row."""
    rows = materialize(measured(docs.select("doc_id", "lang", "text")).select("doc_id", "__m"), "quality")
    chars, words = distances(references(rows))
    rows = rows.withColumns({"char_distance": chars, "word_distance": words})
    failed, kept = _verdict("__m", F.col("char_distance"), F.col("word_distance"))
    base = [F.col(f"__m.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *base, failed.alias("base_failed"), kept.alias("kept"), "char_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, columns as they were.

    Measures are stored beside the rows: a filter over them would be pushed below and compute them once per use.
    Null and empty texts have no words and are rejected, as all of fewer than 20 words are; a null language is judged
    as one without a word list; repeated rows are each kept or not; whole texts are measured, whatever their length;
    an empty table stays empty; columns are passed on whatever their names.
    """
    name = free_name(docs, "quality_measures")
    rows = materialize(measured(docs, name), "quality")
    chars, words = distances(references(rows, name), name)
    _, kept = _verdict(name, chars, words)
    return rows.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
