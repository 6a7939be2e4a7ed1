"""Quality rules with adaptive thresholds: quantile sketches per language and source, then a joined filter.

A sketch is a histogram over bins of bounded relative width (values below 64 exactly, 32 bins for each doubling
beyond): a set of (bin, count) rows.  Sketches merge by adding counts, so they combine map-side, a small group
borrows its language's or the whole table's, and the result does not depend on the order of merging.  All of it
is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourspark.llm.common import SPACES, WORD, written

SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED = 50  # per cent of words in repeated three-word windows
GROUP_ROWS = 200  # a group of fewer rows borrows the next wider group's sketch
FENCE = 3.0  # interquartile ranges beyond the outer quartile
# Rule: (value in thousandths, slack beyond the fence, whether too little is judged as well)
RULES = {"word_length": (500, True), "symbols": (100, False), "dup_lines": (400, False), "repeats": (250, False)}


def _bound(value: Column, use) -> Column:  # type: ignore[no-untyped-def]
    """``use(value)`` with the value computed once, also where lambdas use it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more in the text, the first one included.

    Windows are sorted by hash, equal neighbours kept, and their places walked once: work grows as n log n.
    """

    def places(w: Column) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
        return F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(size))).alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        met = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return F.array_sort(F.array_compact(met))

    start = F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(size), x - acc["last"])).alias("n"))
    return F.aggregate(_bound(_bound(words, places), twice), start, step, lambda acc: acc["n"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; a null text counts as one without a word."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    chars = lambda drop: F.length(F.translate(t, drop, ""))
    both = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        _bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        chars(SPACES).cast("long").alias("word_chars"), (F.length(t) - chars(SYMBOLS)).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    return both.select("doc_id", "lang", "source", "w.*", "word_chars", "n_symbols", "l.*")


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def values() -> dict[str, Column]:
    """Each rule's value, a whole number of thousandths."""
    part = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"word_length": part("word_chars", "n_words"), "symbols": part("n_symbols", "n_words"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words")}


def bin_floor(value: Column) -> Column:
    """The least value of a value's bin."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bin, n) of rows with the rules' values."""
    dealt = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), bin_floor(F.col(r)).alias("bin")) for r in RULES)))
    return measured.select("lang", "source", dealt.alias("s")).groupBy("lang", "source", "s.rule", "s.bin").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """Fences of each group's merged sketch, a column pair for each rule, and the group's rows."""
    merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    by = [*keys, "rule"]
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = merged.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*by))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin")))
    quartiles = rows.groupBy(*by).agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("rows"))
    reach = F.col("q3") - F.col("q1")
    pick = lambda r, e: F.max(F.when(F.col("rule") == r, e))
    out = [pick(r, F.col("q3") + reach * FENCE + slack).alias(f"{r}_most") for r, (slack, _) in RULES.items()]
    out += [pick(r, F.col("q1") - reach * FENCE - slack).alias(f"{r}_least") for r, (slack, low) in RULES.items() if low]
    return quartiles.groupBy(*keys).agg(*out, F.max("rows").alias("rows"))


def thresholds(measured: DataFrame) -> DataFrame:
    """A row for each (lang, source): the fences to use there.  Null languages and sources are groups too."""
    sketch = written(sketches(measured), "sketches")
    own, wide = _fences(sketch, "lang", "source"), _fences(sketch, "lang")
    whole = _fences(sketch.withColumn("everything", F.lit(0)), "everything").drop("everything")
    names = [c for c in own.columns if c not in ("lang", "source", "rows")]
    wide = wide.select(F.col("lang").alias("w_lang"), F.struct(*names, "rows").alias("wide"))
    everywhere = whole.select(*names).first()  # a number for each fence
    whole = F.struct(*(F.lit(everywhere[c] if everywhere else None).cast("double").alias(c) for c in names))
    near = own.join(wide, F.col("lang").eqNullSafe(F.col("w_lang")))
    use = F.when(F.col("rows") >= GROUP_ROWS, F.struct(*names)).when(F.col("wide.rows") >= GROUP_ROWS, F.struct(*(F.col(f"wide.{c}").alias(c) for c in names))).otherwise(whole)
    return near.select("lang", "source", use.alias("t")).select("lang", "source", "t.*")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, failed (rules by name) and kept.

    Thresholds come from the rows that pass the base rules.  Repeated rows count as often as they are there; an
    empty table gives no rows; other columns are not read.
    """
    rows = written(features(docs, doc_id, text, lang, source), "features")
    rows = rows.withColumn("base_failed", base_failed()).withColumns(values())
    limits = thresholds(rows.where(~F.col("base_failed")))
    key = lambda c: F.coalesce(F.concat(F.lit("a"), F.col(c)), F.lit("b"))  # noqa: E731  joins nulls with nulls
    limits = written(limits.select(key("lang").alias("kl"), key("source").alias("ks"), *limits.columns[2:]), "limits")
    held = rows.withColumns({"kl": key("lang"), "ks": key("source")}).join(limits, ["kl", "ks"], "left")
    fails = [F.when(F.col(r) > F.col(f"{r}_most"), F.lit(f"{r} high")) for r in RULES]
    fails += [F.when(F.col(r) < F.col(f"{r}_least"), F.lit(f"{r} low")) for r, (_, low) in RULES.items() if low]
    held = held.withColumn("failed", F.array_compact(F.array(*fails)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return held.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The judged rows that pass both the base rules and their group's thresholds."""
    return judged(docs, doc_id, text).where("kept")
