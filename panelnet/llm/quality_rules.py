"""Quality rules as one Spark projection: word, symbol, stop-word and line counts, a threshold table, no user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelnet.llm.common import as_text

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not this are or from at an "
    "der die das und ist nicht von den zu mit sich des auf für ein eine im dem auch "
    "le la les de des et un une que en du pour dans qui sur par au ce avec "
    "el los las y del que una por con para se su al lo como más"
)
#: A document is kept if for every row low * den <= 100 * num <= high * den; None: no bound. Columns are the counts below.
THRESHOLDS = (
    # name, num, den, low, high
    ("word_length", "word_chars", "n_words", 200, 1500),
    ("symbols_per_word", "n_symbols", "n_words", None, 10),
    ("stop_words", "n_stop", "n_words", 4, None),
    ("shouting", "n_exclaimed", "n_words", None, 10),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 40),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_exclaimed", "n_lines")


def _long(c: Column) -> Column:
    return c.cast("long")


def counted(docs: DataFrame, text: Column, carry: list[Column]) -> DataFrame:
    """carry and the counts of text. Each step is its own projection, so no array is built twice.

    Repeated 3-word windows: a window's key holds a hash in its upper 36 bits and its position in the lower 28,
    so one sort of longs brings equal hashes together; only windows that share a hash are then compared as
    strings, which makes the count exact.
    """
    stop = sorted(set(STOP_WORDS.split()))
    d = docs.select(*carry, text.alias("_t"))
    d = d.select("*", F.array_remove(F.split("_t", SPACE), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "").alias("_l"))
    d = d.select("*", _long(F.size("_w")).alias("n_words"))
    w = F.col("_w")
    key = F.transform(
        F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 28).bitwiseOR(i.cast("long")),
    )
    d = d.select("*", F.sort_array(key).alias("_k"))
    k = F.col("_k")
    head = lambda x: F.shiftright(x, 28)
    like = F.filter(k, lambda x, i: (head(x) == head(F.coalesce(F.get(k, i + 1), F.bitwise_not(x)))) | (head(x) == head(F.coalesce(F.get(k, i - 1), F.bitwise_not(x)))))
    d = d.select("*", F.transform(like, lambda x: x.bitwiseAND(F.lit((1 << 28) - 1)).cast("int")).alias("_p")).drop("_k")
    window = F.transform("_p", lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")))
    d = d.select("*", F.sort_array(window).alias("_s")).drop("_p")
    s = F.col("_s")
    again = F.filter(s, lambda x, i: (x["s"] == F.coalesce(F.get(s, i + 1)["s"], F.lit(""))) | (x["s"] == F.coalesce(F.get(s, i - 1)["s"], F.lit(""))))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    less = lambda chars: _long(F.length("_t") - F.length(F.translate("_t", chars, "")))
    return d.select(
        *[c for c in d.columns if not c.startswith("_") or c.startswith("_c_")],
        _long(F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        less(SYMBOLS).alias("n_symbols"),
        _long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        _long(F.size(covered)).alias("n_repeat_words"),
        _long(F.size(F.filter(w, lambda x: x.isin(stop)))).alias("n_stop"),
        less("!").alias("n_exclaimed"),
        _long(F.size("_l")).alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one condition."""
    out = F.lit(True)
    for _, num, den, low, high in thresholds:
        if low is not None:
            out &= 100 * F.col(num) >= low * F.col(den)
        if high is not None:
            out &= 100 * F.col(num) <= high * F.col(den)
    return out


def _here(c: Column) -> Column:
    """c, at this place of the plan. The partition number, always 0 or more, keeps the optimizer from moving a filter
    on c below the counts, where each of them would be inlined, and computed, many times over."""
    return F.when(F.spark_partition_id() >= 0, c)


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, counts, base_failed, kept), a row for a row.

    A null or blank text has no words and fails the base rule. Null or repeated ids and repeated rows are
    judged row by row; other columns of docs are ignored, whatever their names; an empty table gives none.
    """
    d = counted(docs, as_text(), [F.col("doc_id")])
    flags = {"base_failed": base_failed(), "kept": ~base_failed() & verdict(thresholds)}
    return d.select("doc_id", *[_here(F.col(c)).alias(c) for c in COUNTS], *[_here(c).alias(n) for n, c in flags.items()])


def kept_rows(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    d = counted(docs, as_text(), [F.struct("*").alias("_c_row")])
    kept = _here(~base_failed() & verdict(thresholds))
    return d.select("_c_row", kept.alias("_c_kept")).where("_c_kept").select("_c_row.*")
