"""Quality rules: measures of a text, and lines that many documents of one host share, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

SPACES = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3             # words of a repeated window
FEWEST_WORDS = 50
REPEATED_SHARE = 50    # per cent of words in repeated windows that a text may have
LEAST_DOCUMENTS = 5    # a line in this many documents of a host is never above the limit
SHARE = 0.01           # of a host's documents that may share a line
DEPLETED_SHARE = 50    # per cent of a text's words that removed lines may hold

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def normalised(line: Column) -> Column:
    """A line in lower case with single spaces and none at its ends."""
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def _nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def measured(rows: DataFrame, text: Column, host: Column, *carry: str) -> DataFrame:
    """``carry`` with the measures, the host, a hash of the text, and (position, line hash, words) of its lines with words.

    Windows of three words meet by a 64-bit hash and are compared word by word; only a text with some hash twice sorts
    them, to find the places.
    """
    n = F.size("_w")
    hashes = F.transform(F.slice("_w", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(
        w, *[F.get("_w", i + j) for j in range(1, WINDOW)]))
    placed = F.sort_array(F.zip_with("_g", F.sequence(F.lit(0), F.size("_g") - 1), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    there = rows.select(*carry, F.coalesce(text, F.lit("")).alias("_t"), host.cast("string").alias("_host"))
    there = there.withColumns({"_w": words_in(F.col("_t")), "_l": F.split("_t", "\n")})
    there = there.withColumns({"_g": hashes, "_wordy": F.filter("_l", lambda x: x.rlike(WORD_CHAR))})
    there = there.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed).otherwise(_nothing("struct<g:bigint,i:int>")))

    def same(x: Column, other: Column) -> Column:
        words = [F.get("_w", x["i"] + j) == F.get("_w", other["i"] + j) for j in range(WINDOW)]
        return F.coalesce((x["g"] == other["g"]) & words[0] & words[1] & words[2], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, F.get("_s", i - 1)) | same(x, F.get("_s", i + 1))), lambda x: x["i"]))
    there = there.withColumn("_p", starts)
    # a window covers three words; the next one's start may cut that short
    steps = F.aggregate(F.zip_with(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))),
                                   lambda b, a: F.least(F.lit(WINDOW), b - a)), F.lit(0).cast("long"), lambda s, x: s + x)
    lines = F.filter(F.transform("_l", lambda x, i: F.struct(
        i.cast("int").alias("at"), F.when(x.rlike(WORD_CHAR), F.xxhash64("_host", normalised(x))).alias("line"),
        F.when(x.rlike(WORD_CHAR), F.size(words_in(x))).alias("words"))), lambda s: s["line"].isNotNull())
    return there.select(
        *carry, "_host", F.xxhash64("_t").alias("_x"), n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_wordy") - F.size(F.array_distinct("_wordy"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_p") > 0, steps + WINDOW).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"), lines.alias("_lines"))


def frequent_lines(found: DataFrame, least: int, share: float) -> DataFrame:
    """(line, n_documents): hashes of host and line that more documents of the host hold than its limit.

    A document is a distinct text of its host, so copies count once.  Rows are counted in the tasks that read them
    before they move, also where one line stands in a third of all documents.
    """
    per_host = (found.groupBy("_host", "_x").agg(F.lit(1).alias("_")).groupBy("_host")
                .agg(F.count(F.lit(1)).alias("host_documents")).withColumnRenamed("_host", "_h"))
    pairs = found.select("_host", "_x", F.explode("_lines.line").alias("line")).groupBy("line", "_x").agg(F.any_value("_host").alias("_host"))
    counts = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n_documents"), F.any_value("_host").alias("_host")).filter(F.col("n_documents") > least)
    limit = F.greatest(F.lit(least).cast("double"), F.lit(share) * F.col("host_documents"))
    return counts.join(per_host, F.col("_host").eqNullSafe(F.col("_h"))).filter(F.col("n_documents") > limit).select("line", "n_documents")


def judged(found: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE, depleted: int = DEPLETED_SHARE) -> DataFrame:
    """``found`` (a written :func:`measured` with unique ``_row``) with base_failed, removed, words_removed and kept.

    ``removed`` holds the positions of the lines above their limit, in order; only such lines are brought together by row.
    """
    frequent = materialise(frequent_lines(found, least, share), "frequent-lines")
    lines = found.select("_row", F.inline("_lines")).select("_row", "at", "line", "words")
    gone = lines.join(frequent, "line").groupBy(F.col("_row").alias("_r")).agg(
        F.array_sort(F.collect_list("at")).alias("_at"), F.sum("words").cast("long").alias("_gone"))
    out = found.join(gone, F.col("_row") == F.col("_r"), "left")
    words_removed = F.coalesce(F.col("_gone"), F.lit(0).cast("long"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words"))
    return out.withColumns({
        "base_failed": failed, "removed": F.coalesce(F.col("_at"), _nothing("int")), "words_removed": words_removed,
        "kept": ~failed & (100 * words_removed <= depleted * F.col("n_words"))}).drop("_r", "_at", "_gone")


def line_rules(docs: DataFrame, host: Column, key: str = "doc_id", text: str = "text", least: int = LEAST_DOCUMENTS, share: float = SHARE,
               depleted: int = DEPLETED_SHARE) -> DataFrame:
    """(key, measures, base_failed, kept, removed, words_removed) of every row.

    Lines are compared within a host in lower case with white space made single, by a 64-bit hash.  A line goes when
    more than ``least`` and more than ``share`` of the host's documents hold it (copies of one text count once);
    a document is rejected when its removed lines hold more than ``depleted`` per cent of its words, or by the base
    rules (fewer than 50 words, more than half of them in three-word windows found twice).

    Null texts are empty and fail the base rules; a null host is a host of its own; rows with null or equal keys are
    judged each on its own, so repeated rows repeat; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), host.alias("_of"))
    found = measured(rows, F.col("_text"), F.col("_of"), "_key").withColumn("_row", F.monotonically_increasing_id())
    out = judged(materialise(found, "line-measures"), least, share, depleted)
    return out.select(F.col("_key").alias(key), *MEASURES, "base_failed", "kept", "removed", "words_removed")


def cleaned_documents(docs: DataFrame, host: Column, text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their texts without the removed lines; all other columns as they are.

    Whole rows are written once beside their measures; a null text is never kept.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_doc"), F.col(text).alias("_text"), host.alias("_of"))
    found = measured(rows, F.col("_text"), F.col("_of"), "_doc").withColumn("_row", F.monotonically_increasing_id())
    out = judged(materialise(found, "line-measures"), **limits).filter("kept")
    lines = F.split(F.col("_doc").getField(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    short = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    clean = F.when(F.size("removed") == 0, F.col("_doc").getField(text)).otherwise(short)
    return out.select(*[clean.alias(c) if c == text else F.col("_doc").getField(c).alias(c) for c in docs.columns])
