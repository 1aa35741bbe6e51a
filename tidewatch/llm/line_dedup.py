"""Remove passages of lines that repeat across documents, found by a window at every line.

A passage is worth removing from two lines with LEAST_CHARS code points on, or as one long line. From
every line, the shortest such window that starts there and the shortest that ends there are hashed;
they depend on nothing outside them. Wherever a passage repeats, whatever stands around it, all
windows inside it repeat too, and together they cover it from its first line to its last. The first
occurrence of a window stays, later ones go, line by line, after each line has been compared with
that of the first. Everything is DataFrame functions: windows are grouped by hash as a few longs
each, and only texts of repeated lines travel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table, word_count
from tidewatch.session import configure, settle

# Lines are a passage with at least so many code points together, a line of LONG_LINE code points or
# of more than LONG_WORDS words by itself.
LEAST_CHARS = 40
LONG_LINE = 300
LONG_WORDS = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas in it read it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _is_long(line: Column) -> Column:
    chars = F.length(line)
    # More than LONG_WORDS words have at least as many code points and one less between them.
    wordy = F.when(chars > 2 * LONG_WORDS, word_count(line) > LONG_WORDS).otherwise(F.lit(False))
    return (chars >= LONG_LINE) | wordy


def line_windows(text: Column) -> Column:
    """Windows of a text as structs of ``no``, the first line's number, ``n_lines`` and ``window``, a hash.

    Empty lines do not count as lines, but how many stand between others is part of the hash. Each of
    the others has a code point, so no window needs more than LEAST_CHARS of them.
    """

    def unit(line: Column, at: Column) -> Column:
        return F.struct(
            at.alias("at"),
            F.length(line).alias("chars"),
            _is_long(line).alias("alone"),
            F.xxhash64(line).alias("hash"),
        )

    def other_end(units: Column, i: Column, step: int) -> Column:
        """The unit at which the shortest window from unit i on ends, -1 if none does."""
        last = F.size(units) - 1
        far = F.least(i + LEAST_CHARS, last) if step > 0 else F.greatest(i - LEAST_CHARS, F.lit(0))

        def further(state: Column, j: Column) -> Column:
            chars = state["chars"] + F.get(units, j)["chars"]
            ends = (state["end"] < 0) & (j != i) & (chars >= LEAST_CHARS)
            return F.struct(chars.alias("chars"), F.when(ends, j).otherwise(state["end"]).alias("end"))

        start = F.struct(F.lit(0).alias("chars"), F.lit(-1).alias("end"))
        own, after = F.get(units, i), F.get(units, i + step)
        searched = F.aggregate(F.sequence(i, far), start, further, lambda state: state["end"])
        return (
            F.when(own["alone"], i)
            .when(own["chars"] + after["chars"] >= LEAST_CHARS, i + step)
            .otherwise(searched)
        )

    def listed(units: Column) -> Column:
        def window(a: Column, b: Column) -> Column:
            start = F.get(units, a)["at"]
            inside = F.slice(units, a + 1, b - a + 1)
            hashed = F.xxhash64(F.transform(inside, lambda u: F.struct(u["hash"], u["at"] - start)))
            size = F.get(units, b)["at"] - start + 1
            return F.struct(start.alias("no"), size.alias("n_lines"), hashed.alias("window"))

        def windows(ends: Column) -> Column:
            def span(a: Column, b: Column) -> Column:
                return F.struct(a.alias("a"), b.alias("b"))

            forward = F.transform(ends, lambda b, a: span(a, b))
            back = F.transform(ends, lambda _, b: span(other_end(units, b, -1), b))
            new = F.filter(back, lambda s: (s["a"] >= 0) & (F.get(ends, s["a"]) != s["b"]))
            spans = F.concat(F.filter(forward, lambda s: s["b"] >= 0), new)
            return F.transform(spans, lambda s: window(s["a"], s["b"]))

        return _let(F.transform(units, lambda _, i: other_end(units, i, 1)), windows)

    units = F.filter(F.transform(_lines(text), unit), lambda u: u["chars"] > 0)
    return _let(units, listed)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines in later occurrences of a window, with the lines of the first one.

    Returns ``doc_id``, ``digest`` (of the text), ``no`` and ``first_line``: the line with that number
    is in a window that has the hash of one that comes earlier, by id (null last), digest and number.
    Lines that are also in that first occurrence itself are not among them.
    """
    digest = F.xxhash64("text").alias("digest")
    windows = settle(docs.select("doc_id", digest, F.inline(line_windows(F.col("text")))))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "no")
    groups = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    groups = settle(groups.where("first != last").select("window", "first"))

    later = windows.join(groups, "window").where(place != F.col("first"))
    later = later.select("doc_id", "digest", "no", "n_lines", "first").withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.col("n_lines") - 1))
    )
    in_first = (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        & (F.col("digest") == F.col("first.digest"))
        & (F.col("no") + F.col("step") < F.col("first.no") + F.col("n_lines"))
    )
    source = F.struct(
        "first.unnamed", "first.doc_id", "first.digest", (F.col("first.no") + F.col("step")).alias("no")
    )
    lines = (
        later.where(~in_first)
        .groupBy("doc_id", "digest", (F.col("no") + F.col("step")).alias("no"))
        .agg(F.min(source).alias("s"))
    )
    lines = settle(
        lines.select(
            "doc_id", "digest", "no",
            F.col("s.doc_id").alias("first_id"), F.col("s.digest").alias("first_digest"), F.col("s.no").alias("first_no"),
        )
    )

    firsts = lines.groupBy("first_id", "first_digest").agg(F.collect_set("first_no").alias("own"))
    holders = docs.select("doc_id", "text", digest).alias("d").join(
        firsts.alias("f"),
        F.col("d.doc_id").eqNullSafe(F.col("f.first_id")) & (F.col("d.digest") == F.col("f.first_digest")),
    )
    taken = _let(
        _lines(F.col("text")),
        lambda all_lines: F.transform(
            "own", lambda no: F.struct(no.alias("first_no"), F.get(all_lines, no).alias("first_line"))
        ),
    )
    at = ["first_id", "first_digest", "first_no"]
    texts = holders.select("first_id", "first_digest", F.inline(taken))
    texts = settle(texts.groupBy(*at).agg(F.first("first_line").alias("first_line")))
    same = [F.col(f"l.{name}").eqNullSafe(F.col(f"t.{name}")) for name in at]
    return lines.alias("l").join(texts.alias("t"), same).select("doc_id", "digest", "no", "first_line")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``, and ``removed_chunks`` appended.

    ``docs`` has ``doc_id`` and ``text``; all its columns and rows are returned. ``removed_chunks`` is
    the number of runs of lines that went. Null texts stay null. A text that loses nothing is returned
    as it is; one that loses everything is empty. Rows that agree in id and text are one document, so
    a passage does not repeat between them, though it does within one. Empty lines at the edges of a
    passage stay. No rows give no rows.
    """
    columns = [F.col(f"d.{name}") for name in docs.columns if name != "text"]
    gone = (
        repeated_lines(docs)
        .groupBy("doc_id", "digest")
        .agg(F.sort_array(F.collect_list(F.struct("no", "first_line"))).alias("later"))
    )
    keyed = docs.withColumn("_digest", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d._digest") == F.col("g.digest"))

    def cleaned(lines: Column, gone: Column) -> Column:
        """What stands between the numbers in ``gone``, and how many runs these make."""

        def past(j: Column) -> Column:
            return F.coalesce(F.get(gone, j - 1), F.lit(-1))

        def run(no: Column, j: Column) -> Column:
            return F.slice(lines, past(j) + 2, no - past(j) - 1)

        last = past(F.size(gone))
        tail = F.slice(lines, last + 2, F.size(lines) - last - 1)
        left = F.concat(F.flatten(F.transform(gone, run)), tail)
        heads = F.filter(gone, lambda no, j: (j == 0) | (no != past(j) + 1))
        return F.struct(F.array_join(left, "\n").alias("text"), F.size(heads).alias("removed"))

    def verified(lines: Column) -> Column:
        """Numbers of the listed lines that equal the first ones."""
        equal = F.filter("g.later", lambda x: F.get(lines, x["no"]) == x["first_line"])
        return F.transform(equal, lambda x: x["no"])

    clean = _let(
        _lines(F.col("d.text")),
        lambda lines: _let(verified(lines), lambda found: cleaned(lines, found)),
    )
    joined = keyed.join(gone.alias("g"), same, "left")
    joined = joined.withColumn("_clean", F.when(F.col("g.later").isNotNull(), clean))
    lost = F.coalesce(F.col("_clean.removed"), F.lit(0))
    text = F.when(lost > 0, F.col("_clean.text")).otherwise(F.col("d.text"))
    out = joined.select(*columns, text.alias("text"), lost.alias("removed_chunks"))
    return out.select(*docs.columns, "removed_chunks")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "removed_chunks",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
