"""Document fingerprints that follow edit distance: Order MinHash.

Marcais, DeBlasio, Pandey and Kingsford, "Locality-sensitive hashing for the edit distance" (2019):
k-mers are numbered by occurrence, those with minimal hashes are selected, and they are hashed
together in the order in which they stand in the text. Here a k-mer is ``WORDS`` words, and one hash
serves all entries: its top bits choose the entry, and the two smallest of each make its tuple. All
of it is DataFrame functions on arrays of longs, which hold a hash and a position each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered, table
from tidewatch.session import configure, settle

WORDS = 3
# Entries of a fingerprint, a power of two; the rest of 32 bits is the hash of the tuple.
ENTRY_BITS = 6
TUPLE_BITS = 32 - ENTRY_BITS
# Low bits that hold a position in the text: half a billion words.
PLACE_BITS = 29
PLACES = (1 << PLACE_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas in it read it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(value: Column) -> Column:
    """Of an element known to be there, so that arrays of it can be sorted as plain longs."""
    return F.coalesce(value, F.lit(0).cast("long"))


def _placed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~PLACES)).bitwiseOR(place)


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _kmers(text: Column) -> Column:
    """Sorted hash and place of every k-mer; a text with fewer words is one k-mer."""
    blanks = F.translate(text, "\t\n\x0b\f\r", "     ")
    words = F.filter(F.split(blanks, " "), lambda word: word != "")
    hashed = F.transform(words, lambda word: F.xxhash64(word))

    def at(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(hashes) - WORDS, F.lit(0)))
        kmer = F.transform(
            places,
            lambda i: _placed(F.xxhash64(*(F.get(hashes, i + j) for j in range(WORDS))), i.cast("long")),
        )
        return F.when(F.size(hashes) == 0, F.slice(hashes, 1, 0)).otherwise(F.sort_array(kmer))

    return _let(hashed, at)


def _numbered(kmers: Column) -> Column:
    """New hashes of k-mer and occurrence number, with the same places, sorted.

    Equal k-mers stand together in text order. First occurrences are the elements that differ from
    the one before; longer runs are found by their first and last element.
    """
    n = F.size(kmers)

    def same(i: Column) -> Column:
        """Whether element i equals the one before it."""
        return F.coalesce(_hash_of(F.get(kmers, i)) == _hash_of(F.get(kmers, i - 1)), F.lit(False))

    def mixed(packed: Column, occurrence: Column) -> Column:
        return _placed(F.xxhash64(_hash_of(packed), occurrence), packed.bitwiseAND(F.lit(PLACES)))

    first = F.transform(F.filter(kmers, lambda x, i: ~same(i)), lambda x: mixed(x, F.lit(0)))
    indices = F.sequence(F.lit(0), n - 1)
    heads = F.filter(indices, lambda i: ~same(i) & same(i + 1))
    tails = F.filter(indices, lambda i: same(i) & ~same(i + 1))

    def run(a: Column, b: Column) -> Column:
        inner = F.sequence(a + 1, b)
        return F.transform(inner, lambda i: mixed(_long(F.get(kmers, i)), i - a))

    def with_runs(found: Column) -> Column:
        runs = F.flatten(F.zip_with(heads, tails, run))
        return F.when(F.size(found) < n, F.concat(found, runs)).otherwise(found)

    merged = F.transform(_let(first, with_runs), _long)
    return F.when(n == 0, kmers).otherwise(F.sort_array(merged))


def _entries(ranked: Column) -> Column:
    """Per entry, the hash of its two smallest elements in text order."""

    def entry_of(x: Column) -> Column:
        return F.shiftright(x, 64 - ENTRY_BITS)

    def differs(array: Column, i: Column, back: int) -> Column:
        past = F.get(array, i - back)
        return F.coalesce(entry_of(F.get(array, i)) != entry_of(past), F.lit(True))

    def tuples(least: Column) -> Column:
        starts = F.filter(
            F.transform(least, lambda x, i: i), lambda i: differs(least, i, 1)
        )

        def entry(i: Column) -> Column:
            a, after = F.get(least, i), F.get(least, i + 1)
            b = F.when(entry_of(after) == entry_of(a), after)
            swap = a.bitwiseAND(F.lit(PLACES)) > b.bitwiseAND(F.lit(PLACES))
            ordered = F.when(swap, F.xxhash64(_hash_of(b), _hash_of(a))).otherwise(
                F.xxhash64(_hash_of(a), _hash_of(b))
            )
            low = ordered.bitwiseAND(F.lit((1 << TUPLE_BITS) - 1))
            return F.shiftleft(entry_of(a), TUPLE_BITS).bitwiseOR(low).cast("int")

        return F.transform(starts, entry)

    least = F.filter(ranked, lambda x, i: differs(ranked, i, 2))
    return _let(least, tuples)


def order_minhash(text: Column) -> Column:
    """The fingerprint: for every entry that has a k-mer, its number and tuple hash in one int."""
    return _let(_kmers(text), lambda kmers: _let(_numbered(kmers), _entries))


def as_text(entries: Column) -> Column:
    """Eight hex digits per entry; empty for a text without words."""
    digits = F.transform(entries, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Equal entries of those that either has; two empty fingerprints are alike."""

    def numbers(entries: Column) -> Column:
        return F.transform(entries, lambda x: F.shiftright(x, TUPLE_BITS))

    either = F.size(F.array_union(numbers(a), numbers(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every text, its successor's first code points in place of its last quarter, and fingerprints.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Documents follow each other by
    id, null first, and the first follows the last. Null text is empty. Rows that share an id are one
    document, the one with the smallest text. Returns ``doc_id``, ``n_chars``, ``edited``, and
    ``entries``, ``edited_entries``, ``next_entries``.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = settle(docs.select("doc_id", F.length("text").alias("n")))
    if not sizes.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        sizes = settle(docs.select("doc_id", F.length("text").alias("n")))
    total = sizes.count()
    order = settle(numbered(sizes, [F.col("doc_id")], "at"))
    follows = F.expr(f"b.at = (a.at + 1) % {max(total, 1)}")
    pairs = settle(
        order.alias("a").join(order.alias("b"), follows)
        .select("a.doc_id", F.col("b.doc_id").alias("next_id"), F.floor(F.col("a.n") / 4).cast("int").alias("quarter"))
    )

    whole = docs.select("doc_id", "text", order_minhash(F.col("text")).alias("entries"))
    after = whole.alias("t").join(pairs.alias("p"), F.col("t.doc_id").eqNullSafe(F.col("p.next_id")))
    after = after.select(
        F.col("p.doc_id"), "quarter", F.left("t.text", F.col("quarter")).alias("start"),
        F.col("t.entries").alias("next_entries"),
    )
    both = whole.alias("t").join(after.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")))
    n = F.length("t.text")
    edited = F.concat(F.left("t.text", n - F.col("quarter")), F.col("start"))
    rows = both.select(
        "t.doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "t.entries", "next_entries"
    )
    return rows.withColumn("edited_entries", order_minhash(F.col("edited")))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    rows = edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("entries")).alias("fingerprint"),
        as_text(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )
