"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as sequences of words.  Two lines match if they are equal or, from
NEAR_WORDS words on, if one insertion, deletion or replacement of a word turns one into
the other.  A line goes if an earlier line, by (doc_id, line number), matches it; the
earliest stays.

Plan.  Texts are split once into hashes of lines, and equal lines become one row by a
map-side combined aggregation.  Emitting every deletion variant of every line would
multiply the corpus by its line length, so lines first meet on what an edit leaves
alone: of two lines within one edit, the first or the second half of the shorter one's
length is the same in both.  Lines that share a half emit the variants of the other half,
which loses no match.  Equal variants are then joined as a star, each line to the earliest
of its variant, so a hot variant costs rows in proportion to its lines; each pair is
verified on its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch

#: Least words of lines that also match within one edit; one word is an eighth of them at most.
NEAR_WORDS = 8


def _folded(line: Column) -> Column:
    """The words of a line, each parted from the next by one space.  Most lines are that already, and are only looked at."""
    odd = line.rlike(r"[\x09-\x0D]") | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _half(line: Column, short: Column, side: int) -> Column:
    """Hash of the first (side 0) or the second half, in words, of a line of ``short`` words, counted from that end."""
    first = F.floor(short / 2).cast("int")
    return F.xxhash64(short, F.lit(side), F.call_function("substring_index", line, F.lit(" "), first if side == 0 else first - short))


#: Which halves a line offers: of its own length or of one word less (as the longer of two), and which side.
HALVES = [(less, side) for less in (0, 1) for side in (0, 1)]


def _lines(docs: DataFrame, near_words: int) -> DataFrame:
    """doc_id, line, h1, h2 and the halves k0 to k3 of every line with a word; halves are null below ``near_words``."""
    each = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    each = each.select("doc_id", "line", _folded(F.col("t")).alias("t")).filter("t <> ''")
    each = each.withColumn("n", (F.octet_length("t") - F.octet_length(F.replace(F.col("t"), F.lit(" "), F.lit(""))) + 1).cast("int"))
    h1, h2 = _hashes(F.col("t"))
    halves = [F.when(F.col("n") >= near_words, _half(F.col("t"), F.col("n") - less, side)).alias(f"k{k}") for k, (less, side) in enumerate(HALVES)]
    return each.select("doc_id", "line", h1.alias("h1"), h2.alias("h2"), *halves)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether the word sequences are within one edit: a common beginning and end leave at most one word of either."""
    shorter = F.least(F.size(a), F.size(b))
    same = lambda x, y: F.coalesce(F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False), F.lit(0))
    ahead = F.when(same(a, b) == 0, shorter).otherwise(F.least(same(a, b).cast("int") - 1, shorter))
    behind = F.when(same(F.reverse(a), F.reverse(b)) == 0, shorter).otherwise(F.least(same(F.reverse(a), F.reverse(b)).cast("int") - 1, shorter))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (ahead + behind >= F.greatest(F.size(a), F.size(b)) - 1)


_LINES = 2147483648  # line numbers are below this


def _place(doc: Column, line: Column) -> Column:
    """(doc_id, line number) as one number, which aggregates by hashing where a struct would need a sort."""
    return (doc.cast("decimal(20,0)") * F.lit(_LINES).cast("decimal(10,0)") + line.cast("decimal(10,0)")).cast("decimal(31,0)")


def _parts_of(place: Column) -> Column:
    line = F.pmod(place, F.lit(_LINES).cast("decimal(31,0)"))
    return F.struct(((place - line) / F.lit(_LINES).cast("decimal(10,0)")).cast("long").alias("doc_id"), line.cast("int").alias("line"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once for each row, however often it is used afterwards: a generator of one row stands between."""
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _words_at(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """h1, h2, place, words of the lines (h1, h2, place), from the documents where they come first."""
    at = _parts_of(F.col("place"))
    wanted = lines.select("h1", "h2", "place", at.alias("at")).groupBy("at.doc_id").agg(F.collect_list(F.struct("at.line", "h1", "h2", "place")).alias("wanted"))
    found = _once(docs.join(wanted.hint("merge"), "doc_id"), "all", F.split("text", "\n"))
    each = found.select(F.inline(F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["place"].alias("place"), F.get("all", w["line"]).alias("t")))))
    each = each.select("h1", "h2", "place", _folded(F.col("t")).alias("t"))
    same = [x == F.col(h) for x, h in zip(_hashes(F.col("t")), ("h1", "h2"), strict=True)]  # rows may repeat a doc_id with another text
    return each.filter(same[0] & same[1]).dropDuplicates(["h1", "h2"]).select("h1", "h2", "place", F.split("t", " ").alias("words"))


def _variants(met: DataFrame, worded: DataFrame) -> DataFrame:
    """h1, h2, place, role, key: the deletion variants of every line, for every half that it shares with another line.

    The edit is in the other half, so only words of that are deleted.  A variant's hash
    is the exclusive or of its words' hashes, each with its place in the variant, so one
    pass over the half makes those of all deletions, however long the line.
    Role 0 is the half as it is and role 1 the half without a word, which meet for lines
    that differ by an insertion; role 2, the half without the word at one place, meets
    itself for lines that differ by a replacement.
    """
    n, short = F.size("words"), F.size("words") - F.col("less")
    first = F.floor(short / 2).cast("int")
    free = F.when(F.col("side") == 0, F.slice("words", first + 1, n - first)).otherwise(F.slice("words", F.lit(1), first + F.col("less")))
    rows = met.join(worded, ["h1", "h2"]).select("h1", "h2", "place", "half", "less", free.alias("free"))
    xor = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    own = rows.filter("less = 0").withColumn("hashes", F.transform("free", lambda w, k: F.xxhash64(w, k)))
    own = _once(own, "total", xor("hashes")).select("h1", "h2", "place", "half", "total", F.posexplode("hashes").alias("k", "x"))
    key = F.xxhash64("half", "k", F.col("total").bitwiseXOR(F.col("x")))
    whole = own.filter("k = 0").select("h1", "h2", "place", F.lit(0).alias("role"), F.xxhash64("half", "total").alias("key"))
    replaced = own.select("h1", "h2", "place", F.lit(2).alias("role"), key.alias("key"))
    # Words behind the deleted one move up by a place.
    moved = rows.filter("less = 1").withColumn("up", F.transform("free", lambda w, k: F.xxhash64(w, k - 1)))
    moved = _once(moved, "total", xor("up")).select("h1", "h2", "place", "half", "total", F.posexplode("free").alias("k", "w"))
    moved = moved.withColumn("up", F.xxhash64("w", F.col("k") - 1)).withColumn("change", F.xxhash64("w", "k").bitwiseXOR(F.col("up")))
    before = F.bit_xor("change").over(Window.partitionBy("h1", "h2", "half").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # ``before`` and ``change`` both hold the word itself, which cancels out.
    left = F.col("total").bitwiseXOR(F.col("up")).bitwiseXOR(before).bitwiseXOR(F.col("change"))
    shorter = moved.select("h1", "h2", "place", F.lit(1).alias("role"), F.xxhash64("half", left).alias("key"))
    return whole.unionByName(replaced).unionByName(shorter)


def duplicate_lines(docs: DataFrame, scratch: Scratch, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, lines array<int>: numbers from 0 of the lines that go, for documents that lose some."""
    seen = scratch.table(_lines(docs, near_words), "lines")
    keys = [f"k{k}" for k in range(len(HALVES))]
    equal = seen.groupBy("h1", "h2").agg(F.min(_place(F.col("doc_id"), F.col("line"))).alias("place"), F.count("*").alias("n"), *(F.min(k).alias(k) for k in keys))
    distinct = scratch.table(equal, "distinct")

    # Halves that several lines share, and the words of those lines.
    every = distinct.filter("k0 IS NOT NULL").select("h1", "h2", "place", F.posexplode(F.array(*keys)).alias("k", "half"))
    common = every.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("half")
    met = scratch.table(every.join(common, "half", "left_semi"), "met")
    worded = scratch.table(_words_at(docs, met.select("h1", "h2", "place").distinct()), "worded")
    less, side = (F.element_at(F.array(*(F.lit(x[c]) for x in HALVES)), F.col("k") + 1) for c in (0, 1))
    met = met.select("h1", "h2", "half", less.alias("less"), side.alias("side"))

    scratch.release()
    variants = scratch.table(_variants(met, worded), "variants")
    # Role 0 meets role 1 and role 2 itself; a line is near an earlier one if the earliest line that it meets is earlier.
    at_least = variants.groupBy("key", F.col("role") == 2).agg(*(F.min(F.when(F.col("role") == r, F.col("place"))).alias(f"e{r}") for r in range(3)), F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    at_least = at_least.filter("lo < hi").select("key", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"e{to}").alias("to")) for r, to in ((0, 1), (1, 0), (2, 2))))).alias("x")).select("key", "x.role", "x.to")
    pairs = variants.join(at_least.filter("to IS NOT NULL"), ["key", "role"]).filter("to < place").select("h1", "h2", "to").distinct()
    other = worded.select(F.col("place").alias("to"), F.col("words").alias("to_words"))
    near = pairs.join(worded.select("h1", "h2", "words"), ["h1", "h2"]).join(other, "to").filter(_one_edit(F.col("words"), F.col("to_words"))).select("h1", "h2").distinct()
    near = scratch.table(near, "near")

    # What goes: lines whose earliest equal is elsewhere, and all copies of lines near an earlier one.
    fates = distinct.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").filter("n > 1 OR near").select("h1", "h2", "place", "near")
    gone = seen.select("doc_id", "line", "h1", "h2").join(fates, ["h1", "h2"]).filter(F.coalesce("near", F.lit(False)) | (_place(F.col("doc_id"), F.col("line")) != F.col("place")))
    gone = scratch.table(gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "gone")
    scratch.drop("lines", "distinct", "met", "worded", "variants", "near")
    scratch.release()
    return gone


def _kept(rows: DataFrame) -> DataFrame:
    """``rows`` (text, lines) with kept, the text without those lines; each text is split once, and only where lines go."""
    rows = _once(rows, "all", F.when(F.col("lines").isNotNull(), F.split("text", "\n")))
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("lines"))
    return rows.withColumn("kept", F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda k: F.get("all", k)), "\n")))


def dedup_lines(spark: SparkSession, documents: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, text: every document with the lines that stay.

    Null texts stay null, with no lines; empty ones are one empty line, and lines without
    a word always stay.  Within a document, too, the first of several matching lines
    stays.  Rows without a doc_id keep their text, having no place in the order; rows that
    repeat a doc_id count as the same place, so equal lines at one line number all stay.
    Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = duplicate_lines(docs, Scratch(spark, "lines"), near_words)
    both = _kept(docs.join(gone.hint("merge"), "doc_id", "left"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return both.select("doc_id", F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.col("kept").alias("text"))


def deduplicated(spark: SparkSession, documents: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """``documents`` with their columns, lines that go taken out of ``text`` and ``n_chars`` counted anew.

    Documents that lose their last word go; nulls, empties and repeats as in
    ``dedup_lines``.  Columns of any other name are handed through.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = duplicate_lines(docs, Scratch(spark, "lines"), near_words)
    packed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    both = _kept(packed.join(gone.hint("merge"), "doc_id", "left")).filter(F.col("lines").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    kinds = dict(documents.dtypes)
    new = {"text": F.col("kept").cast(kinds["text"]), "n_chars": F.when(F.col("lines").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast(kinds["n_chars"])) if "n_chars" in kinds else None}
    return both.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in documents.columns))
