"""Document fingerprints of closed syncmers with their places, in DataFrame functions alone.

A text's units are short runs of characters that end at white space or after certain characters, so where a unit begins and ends depends
on its own characters alone, never on a count from some earlier place. A k-mer is K units in a row. It is a closed syncmer if the
smallest of its inner s-mers, by hash, is its first or its last; that depends on the k-mer alone and not on what surrounds it, so an edit
moves no anchor that it doesn't touch. A fingerprint holds all syncmers of the text with the unit each begins at. Two
fingerprints are matched anchor by anchor and by place: what counts are matches in one band of diagonals, so passages that
stand in another order match in part only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import text_of

#: Characters that go on with a unit. It ends before white space and after any other character: a rare letter, two digits, a mark, any
#: character beyond ASCII. They are listed one by one, as the pattern's classes are looked up in a table then, not tried range by range.
GOES_ON = "ACDEFHILMNOPRSTUWacdefhilmnoprstuw02345689"
#: Where LONG or more such characters stand in a row, a unit ends after the third or a later one that is one of these.
TURNS = "AEIOUNSTaeiounst02468"
LONG = 16
_ON_ALONE = "".join(c for c in GOES_ON if c not in TURNS)
UNIT = rf"[{GOES_ON}]{{1,{LONG - 1}}}+(?![{GOES_ON}])[^\s{GOES_ON}]?|[{GOES_ON}]{{2}}[{_ON_ALONE}]*+[{TURNS}]|[{GOES_ON}]++[^\s{GOES_ON}]?|[^\s{GOES_ON}]"
K, S = 4, 2
#: So many k-mers at either end of a text are anchors whether they are closed or not.
ENDS = 2
#: Two neighbouring bins of offsets are a band; a bin is this part of the longer text's units.
BINS = 16
#: Bits of an anchor's hash that take part in matching; the rest of a long holds its side and its place.
_PLACE = _SIDE = 1 << 31
_TOP = 32
#: Ranges of ids for each partition.
RANGES = 2


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once: lambda variables are bound, not copied into the expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def unit_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))


def places(text: Column) -> Column:
    """The anchors of a text in its order, as a struct of two arrays: hashes, and the unit that each begins at.

    Anchors are all closed syncmers, and the first two and last two k-mers, all named alike. Only texts of less than K units, which have no k-mer,
    have their pairs of units; one of a single unit has that.
    """

    def of_units(h: Column) -> Column:
        pairs = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(h) > 1, _let(pairs, of_pairs)).otherwise(F.struct(h.alias("hash"), F.transform(h, lambda x, i: i).alias("at")))

    def of_pairs(p: Column) -> Column:
        # Four units hold three pairs. A k-mer whose middle pair is smaller than both others isn't closed; its outer pairs cover and name it.
        last = F.size(p) - (K - S + 1)
        closed = lambda i: F.least(F.get(p, i), F.get(p, i + 2)) <= F.get(p, i + 1)
        inner = F.filter(F.sequence(F.lit(ENDS), last - ENDS), closed)
        ends = lambda first: F.sequence(first, first + (ENDS - 1))
        found = F.when(last < 2 * ENDS, F.sequence(F.lit(0), last)).otherwise(F.concat(ends(F.lit(0)), inner, ends(last - (ENDS - 1))))
        every = F.struct(p.alias("hash"), F.transform(p, lambda x, i: i).alias("at"))
        named = _let(found, lambda at: F.struct(F.transform(at, lambda i: F.xxhash64(F.get(p, i), F.get(p, i + 2))).alias("hash"), at.alias("at")))
        return F.when(last >= 0, named).otherwise(every)

    return _let(unit_hashes(text), of_units)


def printed(marks: Column) -> Column:
    """Anchors as a string in the text's order: the hash in hexadecimal, a colon, the place, and a full stop."""
    return F.array_join(F.zip_with(marks["hash"], marks["at"], lambda h, at: F.concat(F.hex(h), F.lit(":"), at.cast("string"))), ".")


def _first_of_runs(ordered: Column) -> Column:
    """Where runs of equal neighbours begin in a sorted array, with the array's size at the end."""
    return F.concat(F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))), F.array(F.size(ordered)))


def told_apart(marks: Column) -> Column:
    """One long an anchor, that no other anchor of the text has: the top bits of its hash, and its place. Repeats after the first are hashed with their number.

    Only texts with repeats are numbered. Every place that a text can have is held whole.
    """
    hashed = lambda h, at: h.bitwiseAND(F.lit(-2 * _SIDE)).bitwiseOR(at.cast("long").bitwiseAND(F.lit(_PLACE - 1)))

    def numbered(c: Column) -> Column:
        again = lambda x, i: (i > 0) & (F.shiftright(x, _TOP) == F.shiftright(F.get(c, i - 1), _TOP))
        return F.concat(F.filter(c, lambda x, i: ~again(x, i)), _let(F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: again(F.get(c, i), i)), lambda r: of_repeats(c, r)))

    def of_repeats(c: Column, r: Column) -> Column:
        # Repeats of one hash stand next to each other, after its first anchor; the next hash's come after a gap.
        first = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda j: (j == 0) | (F.get(r, j) != F.get(r, j - 1) + 1))
        numbers = _let(first, lambda f: F.flatten(F.zip_with(f, F.concat(F.slice(f, 2, F.size(f)), F.array(F.size(r))), lambda a, b: F.sequence(F.lit(1), b - a))))
        renamed = lambda i, k: hashed(F.xxhash64(F.get(c, i).bitwiseAND(F.lit(-2 * _SIDE)), k), F.get(c, i).bitwiseAND(F.lit(_PLACE - 1)))
        return F.when(F.size(r) > 0, F.zip_with(r, numbers, renamed)).otherwise(F.array().cast("array<bigint>"))

    packed = F.zip_with(marks["hash"], marks["at"], hashed)
    many = F.size(F.array_distinct(marks["hash"])) < F.size(marks["hash"])
    return F.when(many, _let(F.sort_array(packed), numbered)).otherwise(packed)


def matched(a: Column, b: Column) -> Column:
    """How two texts' anchors (longs of `told_apart`) match: a struct of near, placed and offset.

    The k-th anchor of a hash in one meets the k-th of that hash in the other. `near` is the Dice coefficient of the matches whose offsets
    lie in the best band: two neighbouring bins of a sixteenth of the longer text's anchors, in units. `placed` counts only the matches of the
    commonest offset, and `offset` is that one in units (ties: the smaller one, then the lower). Two texts without anchors are alike (1); one
    without is like no other (0).
    """
    none = F.array().cast("array<int>")
    top = lambda x: F.shiftright(x, _TOP)
    place = lambda x: x.bitwiseAND(F.lit(_PLACE - 1)).cast("int")

    def of_both(c: Column) -> Column:
        steps = F.filter(F.sequence(F.lit(1), F.size(c) - 1), lambda i: top(F.get(c, i)) == top(F.get(c, i - 1)))
        return F.sort_array(F.transform(steps, lambda i: place(F.get(c, i)) - place(F.get(c, i - 1))))

    # A bin is measured by anchors, of which there are fewer than units, and no less than one.
    width = F.greatest(F.floor(F.greatest(F.size(a), F.size(b)) * 3 / (2 * BINS)), F.lit(1))
    bin_of = lambda x: F.floor((x + F.floor(width / 2)) / width)

    def best_of(o: Column) -> Column:
        run = _let(
            _first_of_runs(o),
            lambda f: F.array_max(F.zip_with(F.slice(f, 1, F.size(f) - 1), F.slice(f, 2, F.size(f)), lambda i, j: F.struct((j - i).alias("n"), (-F.abs(F.get(o, i))).alias("short"), (-F.get(o, i)).alias("low")))),
        )
        bins = F.transform(o, lambda x: bin_of(x))
        band = _let(
            bins,
            lambda v: _let(
                _first_of_runs(v),
                lambda f: F.array_max(
                    F.transform(F.sequence(F.lit(0), F.size(f) - 2), lambda i: F.when(F.get(v, F.get(f, i + 1)) == F.get(v, F.get(f, i)) + 1, F.get(f, i + 2)).otherwise(F.get(f, i + 1)) - F.get(f, i))
                ),
            ),
        )
        return F.when(F.size(o) > 0, F.struct(run.alias("run"), band.alias("band")))

    def in_numbers(m: Column) -> Column:
        total = F.size(a) + F.size(b)
        return F.struct(
            F.when(total == 0, F.lit(1.0)).otherwise(2 * F.coalesce(m["band"], F.lit(0)) / total).alias("near"),
            F.when(total == 0, F.lit(1.0)).otherwise(2 * F.coalesce(m["run"]["n"], F.lit(0)) / total).alias("placed"),
            (-m["run"]["low"]).alias("offset"),
        )

    # Texts without a common hash are told by a set, unsorted; most pairs of documents are such.
    meet = F.arrays_overlap(F.transform(a, top), F.transform(b, top))
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(_SIDE)))))
    offsets = F.when(meet, _let(both, of_both)).otherwise(none)
    return _let(_let(offsets, best_of), in_numbers)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document's whole text, and of the text edited with the next document's beginning.

    Takes any frame with doc_id and text. The edited text has its last floor(n / 4) code points replaced by the first as many (or all) of
    the next document by id; the last document's next is the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and of both matches the share and the offset of the anchors on the commonest diagonal
    (placed_edited, offset_edited, placed_next, offset_next).

    Null texts are empty and have an empty fingerprint. A null id counts as the largest. Rows that repeat an id share the next
    document; as a next document, such rows stand for the text of the smallest hash. A single document follows itself. An empty table
    gives no rows; further columns are ignored.
    """
    last = F.lit((1 << 63) - 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("key", F.coalesce("doc_id", last))
    part, before = _key_ranges(texts.select("key"))

    # Texts are dealt once, by ranges of ids, in which a text's next is the row beside it; each range also gets the next one's first text. Anchors are larger than texts and found after it.
    tie = F.xxhash64("text", "doc_id")
    beyond = texts.join(F.broadcast(before), "key").groupBy("part").agg(F.min_by("text", tie).alias("text"))
    beyond = beyond.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("key"), "part", F.lit(0).cast("long").alias("tie"))
    dealt = texts.select("doc_id", "text", "key", part.alias("part"), tie.alias("tie")).unionByName(beyond)
    by = Window.partitionBy("part").orderBy(F.desc_nulls_first("key"), F.desc("tie"))
    # Of rows that share an id the last stands beside the rows before it, which all take what the first of them found.
    met = dealt.withColumn("sent", F.when(~F.lag("key").over(by).eqNullSafe(F.col("key")), F.lag("text").over(by)))
    met = met.withColumn("sent", F.last("sent", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("key is not null").select("doc_id", "text", "sent")
    met = met.withColumn("n", F.length("text")).withColumn("cut", F.floor(F.col("n") / 4).cast("int"))
    met = met.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("cut")), F.substring(F.col("sent"), F.lit(1), F.col("cut"))))
    met = met.withColumns({"marks": places(F.col("text")), "edited_marks": places(F.col("edited")), "next_marks": places(F.col("sent"))})
    met = met.withColumns({x: told_apart(F.col(y)) for x, y in (("own", "marks"), ("changed", "edited_marks"), ("after", "next_marks"))})
    met = met.withColumns({"to_edited": matched(F.col("own"), F.col("changed")), "to_next": matched(F.col("own"), F.col("after"))})
    return met.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("marks")).alias("fingerprint"),
        printed(F.col("edited_marks")).alias("edited_fingerprint"),
        F.col("to_edited.near").alias("near_edited"),
        F.col("to_next.near").alias("near_next"),
        F.col("to_edited.placed").alias("placed_edited"),
        F.col("to_edited.offset").alias("offset_edited"),
        F.col("to_next.placed").alias("placed_next"),
        F.col("to_next.offset").alias("offset_next"),
    )


def _key_ranges(keys: DataFrame) -> tuple[Column, DataFrame]:
    """The range that a key lies in, by about equal numbers of keys, and for each range that has any the first key of the next one, of the last the smallest: rows (key, part).

    Only keys are read; there are RANGES ranges for each partition that Spark deals to, so those are about equal, too.
    """
    n = RANGES * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(x) for x in keys.approxQuantile("key", [i / n for i in range(1, n)], 1 / (20 * n))}) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(min(x, (1 << 63) - 1)).cast("long") for x in bounds]).cast("array<bigint>"), lambda x: x <= F.col("key")))
    firsts = keys.select("key", part.alias("part")).groupBy("part").agg(F.min("key").alias("key"))
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    return part, firsts.select("key", before.alias("part"))
