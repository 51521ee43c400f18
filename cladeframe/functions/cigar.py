"""CIGAR and MD walks as higher-order functions: spans, aligned bases, edits, uncalled bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTS = "array<int>"


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>>."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def reference_span(cigar: Column) -> Column:
    """Reference bases that the alignment covers."""
    size = lambda o: F.when(o["op"].isin("M", "=", "X", "D", "N"), o["len"]).otherwise(0)
    return F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), lambda a, o: a + size(o))


def _positions(ops: Column, skips: tuple[str, ...]) -> Column:
    """Positions of the aligned bases in the read (skips: I, S) or from the start of the reference (skips: D, N)."""

    def step(s: Column, o: Column) -> Column:
        grown = F.struct((s["p"] + o["len"]).alias("p"), F.concat(s["a"], F.sequence(s["p"], s["p"] + o["len"] - 1)).alias("a"))
        moved = F.struct((s["p"] + o["len"]).alias("p"), s["a"].alias("a"))
        return F.when(o["op"].isin("M", "=", "X") & (o["len"] > 0), grown).when(o["op"].isin(*skips), moved).otherwise(s)

    return F.aggregate(ops, F.struct(F.lit(0).alias("p"), F.array().cast(_INTS).alias("a")), step, lambda s: s["a"])


def read_positions(cigar: Column) -> Column:
    return _positions(cigar_ops(cigar), ("I", "S"))


def reference_positions(cigar: Column) -> Column:
    return _positions(cigar_ops(cigar), ("D", "N"))


def _base(seq: Column, at: Column) -> Column:
    return F.substring(seq, at + 1, F.lit(1))


def aligned_ns(seq: Column, cigar: Column) -> Column:
    """Uncalled bases at aligned positions."""
    return F.size(F.filter(read_positions(cigar), lambda p: F.upper(_base(seq, p)) == "N")).cast("long")


def substitutions(seq: Column, cigar: Column, md: Column) -> Column:
    """Mismatches that MD names, but for those where the read has no call or no base.

    An MD that runs past the alignment counts each further letter.
    """
    tokens = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))

    def walk(places: Column) -> Column:
        def step(s: Column, t: Column) -> Column:
            called = ~F.upper(_base(seq, F.get(places, s["c"]))).isin("N", "")
            hit = (s["c"] >= F.size(places)) | called
            letter = F.struct((s["c"] + 1).alias("c"), (s["n"] + F.when(hit, 1).otherwise(0)).cast("long").alias("n"))
            number = F.struct((s["c"] + t.try_cast("int")).alias("c"), s["n"].alias("n"))
            return F.when(t.rlike("^[0-9]"), number).when(t.startswith("^"), s).otherwise(letter)

        return F.aggregate(tokens, F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("n")), step, lambda s: s["n"])

    return _let(read_positions(cigar), walk)


def indels(cigar: Column) -> Column:
    """Signed lengths of the insertions (+) and deletions (-); skips don't count."""
    kept = F.filter(cigar_ops(cigar), lambda o: o["op"].isin("I", "D"))
    return F.transform(kept, lambda o: F.when(o["op"] == "I", o["len"]).otherwise(-o["len"]))


def edit_counts(seq: Column, cigar: Column, md: Column) -> Column:
    """struct<substitutions, indels>; null without an MD."""
    return F.when(md.isNotNull(), F.struct(substitutions(seq, cigar, md).alias("substitutions"), indels(cigar).alias("indels")))


def within_edit_limits(
    seq: Column, cigar: Column, md: Column, flag: Column, max_edit_distance: int | None = None, max_indels: int | None = None, max_indel_length: int | None = None, n_adjustment: int | None = None
) -> Column:
    """Whether a mapped record with an MD stays within each limit that is set; false if none is."""
    if max_edit_distance is None and max_indels is None and max_indel_length is None and n_adjustment is None:
        return F.lit(False)

    def test(e: Column) -> Column:
        ok = F.lit(True)
        if max_edit_distance is not None:
            less = F.floor(aligned_ns(seq, cigar) / n_adjustment) if n_adjustment else F.lit(0)
            ok = ok & (e["substitutions"] + F.size(e["indels"]) <= F.greatest(F.lit(0), F.lit(max_edit_distance) - less))
        if max_indels is not None:
            ok = ok & (F.size(e["indels"]) <= max_indels)
        if max_indel_length is not None:
            ok = ok & (F.coalesce(F.array_max(F.transform(e["indels"], F.abs)), F.lit(0)) <= max_indel_length)
        return ok

    counted = F.struct(substitutions(seq, cigar, md).alias("substitutions"), indels(cigar).alias("indels"))
    return F.when(flag.bitwiseAND(F.lit(4)).eqNullSafe(F.lit(0)) & md.isNotNull(), _let(counted, test)).otherwise(F.lit(False))


def reverted(seq: Column, cigar: Column, reference: Column) -> Column:
    """struct<seq, places>: aligned uncalled bases become the reference's, in upper case; places are those changed.

    reference starts at the alignment's first base.
    """

    def build(hits: Column) -> Column:
        table = F.map_from_entries(hits)
        text = F.array_join(F.transform(F.sequence(F.lit(0), F.length(seq) - 1), lambda i: F.coalesce(F.try_element_at(table, i), _base(seq, i))), "")
        return F.struct(F.when(F.size(hits) == 0, seq).otherwise(text).alias("seq"), F.transform(hits, lambda h: h["p"]).alias("places"))

    both = F.arrays_zip(read_positions(cigar).alias("p"), reference_positions(cigar).alias("r"))
    uncalled = F.filter(both, lambda x: (F.upper(_base(seq, x["p"])) == "N") & (x["r"] < F.length(reference)))
    hits = F.transform(uncalled, lambda x: F.struct(x["p"].alias("p"), F.upper(_base(reference, x["r"])).alias("b")))
    none = F.struct(seq.alias("seq"), F.array().cast(_INTS).alias("places"))
    return F.when((F.length(seq) > 0) & (F.length(reference) > 0) & F.upper(seq).contains("N"), _let(hits, build)).otherwise(none)


def with_quality(qual: Column, places: Column, quality: int) -> Column:
    """Quality text with the changed places set to a quality of 0 to 93."""
    if not 0 <= quality <= 93:
        raise ValueError("quality must be 0 to 93")
    mark = F.lit(chr(quality + 33))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.length(qual) - 1), lambda i: F.when(F.array_contains(places, i), mark).otherwise(_base(qual, i))), "")
    return F.when((F.size(places) > 0) & (F.length(qual) > 0) & (qual != "*"), text).otherwise(qual)
