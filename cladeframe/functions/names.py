"""Read names, pair suffixes and sequences, as Column to Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_pair_suffix(name: Column) -> Column:
    """Without one trailing /1 or /2."""
    return F.regexp_replace(name, r"/[12]\z", "")


def first_token(name: Column) -> Column:
    """The first token cut at any white space."""
    return F.regexp_extract(name, r"^\s*(\S*)", 1)


def fastq_base_name(name: Column) -> Column:
    """What the filter looks a read up by."""
    return strip_pair_suffix(first_token(name))


def fastq_name(name: Column) -> Column:
    """The name that templates carry: cut at the first space only, suffix kept."""
    return F.element_at(F.split(name, " ", 2), 1)


def fasta_name(definition: Column) -> Column:
    """First token of a definition line without its leading > signs."""
    return first_token(F.regexp_replace(F.trim(definition), "^>+", ""))


def pair_suffix(name: Column) -> Column:
    """1, 2 or null."""
    return F.when(name.endswith("/1"), 1).when(name.endswith("/2"), 2)


def suffixes_pair(first: Column, second: Column) -> Column:
    """True for no suffixes, or /1 then /2."""
    a, b = F.coalesce(pair_suffix(first), F.lit(0)), F.coalesce(pair_suffix(second), F.lit(0))
    return ((a == 0) & (b == 0)) | ((a == 1) & (b == 2))


def checked_pair_name(first: Column, second: Column) -> Column:
    """The base name of a valid pair; the query fails on any other."""
    base = strip_pair_suffix(first)
    ok = suffixes_pair(first, second) & (F.length(base) > 0) & (base == strip_pair_suffix(second))
    return F.when(ok, base).otherwise(F.raise_error(F.concat(F.lit("reads are no pair: '"), first, F.lit("' and '"), second, F.lit("'"))))


def checked_record_name(name: Column) -> Column:
    """The name of an alignment; missing, empty and * fail."""
    return F.when(name.isNull() | name.isin("", "*"), F.raise_error(F.lit("alignment record has no name"))).otherwise(name)


def reverse_complement(seq: Column) -> Column:
    """Reversed with A, C, G, T complemented in either case; all else stays as it is."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def template_sequence(r1: Column, r2: Column) -> Column:
    """Upper-case R1, then N and R2 where there is one."""
    return F.upper(F.concat(r1, F.coalesce(F.concat(F.lit("N"), r2), F.lit(""))))


def flag_is(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def is_primary(flag: Column) -> Column:
    """Neither secondary (0x100) nor supplementary (0x800)."""
    return flag.bitwiseAND(F.lit(0x900)) == 0


def is_mapped(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(0x4)) == 0


def with_record_suffix(name: Column, flag: Column) -> Column:
    """A segmented record's name with /1 for first, else /2 for last, unless it has a suffix."""
    bare = flag_is(flag, 0x1) & pair_suffix(name).isNull()
    return F.when(bare & flag_is(flag, 0x40), F.concat(name, F.lit("/1"))).when(bare & flag_is(flag, 0x80), F.concat(name, F.lit("/2"))).otherwise(name)


def forward_sequence(seq: Column, flag: Column) -> Column:
    """The sequence as read: reverse-strand records are turned back."""
    return F.when(flag_is(flag, 0x10), reverse_complement(seq)).otherwise(seq)


#: Taxonomic rank names and their codes.
RANK_CODES = {
    "root": "R", "Root": "R", "domain": "D", "superkingdom": "D", "kingdom": "K", "subkingdom": "K1", "phylum": "P", "subphylum": "P1",
    "class": "C", "subclass": "C1", "infraclass": "C2", "order": "O", "superorder": "O1", "suborder": "O2", "infraorder": "O3", "parvorder": "O4",
    "family": "F", "superfamily": "F1", "subfamily": "F2", "tribe": "F3", "subtribe": "F4", "genus": "G", "subgenus": "G1", "species group": "G2",
    "species subgroup": "G3", "species": "S", "subspecies": "S1", "varietas": "S2", "variety": "S2", "forma": "S3", "form": "S3",
}


def rank_code(rank: Column) -> Column:
    """The code of a rank name; -- for any other."""
    table = F.create_map(*(F.lit(x) for pair in RANK_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, rank), F.lit("--"))
