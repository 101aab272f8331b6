"""Sequences as string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The complement of each nucleotide code, and the standard genetic code by codon.
COMPLEMENT = ("ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn")
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def genetic_code() -> dict[str, str]:
    """Codon to amino acid; codons count up in the order of BASES, * is a stop."""
    return {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def pack(col: Column) -> Column:
    """Without gaps and white space."""
    return F.regexp_replace(col, r"[\s.~_-]", "")


def normalize(col: Column, alphabet: str) -> Column:
    """Upper case; U to T for dna, T to U for rna; letters only for letters (a-z, lower case)."""
    if alphabet == "letters":
        return F.lower(F.regexp_replace(col, "[^A-Za-z]", ""))
    upper = F.upper(pack(col))
    return {"dna": F.translate(upper, "U", "T"), "rna": F.translate(upper, "T", "U"), "protein": upper}[alphabet]


def revcomp(col: Column) -> Column:
    """Reverse complement, with ambiguity codes; other characters stay."""
    return F.reverse(F.translate(col, *COMPLEMENT))


def as_dna(col: Column) -> Column:
    """A nucleotide sequence from the letters of a text (a stand-in where a table holds no sequences)."""
    return F.translate(normalize(col, "letters"), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def codons(dna: Column, frame: int = 0) -> Column:
    """The whole codons from a frame on."""
    n = F.floor((F.length(dna) - frame) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(dna, i * 3 + (frame + 1), F.lit(3)))).otherwise(F.array().cast("array<string>"))


def translate(dna: Column, frame: int = 0) -> Column:
    """Amino acids of a frame; a codon that isn't four-letter DNA gives x."""
    table = F.create_map(*(F.lit(x) for kv in genetic_code().items() for x in kv))
    return F.array_join(F.transform(codons(dna, frame), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("x"))), "")


def translate_frames(df: DataFrame, seq: str = "seq", protein: str = "protein") -> DataFrame:
    """A row for each strand (+, -) and frame (0, 1, 2)."""
    both = df.withColumn("_strands", F.array(F.struct(F.lit("+").alias("strand"), F.col(seq).alias("s")), F.struct(F.lit("-").alias("strand"), revcomp(F.col(seq)).alias("s"))))
    one = both.select(*df.columns, F.inline("_strands"))
    frames = F.array(*(F.struct(F.lit(f).alias("frame"), translate(F.col("s"), f).alias(protein)) for f in range(3)))
    return one.select(*df.columns, "strand", F.inline(frames))


def guess_type(col: Column) -> Column:
    """DNA, RNA or protein by composition; '' for ten letters or fewer."""
    def count(letters: str) -> Column:
        return F.length(F.regexp_replace(F.upper(col), f"[^{letters}]", ""))

    letters, nucleic = count("A-Z"), count("ACGTUN")
    return F.when(letters <= 10, "").when(nucleic < 0.75 * letters, "protein").when(count("U") > count("T"), "RNA").otherwise("DNA")


def parse_id(col: Column) -> dict[str, Column]:
    """Genome id (number.number), length and coverage found in a contig id; null where missing."""
    def found(pattern: str) -> Column:
        x = F.regexp_extract(col, pattern, 1)
        return F.when(x != "", x)

    return {"genome_id": found(r"(?:^|\D)(\d+\.\d+)"), "length": found(r"length_(\d+)").cast("long"), "coverage": found(r"cov(?:erage)?_([0-9.]+)").cast("double")}


def places(df: DataFrame, ids: list[str], seq: Column, width: int, step: int, drop: int = 0, block: int = 64) -> DataFrame:
    """(ids, place, last, piece): the pieces of a sequence at every step, from 0 on; drop: so many of the last left out.

    A position in a string is found by counting characters from its start, so long sequences are first cut into blocks.
    The generator around the sequence keeps filters on it from computing it again below. Blocks are dealt out evenly
    before they grow into pieces: a few long sequences, or a file of few row groups, would make a few long tasks, and the
    exchange of the letters is a small part of that of the pieces.
    """
    total = F.floor((F.length("_s") - width) / step).cast("int") + 1 - drop
    blocks = df.select(*ids, F.explode(F.array(seq)).alias("_s")).select(*ids, "_s", total.alias("_n")).where("_n > 0")
    cut = blocks.select(*ids, "_s", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block).cast("int"))).alias("_b"))
    held = cut.select(*ids, "_n", "_b", F.substring(F.col("_s"), F.col("_b") * (block * step) + 1, F.lit((block - 1) * step + width)).alias("_t"), F.monotonically_increasing_id().alias("_at"))
    held = held.repartition("_at")
    each = held.select(*ids, "_n", "_b", "_t", F.explode(F.sequence(F.lit(0), F.least(F.lit(block), F.col("_n") - F.col("_b") * block) - 1)).alias("_i"))
    place = F.col("_b") * block + F.col("_i")
    return each.select(*ids, place.alias("place"), (place == F.col("_n") - 1).alias("last"), F.substring(F.col("_t"), F.col("_i") * step + 1, F.lit(width)).alias("piece"))
