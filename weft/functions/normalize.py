"""Normalisers of identifiers and fields as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed confidence of the tiers of a regulation.
TIER_CONFIDENCE = {"A": 1.0, "B": 0.85, "C": 0.7, "D": 0.5, "E": 0.25}


def once(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def not_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def strip_version(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def chromosome(location: Column) -> Column:
    """`17p13.1` -> `17`; mitochondrial places -> `MT`; null for an unplaced one."""
    place = F.trim(location)
    return F.when(F.lower(place).startswith("mitochond"), "MT").otherwise(F.nullif(F.regexp_extract(place, r"^(\d{1,2}|X|Y|MT)", 1), F.lit("")))


def aliases(*lists: Column, canonical: Column) -> Column:
    """Pipe-separated lists as one array in order, without blanks, repeats and the canonical name."""
    parts = F.transform(F.split(F.concat_ws("|", *lists), r"\|"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != canonical)))


def gtf_attributes(c: Column) -> Column:
    """`key "value";` pairs as a map, the last of equal keys."""
    keys, values = F.regexp_extract_all(c, F.lit(r'(\w+) "([^"]*)"'), F.lit(1)), F.regexp_extract_all(c, F.lit(r'(\w+) "([^"]*)"'), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"]))


def span(start: Column, end: Column) -> Column:
    return end - start + 1


def mode_of(sign: Column) -> Column:
    return F.when(sign > 0, "activator").when(sign < 0, "repressor").otherwise("unknown")


def tier_confidence(tier: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TIER_CONFIDENCE.items() for x in kv])
    return F.coalesce(table[tier], F.lit(0.5))


def variant_key(snps: Column, chrom: Column, pos: Column) -> Column:
    """The first rs number, else chr<c>:<p>:NA:NA, else null."""
    rs = F.nullif(F.regexp_extract(snps, r"(rs\d+)", 1), F.lit(""))
    place = F.when(not_blank(chrom).isNotNull() & not_blank(pos).isNotNull(), F.concat(F.lit("chr"), chrom, F.lit(":"), pos, F.lit(":NA:NA")))
    return F.coalesce(rs, place)


def traits(names: Column, uris: Column) -> Column:
    """array<struct<id, name>>: both split at comma and space, so a bare comma stays in a name; ids are the URIs' tails.

    Blank URIs go before the two are aligned. A name that is missing, blank or only digits gives way to the id.
    """
    known = F.filter(F.transform(F.split(F.coalesce(uris, F.lit("")), ", "), lambda u: F.trim(u)), lambda u: u != "")
    labels = F.transform(F.split(F.coalesce(names, F.lit("")), ", "), lambda n: F.trim(n))
    pairs = F.transform(known, lambda u, k: F.struct(F.regexp_replace(F.regexp_replace(u, "/+$", ""), "^.*/", "").alias("id"), F.coalesce(F.get(labels, k), F.lit("")).alias("name")))
    kept = F.filter(pairs, lambda x: ~F.lower(x["id"]).isin("", "nan"))
    return F.transform(kept, lambda x: F.struct(x["id"].alias("id"), F.when(x["name"].rlike(r"^[0-9]*$"), x["id"]).otherwise(x["name"]).alias("name")))


def genes(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,]| - "), lambda x: F.trim(x)), lambda g: g != "")


def first_value(c: Column) -> Column:
    first = F.trim(F.split(c, ";")[0])
    return F.when(~F.lower(first).isin("", "nan"), first)


def to_int(c: Column) -> Column:
    return first_value(c).try_cast("double").cast("int")


def sample_type(explicit: Column, barcode: Column) -> Column:
    """The explicit code, else the digits of the barcode's fourth field."""
    return F.coalesce(explicit.try_cast("int"), F.nullif(F.regexp_extract(F.get(F.split(barcode, "-"), 3), r"^(\d+)", 1), F.lit("")).cast("int"))


def hmdb(c: Column) -> Column:
    """The first HMDB number in a text, padded to seven digits."""
    digits = F.regexp_extract(F.upper(c), r"HMDB0*(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("HMDB"), F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)))


def chebi(c: Column) -> Column:
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("CHEBI:"), digits))


def without_compartment(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[a-z]\]$", "")


def scored_locations(c: Column) -> Column:
    """`nucleus:0.8|cytosol:0.7` as array<struct<loc, score>>; the score stands behind the last colon."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.*):([^:]*)$", 1)).alias("loc"), F.regexp_extract(p, r"^(.*):([^:]*)$", 2).try_cast("double").alias("score")))
    return F.filter(parts, lambda p: (p["loc"] != "") & p["score"].isNotNull())


def pretty_process(c: Column) -> Column:
    return F.lower(F.translate(F.regexp_replace(c, "^GOBP_", ""), "_", " "))


def allele_frequency(populations: Column, reference: Column, preferred: str) -> Column:
    """Sum of the frequencies of all alleles but the reference in one population, at most 1, to 6 places; null if the population is missing."""
    own = F.filter(populations, lambda p: p["population"] == preferred)
    total = F.aggregate(F.filter(own, lambda p: p["allele"] != reference), F.lit(0.0), lambda a, p: a + F.coalesce(p["frequency"], F.lit(0.0)))
    return F.when(F.size(own) > 0, F.round(F.least(F.lit(1.0), total), 6))


def weights_map(tissues: dict[str, Column]) -> Column:
    """Flat weights as a map: a missing one is 0, all missing is null."""
    filled = F.create_map(*[x for name, c in tissues.items() for x in (F.lit(name), F.coalesce(c, F.lit(0.0)))])
    return F.when(F.coalesce(*tissues.values()).isNotNull(), filled)


#: What a search text may not carry into a query.
OPERATORS = r'(\+|-|&&|\|\||!|\(|\)|\{|\}|\[|\]|\^|"|~|\*|\?|:|\\|/)'


def query_tokens(c: Column) -> Column:
    """Lower-case words of a search text, without operators."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, OPERATORS, " ")), r"\s+"), lambda t: t != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)"), F.lit(1))


#: Fixed abbreviations after whose dot a sentence goes on.
ABBREVIATIONS = r"(?i)\b(?:e\.g|i\.e|et al|vs|Fig|approx|cf|Dr|no)\.$"


def sentences(c: Column) -> Column:
    """Sentences of a text: cut after `.`, `!` or `?` before a capital or digit, joined again behind an abbreviation."""
    parts = F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: s != "")

    def joined(parts: Column) -> Column:
        begins = lambda i: (i == 0) | ~F.coalesce(F.get(parts, i - 1).rlike(ABBREVIATIONS), F.lit(False))
        starts = F.filter(F.transform(parts, lambda s, i: F.when(begins(i), i)), lambda i: i.isNotNull())
        return once(starts, lambda at: F.transform(at, lambda a, k: F.array_join(F.slice(parts, a + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - a), " ")))

    return once(parts, joined)


def triple_key(rel: Column, subject: Column, target: Column, symmetric: tuple[str, ...] = ("INTERACTS_WITH",)) -> Column:
    both = rel.isin(*symmetric)
    return F.concat_ws("__", F.when(both, F.least(subject, target)).otherwise(subject), rel, F.when(both, F.greatest(subject, target)).otherwise(target))


def edge_type(kind_a: Column, kind_b: Column) -> Column:
    return F.when((kind_a == "protein") & (kind_b == "protein"), "INTERACTS_WITH").when(F.array_sort(F.array(kind_a, kind_b)) == F.array(F.lit("disease"), F.lit("gene")), "IMPLICATED_IN")


def verdict(c: Column) -> Column:
    """Struct of asserted, polarity, confidence, evidence from a reply with one JSON object in it; null if it can't be read or has another polarity."""
    raw = F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), "asserted boolean, polarity string, confidence double, evidence string")
    ok = F.lower(raw["polarity"]).isin("affirm", "negate", "hedge")
    return F.when(ok, F.struct(F.coalesce(raw["asserted"], F.lit(False)).alias("asserted"), F.lower(raw["polarity"]).alias("polarity"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw["confidence"], F.lit(0.0)))).alias("confidence"), F.left(F.coalesce(raw["evidence"], F.lit("")), F.lit(500)).alias("evidence")))


def evidence_confidence(affirm: Column, negate: Column) -> Column:
    """(1 - 2^-a) * a / (a + n); 0 without an affirmation."""
    return F.when(affirm > 0, (1 - F.pow(F.lit(0.5), affirm)) * affirm / (affirm + negate)).otherwise(F.lit(0.0))


def snippet(c: Column, length: int = 280) -> Column:
    return F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length)), F.lit("…"))).otherwise(c)
