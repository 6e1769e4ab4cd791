"""Predicates and scalar functions over calls, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_snp(ref, alt) -> Column:
    return (F.length(_c(ref)) == 1) & (F.length(_c(alt)) == 1) & ~_c(alt).isin(".", "*")


def is_mnp(ref, alt) -> Column:
    return (F.length(_c(ref)) == F.length(_c(alt))) & (F.length(_c(ref)) > 1) & ~F.contains(_c(alt), F.lit(",")) & (_c(alt) != ".")


def is_indel(ref, alt) -> Column:
    return (F.length(_c(ref)) != F.length(_c(alt))) | F.contains(_c(alt), F.lit(","))


def is_pass(flt) -> Column:
    return _c(flt).isin("PASS", ".", "")


def quality_passes(qual_text, least: float) -> Column:
    """QUAL text: a dot always passes, other unparseable text counts as 0."""
    q = _c(qual_text)
    return (q == ".") | (F.coalesce(F.try_to_number(q, F.lit("S9999999999D9999999999")).cast("double"), q.try_cast("double"), F.lit(0.0)) >= least)


def quality(qual_text) -> Column:
    return F.coalesce(_c(qual_text).try_cast("double"), F.lit(0.0))


def valid_allele(allele) -> Column:
    return ~_c(allele).isin("N", "-")


def valid_base(base) -> Column:
    return _c(base).isin("A", "C", "G", "T")


def info_value(info, key: str) -> Column:
    """The text of the first ``key=`` of an INFO column, or null."""
    hit = F.filter(F.split(_c(info), ";"), lambda x: F.startswith(x, F.lit(key + "=")))
    return F.get(hit, F.lit(0)).substr(F.lit(len(key) + 2), F.length(_c(info)))


def info_number(info, key: str, kind: str = "long") -> Column:
    """Its first comma part as a number; unparseable gives null."""
    return F.split_part(info_value(info, key), F.lit(","), F.lit(1)).try_cast(kind)


def info_depth(info) -> Column:
    """The first parseable DP= or ADP= in INFO order."""
    hit = F.filter(F.split(_c(info), ";"), lambda x: F.regexp_like(x, F.lit(r"^A?DP=[0-9]+$")))
    return F.regexp_extract(F.get(hit, F.lit(0)), r"=([0-9]+)$", 1).try_cast("long")


def format_value(fmt, sample, key: str) -> Column:
    """The value of a FORMAT key; the last one counts if the key repeats."""
    z = F.filter(F.arrays_zip(F.split(_c(fmt), ":").alias("k"), F.split(_c(sample), ":").alias("v")), lambda x: x["k"] == key)
    return F.get(z, F.size(z) - 1)["v"]


def fraction(text) -> Column:
    """An allele frequency, written as a number or with a percent sign."""
    t = _c(text)
    return F.when(F.endswith(t, F.lit("%")), F.regexp_replace(t, "%$", "").try_cast("double") / 100).otherwise(t.try_cast("double"))


def allele_depth_fraction(ad) -> Column:
    """Alternative reads over all reads of an AD value ``ref,alt,...``."""
    n = F.transform(F.split(_c(ad), ","), lambda x: x.try_cast("long"))
    total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(total > 0, F.get(n, F.lit(1)) / total)


def format_fields(fmt, sample) -> Column:
    """struct<gt,depth,af,ro,ao,qa,gq,abq,pval> of a FORMAT and a sample column, keys taken in turn: a later key replaces an
    earlier one, but AD gives the depth and RD the reference reads only where none is known yet, and an unreadable AF or
    FREQ changes nothing.  Keys without a value end the list."""
    pairs = F.filter(F.arrays_zip(F.split(_c(fmt), ":").alias("k"), F.split(_c(sample), ":").alias("v")), lambda x: x["v"].isNotNull() & x["k"].isNotNull())
    kinds = {"gt": "string", "depth": "long", "af": "double", "ro": "long", "ao": "long", "qa": "double", "gq": "double", "abq": "double", "pval": "double"}
    start = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])

    def step(s, x):
        k, v = x["k"], x["v"]
        whole = v.try_cast("long")
        ad = F.filter(F.transform(F.split(v, ","), lambda y: y.try_cast("long")), lambda y: y.isNotNull() & (y >= 0))
        total = F.aggregate(ad, F.lit(0).cast("long"), lambda a, y: a + y)
        has_ad = (k == "AD") & (F.size(ad) >= 2)
        freq = fraction(v)
        new = {
            "gt": F.when(k == "GT", v).otherwise(s["gt"]),
            "depth": F.when(k == "DP", whole).when(has_ad & s["depth"].isNull(), total).otherwise(s["depth"]),
            "af": F.when(has_ad & (total > 0), F.get(ad, F.lit(1)) / total).when(k.isin("AF", "FREQ") & freq.isNotNull(), freq).otherwise(s["af"]),
            "ro": F.when(has_ad, F.get(ad, F.lit(0))).when((k == "RO") | ((k == "RD") & s["ro"].isNull()), whole).otherwise(s["ro"]),
            "ao": F.when(has_ad, F.get(ad, F.lit(1))).when(k == "AO", whole).otherwise(s["ao"]),
        }
        for name, key in (("qa", "QA"), ("gq", "GQ"), ("abq", "ABQ"), ("pval", "PVAL")):
            new[name] = F.when(k == key, v.try_cast("double")).otherwise(s[name])
        return F.struct(*[c.alias(n) for n, c in new.items()])

    return F.aggregate(pairs, start, step)


def decompose(pos, ref, alt) -> Column:
    """array<struct<pos,ref,alt>>: a row for each differing base of an MNP (equal lengths)."""
    z = F.expr(f"transform(sequence(1, length({ref})), i -> named_struct('pos', {pos} + i - 1, 'ref', substr({ref}, i, 1), 'alt', substr({alt}, i, 1)))")
    return F.filter(z, lambda x: x["ref"] != x["alt"])


def genotype_allele(gt, ref, alt) -> Column:
    """The allele of the first number of a genotype like 0/1; missing gives N."""
    first = F.get(F.split(_c(gt), r"[/|]"), F.lit(0))
    n = first.try_cast("int")
    return F.when(_c(gt).isin("./.", ".|.", ".") | first.isin("."), "N").when(n.isNull(), first).when(n == 0, _c(ref)).otherwise(F.coalesce(F.get(F.split(_c(alt), ","), n - 1), F.lit("N")))


def cigar_span(cigar) -> Column:
    """Reference bases that a CIGAR covers: the sum of M, D, N, = and X."""
    n = F.regexp_extract_all(_c(cigar), F.lit(r"([0-9]+)[MDN=X]"), F.lit(1))
    return F.aggregate(F.transform(n, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def strip_suffix(name, suffix: str) -> Column:
    """Removes every repetition of a suffix."""
    return F.regexp_replace(_c(name), f"({suffix})+$", "")


def gff_attribute(attrs, key: str) -> Column:
    """The first attribute of the key: GFF3 ``key=value`` with five percent codes decoded in turn, or GTF ``key "value"``,
    for which any attribute that begins with the key and has a space counts, so ``gene`` finds ``gene_id "x"``."""
    parts = F.transform(F.split(_c(attrs), ";"), lambda x: F.trim(x))
    is_pair = lambda x: F.startswith(x, F.lit(f"{key}="))
    hit = F.get(F.filter(parts, lambda x: is_pair(x) | (F.startswith(x, F.lit(key)) & F.contains(x, F.lit(" ")))), F.lit(0))
    v = hit.substr(F.lit(len(key) + 2), F.length(hit))
    for code, char in (("%3B", ";"), ("%2C", ","), ("%3D", "="), ("%26", "&"), ("%25", "%")):
        v = F.replace(v, F.lit(code), F.lit(char))
    quoted = F.regexp_replace(F.regexp_replace(hit, "^[^ ]* ", ""), '^"+|"+$', "")
    return F.when(is_pair(hit), v).otherwise(quoted)


def base_call(depth, best, total, base, min_depth: int, min_consensus: float) -> Column:
    """The base if depth and consensus suffice, - for too little depth, N otherwise."""
    return F.when(_c(depth) < min_depth, "-").when(_c(best) / _c(total) >= min_consensus, _c(base)).otherwise("N")


def percent(part, whole) -> Column:
    return F.when(_c(whole) > 0, _c(part) / _c(whole) * 100).otherwise(0.0)
