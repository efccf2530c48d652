"""Scalar functions of names and addresses, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference probabilities of English letter pairs; any other pair has FLOOR.
BIGRAMS = {
    "th": 0.035, "he": 0.030, "in": 0.024, "er": 0.020, "an": 0.019,
    "re": 0.018, "on": 0.017, "at": 0.014, "en": 0.014, "nd": 0.013,
    "ti": 0.013, "es": 0.013, "or": 0.012, "te": 0.012, "of": 0.011,
    "ed": 0.011, "is": 0.011, "it": 0.011, "al": 0.010, "ar": 0.010,
    "st": 0.010, "to": 0.010, "nt": 0.010, "ng": 0.009, "se": 0.009,
    "ha": 0.009, "as": 0.008, "ou": 0.008, "io": 0.008, "le": 0.008,
}
FLOOR = 1e-4
# DNS type codes.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for empty text, null for null."""
    n = F.length(text)
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(
        F.filter(F.array_sort(parts), lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)
    ))


def bigram_log_likelihood(name: Column) -> Column:
    """Mean log-probability of the letter pairs of the first label; 0 for labels of fewer than two letters."""
    label = F.substring_index(F.lower(name), ".", 1)
    table = F.create_map(*[F.lit(x) for pair in BIGRAMS.items() for x in pair])
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(label) - 1),
        lambda i: F.log(F.coalesce(F.try_element_at(table, F.substr(label, i, F.lit(2))), F.lit(FLOOR)))
    )
    return F.when(F.length(label) < 2, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (F.length(label) - 1))


def subdomain_depth(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))


def letter_ratios(text: Column) -> dict[str, Column]:
    """Vowels and consonants among letters; digits and different characters among all characters."""
    low, n = F.lower(text), F.greatest(F.length(text), F.lit(1))
    letters = F.greatest(F.regexp_count(low, F.lit(r"\p{L}")), F.lit(1))
    vowels = F.regexp_count(low, F.lit("[aeiou]"))
    return {
        "vowel_ratio": vowels / letters,
        "consonant_ratio": (F.regexp_count(low, F.lit(r"\p{L}")) - vowels) / letters,
        "digit_ratio": F.regexp_count(low, F.lit(r"\p{Nd}")) / n,
        "unique_char_ratio": F.when(F.length(text) == 0, 0.0).otherwise(F.size(F.array_distinct(F.split(low, ""))) / n),
    }


def tls_version_number(version: Column) -> Column:
    return F.when(version.isNull() | (version == ""), 0.0).when(version.contains("1.3"), 1.3).when(version.contains("1.2"), 1.2).otherwise(1.0)


def dns_type_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DNS_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit("TYPE_"), code.cast("string")))


def ratio(top: Column, bottom: Column, least: float) -> Column:
    """top / max(least, bottom): never null or infinite for numbers."""
    return top / F.greatest(F.lit(least), bottom)


def md5_partition(key: Column, partitions: int) -> Column:
    """The 128-bit md5 of `key` modulo a number of partitions, folded hex digit by hex digit."""
    digits = F.transform(F.split(F.md5(key), ""), lambda d: F.conv(d, 16, 10).cast("bigint"))
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: (a * 16 + d) % partitions)


def flow_id(src: Column, sport: Column, dst: Column, dport: Column, protocol: Column) -> Column:
    return F.concat(src, F.lit(":"), sport.cast("string"), F.lit(" -> "), dst, F.lit(":"), dport.cast("string"), F.lit(" ["), protocol, F.lit("]"))


def both_ways_id(src: Column, sport: Column, dst: Column, dport: Column, protocol: Column) -> Column:
    """The same text for both directions of a conversation."""
    a, b = F.concat(src, F.lit(":"), sport.cast("string")), F.concat(dst, F.lit(":"), dport.cast("string"))
    return F.concat(F.least(a, b), F.lit(" <-> "), F.greatest(a, b), F.lit(" ["), protocol, F.lit("]"))


def tcp_flag_summary(flags: dict[str, Column]) -> Column:
    """SYN+ACK and the like; NONE without flags."""
    return F.coalesce(F.nullif(F.concat_ws("+", *[F.when(c, k) for k, c in flags.items()]), F.lit("")), F.lit("NONE"))
