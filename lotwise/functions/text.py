"""Text functions: cleaning, token sets, trigrams, hashes."""
from pyspark.sql import Column, functions as F


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def text_clean(text: Column) -> Column:
    """Single spaces, lower case, only letters, digits, underscore, hyphen and space (any script)."""
    return F.regexp_replace(F.lower(squeeze(text)), r"(?U)[^\w\s-]", "")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def trigrams(text: Column) -> Column:
    """Set of trigrams of the lower-cased words, each padded with two spaces before and one after."""
    split_words = F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(split_words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def description_hash(text: Column) -> Column:
    """md5 of the folded text as the signature rule defines it: its first 500 characters."""
    return F.when(F.length(text) > 0, F.md5(F.substring(squeeze(F.lower(text)), 1, 500)))
