"""Column expressions over texts, titles and ids. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a run of letters, numbers and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"
#: Fixed value: the article number in a benchmark passage's id.
BENCHMARK_ID = r"wiki_(\d+)_"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _grams(words: Column, n: int, of) -> Column:
    """`of` each run of n words (a struct, nulls where a text has fewer), from the list zipped with itself moved on.

    The list is named in the argument only: an expression that names it for each element is evaluated anew for each, if
    the optimizer puts the tokenizer in its place.
    """
    moved = [words.alias("w0")] + [F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{k}") for k in range(1, n)]
    grams = F.slice(F.transform(F.arrays_zip(*moved), of), 1, F.greatest(F.size(words) - F.lit(n - 1), F.lit(1)))
    return F.array_distinct(grams)


def shingles(words: Column, n: int = 5) -> Column:
    """Different n-grams joined by a space. Fewer than n tokens make one shingle of all; none make none."""
    return _grams(words, n, lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)]))


def shingle_hashes(words: Column, n: int = 5) -> Column:
    """64-bit hashes of the different n-grams."""
    return _grams(words, n, lambda x: F.xxhash64(x))


def norm_title(title: Column) -> Column:
    """Lower case, white space collapsed and trimmed; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " ")))


def article_id(doc_id: Column) -> Column:
    """What stands before the first underscore; the whole id without one."""
    return F.split_part(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("_"), F.lit(1))


def benchmark_article_id(passage_id: Column, pattern: str = BENCHMARK_ID) -> Column:
    return F.regexp_extract(F.coalesce(passage_id, F.lit("")), pattern, 1)


def first_present(*values: Column) -> Column:
    """The first value, as text, that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_question(text: Column, least: int = 5) -> Column:
    return F.coalesce(F.length(strip(text)) >= least, F.lit(False))


def is_trivial(token: Column) -> Column:
    """Tokens that are not worth stemming: digits alone, or a single character."""
    return token.rlike(r"^\p{Nd}+$") | (F.length(token) <= 1)


def cache_key(name: Column, most: int = 60) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    return F.right(clean, F.lit(most))


def json_list(reply: Column) -> Column:
    """The text of the JSON list in a model's reply, fences and chatter cut away; null where there is none."""
    bare = strip(F.coalesce(reply, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    found = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def seeded_order(seed: int, key: Column) -> Column:
    """A reproducible shuffle: sort by this, then by the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
