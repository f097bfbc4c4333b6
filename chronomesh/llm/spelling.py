"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so anagrams share a key, and a word that has one letter
more differs by that letter's power. Words one edit apart meet where their keys agree after the
changed letter is taken away: a word offers its own key, to those with one letter more, and its key
less each of its letters, to those with one letter less or another letter in its place. One half of a
word stays as it is under an edit of the other half, so its hash is part of what must agree, which keeps
words that are mere anagrams apart. What meets is then held against the order of letters.

Occurrences are counted by word before anything is shuffled; all that follows works on different words.
Words of a key meet in a join of narrow rows. Forms point to words at least twice as frequent, so chains of forms
have at most 63 links, and pointers that double end in six rounds.

Null and empty texts hold no words; a null id counts as an empty one. Repeated rows count each. An empty table
gives an empty result. Further columns are ignored, whatever their names. Ties go to the word first in
code-point order. A word's work grows with its length alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, settle, table

LETTERS = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
NOISE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent.
TIMES = 2
#: Keys are sums modulo this prime, 2^61 - 1, so that they fit a long however long a word is.
MODULUS = (1 << 61) - 1


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): words of all texts, of which one run in `noise` has lost a letter by the hash of its row's id and itself."""
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = runs.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = F.pmod("h", F.length("run")).cast("int") + 1
    word = F.when(F.pmod("h", F.lit(noise)) == 0, F.overlay("run", F.lit(""), place, F.lit(1))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def offered(vocabulary: DataFrame) -> DataFrame:
    """(id, whole, k) from rows (id, word): a word offers its own key, and its key less each letter."""
    split = vocabulary.select("id", "word", F.slice(F.split("word", ""), 1, F.length("word")).alias("letters"), F.length("word").alias("size"))
    total = F.aggregate(F.transform("letters", power), F.lit(0).cast("long"), lambda a, v: (a + v) % MODULUS)
    keyed = split.withColumn("total", total)

    def halves(size: Column) -> tuple[Column, Column]:
        """Hashes of what an edit leaves at the start and at the end, for a shorter word of `size` letters."""
        start = F.floor(size / 2).cast("int")
        return F.xxhash64(F.lit(0), size, F.substring("word", F.lit(1), start)), F.xxhash64(F.lit(1), size, F.right("word", size - start))

    own, less = halves(F.col("size")), halves(F.col("size") - 1)
    # A letter in the second half leaves the first as it is.
    kept = keyed.select("id", "letters", "total", "size", F.array(*own).alias("own"), F.array(*less).alias("less"))
    whole = F.transform("own", lambda half: F.struct(F.lit(True).alias("whole"), F.xxhash64("total", half).alias("k")))
    parted = F.transform(
        "letters",
        lambda letter, i: F.struct(
            F.lit(False).alias("whole"),
            F.xxhash64((F.col("total") - power(letter) + MODULUS) % MODULUS, F.get("less", F.when(i >= F.floor((F.col("size") - 1) / 2), 0).otherwise(1))).alias("k"),
        ),
    )
    return kept.select("id", F.inline(F.array_distinct(F.concat(whole, parted))))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, b): ids of each two words that one letter added, removed or exchanged makes equal, once, from a settled table (id, word)."""
    rows = offered(vocabulary)
    left, right = (rows.select(F.col("id").alias(n), F.col("whole").alias(f"whole_{n}"), "k") for n in ("a", "b"))
    met = left.join(right, "k").where("a < b and not (whole_a and whole_b)").select("a", "b").distinct()
    word = lambda n: vocabulary.select(F.col("id").alias(n), F.col("word").alias(f"word_{n}"))
    return met.join(word("a"), "a").join(word("b"), "b").where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for rows (id, form): the end of each chain of forms, by pointers that double."""
    now = settle(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = settle(now.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(now)
        now = after
    return now.select("id", "root")


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for rows (word, n) with different words."""
    vocabulary = settle(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pairs = settle(near_words(vocabulary.select("id", "word")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = vocabulary.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word", "id").alias("near"))
    found = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    fits = -F.col("near.less") >= times * F.col("n")
    named = settle(
        vocabulary.join(found, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(fits, c).alias(n) for c, n in ((F.col("near.word"), "form"), (F.col("near.id"), "form_id"), (-F.col("near.less"), "form_n")))
        )
    )
    last = roots(named.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    ends = last.join(vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return named.join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the more frequent word each is a variant of, and the last of that chain."""
    return variants(words(table(spark, sf_dir, "documents")))
