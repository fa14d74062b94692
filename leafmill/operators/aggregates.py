"""What is counted in a document or a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.repair import SMALL_WORDS


def first_mode(df: DataFrame, keys: list[str], value: str, weight: Column, order: str) -> DataFrame:
    """The value with the greatest weight in each group; of equals the one met first, then the greatest.

    One partial aggregation and one more over its few rows; no window.
    """
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("weight"), F.min(order).alias("first"))
    best = F.max_by(F.struct(value, "weight", "first"), F.struct("weight", (-F.col("first")).alias("first"), value))
    return sums.groupBy(*keys).agg(best.alias("best")).select(*keys, f"best.{value}", "best.weight", "best.first")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Where half of the weight lies on either side; the mean of two middles."""
    by = Window.partitionBy(*keys).orderBy(value)
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("w")).withColumn("upto", F.sum("w").over(by)).withColumn("all", F.sum("w").over(Window.partitionBy(*keys)))
    middle = sums.where((2 * F.col("upto") >= F.col("all")) & (2 * (F.col("upto") - F.col("w")) <= F.col("all")))
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias("median"))


def running_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """Lines that stand in ``least`` documents or more, numbers aside: boilerplate."""
    key = F.regexp_replace(T.squeeze(F.lower("text")), r"\d+", "#")
    keyed = lines.select("doc_id", key.alias("line")).where("line <> ''")
    return keyed.groupBy("line", "doc_id").agg(F.count("*").alias("n")).groupBy("line").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines")).where(F.col("n_docs") >= least)


#: Capital words that are no acronyms, and acronyms known beforehand.
NOT_ACRONYMS = (
    *(w.upper() for w in SMALL_WORDS),
    *("THIS THAT NOT ALL ONE TWO NEW OLD END SEE ARE WAS HIS HER ITS OUR YOU WHO HOW WHY MAY CAN OUT OFF".split()),
)
ACRONYMS = tuple(
    "ISBN DOI LCCN LCC DDC LCSH USA UK NY CA DC MIT IEEE ACM AI II III IV VI VII VIII IX XI XII PhD MD BC AD TV US EU UN CEO CTO UX UI API OCR PDF TD MC DP RL MDP".split()
)


def acronyms(lines: DataFrame, least: int = 3) -> DataFrame:
    """Capital words of 2 to 6 characters that a document uses ``least`` times in lines of mixed case."""
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z'’\-]*)"), F.lit(1))
    caps = F.filter(words, lambda w: w.rlike(r"^[A-Z][A-Z'’\-]*[A-Z]$") & (F.length(w) <= 6))
    mixed = (F.size(words) >= 4) & (F.size(caps) * 2 <= F.size(words))
    found = lines.where(mixed).select("doc_id", F.explode(caps).alias("token"))
    return found.where(~F.col("token").isin(*NOT_ACRONYMS)).groupBy("doc_id", "token").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def acronym_sets(lines: DataFrame, least: int = 3) -> DataFrame:
    """``doc_id, acronyms``: what a document taught, united with those known beforehand, sorted."""
    learned = acronyms(lines, least).groupBy("doc_id").agg(F.collect_set("token").alias("learned"))
    known = F.array(*map(F.lit, ACRONYMS))
    docs = lines.select("doc_id").distinct()
    return docs.join(learned, "doc_id", "left").select("doc_id", F.array_sort(F.array_union(F.coalesce("learned", F.array().cast("array<string>")), known)).alias("acronyms"))


def word_forms(docs: DataFrame) -> DataFrame:
    """Distinct lowered words of each document, and how many are compounds."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)"), F.lit(1)))
    return docs.where("text is not null").select("doc_id", F.size(found).alias("n_forms"), F.size(F.filter(found, lambda w: w.contains("-"))).alias("n_compounds"))


def glyphs(docs: DataFrame, above: int = 0x2000, top: int = 40) -> DataFrame:
    """The most frequent characters beyond ``above``: how often, in how many documents."""
    pattern = rf"([^\x{{0}}-\x{{{above:X}}}\p{{M}}])"
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("glyph"))
    by_doc = each.groupBy("glyph", "doc_id").agg(F.count("*").alias("k"))
    return by_doc.groupBy("glyph").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs")).orderBy(F.desc("n"), "glyph").limit(top)


def token_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Precision and recall of the words of ``left`` against ``right``, counted with repeats."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({T.WORD})"), F.lit(1)))
        return df.select(key, words.alias("word")).groupBy(key, "word").agg(F.count("*").alias(name))

    left = left.join(right.select(key).distinct(), key, "left_semi")  # ids of one side alone have no measure
    both = counts(left, "a").join(counts(right, "b"), [key, "word"], "full_outer").fillna(0, ["a", "b"])
    sums = both.groupBy(key).agg(F.sum(F.least("a", "b")).alias("common"), F.sum("a").alias("n_left"), F.sum("b").alias("n_right")).where("n_left > 0 and n_right > 0")
    return sums.select(key, "common", F.round(F.col("common") / F.col("n_left"), 6).alias("precision"), F.round(F.col("common") / F.col("n_right"), 6).alias("recall"))
