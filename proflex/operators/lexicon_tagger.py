"""T1 on real text: a tagger learnt from a tagged corpus, as Spark jobs.

1. lexicon: for each lower-cased word its most frequent analysis (lemma, upos, xpos, feats);
2. suffix rules: every word of letters votes, once for each of its endings of 1 to MAX_SUFFIX
   letters, for its tags and its lemma rule (cut so many letters, add a string); the rule that most
   words of an ending vote for stays, if MIN_WORDS do.  A lemma rule that cuts more than the ending
   does not vote there;
3. analysis of new words: the distinct words that the lexicon lacks meet the rules in one equi-join on
   their endings; the longest ending decides.  So texts are tagged by one join of tokens with words,
   known and new.

Ties go to the smaller tags.  Words without any rule are nouns with their own form as lemma;
punctuation and numbers have their fixed tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .speller import LETTERS_ONLY
from .tagging import NUMBER_PATTERN, NUMERAL_FEATS, PUNCT_PATTERN, tokenize

MAX_SUFFIX = 5
MIN_WORDS = 2
TAGS = ["upos", "xpos", "feats"]


def _is_word(word: Column) -> Column:
    return word.isNotNull() & ~word.rlike(PUNCT_PATTERN) & ~word.rlike(NUMBER_PATTERN)


def build_lexicon(tagged: DataFrame) -> DataFrame:
    """(form, lemma, upos, xpos, feats) from (word, lemma, upos, xpos, feats) rows."""
    counts = (tagged.where(_is_word(F.col("word"))).groupBy(F.lower("word").alias("form"), "lemma", *TAGS)
              .agg(F.count(F.lit(1)).alias("n")))
    # a group holds the analyses of one word, counted before
    first = Window.partitionBy("form").orderBy(F.col("n").desc(), "lemma", *TAGS)
    return counts.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("form", "lemma", *TAGS)


def _endings(form: Column, shorter: int) -> Column:
    """Endings of 1 to MAX_SUFFIX letters that leave at least `shorter` letters."""
    longest = F.least(F.lit(MAX_SUFFIX), F.length(form) - shorter)
    return F.when(longest > 0, F.transform(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), lambda k: F.right(form, k)))


def suffix_rules(lexicon: DataFrame) -> DataFrame:
    """(ending, upos, xpos, feats, cut, added, words), one row for each ending with a rule."""
    words = lexicon.where(F.col("form").rlike(LETTERS_ONLY) & F.col("lemma").isNotNull())
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("lemma"), F.lit(1))), lambda i: (i <= F.length("form")) & (
        F.substring("form", F.lit(1), i) == F.substring("lemma", F.lit(1), i))))
    ruled = (words.withColumn("_shared", shared)
             .select("form", *TAGS, (F.length("form") - F.col("_shared")).alias("cut"),
                     F.substring("lemma", F.col("_shared") + 1, F.length("lemma")).alias("added")))
    votes = (ruled.select(F.explode(_endings(F.col("form"), 1)).alias("ending"), *TAGS, "cut", "added")
             .where("cut <= length(ending)").groupBy("ending", *TAGS, "cut", "added").agg(F.count(F.lit(1)).alias("words"))
             .where(F.col("words") >= MIN_WORDS))
    first = Window.partitionBy("ending").orderBy(F.col("words").desc(), *TAGS, "cut", "added")
    return votes.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def analyse(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """(form, lemma, upos, xpos, feats) of the forms of letters that have an ending with a rule."""
    asked = forms.where(F.col("form").rlike(LETTERS_ONLY)).select("form", F.explode(_endings(F.col("form"), 1)).alias("ending"))
    found = asked.join(rules, "ending")
    rule = F.max_by(F.struct(*TAGS, "cut", "added"), F.length("ending"))
    best = found.groupBy("form").agg(rule.alias("r"))
    return best.select("form", F.concat(F.substring("form", F.lit(1), F.length("form") - F.col("r.cut")), "r.added").alias("lemma"),
                       *[F.col(f"r.{t}").alias(t) for t in TAGS])


def tag_with_lexicon(docs: DataFrame, lexicon: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_id, idx, word, lemma, upos, xpos, feats): the T1 contract."""
    tokens = tokenize(docs, key, text)
    new = (tokens.where(_is_word(F.col("word"))).select(F.lower("word").alias("form")).distinct()
           .join(lexicon.select("form"), "form", "left_anti"))
    words = lexicon.unionByName(analyse(new, rules)).withColumnRenamed("form", "_form")
    punct, number = F.col("word").rlike(PUNCT_PATTERN), F.col("word").rlike(NUMBER_PATTERN)
    joined = tokens.withColumn("_low", F.when(_is_word(F.col("word")), F.lower("word"))).join(words, F.col("_low") == F.col("_form"), "left")
    known = F.col("_form").isNotNull()
    # a placeholder of a piece without tokens has no tags
    return joined.select(
        key, "sent_id", "idx", "word",
        F.when(known, F.col("lemma")).otherwise(F.coalesce("_low", "word")).alias("lemma"),
        F.when(punct, "PUNCT").when(number, "NUM").when(known, F.col("upos")).when(F.col("word").isNotNull(), "NOUN").alias("upos"),
        F.when(punct, "Z").when(number, "N").when(known, F.col("xpos")).when(F.col("word").isNotNull(), "S").alias("xpos"),
        F.when(number, NUMERAL_FEATS).when(known, F.col("feats")).alias("feats"))
