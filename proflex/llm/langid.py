"""Operator 8: language identification by Bayesian fusion of evidence.

For each row the posterior over the languages and `und` (no language) is the product of

* the text: naive Bayes over letter trigrams, against uniform trigrams for `und`.  Neighbouring
  trigrams are not independent, so the log-likelihood is divided by TEMPER;
* the language declared in the markup (`html lang`): how often rows of each language declare it;
* the address suffix: how often rows of each language have it;
* the host prior: shares of the languages among the rows of the host, smoothed towards those of
  its domain, and these towards those of all rows.

The last three are estimated on all rows by grouped sums of a first decision by text alone; a
row's own first decision is taken out of them.  The text model is fitted on a bounded sample of
labelled texts: about SAMPLE for each language, those with the smallest hashes of id and text.

Edge cases: a row without letters is `und`, whatever else is known; null texts count as empty;
null or odd addresses have an empty host; a declared language is cut to its primary code, null
or unknown ones count as one; ties go to the first language in alphabetical order; repeated rows
are rows of their own; other columns are not read; without labelled texts every row is `und`; an
empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .word_hash import ODD, mix

SAMPLE = 400            # labelled texts of each language that the text model is fitted on
MOST_LANGUAGES = 500
BUCKET_BITS = 15
TEMPER = 3.0
SMOOTH = 0.5            # added to trigram counts
STRENGTH = 5.0          # rows that the wider level counts for in a host's or domain's prior
UND = "und"
UND_PRIOR = 0.01

_U = np.uint64
#: Letters of the basic plane; higher planes hold letters for our purpose.
LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])

HIDDEN = re.compile(r"<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
TAG = re.compile(r"<[^<>]*>")
DECLARED = r"(?is)<html[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,8})"


def letter_trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a text; each word has a blank on both sides."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    kept = letters.copy()
    kept[1:] |= letters[:-1]        # the first blank after a word
    codes = np.where(letters, codes, 32)[kept].astype(np.uint64)
    if not len(codes):
        return codes.astype(np.int64)
    codes = np.concatenate([[_U(32)], codes, [_U(32)]]) if codes[-1] != 32 else np.concatenate([[_U(32)], codes])
    hashed = mix(codes[:-2] * _U(ODD) + codes[1:-1] * _U(0xD6E8FEB86659FD93) + codes[2:])
    return (hashed >> _U(64 - BUCKET_BITS)).astype(np.int64)


class TextModel:
    """log p(bucket | language) - log p(bucket | und), and the languages in order."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        weights = counts + SMOOTH
        self.table = (np.log(weights / weights.sum(1, keepdims=True)) + BUCKET_BITS * np.log(2)).T.astype(np.float32).copy()

    def of(self, part: int) -> TextModel:
        return self

    def score(self, text: str) -> tuple[list[float], int]:
        buckets = letter_trigrams(text)
        total = np.zeros(len(self.languages))
        for at in range(0, len(buckets), 1 << 16):
            total += self.table[buckets[at:at + (1 << 16)]].sum(0, dtype=np.float64)
        return (total / TEMPER).round(6).tolist(), len(buckets)


class CrossModel:
    """Two models of the same languages; texts of a part are judged by the model of the other."""

    def __init__(self, halves: list[TextModel]):
        self.halves, self.languages = halves, halves[0].languages

    def of(self, part: int) -> TextModel:
        return self.halves[1 - part]


def fit_parts(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int, parts: int) -> list[TextModel]:
    """`parts` models; the rows of a text are for one of them, by a hash of the text.  Each is fitted on
    about `sample` texts of each language: those whose hash is below a bound that the number of rows
    gives, so no task meets the texts of a language."""
    rows = labelled.select(F.lower(lang_col).alias("lang"), F.col(text_col).alias("text"),
                           F.xxhash64(id_col, text_col).alias("order"), F.pmod(F.xxhash64(text_col), F.lit(parts)).cast("int").alias("part"))
    known = rows.where("lang is not null and lang <> 'und'")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    languages = sorted(sizes)
    bounds = [min((parts * sample << 64) // sizes[lang], (1 << 64) - 1) - (1 << 63) for lang in languages]
    if not languages:
        return [TextModel([], np.zeros((0, 1 << BUCKET_BITS)))] * parts
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in zip(languages, bounds) for x in pair]), F.col("lang"))
    chosen = known.where("text <> ''").where(F.col("order") <= bound).select("lang", "part", "text")

    def make():
        def row(lang, part, text):
            found, times = np.unique(letter_trigrams(text), return_counts=True)
            return list(zip([lang] * len(found), [part] * len(found), found.tolist(), times.tolist()))
        return row

    # at most languages x buckets sums, whatever the number of rows
    sums = (map_batches(chosen, make, "lang string, part int, bucket int, times bigint").groupBy("lang", "part", "bucket")
            .agg(F.sum("times").alias("times")).groupBy("lang", "part")
            .agg(F.collect_list(F.struct("bucket", "times")).alias("counts")).collect())
    counts = np.zeros((parts, len(languages), 1 << BUCKET_BITS))
    for r in sums:
        counts[r.part, languages.index(r.lang), [c["bucket"] for c in r.counts]] = [c["times"] for c in r.counts]
    return [TextModel(languages, c) for c in counts]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE):
    """A broadcast TextModel from the bounded sample."""
    model, = fit_parts(labelled, id_col, text_col, lang_col, sample, 1)
    return labelled.sparkSession.sparkContext.broadcast(model)


def fit_halves(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE):
    """A broadcast CrossModel: two models, each for the texts that the other was fitted on."""
    return labelled.sparkSession.sparkContext.broadcast(CrossModel(fit_parts(labelled, id_col, text_col, lang_col, sample, 2)))


def visible(html: str) -> str:
    return TAG.sub(" ", HIDDEN.sub(" ", html))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """Fuse: `evidence` has id, host, domain, suffix, declared, letters and scores (one for each
    language).  Returns id, lang, posterior, text_lang, letters."""
    names = [*languages, UND]
    k = len(names)
    base = (evidence
            .withColumn("scores", F.concat("scores", F.array(F.lit(0.0))))
            .withColumn("pick", F.when(F.col("letters") == 0, k).otherwise(F.array_position("scores", F.array_max("scores"))).cast("int")))
    one = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i == F.col("pick"), 1.0).otherwise(0.0))

    def sums(*keys: str) -> DataFrame:
        """How many rows of each key were first decided for each language, as an array."""
        return base.groupBy(*keys).agg(F.array(*[F.count_if(F.col("pick") == i).cast("double") for i in range(1, k + 1)]).alias("of_" + keys[-1]))

    # all rows: one row of sums, joined by a constant
    everything = sums("declared").select(*[F.col("of_declared")[i].alias(f"c{i}") for i in range(k)]).agg(
        F.array(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)) for i in range(k)]).alias("of_all")).first()["of_all"]
    overall = F.array(*[F.lit(float(x)) for x in everything])
    joined = (base.join(sums("domain"), "domain").join(sums("domain", "host"), ["domain", "host"])
              .join(sums("suffix"), "suffix").join(sums("declared"), "declared"))
    n_suffix, n_declared = (base.select(c).distinct().count() for c in ("suffix", "declared"))

    def without_own(counts: Column) -> Column:
        return F.zip_with(counts, F.col("own"), lambda n, o: n - o)

    def smoothed(counts: Column, wider: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x)
        return F.zip_with(counts, wider, lambda n, w: (n + F.lit(STRENGTH) * w) / (size + F.lit(STRENGTH)))

    def likelihood(counts: Column, kinds: int) -> Column:
        return F.zip_with(counts, F.col("all_own"), lambda n, t: F.log((n + 1.0) / (t + float(max(kinds, 1)))))

    def decide(df: DataFrame) -> DataFrame:
        size = F.aggregate("all_own", F.lit(0.0), lambda t, x: t + x)
        df = df.withColumn("own", one).withColumn("all_own", without_own(overall))
        df = df.withColumn("prior", F.transform("all_own", lambda n: (n + 1.0) / (size + float(k))))
        df = df.withColumn("prior", smoothed(without_own(F.col("of_domain")), F.col("prior")))
        df = df.withColumn("prior", smoothed(without_own(F.col("of_host")), F.col("prior")))
        # `und` is not learnt from neighbours: its prior is fixed, and it declares nothing special
        weights = F.transform("prior", lambda p, i: F.log(F.when(i == k - 1, F.lit(UND_PRIOR)).otherwise(p)))
        score = add(add(F.col("scores"), weights), add(likelihood(without_own(F.col("of_suffix")), n_suffix),
                                                       likelihood(without_own(F.col("of_declared")), n_declared)))
        df = df.withColumn("score", score).withColumn("best", F.array_max("score"))
        total = F.aggregate("score", F.lit(0.0), lambda t, s: t + F.exp(s - F.col("best")))
        names_array = F.array(*[F.lit(n) for n in names])
        silent = F.col("letters") == 0
        return df.select(
            "id", F.when(silent, UND).otherwise(F.element_at(names_array, F.array_position("score", F.col("best")).cast("int"))).alias("lang"),
            F.when(silent, 1.0).otherwise(F.round(1.0 / total, 6)).alias("posterior"),
            F.element_at(names_array, F.col("pick")).alias("text_lang"), "letters")

    return decide(joined)


def evidence_of(df: DataFrame, model, is_html: bool) -> DataFrame:
    """Text scores of every row, written once; `df` has id, text, host, declared."""
    id_type = df.schema["id"].dataType.simpleString()

    def make():
        def row(key, text, host, declared, part):
            scores, letters = model.value.of(part).score(visible(text or "") if is_html else text or "")
            return [(key, host, declared, scores, letters)]
        return row

    found = map_batches(df.select("id", "text", "host", "declared", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("part")), make,
                        f"id {id_type}, host string, declared string, scores array<double>, letters bigint")
    return (materialize(found).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))


def primary(declared: Column, languages: list[str]) -> Column:
    code = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]{2,8})", 1))
    return F.when(code.isin(languages), code).otherwise("")


def identify_pages(pages: DataFrame, model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, lang, posterior, text_lang, letters of every page."""
    languages = model.value.languages
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("text"), host_of(F.col(url_col)).alias("host"),
                        primary(F.regexp_extract(F.col(html_col), DECLARED, 1), languages).alias("declared"))
    return identify(evidence_of(rows, model, True), languages).withColumnRenamed("id", id_col)


def identify_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                       lang_col: str = "lang") -> DataFrame:
    """The same for plain texts: the source stands for the host, the language column declares."""
    languages = model.value.languages
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                       primary(F.col(lang_col), languages).alias("declared"))
    return identify(evidence_of(rows, model, False), languages).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                    lang_col: str = "lang") -> DataFrame:
    """The documents, with all their columns, that have a language.  No text is judged by a model that
    it was fitted on.  Rows of an id that is `und` in one of its rows are told apart by a hash of the
    text."""
    keyed = docs.withColumn("_key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")))
    model = fit_halves(docs, id_col, text_col, lang_col)
    found = identify_documents(keyed, model, "_key", text_col, host_col, lang_col)
    rejected = found.where(F.col("lang") == UND).select(F.col("_key").alias("_rejected")).distinct()
    return keyed.join(rejected, F.col("_key").eqNullSafe(F.col("_rejected")), "left_anti").drop("_key")
