"""T1 `tag_text`: text -> token table.

The tagger contract is the six CoNLL-U columns the feature operators read
(idx, word, lemma, upos, xpos, feats) plus the document and sentence keys.  The default
tagger is a deterministic rule tagger (hash-of-word tag assignment) that runs entirely as
column expressions, so tagging stays inside whole-stage codegen and never shuffles: the
tokens of a document are produced by the task that read the document.  A trained tagger
can be plugged in with `tag_with_pandas`, which runs a user function on Arrow batches.

Sentence ids come from array positions, not from a window: the text is cut after every
sentence-final character, so piece k holds exactly the tokens with k sentence ends before
them.  That equals "1 + number of `.`, `!`, `?` tokens before the token".
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import WS

# ---- fixed values: tokeniser and sentence-end patterns ----
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^" + WS + r"\p{L}\p{N}]"
SENTENCE_END_SPLIT = r"(?<=[.!?])"
PUNCT_PATTERN = r"^[^\p{L}\p{N}]$"
NUMBER_PATTERN = r"^[0-9]+$"

# ---- fixed values: rule tagger tables, indexed by one hex digit of md5(lower(word)) ----
UPOS_BY_DIGIT = ["NOUN", "NOUN", "NOUN", "NOUN", "NOUN", "PROPN", "VERB", "VERB", "VERB",
                 "ADJ", "PRON", "ADV", "CCONJ", "SCONJ", "ADP", "INTJ"]
XPOS_BY_DIGIT = ["S", "S", "S", "S", "S", "S", "V", "V", "V",
                 "A", "P", "D", "J", "J", "K", "I"]
CASE_BY_DIGIT = ["Nom", "Gen", "Par", "Add", "Ill", "Ine", "Ela", "All", "Ade", "Abl",
                 "Tra", "Ter", "Ess", "Abe", "Com", "Nom"]
PRONTYPE_BY_DIGIT = ["PronType=Prs", "PronType=Prs", "PronType=Prs", "PronType=Prs",
                     "PronType=Prs", "PronType=Prs|Reflex=Yes", "Poss=Yes|PronType=Prs",
                     "PronType=Dem", "PronType=Dem", "PronType=Ind", "PronType=Tot",
                     "PronType=Int,Rel", "PronType=Rel", "PronType=Rcp", "PronType=Int",
                     "PronType=Dem"]
PLURAL_DIGITS = [1, 4, 7, 10, 13]
NUMERAL_FEATS = "NumForm=Digit|NumType=Card"
INFINITIVE_FEATS = "VerbForm=Inf"
PARTICIPLE_FEATS = "Tense=Past|VerbForm=Part|Voice=Pass"
CONVERB_FEATS = "VerbForm=Conv"
SUPINE_FEATS = "VerbForm=Sup|Voice=Act"
LEMMA_COMPOUND_MIN_CHARS = 11
# codes behind those of three hex digits
PUNCT_CODE, NUMBER_CODE = 4096, 4097

TOKEN_COLUMNS = ["sent_id", "idx", "word", "lemma", "upos", "xpos", "feats"]


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, text) -> (key, *carry, sent_id, idx, word); map-side only.

    A piece without a token keeps one row with a null word, so no document disappears from a
    later grouping; `drop_empty` removes these rows where only tokens are wanted."""
    pieces = docs.select(key, *carry, F.posexplode(
        F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END_SPLIT)).alias("s", "piece"))
    toks = pieces.select(key, *carry, (F.col("s") + 1).cast("int").alias("sent_id"),
                         F.posexplode_outer(F.regexp_extract_all("piece", F.lit(TOKEN_PATTERN), 0))
                         .alias("p", "word"))
    return toks.select(key, *carry, "sent_id", (F.col("p") + 1).cast("int").alias("idx"), "word")


def drop_empty(tokens: DataFrame) -> DataFrame:
    """The rows that are tokens."""
    return tokens.where(F.col("word").isNotNull())


def _feats_by_code() -> list[str | None]:
    """Feats of the rule tagger for each code: three hex digits, then punctuation and number."""
    out: list[str | None] = []
    for code in range(4096):
        xpos, d2, d3 = XPOS_BY_DIGIT[code >> 8], code >> 4 & 15, code & 15
        number = "Plur" if d3 in PLURAL_DIGITS else "Sing"
        head = ("Abbr=Yes|" if d2 == 15 else "") + "Case=" + CASE_BY_DIGIT[d2]
        degree = "Pos" if d3 <= 11 else "Cmp" if d3 <= 13 else "Sup"
        finite = (f"Mood={'Ind' if d3 <= 11 else 'Cnd' if d3 <= 13 else 'Imp'}|Number={number}|Person={d2 % 3 + 1}"
                  f"{'|Polarity=Neg' if d3 == 0 else ''}|Tense={'Pres' if d2 <= 4 else 'Past'}"
                  f"|VerbForm=Fin|Voice={'Pass' if d2 == 5 else 'Act'}")
        verb = (finite if d2 <= 9 else INFINITIVE_FEATS if d2 <= 11 else PARTICIPLE_FEATS if d2 <= 13
                else CONVERB_FEATS if d2 == 14 else SUPINE_FEATS)
        out.append({"S": f"{head}|Number={number}", "A": f"{head}|Degree={degree}|Number={number}",
                    "P": f"{head}|Number={number}|{PRONTYPE_BY_DIGIT[d3]}", "V": verb,
                    "K": "AdpType=Post" if d2 <= 7 else "AdpType=Prep"}.get(xpos))
    return [*out, None, NUMERAL_FEATS]


def _table(values: list[str | None]) -> Column:
    """A constant array of strings, folded into one literal; none of them is empty."""
    return F.split(F.lit(";".join(v or "" for v in values)), ";")


def _tag_stages(tokens: DataFrame) -> DataFrame:
    """Rule tagger: one code for each token (three hex digits of md5(lower(word)), or that the word is
    punctuation or a number), then tables by code.

    The tags leave a generator of one row, so they are columns: a filter or a projection above that
    reads them does not write the md5 out again for every place where it reads one."""
    word = F.col("word")
    lw = F.lower(word)
    code = (F.when(word.rlike(PUNCT_PATTERN), PUNCT_CODE).when(word.rlike(NUMBER_PATTERN), NUMBER_CODE)
            .otherwise(F.conv(F.substring(F.md5(lw), 1, 3), 16, 10).cast("int")))
    lemma = F.concat(F.substring(lw, 1, 4), F.when(F.length(word) >= LEMMA_COMPOUND_MIN_CHARS, "_").otherwise(""),
                     F.substring(lw, 5, 2))
    coded = tokens.select("*", code.alias("_code"), lemma.alias("_lemma"))
    c = F.col("_code")
    digit = F.when(c >= PUNCT_CODE, c - PUNCT_CODE + 16).otherwise(F.shiftright(c, 8))
    tags = F.struct(F.col("_lemma").alias("lemma"),
                    F.get(_table([*UPOS_BY_DIGIT, "PUNCT", "NUM"]), digit).alias("upos"),
                    F.get(_table([*XPOS_BY_DIGIT, "Z", "N"]), digit).alias("xpos"),
                    F.nullif(F.get(_table(_feats_by_code()), c), F.lit("")).alias("feats"))
    return coded.select(*tokens.columns, F.inline_outer(F.array(tags)))


def tag_tokens(tokens: DataFrame) -> DataFrame:
    """Add lemma/upos/xpos/feats to a (…, word) token table."""
    tagged = _tag_stages(tokens)
    cols = [c for c in tokens.columns] + ["lemma", "upos", "xpos", "feats"]
    return tagged.select(*cols)


def tag_text(docs: DataFrame, key: str = "doc_id", text: str = "text",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents -> (key, *carry, sent_id, idx, word, lemma, upos, xpos, feats)."""
    return tag_tokens(tokenize(docs, key, text, carry))


def tag_with_pandas(tokens: DataFrame, tagger: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Plug-in point for an external tagger: `tagger` gets an Arrow batch of token rows and
    returns the same rows with lemma/upos/xpos/feats filled; runs per partition."""
    fields = list(tokens.schema.fields)
    for name in ("lemma", "upos", "xpos", "feats"):
        if name not in tokens.columns:
            fields.append(T.StructField(name, T.StringType()))
    schema = T.StructType(fields)

    def run(batches):
        for pdf in batches:
            yield tagger(pdf)

    return tokens.mapInPandas(run, schema=schema)
