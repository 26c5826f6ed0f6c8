"""Scalar column functions (P*) and token predicates (F*).

All are built-in Spark expressions, so they stay JVM-side and inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LEVELS, LEXICON_LEMMA_STRIP, MAX_REQUEST_CHARS, NOMINAL_XPOS, STOP_LEMMA_STRIP, WS

# ---- fixed values: syllable nuclei (vowel groups) for the syllable fallback ----
VOWEL_GROUP = "[aeiouõäöüy]+"
# ---- fixed values: whitespace-run split that keeps the runs as tokens ----
WS_TOKEN_SPLIT = rf"(?<=[{WS}])(?=[^{WS}])|(?<=[^{WS}])(?=[{WS}])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- P: projections -------------------------------------------------------------------

def level_from_name(name) -> Column:
    """Proficiency level = first two characters of the file name."""
    return F.substring(_c(name), 1, 2)


def exam_from_name(name) -> Column:
    """Exam session = second `_`-separated field of the file name."""
    return F.split_part(_c(name), F.lit("_"), F.lit(2))


def level_from_dir(path) -> Column:
    """level = first two characters of the last directory of a path."""
    return F.substring(F.regexp_extract(_c(path), r"([^/]+)/[^/]+$", 1), 1, 2)


def type_from_dir(path) -> Column:
    """Text type of the second test set, decided by level and directory suffix."""
    d = F.regexp_extract(_c(path), r"([^/]+)/[^/]+$", 1)
    lvl = F.substring(d, 1, 2)
    return (F.when(lvl.isin("A2", "B1"), "description/narration")
            .when(((lvl == "B2") & d.endswith("arg_writings")) | (lvl == "C1"),
                  "argumentative writing")
            .when((lvl == "B2") & d.endswith("semiformal_letters"), "semiformal letter"))


def level_from_id(doc_id) -> Column:
    """Level of a document of the driver tables: doc_id mod 4 -> A2, B1, B2, C1."""
    return F.element_at(F.array(*[F.lit(v) for v in LEVELS]),
                        (F.pmod(_c(doc_id), F.lit(4)) + 1).cast("int"))


def clean_lemma_stop(lemma) -> Column:
    """Remove `_` and `=` before the stopword test."""
    return F.translate(_c(lemma), STOP_LEMMA_STRIP, "")


def clean_lemma_lexicon(lemma) -> Column:
    """P5: remove `_ = ( ) " & '` before the lexicon lookup."""
    return F.translate(_c(lemma), LEXICON_LEMMA_STRIP, "")


def split_ws_tokens(s) -> Column:
    """Split into tokens keeping whitespace runs as their own tokens."""
    return F.split(_c(s), WS_TOKEN_SPLIT)


def detokenize_pieces(s) -> Column:
    """Sub-word pieces -> text: drop spaces, `▁` becomes a space, strip."""
    joined = F.replace(F.replace(_c(s), F.lit(" "), F.lit("")), F.lit("▁"), F.lit(" "))
    return F.regexp_replace(joined, rf"^[{WS}]+|[{WS}]+$", "")


def capitalize_first(s) -> Column:
    """P10: upper-case the first character only."""
    s = _c(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


def length_gate(text, max_chars: int = MAX_REQUEST_CHARS) -> Column:
    """A request is accepted when its text has at most `max_chars` characters."""
    return F.length(_c(text)) <= F.lit(max_chars)


def label_index(label) -> Column:
    """Numeric label in alphabetical order of the level names (A2=0, B1=1, ...)."""
    return F.array_position(F.array(*[F.lit(v) for v in LEVELS]), _c(label)).cast("int") - 1


def syllables(word) -> Column:
    """Syllable fallback: number of vowel groups, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(_c(word)), F.lit(VOWEL_GROUP)))


# ---- F: predicates --------------------------------------------------------------------

def not_punct(xpos="xpos") -> Column:
    """Xpos is not `Z`; a missing Xpos is kept."""
    return ~_c(xpos).eqNullSafe("Z")


def cleaned(upos="upos", feats="feats", xpos="xpos") -> Column:
    """F2 (on top of F1): drop PROPN, SYM and digit numerals; missing values are kept."""
    return (not_punct(xpos) & ~_c(upos).eqNullSafe("PROPN") & ~_c(upos).eqNullSafe("SYM")
            & ~F.coalesce(_c(feats).contains("NumForm=Digit"), F.lit(False)))


def by_pos(tag: str, upos="upos", xpos="xpos") -> Column:
    """a tag longer than one character tests Upos, otherwise Xpos."""
    return (_c(upos) if len(tag) > 1 else _c(xpos)) == F.lit(tag)


def nominal(xpos="xpos") -> Column:
    """Xpos in S, A, P, N."""
    return _c(xpos).isin(NOMINAL_XPOS)


def sentence_word(upos="upos") -> Column:
    """words of a sentence for error ratios (Upos is not PUNCT)."""
    return ~_c(upos).eqNullSafe("PUNCT")


def has_feat(f: str, feats="feats") -> Column:
    """substring test on the Feats string (null Feats -> false)."""
    return F.coalesce(_c(feats).contains(f), F.lit(False))


def level_type(level: str, text_type: str) -> Column:
    """rows of one (level, text type) cell."""
    return (F.col("prof_level") == level) & (F.col("text_type") == text_type)
