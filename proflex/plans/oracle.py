"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark plans (different formulation where possible: window
sums instead of array positions, `count(DISTINCT …)` instead of collected sets, list_reduce
instead of a Python fold) so that agreement is evidence, not a tautology.  Doubles are
rounded to 6 places on both sides; integer sums are cast to BIGINT.
"""

from __future__ import annotations

from ..constants import (ADJ_DEGREE_TAGS, EXAM_SESSIONS, GENRE_BY_EXAM, LEVELS, NOMINAL_TAGS,
                         POS_TAGS, RARE_BOUNDS, VERB_TAGS, WS)
from ..operators.features import PRONOUN_TAGS, _suffix, _verb_name, feature_names
from ..operators.tagging import (CASE_BY_DIGIT, PRONTYPE_BY_DIGIT, UPOS_BY_DIGIT, XPOS_BY_DIGIT)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


TOKEN = r"[\p{L}\p{N}]+|[^" + WS + r"\p{L}\p{N}]"

HEX = "'0123456789abcdef'"

DOCS_CTE = f"""
docs AS (
  SELECT doc_id, text,
         {lst(LEVELS)}[(doc_id % 4) + 1] AS prof_level,
         {lst(EXAM_SESSIONS)}[(CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 9) + 1] AS exam_time
  FROM documents)"""

TOKENS_CTE = DOCS_CTE + r""",
raw_tok AS (
  SELECT doc_id, prof_level, exam_time, unnest(toks) AS word, unnest(generate_series(1, len(toks))) AS i
  FROM (SELECT *, regexp_extract_all(text, '""" + TOKEN + r"""') AS toks FROM docs)),
sent_tok AS (
  SELECT *, 1 + coalesce(sum(CASE WHEN word IN ('.', '!', '?') THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS sent_id
  FROM raw_tok),
idx_tok AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY i) AS INTEGER) AS idx,
         md5(lower(word)) AS h
  FROM sent_tok),
dig_tok AS (
  SELECT *, strpos(""" + HEX + r""", substr(h, 1, 1)) - 1 AS d1,
            strpos(""" + HEX + r""", substr(h, 2, 1)) - 1 AS d2,
            strpos(""" + HEX + r""", substr(h, 3, 1)) - 1 AS d3,
            regexp_matches(word, '^[^\p{L}\p{N}]$') AS is_punct,
            regexp_matches(word, '^[0-9]+$') AS is_num
  FROM idx_tok),
pos_tok AS (
  SELECT *,
    substr(lower(word), 1, 4) || CASE WHEN length(word) >= 11 THEN '_' ELSE '' END
      || substr(lower(word), 5, 2) AS lemma,
    CASE WHEN is_punct THEN 'PUNCT' WHEN is_num THEN 'NUM' ELSE """ + lst(UPOS_BY_DIGIT) + r"""[d1 + 1] END AS upos,
    CASE WHEN is_punct THEN 'Z' WHEN is_num THEN 'N' ELSE """ + lst(XPOS_BY_DIGIT) + r"""[d1 + 1] END AS xpos,
    CASE WHEN d3 IN (1, 4, 7, 10, 13) THEN 'Plur' ELSE 'Sing' END AS num,
    CASE WHEN d2 = 15 THEN 'Abbr=Yes|' ELSE '' END || 'Case=' || """ + lst(CASE_BY_DIGIT) + r"""[d2 + 1] AS nhead
  FROM dig_tok),
tok AS (
  SELECT doc_id, prof_level, exam_time, i, sent_id, idx, word, lemma, upos, xpos,
    CASE xpos
      WHEN 'N' THEN 'NumForm=Digit|NumType=Card'
      WHEN 'S' THEN nhead || '|Number=' || num
      WHEN 'A' THEN nhead || '|Degree=' || CASE WHEN d3 <= 11 THEN 'Pos' WHEN d3 <= 13 THEN 'Cmp' ELSE 'Sup' END
                   || '|Number=' || num
      WHEN 'P' THEN nhead || '|Number=' || num || '|' || """ + lst(PRONTYPE_BY_DIGIT) + r"""[d3 + 1]
      WHEN 'V' THEN CASE
          WHEN d2 <= 9 THEN 'Mood=' || CASE WHEN d3 <= 11 THEN 'Ind' WHEN d3 <= 13 THEN 'Cnd' ELSE 'Imp' END
               || '|Number=' || num || '|Person=' || CAST(d2 % 3 + 1 AS VARCHAR)
               || CASE WHEN d3 = 0 THEN '|Polarity=Neg' ELSE '' END
               || '|Tense=' || CASE WHEN d2 <= 4 THEN 'Pres' ELSE 'Past' END
               || '|VerbForm=Fin|Voice=' || CASE WHEN d2 = 5 THEN 'Pass' ELSE 'Act' END
          WHEN d2 <= 11 THEN 'VerbForm=Inf'
          WHEN d2 <= 13 THEN 'Tense=Past|VerbForm=Part|Voice=Pass'
          WHEN d2 = 14 THEN 'VerbForm=Conv'
          ELSE 'VerbForm=Sup|Voice=Act' END
      WHEN 'K' THEN CASE WHEN d2 <= 7 THEN 'AdpType=Post' ELSE 'AdpType=Prep' END
    END AS feats
  FROM pos_tok)"""

LOOKUP_CTE = r""",
wtok AS (SELECT * FROM tok WHERE xpos IS DISTINCT FROM 'Z'),
lexicon AS (
  SELECT key AS lemma, count(*) AS frequency,
         CAST(1 + (ascii(substr(md5(key), 1, 1)) % 3) AS DOUBLE) AS abstractness
  FROM (SELECT regexp_replace(lemma, '[_=()"&'']', '', 'g') AS key FROM wtok WHERE lemma IS NOT NULL)
  WHERE key <> '' GROUP BY key),
stopwords AS (
  SELECT key AS stoplemma FROM (
    SELECT replace(replace(lemma, '_', ''), '=', '') AS key, count(*) AS n
    FROM wtok WHERE lemma IS NOT NULL GROUP BY 1)
  ORDER BY n DESC, key LIMIT 100),
ftok AS (
  SELECT t.*, (t.xpos IS DISTINCT FROM 'Z') AS w,
    (t.xpos IS DISTINCT FROM 'Z') AND (t.upos IS DISTINCT FROM 'PROPN') AND (t.upos IS DISTINCT FROM 'SYM')
      AND NOT coalesce(contains(t.feats, 'NumForm=Digit'), false) AS c,
    (t.xpos IS DISTINCT FROM 'Z') AND t.xpos IN ('S', 'A', 'P', 'N') AS nom,
    greatest(1, len(regexp_extract_all(lower(t.word), '[aeiouõäöüy]+'))) AS syl,
    (s.stoplemma IS NOT NULL) AS is_stop,
    l.abstractness, l.frequency
  FROM tok t
  LEFT JOIN stopwords s ON replace(replace(t.lemma, '_', ''), '=', '') = s.stoplemma
  LEFT JOIN lexicon l ON regexp_replace(t.lemma, '[_=()"&'']', '', 'g') = l.lemma)"""


def _r(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0)"


def _g(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / {den} ELSE 0.0 END"


def _cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def feature_sql(names: list[str] | None = None, rounded: bool = True) -> str:
    """Per-document features from `ftok`, one column per requested name."""
    n = names or feature_names()
    agg = {
        "sent": _cnt("idx = 1"), "words": _cnt("w"),
        "len": "CAST(sum(length(word)) FILTER (WHERE w) AS BIGINT)",
        "long": _cnt("w AND length(word) > 6"),
        "syl": "CAST(sum(syl) FILTER (WHERE w) AS BIGINT)", "poly": _cnt("w AND syl >= 3"),
        "lemmas": "count(DISTINCT lemma) FILTER (WHERE w)",
        "nclean": _cnt("c AND lemma IS NOT NULL"), "vclean": "count(DISTINCT lemma) FILTER (WHERE c)",
        "cwords": _cnt("c"), "cstop": _cnt("c AND is_stop"),
        "propn": _cnt("w AND upos = 'PROPN'"), "cconj": _cnt("w AND upos = 'CCONJ'"),
        "sconj": _cnt("w AND upos = 'SCONJ'"),
        "abs_sum": "sum(abstractness) FILTER (WHERE w AND xpos = 'S' AND abstractness <> 0)",
        "abs_n": _cnt("w AND xpos = 'S' AND abstractness <> 0"),
        "comp": _cnt("w AND contains(lemma, '_')"), "nomn": _cnt("nom"),
        "ncases": "count(DISTINCT split_part(feats, '|', 1)) FILTER (WHERE nom AND contains(feats, 'Case='))",
        "mtld_words": "coalesce(list(lower(word) ORDER BY sent_id, idx) FILTER (WHERE c), [])",
    }
    for t in POS_TAGS:
        agg[f"pos_{t}"] = _cnt(f"w AND xpos = '{t}'")
        agg[f"poslem_{t}"] = _cnt(f"w AND xpos = '{t}' AND lemma IS NOT NULL")
        agg[f"posdist_{t}"] = f"count(DISTINCT lemma) FILTER (WHERE w AND xpos = '{t}')"
    for x in ("S", "A", "P"):
        agg[f"cases_{x}"] = (f"count(DISTINCT split_part(feats, '|', 1)) FILTER "
                             f"(WHERE w AND xpos = '{x}' AND contains(feats, 'Case='))")
    for bound, freq in RARE_BOUNDS:
        agg[f"rare_{bound}"] = _cnt(f"w AND frequency <> 0 AND frequency < {freq}")
    keyi = 0
    tagcols = {}
    for prefix, cond, tags in (("n", "nom", NOMINAL_TAGS), ("S", "w AND xpos = 'S'", NOMINAL_TAGS),
                               ("A", "w AND xpos = 'A'", NOMINAL_TAGS + ADJ_DEGREE_TAGS),
                               ("P", "w AND xpos = 'P'", NOMINAL_TAGS + PRONOUN_TAGS),
                               ("V", "w AND xpos = 'V'", VERB_TAGS),
                               ("K", "w AND xpos = 'K'", ["AdpType=Prep", "AdpType=Post"])):
        for tag in tags:
            keyi += 1
            tagcols[(prefix, tag)] = f"t{keyi}"
            agg[f"t{keyi}"] = _cnt(f"{cond} AND contains(feats, {q(tag)})")

    lnn = "ln(nullif(CAST(nclean AS DOUBLE), 0))"
    lnv = "ln(nullif(CAST(vclean AS DOUBLE), 0))"
    thr = "0.72::DOUBLE"
    mtld = (f"list_reduce(mtld_words, lambda s, x: CASE "
            f"WHEN CAST(len(CASE WHEN list_contains(s.types, x) THEN s.types ELSE list_append(s.types, x) END) AS DOUBLE)"
            f" / (s.tc + 1) <= {thr} "
            f"THEN {{'f': s.f + 1.0::DOUBLE, 'tc': 0, 'types': []::VARCHAR[], 'ttr': 1.0::DOUBLE}} "
            f"ELSE {{'f': s.f, 'tc': s.tc + 1, "
            f"'types': CASE WHEN list_contains(s.types, x) THEN s.types ELSE list_append(s.types, x) END, "
            f"'ttr': CAST(len(CASE WHEN list_contains(s.types, x) THEN s.types ELSE list_append(s.types, x) END) AS DOUBLE)"
            f" / (s.tc + 1)}} END, "
            f"{{'f': 0.0::DOUBLE, 'tc': 0, 'types': []::VARCHAR[], 'ttr': 1.0::DOUBLE}})")
    fin = {
        "sent_count": "sent", "word_count": "words",
        "sent_length": _r("words", "sent"), "word_length": _r("len", "words"),
        "LIX": f"CAST(round_even({_r('words', 'sent')} + 100.0::DOUBLE * {_r('long', 'words')}, 0) AS BIGINT)",
        "SMOG": f"1.0430::DOUBLE * sqrt(poly * (30.0::DOUBLE / nullif(sent, 0))) + 3.1291::DOUBLE",
        "FK": f"0.39::DOUBLE * {_r('words', 'sent')} + 11.8::DOUBLE * {_r('syl', 'words')} - 15.59::DOUBLE",
        "syllable_count": "syl", "polysyllables": "poly", "lemma_count": "lemmas",
        "TTR": _r("vclean", "nclean"),
        "RTTR": "CAST(vclean AS DOUBLE) / nullif(sqrt(CAST(nclean AS DOUBLE)), 0)",
        "Uber": f"({lnn} * {lnn}) / nullif({lnn} - {lnv}, 0)",
        "Maas": f"({lnn} - {lnv}) / nullif({lnn} * {lnn}, 0)",
        "MTLD": (f"CASE WHEN (m.f + (1.0::DOUBLE - m.ttr) / (1.0::DOUBLE - {thr})) <> 0 "
                 f"THEN len(mtld_words) / (m.f + (1.0::DOUBLE - m.ttr) / (1.0::DOUBLE - {thr})) ELSE -1.0 END"),
        "CVV": "CAST(posdist_V AS DOUBLE) / nullif(sqrt(2.0 * poslem_V), 0)",
        "LD": _r("(cwords - cstop)", "cwords"),
        "S_Prop": _r("propn", "words"),
        "S_abstr": "abs_sum / nullif(CAST(abs_n AS DOUBLE), 0)",
        "compounds": _r("comp", "words"),
        "n_cases": "ncases", "S_cases": "cases_S", "A_cases": "cases_A", "P_cases": "cases_P",
        "J_Crd": _r("cconj", "pos_J"), "J_Sub": _r("sconj", "pos_J"),
    }
    for t in POS_TAGS:
        fin[t] = _r(f"pos_{t}", "words")
        fin[f"{t}_TTR"] = _g(f"posdist_{t}", f"poslem_{t}")
    for bound, _ in RARE_BOUNDS:
        fin[f"rare_{bound}"] = _r(f"rare_{bound}", "words")
    dens = {"n": "nomn", "S": "pos_S", "A": "pos_A", "P": "pos_P", "V": "pos_V", "K": "pos_K"}
    for (prefix, tag), col in tagcols.items():
        ratio = _g(col, dens[prefix])
        if prefix == "V":
            fin[_verb_name(tag)] = ratio
        elif prefix == "K":
            fin["K_" + _suffix(tag)] = ratio
        elif prefix == "P" and tag in PRONOUN_TAGS:
            fin["_P|" + tag] = ratio
        else:
            fin[f"{prefix}_{_suffix(tag)}"] = ratio
    fin["n_AddIll"] = f"({fin['n_Add']}) + ({fin['n_Ill']})"
    fin["S_AddIll"] = f"({fin['S_Add']}) + ({fin['S_Ill']})"

    def p(tag):
        return "(" + fin["_P|" + tag] + ")"

    fin["P_Reflex"] = f"{p('Reflex=Yes')} + {p('Poss=Yes')}"
    fin["P_Prs"] = f"{p('PronType=Prs')} - ({fin['P_Reflex']})"
    fin["P_Dem"] = p("PronType=Dem")
    fin["P_Ind"] = f"{p('PronType=Ind')} + {p('PronType=Tot')}"
    fin["P_IntRel"] = f"{p('PronType=Int,Rel')} + {p('PronType=Rel')}"
    fin["P_Rcp"] = p("PronType=Rcp")
    fin["V_NonFin"] = f"({fin['V_Inf']}) + ({fin['V_Part']}) + ({fin['V_Conv']})"

    int_cols = {"sent_count", "word_count", "LIX", "syllable_count", "polysyllables", "lemma_count",
                "n_cases", "S_cases", "A_cases", "P_cases"}
    select = []
    for name in n:
        e = fin[name]
        if name in int_cols:
            select.append(f"CAST({e} AS BIGINT) AS \"{name}\"")
        elif rounded:
            select.append(f"round(CAST({e} AS DOUBLE), 6) AS \"{name}\"")
        else:
            select.append(f"CAST({e} AS DOUBLE) AS \"{name}\"")
    aggs = ",\n    ".join(f"{e} AS {k}" for k, e in agg.items())
    genre_rows = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in GENRE_BY_EXAM)
    return f"""WITH {TOKENS_CTE}{LOOKUP_CTE},
per_doc AS (
  SELECT doc_id, prof_level, exam_time,
    {aggs}
  FROM (SELECT d.doc_id, d.prof_level, d.exam_time, f.* EXCLUDE (doc_id, prof_level, exam_time)
        FROM docs d LEFT JOIN ftok f ON d.doc_id = f.doc_id)
  GROUP BY doc_id, prof_level, exam_time),
genres(g_level, g_exam, g_type) AS (VALUES {genre_rows}),
folded AS (SELECT *, {mtld} AS m FROM per_doc)
SELECT doc_id, prof_level, exam_time,
  CASE WHEN prof_level = 'C1' THEN 'argumentative writing' ELSE g.g_type END AS text_type,
  {", ".join(select)}
FROM folded LEFT JOIN genres g ON prof_level = g.g_level AND exam_time = g.g_exam"""


def tokens_sql() -> str:
    return f"""WITH {TOKENS_CTE}
SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, idx, word, lemma, upos, xpos, feats FROM tok"""


def lexicon_tagger_sql() -> str:
    """Endings of up to 5 letters, 2 words for a rule."""
    taught = TOKENS_CTE.replace("FROM documents)", "FROM (SELECT conv_id AS doc_id, text, '0' AS source FROM conversations))")
    raw = TOKENS_CTE[:TOKENS_CTE.index("dig_tok AS (")].rstrip().rstrip(",")
    return rf"""WITH taught AS (WITH {taught} SELECT word, lemma, upos, xpos, feats FROM tok),
lex AS MATERIALIZED (
  SELECT form, lemma, upos, xpos, feats FROM (
    SELECT lower(word) AS form, lemma, upos, xpos, feats, count(*) AS n FROM taught
    WHERE regexp_matches(word, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY n DESC, lemma NULLS FIRST, upos NULLS FIRST, xpos NULLS FIRST, feats NULLS FIRST) = 1),
shared AS (
  SELECT *, len(list_filter(range(1, least(length(form), length(lemma)) + 1), lambda i: substr(form, 1, i) = substr(lemma, 1, i))) AS p
  FROM lex WHERE regexp_full_match(form, '\p{{L}}+') AND lemma IS NOT NULL),
votes AS (
  SELECT ending, upos, xpos, feats, cut, added, count(*) AS words FROM (
    SELECT upos, xpos, feats, length(form) - p AS cut, substr(lemma, p + 1) AS added,
           right(form, unnest(range(1, least(5, length(form) - 1) + 1))) AS ending FROM shared)
  WHERE cut <= length(ending) GROUP BY ALL HAVING count(*) >= 2),
rules AS MATERIALIZED (
  SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY ending
    ORDER BY words DESC, upos NULLS FIRST, xpos NULLS FIRST, feats NULLS FIRST, cut, added) = 1),
spoken AS MATERIALIZED (WITH {raw} SELECT doc_id, sent_id, idx, word FROM idx_tok),
new_forms AS (
  SELECT DISTINCT lower(word) AS form FROM spoken
  WHERE regexp_full_match(word, '\p{{L}}+') AND lower(word) NOT IN (SELECT form FROM lex)),
guessed AS (
  SELECT e.form, substr(e.form, 1, length(e.form) - r.cut) || r.added AS lemma, r.upos, r.xpos, r.feats
  FROM (SELECT form, right(form, unnest(range(1, least(5, length(form) - 1) + 1))) AS ending FROM new_forms) e
  JOIN rules r ON r.ending = e.ending
  QUALIFY row_number() OVER (PARTITION BY e.form ORDER BY length(e.ending) DESC) = 1),
known AS (SELECT * FROM lex UNION ALL SELECT form, lemma, upos, xpos, feats FROM guessed),
kinds AS (
  SELECT *, NOT regexp_matches(word, '[\p{{L}}\p{{N}}]') AS punct, regexp_matches(word, '^[0-9]+$') AS number FROM spoken)
SELECT k.doc_id, CAST(k.sent_id AS INTEGER) AS sent_id, k.idx, k.word,
  CASE WHEN punct OR number THEN word WHEN w.form IS NULL THEN lower(word) ELSE w.lemma END AS lemma,
  CASE WHEN punct THEN 'PUNCT' WHEN number THEN 'NUM' WHEN w.form IS NULL THEN 'NOUN' ELSE w.upos END AS upos,
  CASE WHEN punct THEN 'Z' WHEN number THEN 'N' WHEN w.form IS NULL THEN 'S' ELSE w.xpos END AS xpos,
  CASE WHEN punct THEN NULL WHEN number THEN 'NumForm=Digit|NumType=Card' ELSE w.feats END AS feats
FROM kinds k LEFT JOIN known w ON w.form = lower(k.word) AND NOT punct AND NOT number"""


# ---- error features (E1-E11) -----------------------------------------------------------------

_TOK = TOKEN

SENTENCES_CTE = r"""
bodies AS (
  SELECT doc_id, coalesce(text, '') AS whole, NOT regexp_matches(coalesce(text, ''), '[^WS]') AS blank,
         CASE WHEN blank THEN '' ELSE regexp_replace(whole, '[WS]+$', '') END AS body
  FROM documents),
pieces AS (
  SELECT doc_id, unnest(p) AS piece, unnest(generate_series(1, len(p))) AS sent_id, substr(whole, length(body) + 1) AS tail
  FROM (SELECT *, string_split(regexp_replace(body, '([.!?])([WS])', '\1' || chr(65535) || '\2', 'g'), chr(65535)) AS p FROM bodies)),
sents AS (
  SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, regexp_replace(piece, '^[WS]+', '') AS sentence, piece, tail
  FROM pieces)""".replace("[WS]", "[" + WS + "]").replace("[^WS]", "[^" + WS + "]")

DICT_CTE = r""",
corpus_words AS (
  SELECT unnest(regexp_extract_all(text, '""" + _TOK + r"""')) AS word FROM documents),
cl AS (
  SELECT DISTINCT word AS wrong,
    CASE substr(md5(word), 1, 2) WHEN '00' THEN word || 'q' WHEN '02' THEN ''
      ELSE substr(word, 1, length(word) // 2) || ' ' || substr(word, length(word) // 2 + 1) END AS "right"
  FROM corpus_words
  WHERE regexp_matches(word, '[\p{L}\p{N}]')
    AND (substr(md5(word), 1, 2) IN ('00', '02') OR (starts_with(md5(word), '01') AND length(word) > 1))),
forms AS (
  SELECT lower(word) AS key, word AS form, count(*) AS freq FROM corpus_words
  WHERE regexp_matches(word, '[\p{L}\p{N}]') GROUP BY 1, 2),
tm AS (
  SELECT key, form AS word FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY freq DESC, form) AS rn FROM forms)
  WHERE rn = 1)"""

CORRECTED_CTE = r""",
stok AS (
  SELECT doc_id, sent_id, sentence, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos,
         gaps
  FROM (SELECT *, regexp_extract_all(sentence, '""" + _TOK + r"""') AS toks,
               regexp_split_to_array(sentence, '""" + _TOK + r"""') AS gaps FROM sents)),
jt AS (
  SELECT s.doc_id, s.sent_id, s.sentence, s.pos, s.tok, s.gaps[s.pos + 1] AS gap,
         cl."right" AS spell, tm.word AS case_word, regexp_matches(s.tok, '[\p{L}\p{N}]') AS is_word,
         coalesce(sum(CASE WHEN regexp_matches(s.tok, '[\p{L}\p{N}]') THEN 1 ELSE 0 END)
           OVER (PARTITION BY s.doc_id, s.sent_id ORDER BY s.pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before,
         lag(s.tok) OVER (PARTITION BY s.doc_id, s.sent_id ORDER BY s.pos) AS prev_tok
  FROM stok s LEFT JOIN cl ON s.tok = cl.wrong LEFT JOIN tm ON lower(s.tok) = tm.key),
outs AS (
  SELECT *, coalesce(spell, tok) AS spell_out,
    CASE WHEN is_word AND case_word IS NOT NULL AND (words_before = 0
                  OR (upper(tok) = tok AND lower(tok) <> tok) OR prev_tok IN ('.', ':', ';', '?', '!'))
                THEN case_word ELSE tok END AS case_out
  FROM jt),
corrected AS (
  SELECT s.doc_id, s.sent_id, s.sentence, coalesce(o.spell_target, '') AS spell_target, coalesce(o.case_target, '') AS case_target
  FROM sents s LEFT JOIN (
    SELECT doc_id, sent_id,
      string_agg(spell_out || repeat(' ', length(coalesce(gap, ''))), '' ORDER BY pos) AS spell_target,
      string_agg(case_out || coalesce(gap, ''), '' ORDER BY pos) AS case_target
    FROM outs GROUP BY doc_id, sent_id) o ON s.doc_id = o.doc_id AND s.sent_id = o.sent_id)"""


# The speller (T10).  Fixed values: ratio 20, backoff 0.4, a change costs ln 100, order 3.
PAIRS_CTE = r"""
spelt AS (SELECT unnest(regexp_extract_all(text, '""" + _TOK + r"""')) AS word FROM documents),
spelt_counts AS (SELECT lower(word) AS w, count(*) AS n FROM spelt WHERE regexp_matches(word, '^\p{L}+$') GROUP BY 1),
variants AS (
  SELECT w, n, unnest(list_distinct(list_concat([w],
           list_transform(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1))))) AS key
  FROM spelt_counts),
pairs AS MATERIALIZED (
  SELECT DISTINCT r.w AS wrong, t.w AS "right", t.n AS right_count
  FROM variants r JOIN variants t ON r.key = t.key
  WHERE t.n >= 20 * r.n AND r.w <> t.w
    AND (length(r.w) <> length(t.w)
         OR len(list_filter(range(1, length(r.w) + 1), lambda i: substr(r.w, i, 1) <> substr(t.w, i, 1))) = 1))"""

GRAMS_CTE = r"""
sequences AS (
  SELECT doc_id, sent_id, list_concat(list_concat(['<s>', '<s>'], list_transform(list_filter(regexp_extract_all(sentence, '""" + _TOK + r"""'),
           lambda t: regexp_matches(t, '[\p{L}\p{N}]')), lambda t: lower(t))), ['</s>']) AS seq FROM sents),
gram_rows AS (
  SELECT doc_id, sent_id, unnest(list_concat(list_concat(seq,
           list_transform(range(1, len(seq)), lambda i: seq[i] || ' ' || seq[i + 1])),
           list_transform(range(1, len(seq) - 1), lambda i: seq[i] || ' ' || seq[i + 1] || ' ' || seq[i + 2]))) AS gram
  FROM sequences),
grams AS MATERIALIZED (SELECT gram, count(*) AS n FROM gram_rows GROUP BY 1)"""


def _micro(x: str) -> str:
    return f"CAST(round(ln({x}) * 1000000) AS BIGINT)"


def _seen(alias: str) -> str:
    return f"(coalesce({alias}.n, 0) - coalesce(own_{alias}.n, 0))"


def _gram_join(alias: str, gram: str) -> str:
    return (f"LEFT JOIN grams {alias} ON {alias}.gram = {gram} "
            f"LEFT JOIN own own_{alias} ON own_{alias}.doc_id = w.doc_id AND own_{alias}.sent_id = w.sent_id AND own_{alias}.gram = {gram}\n  ")


CHAINED_CTE = CORRECTED_CTE[:CORRECTED_CTE.index("corrected AS (")].replace("outs AS (", "listed AS (") + r"""
own AS (SELECT doc_id, sent_id, gram, count(*) AS n FROM gram_rows GROUP BY ALL),
context AS (
  SELECT doc_id, sent_id, pos, fixed, tok, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS sub
  FROM (SELECT doc_id, sent_id, pos, tok, spell IS NOT NULL AND spell <> tok AS fixed,
          CASE WHEN spell IS NOT NULL AND spell <> tok THEN list_transform(regexp_extract_all(spell, '[\p{L}\p{N}]+'), lambda t: lower(t))
               WHEN is_word THEN [lower(tok)] ELSE [] END AS ws FROM listed)),
numbered AS MATERIALIZED (
  SELECT *, 2 + row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos, sub) AS j FROM context
  UNION ALL SELECT doc_id, sent_id, 0, true, NULL, '<s>', 1, unnest([1, 2]) FROM sents
  UNION ALL SELECT s.doc_id, s.sent_id, 0, true, NULL, '</s>', 1, 3 + (SELECT count(*) FROM context c WHERE c.doc_id = s.doc_id AND c.sent_id = s.sent_id) FROM sents s),
choices AS MATERIALIZED (
  SELECT doc_id, sent_id, j, word, 0 AS changed FROM numbered
  UNION ALL SELECT doc_id, sent_id, j, p."right", 1 FROM numbered JOIN pairs p ON p.wrong = word WHERE NOT fixed),
hit_places AS (SELECT DISTINCT doc_id, sent_id, j FROM choices WHERE changed = 1),
isles AS (
  SELECT doc_id, sent_id, isle, min(j) AS first, max(j) AS last
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, sent_id ORDER BY j) AS isle
        FROM (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY doc_id, sent_id ORDER BY j) <= 2 THEN 0 ELSE 1 END AS fresh FROM hit_places))
  GROUP BY ALL),
window_ends AS (SELECT doc_id, sent_id, isle, first, unnest(range(first, last + 3)) AS j FROM isles),
windows AS (
  SELECT e.doc_id, e.sent_id, e.isle, e.j, a.word AS a, b.word AS b, c.word AS c, c.changed
  FROM window_ends e
  JOIN choices a ON a.doc_id = e.doc_id AND a.sent_id = e.sent_id AND a.j = e.j - 2
  JOIN choices b ON b.doc_id = e.doc_id AND b.sent_id = e.sent_id AND b.j = e.j - 1
  JOIN choices c ON c.doc_id = e.doc_id AND c.sent_id = e.sent_id AND c.j = e.j),
scored AS MATERIALIZED (
  SELECT w.*, CASE
      WHEN """ + _seen("abc") + " > 0 THEN " + _micro(_seen("abc")) + " - " + _micro(_seen("ab")) + r"""
      WHEN """ + _seen("bc") + " > 0 THEN " + _micro("0.4") + " + " + _micro(_seen("bc")) + " - " + _micro(_seen("b")) + r"""
      ELSE 2 * """ + _micro("0.4") + " + " + _micro("greatest(" + _seen("c") + ", 1)") + " - " + _micro("(SELECT sum(n) FROM grams WHERE NOT contains(gram, ' '))") + r"""
    END - changed * """ + _micro("100") + r""" AS score
  FROM windows w
  """ + _gram_join("abc", "w.a || ' ' || w.b || ' ' || w.c") + _gram_join("ab", "w.a || ' ' || w.b") + _gram_join("bc", "w.b || ' ' || w.c") \
    + _gram_join("b", "w.b") + _gram_join("c", "w.c").rstrip() + r"""),
paths AS (
  SELECT i.doc_id, i.sent_id, i.isle, i.first - 1 AS j, a.word AS a, b.word AS b, CAST(0 AS BIGINT) AS score, 0 AS changes, CAST([] AS VARCHAR[]) AS picks
  FROM isles i JOIN choices a ON a.doc_id = i.doc_id AND a.sent_id = i.sent_id AND a.j = i.first - 2
  JOIN choices b ON b.doc_id = i.doc_id AND b.sent_id = i.sent_id AND b.j = i.first - 1
  UNION ALL
  SELECT doc_id, sent_id, isle, j, a, b, score, changes, picks FROM (
    SELECT p.doc_id, p.sent_id, p.isle, s.j, s.b AS a, s.c AS b, p.score + s.score AS score, p.changes + s.changed AS changes,
      list_append(p.picks, s.c) AS picks,
      row_number() OVER (PARTITION BY p.doc_id, p.sent_id, p.isle, s.b, s.c
                         ORDER BY p.score + s.score DESC, p.changes + s.changed, list_append(p.picks, s.c)) AS rn
    FROM paths p JOIN scored s ON s.doc_id = p.doc_id AND s.sent_id = p.sent_id AND s.isle = p.isle AND s.j = p.j + 1 AND s.a = p.a AND s.b = p.b)
  WHERE rn = 1),
best_paths AS (
  SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY doc_id, sent_id, isle ORDER BY j DESC, score DESC, changes, picks) = 1),
picked AS (
  SELECT doc_id, sent_id, unnest(picks) AS word, j - len(picks) + unnest(generate_series(1, len(picks))) AS j FROM best_paths),
respelt AS (
  SELECT n.doc_id, n.sent_id, n.pos, CASE WHEN substr(n.tok, 1, 1) = lower(substr(n.tok, 1, 1)) THEN k.word
           ELSE upper(substr(k.word, 1, 1)) || substr(k.word, 2) END AS respell
  FROM picked k JOIN numbered n ON n.doc_id = k.doc_id AND n.sent_id = k.sent_id AND n.j = k.j WHERE k.word <> n.word),
outs AS (
  SELECT l.* REPLACE (coalesce(r.respell, l.spell_out) AS spell_out)
  FROM listed l LEFT JOIN respelt r ON r.doc_id = l.doc_id AND r.sent_id = l.sent_id AND r.pos = l.pos),
""" + CORRECTED_CTE[CORRECTED_CTE.index("corrected AS ("):]


# Spans as gaps and islands over one row for each white-space-kept token (`place`).
ISLANDS_CTE = r""",
placed AS (
  SELECT *, 1 + 2 * coalesce(sum(CASE WHEN length(gap) > 0 THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM outs),
kept AS (
  SELECT doc_id, sent_id, place, string_agg(tok, '' ORDER BY pos) AS src,
         string_agg(spell_out, '' ORDER BY pos) AS spell, string_agg(case_out, '' ORDER BY pos) AS "case"
  FROM placed GROUP BY ALL
  UNION ALL
  SELECT doc_id, sent_id, place + 1, gap, repeat(' ', length(gap)), gap FROM placed WHERE length(gap) > 0),
both_kinds AS (
  SELECT doc_id, sent_id, place, src, 'spell' AS kind, spell AS new FROM kept
  UNION ALL SELECT doc_id, sent_id, place, src, 'case', "case" FROM kept),
islands AS (
  SELECT *, sum(CASE WHEN before IS NULL OR place - before > 3 THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id, sent_id, kind ORDER BY place) AS island
  FROM (SELECT *, lag(place) OVER (PARTITION BY doc_id, sent_id, kind ORDER BY place) AS before
        FROM both_kinds WHERE src <> new)),
ends AS (
  SELECT doc_id, sent_id, kind, island, min(place) AS a, max(place) AS b FROM islands GROUP BY ALL),
wide AS (
  SELECT e.doc_id, e.sent_id, e.kind, e.island, a - CASE WHEN l.src <> ' ' THEN 1 ELSE 0 END AS lo,
         b + CASE WHEN r.src <> ' ' THEN 1 ELSE 0 END AS hi
  FROM ends e
  LEFT JOIN kept l ON l.doc_id = e.doc_id AND l.sent_id = e.sent_id AND l.place = a - 1
  LEFT JOIN kept r ON r.doc_id = e.doc_id AND r.sent_id = e.sent_id AND r.place = b + 1),
spans AS (
  SELECT w.doc_id, w.sent_id, w.kind,
         CAST(coalesce(sum(length(k.src)) FILTER (WHERE k.place < lo), 0) AS INTEGER) AS "start",
         CAST(sum(length(k.src)) FILTER (WHERE k.place <= hi) AS INTEGER) AS "end",
         string_agg(k.src, '' ORDER BY k.place) FILTER (WHERE k.place BETWEEN lo AND hi) AS "value",
         nullif(string_agg(k.new, '' ORDER BY k.place) FILTER (WHERE k.place BETWEEN lo AND hi), '') AS replacement
  FROM wide w JOIN both_kinds k ON k.doc_id = w.doc_id AND k.sent_id = w.sent_id AND k.kind = w.kind
  GROUP BY w.doc_id, w.sent_id, w.kind, w.island)"""

SPANS_CTE = CORRECTED_CTE + ISLANDS_CTE

# spelling spans are those of the chain
ERROR_STATS_CTE = "," + PAIRS_CTE + "," + GRAMS_CTE + CHAINED_CTE + ISLANDS_CTE + r""",
counted AS (
  SELECT doc_id, sent_id, count(*) FILTER (WHERE kind = 'spell') AS spell_n, count(*) FILTER (WHERE kind = 'case') AS grammar_n,
         coalesce(sum(len(regexp_extract_all("value", '[^""" + WS + r"""]+'))) FILTER (WHERE kind = 'case'), 0) AS grammar_words
  FROM spans GROUP BY doc_id, sent_id),
sstats AS (
  SELECT s.doc_id, s.sent_id, len(regexp_extract_all(s.sentence, '[\p{L}\p{N}]+')) AS words,
         coalesce(spell_n, 0) AS spell_n, coalesce(grammar_n, 0) AS grammar_n, coalesce(grammar_words, 0) AS grammar_words
  FROM sents s LEFT JOIN counted c ON s.doc_id = c.doc_id AND s.sent_id = c.sent_id),
sratio AS (
  SELECT *, CASE WHEN spell_n > 0 THEN spell_n / nullif(CAST(words AS DOUBLE), 0) ELSE 0.0 END AS spell_ratio,
            CASE WHEN grammar_n > 0 THEN grammar_words / nullif(CAST(words AS DOUBLE), 0) ELSE 0.0 END AS error_ratio
  FROM sstats)"""


def error_sql() -> str:
    return f"""WITH RECURSIVE {SENTENCES_CTE}{DICT_CTE}{ERROR_STATS_CTE}
SELECT doc_id,
  round(sum(spell_n) / nullif(CAST(sum(words) AS DOUBLE), 0), 6) AS spell_word_ratio,
  round(count(*) FILTER (WHERE spell_n > 0) / CAST(count(*) AS DOUBLE), 6) AS spell_sent_ratio,
  round(sum(spell_n) / CAST(count(*) AS DOUBLE), 6) AS spell_errors_per_sent,
  round(avg(spell_ratio), 6) AS avg_spell_word_ratio,
  round(sum(grammar_words) / nullif(CAST(sum(words) AS DOUBLE), 0), 6) AS error_word_ratio,
  round(count(*) FILTER (WHERE grammar_n > 0) / CAST(count(*) AS DOUBLE), 6) AS error_sent_ratio,
  round(sum(grammar_n) / nullif(CAST(sum(words) AS DOUBLE), 0), 6) AS errors_per_word,
  round(sum(grammar_n) / CAST(count(*) AS DOUBLE), 6) AS errors_per_sent,
  round(avg(error_ratio), 6) AS avg_error_word_ratio
FROM sratio GROUP BY doc_id"""


def sentence_stats_sql() -> str:
    return f"""WITH RECURSIVE {SENTENCES_CTE}{DICT_CTE}{ERROR_STATS_CTE}
SELECT doc_id, sent_id, CAST(words AS BIGINT) AS words, CAST(spell_n AS INTEGER) AS spell_n,
       CAST(grammar_n AS INTEGER) AS grammar_n, CAST(grammar_words AS INTEGER) AS grammar_words,
       round(spell_ratio, 6) AS spell_ratio, round(error_ratio, 6) AS error_ratio
FROM sratio"""


def spans_sql() -> str:
    return f"""WITH {SENTENCES_CTE}{DICT_CTE}{SPANS_CTE}
SELECT doc_id, sent_id, kind, "start", "end", "value", replacement FROM spans"""


def applied_sql() -> str:
    return f"""WITH {SENTENCES_CTE}{DICT_CTE}{CORRECTED_CTE}
SELECT doc_id, sent_id, spell_target AS spell_applied, case_target AS case_applied FROM corrected"""


def feats_table_sql() -> str:
    return f"""WITH {TOKENS_CTE}
SELECT doc_id, feats, count(*) AS n FROM tok WHERE xpos IS DISTINCT FROM 'Z' AND feats IS NOT NULL GROUP BY doc_id, feats"""


def chain_sql() -> str:
    """The spelling column of the chain; nothing to strip, as the sentences are stripped."""
    return f"""WITH RECURSIVE {SENTENCES_CTE}{DICT_CTE},{PAIRS_CTE},{GRAMS_CTE}{CHAINED_CTE}
SELECT doc_id, sent_id, spell_target AS target FROM corrected"""


def metadata_sql() -> str:
    return f"""WITH {DOCS_CTE},
named AS (SELECT doc_id, prof_level || '_' || exam_time || '_' || doc_id || '.txt' AS name,
                 '/' || prof_level || CASE WHEN prof_level = 'B2' AND doc_id % 8 = 2 THEN '_arg_writings'
                   WHEN prof_level = 'B2' THEN '_semiformal_letters' ELSE '' END AS dir FROM docs)
SELECT doc_id, substr(name, 1, 2) AS name_level, split_part(name, '_', 2) AS name_exam, substr(dir, 2, 2) AS dir_level,
  CASE WHEN substr(dir, 2, 2) IN ('A2', 'B1') THEN 'description/narration'
       WHEN dir LIKE '%arg_writings' OR substr(dir, 2, 2) = 'C1' THEN 'argumentative writing'
       ELSE 'semiformal letter' END AS dir_type FROM named"""


def level_type_sql(level: str, text_type: str) -> str:
    return f"SELECT * FROM ({genre_sql()}) WHERE prof_level = {q(level)} AND text_type = {q(text_type)}"


def sentences_sql() -> str:
    return f"""WITH {SENTENCES_CTE}
SELECT doc_id, sent_id, sentence FROM sents"""


def batch_infer_sql() -> str:
    return f"""WITH {SENTENCES_CTE}
SELECT doc_id, sent_id, sentence, upper(substr(sentence, 1, 1)) || substr(sentence, 2) AS target FROM sents"""


def syllable_lookup_sql() -> str:
    return rf"""WITH {TOKENS_CTE},
known AS (
  SELECT DISTINCT word, regexp_replace(lower(word), '([aeiouõäöüy]+[^aeiouõäöüy])', '\1-', 'g') AS syllabified
  FROM tok WHERE regexp_full_match(word, '\p{{L}}+') AND md5(word) < '8')
SELECT t.doc_id, CAST(t.sent_id AS INTEGER) AS sent_id, t.idx, t.word, CAST(CASE
  WHEN k.word IS NOT NULL THEN length(k.syllabified) - length(replace(k.syllabified, '-', '')) + 1
  ELSE greatest(1, len(regexp_extract_all(lower(t.word), '[aeiouõäöüy]+'))) END AS INTEGER) AS syllables
FROM tok t LEFT JOIN known k ON t.word = k.word"""


def corrected_sql() -> str:
    return f"""WITH {SENTENCES_CTE}{DICT_CTE}{CORRECTED_CTE}
SELECT doc_id, sent_id, sentence, spell_target, case_target FROM corrected"""


def merged_sql(names: list[str] | None = None) -> str:
    f = feature_sql(names)
    return (f"SELECT * EXCLUDE (syllable_count), syllable_count AS syll_count FROM ({f}) f "
            f"JOIN ({error_sql()}) e USING (doc_id)") if (names is None or "syllable_count" in names) \
        else f"SELECT * FROM ({f}) f JOIN ({error_sql()}) e USING (doc_id)"


# ---- lookups, scalar functions, predicates, segmentation ------------------------------------------

def stopwords_sql() -> str:
    return f"WITH {TOKENS_CTE}{LOOKUP_CTE}\nSELECT stoplemma AS \"Stoplemma\" FROM stopwords"


def lexicon_sql() -> str:
    return f"WITH {TOKENS_CTE}{LOOKUP_CTE}\nSELECT lemma, abstractness, frequency FROM lexicon"


def genre_sql() -> str:
    genre_rows = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in GENRE_BY_EXAM)
    return f"""WITH {DOCS_CTE},
genres(g_level, g_exam, g_type) AS (VALUES {genre_rows})
SELECT doc_id, prof_level, exam_time,
       CASE WHEN prof_level = 'C1' THEN 'argumentative writing' ELSE g.g_type END AS text_type
FROM docs LEFT JOIN genres g ON prof_level = g.g_level AND exam_time = g.g_exam"""


def lemma_functions_sql() -> str:
    return f"""WITH {TOKENS_CTE}
SELECT DISTINCT lemma, replace(replace(lemma, '_', ''), '=', '') AS stop_key,
       regexp_replace(lemma, '[_=()"&'']', '', 'g') AS lexicon_key FROM tok"""


def sentence_functions_sql() -> str:
    return f"""WITH {SENTENCES_CTE}
SELECT doc_id, sent_id, CAST(len(regexp_extract_all(sentence, '[{WS}]+|[^{WS}]+')) AS INTEGER) AS ws_tokens,
       upper(substr(sentence, 1, 1)) || substr(sentence, 2) AS capitalized,
       regexp_replace(replace(replace(sentence, ' ', ''), '▁', ' '), '^[{WS}]+|[{WS}]+$', '', 'g') AS detokenized,
       length(sentence) <= 10000 AS accepted,
       CAST(list_position(['A2', 'B1', 'B2', 'C1'], ['A2', 'B1', 'B2', 'C1'][(doc_id % 4) + 1]) - 1 AS INTEGER)
         AS label_index
FROM sents"""


def predicates_sql() -> str:
    return f"""WITH {TOKENS_CTE}
SELECT doc_id,
  count(*) FILTER (WHERE word IS NOT NULL AND xpos IS DISTINCT FROM 'Z') AS f1_not_punct,
  count(*) FILTER (WHERE word IS NOT NULL AND xpos IS DISTINCT FROM 'Z' AND upos IS DISTINCT FROM 'PROPN'
                   AND upos IS DISTINCT FROM 'SYM' AND NOT coalesce(contains(feats, 'NumForm=Digit'), false))
    AS f2_cleaned,
  count(*) FILTER (WHERE upos = 'PROPN') AS f3_propn,
  count(*) FILTER (WHERE xpos = 'S') AS f3_s,
  count(*) FILTER (WHERE xpos IN ('S', 'A', 'P', 'N')) AS f4_nominal,
  count(*) FILTER (WHERE word IS NOT NULL AND upos IS DISTINCT FROM 'PUNCT') AS f5_sentence_words,
  count(*) FILTER (WHERE coalesce(contains(feats, 'Case=Gen'), false)) AS f6_case_gen
FROM (SELECT d.doc_id, t.* EXCLUDE (doc_id) FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id)
GROUP BY doc_id"""


def chunks_sql(max_pos: int = 40) -> str:
    return f"""WITH {SENTENCES_CTE}
SELECT doc_id, sent_id, CAST(k AS INTEGER) AS piece_no, substr(sentence, (k - 1) * {max_pos} + 1, {max_pos}) AS sentence
FROM (SELECT *, unnest(range(1, CAST(greatest(ceil(length(sentence) / {max_pos}), 1) AS BIGINT) + 1)) AS k FROM sents)"""


def offsets_sql() -> str:
    return f"""WITH {SENTENCES_CTE}
SELECT doc_id, sent_id, sentence, CAST(
    coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(piece) - length(sentence) AS INTEGER) AS start FROM sents"""


def speller_sql() -> str:
    return f"""WITH {PAIRS_CTE}
SELECT wrong, "right", right_count FROM (
  SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY right_count DESC, "right") AS rn FROM pairs)
WHERE rn = 1"""


def ngrams_sql() -> str:
    return f"""WITH {SENTENCES_CTE},{GRAMS_CTE}
SELECT CAST(1 + length(gram) - length(replace(gram, ' ', '')) AS INTEGER) AS words, gram, n AS times FROM grams"""


def reassembled_sql() -> str:
    return "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def chunk_delimiters_sql(max_pos: int) -> str:
    """From the sentences: the first piece of a sentence has the white space before it, others nothing;
    sentences without a character are no pieces, but their white space counts for the next."""
    return f"""WITH {SENTENCES_CTE},
full_text AS (
  SELECT doc_id, sent_id, sentence, piece, tail, coalesce(sum(CASE WHEN sentence <> '' THEN 1 ELSE 0 END) OVER (
           PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(CASE WHEN sentence <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS n FROM sents),
chunks AS (
  SELECT doc_id, sent_id, tail, unnest(range(1, CAST(ceil(length(sentence) / {max_pos}) AS BIGINT) + 1)) AS k, sentence,
         substr(piece, 1, length(piece) - length(sentence)) AS lead FROM full_text WHERE sentence <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, k) AS INTEGER) AS piece_no,
  substr(sentence, (k - 1) * {max_pos} + 1, {max_pos}) AS piece, CASE WHEN k = 1 THEN lead ELSE '' END AS delim, tail FROM chunks
UNION ALL
SELECT doc_id, 1, '', '', coalesce(text, '') FROM documents WHERE doc_id IN (SELECT doc_id FROM full_text WHERE n = 0)"""


_REQUEST_CTE = SPANS_CTE + r""",
starts AS (
  SELECT doc_id, sent_id, sentence, piece, tail, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY sent_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(piece) - length(sentence) AS INTEGER) AS at FROM sents),
accepted AS (SELECT doc_id FROM documents WHERE coalesce(length(text), 0) <= 10000)"""


def request_corrections_sql() -> str:
    return f"""WITH {SENTENCES_CTE}{DICT_CTE}{_REQUEST_CTE}
SELECT s.doc_id, s."start" + t.at AS "start", s."end" + t.at AS "end", s."value", s.replacement
FROM spans s JOIN starts t ON t.doc_id = s.doc_id AND t.sent_id = s.sent_id
WHERE s.kind = 'spell' AND s.doc_id IN (SELECT doc_id FROM accepted)"""


def request_texts_sql() -> str:
    return f"""WITH {SENTENCES_CTE}{DICT_CTE}{_REQUEST_CTE},
counted AS (SELECT doc_id, count(*) AS n FROM spans WHERE kind = 'spell' GROUP BY 1)
SELECT c.doc_id, coalesce(any_value(d.text), '') AS original_text,
  string_agg(substr(t.piece, 1, length(t.piece) - length(t.sentence)) || regexp_replace(c.spell_target, '^[{WS}]+|[{WS}]+$', '', 'g'), ''
             ORDER BY c.sent_id) || any_value(t.tail) AS corrected_text,
  CAST(coalesce(any_value(n.n), 0) AS INTEGER) AS n_corrections
FROM corrected c JOIN starts t ON t.doc_id = c.doc_id AND t.sent_id = c.sent_id JOIN documents d ON d.doc_id = c.doc_id
LEFT JOIN counted n ON n.doc_id = c.doc_id WHERE c.doc_id IN (SELECT doc_id FROM accepted) GROUP BY c.doc_id"""


def rejected_sql() -> str:
    return "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, 422 AS status_code FROM documents WHERE length(text) > 10000"


_LINES = "SELECT doc_id, words, unnest(words) AS word, unnest(range(len(words))) AS line FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents WHERE text IS NOT NULL)"


def correction_list_sql() -> str:
    return f"""WITH lines AS ({_LINES}),
fields AS (
  SELECT doc_id, line, string_split(word || CASE WHEN line + 1 < len(words) THEN ';' || words[line + 2] ELSE '' END, ';') AS p
  FROM lines WHERE line > 0)
SELECT p[1] AS wrong, regexp_replace(p[2], '^[{WS}]+|[{WS}]+$', '', 'g') AS "right" FROM fields WHERE len(p) >= 2
QUALIFY row_number() OVER (PARTITION BY p[1] ORDER BY doc_id DESC, line DESC) = 1"""


def truecase_list_sql() -> str:
    return f"""WITH lines AS ({_LINES}),
stripped AS (
  SELECT doc_id, line, regexp_replace(CASE WHEN line % 3 = 0 THEN word ELSE word || chr(9) || line END, '^[{WS}]+|[{WS}]+$', '', 'g') AS s
  FROM lines WHERE word <> ''),
fields AS (SELECT doc_id, line, s, string_split(s, chr(9)) AS p FROM stripped),
entries AS (
  SELECT doc_id, line, CASE WHEN len(p) = 2 THEN p[1] ELSE s END AS word,
         CASE WHEN len(p) = 2 THEN coalesce(TRY_CAST(p[2] AS INTEGER), 5) ELSE 5 END AS freq FROM fields)
SELECT lower(word) AS key, word, freq FROM entries
QUALIFY row_number() OVER (PARTITION BY lower(word) ORDER BY doc_id DESC, line DESC) = 1"""
