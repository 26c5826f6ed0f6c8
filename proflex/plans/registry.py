"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB oracles.

Every query reads the driver tables (or tables Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators.features import feature_names
from ..session import ensure_checkpoint_dir, tune_session
from . import oracle
from .corpus import document_features, round_doubles, token_table, tokens

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune_session(spark)
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def _features(names: list[str]) -> QueryFn:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(document_features(spark, sf_dir, names))
    return q


FEATURE_FAMILIES: dict[str, list[str]] = {
    # Surface and readability
    "a1_a8_surface": ["sent_count", "word_count", "sent_length", "word_length", "LIX", "SMOG",
                      "FK", "syllable_count", "polysyllables"],
    # Lexical diversity and density
    "a9_a15_lexical": ["lemma_count", "TTR", "RTTR", "Uber", "Maas", "MTLD", "CVV", "LD"],
    # Part-of-speech ratios and TTRs
    "a16_a18_pos": [n for n in feature_names() if n in list("ADIJKNPSV") or n == "S_Prop"
                    or n.endswith("_TTR")],
    # Lexicon lookups and compounds
    "a19_a21_lexicon": ["S_abstr", "rare_5000", "rare_4000", "rare_3000", "rare_2000",
                        "rare_1000", "compounds"],
    # morphology
    "a22_a30_morphology": [n for n in feature_names() if n[:2] in ("n_", "S_", "A_", "P_", "V_",
                                                                   "J_", "K_")
                           and n not in ("S_Prop", "S_abstr") and not n.endswith("_TTR")],
}


@register("t1_tokens", oracle.tokens_sql())
def t1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged token table of all documents."""
    return token_table(spark, sf_dir)


@register("t1_lexicon_tagger", oracle.lexicon_tagger_sql())
def t1_lexicon_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 with a learnt tagger: lexicon and suffix rules from the tagged conversations, applied to
    all documents, of whose words the conversations hold some."""
    from ..operators import lexicon_tagger as lt
    from ..operators.tagging import drop_empty, tag_text
    from .corpus import documents, read_table
    taught = drop_empty(tag_text(read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text")))
    lexicon = lt.build_lexicon(taught).checkpoint(eager=True)
    rules = lt.suffix_rules(lexicon).checkpoint(eager=True)
    return drop_empty(lt.tag_with_lexicon(documents(spark, sf_dir), lexicon, rules))


@register("a31_feature_table", oracle.feature_sql())
def a31_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full per-document feature table (flagship)."""
    return round_doubles(document_features(spark, sf_dir))


for _name, _cols in FEATURE_FAMILIES.items():
    register(_name, oracle.feature_sql(_cols))(_features(_cols))


# ---- segmentation, correction, error features -------------------------------------------------

from .corpus import (correction_dictionaries, document_error_features, form_counts, speller_model, merged_features,  # noqa: E402
                     sentence_stats, sentences)


@register("t2_sentences", oracle.sentences_sql())
def t2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence table of all documents (stripped; at least one row each)."""
    return sentences(spark, sf_dir)


@register("j4_j8_corrected", oracle.corrected_sql())
def j4_j8_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + J8: every sentence with the correction-list and truecaser outputs."""
    from ..operators.correction import dictionary_correct
    cl, tm = correction_dictionaries(spark, sf_dir)
    return dictionary_correct(sentences(spark, sf_dir), ["doc_id", "sent_id"], "sentence",
                              correction_list=cl, truecase_model=tm).drop("spell_pieces", "case_pieces")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both correctors on every sentence, with their spans."""
    from ..operators.correction import add_spans, dictionary_correct
    cl, tm = correction_dictionaries(spark, sf_dir)
    d = dictionary_correct(sentences(spark, sf_dir), ["doc_id", "sent_id"], "sentence", correction_list=cl, truecase_model=tm)
    return add_spans(add_spans(d, "sentence", "spell_pieces", "spell"), "sentence", "case_pieces", "case")


@register("t6_spans", oracle.spans_sql())
def t6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every correction span with its offsets, value and replacement."""
    d = _spans(spark, sf_dir)
    def tagged(kind: str):
        return F.transform(kind, lambda x: F.struct(
            F.lit(kind).alias("kind"), *[x[c].alias(c) for c in ("start", "end", "value", "replacement")]))

    # outer: the plain form adds a filter on the spans, pushed down as their whole expression
    spans = d.select("doc_id", "sent_id", F.explode_outer(F.concat(tagged("spell"), tagged("case"))).alias("s")) \
        .select("doc_id", "sent_id", "s.*")
    return spans.where(F.col("kind").isNotNull())


@register("t7_apply", oracle.applied_sql())
def t7_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans applied to the sentences, which gives the corrected sentences."""
    from ..operators.correction import apply_corrections
    d = _spans(spark, sf_dir)
    return d.select("doc_id", "sent_id", apply_corrections("sentence", "spell").alias("spell_applied"),
                    apply_corrections("sentence", "case").alias("case_applied"))


@register("a22_feats_table", oracle.feats_table_sql())
def a22_feats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each Feats string stands in each document."""
    t = token_table(spark, sf_dir)
    return (t.where(fx.not_punct() & F.col("feats").isNotNull())
            .groupBy("doc_id", "feats").agg(F.count("*").alias("n")))


@register("e1_sentence_error_stats", oracle.sentence_stats_sql())
def e1_sentence_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 (with T6 spans of both correctors): per-sentence counts and ratios."""
    st = sentence_stats(spark, sf_dir)
    return round_doubles(st.select("doc_id", "sent_id", st["words"].cast("bigint").alias("words"),
                                   "spell_n", "grammar_n", "grammar_words", "spell_ratio", "error_ratio"))


@register("e11_error_feature_table", oracle.error_sql())
def e11_error_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine document-level error features."""
    return round_doubles(document_error_features(spark, sf_dir))


@register("j1_merged_features", oracle.merged_sql())
def j1_merged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table joined with error features (158 columns, syll_count name)."""
    return round_doubles(merged_features(spark, sf_dir))


# ---- splits, selection, models and evaluation ----------------------------------------------------

from . import ml, oracle_ml  # noqa: E402
from ..operators import evaluation as ev  # noqa: E402
from ..operators.selection import anova_f, select_k_best  # noqa: E402

_KEYS = ["doc_id", "prof_level", "text_type"]


@register("m1_m3_test_split", oracle_ml.test_split_sql())
def m1_m3_test_split(spark, sf_dir):
    """M1-M3: stratified test sample (30 per level; by text type except C1)."""
    return ml.splits(spark, sf_dir)[1].select(*_KEYS)


@register("j2_train_split", oracle_ml.train_split_sql())
def j2_train_split(spark, sf_dir):
    """Training rows = all labelled rows not in the test split (anti join)."""
    return ml.splits(spark, sf_dir)[0].select(*_KEYS)


@register("m4_shuffle", oracle_ml.shuffle_sql())
def m4_shuffle(spark, sf_dir):
    """M4: reproducible shuffle key of the training rows."""
    from ..operators.sampling import shuffled
    return shuffled(ml.splits(spark, sf_dir)[0]).select(*_KEYS, "shuffle_key")


@register("m5_stratified_folds", oracle_ml.folds_sql())
def m5_stratified_folds(spark, sf_dir):
    """M5: class-balanced 10 folds of the training rows."""
    from ..operators.sampling import stratified_folds
    return stratified_folds(ml.splits(spark, sf_dir)[0]).select("doc_id", "prof_level", "fold")


@register("m6_standardize", oracle_ml.standardized_sql())
def m6_standardize(spark, sf_dir):
    """M6: features standardised with train mean / population sd (train and test rows)."""
    tr, te = ml.scaled_splits(spark, sf_dir)
    cols = ["doc_id", *ml.MODEL_FEATURES]
    out = tr.select(*cols).withColumn("split", F.lit("train")).unionByName(
        te.select(*cols).withColumn("split", F.lit("test")))
    return round_doubles(out.select("doc_id", "split", *ml.MODEL_FEATURES))


@register("m7_anova_f", oracle_ml.anova_sql())
def m7_anova_f(spark, sf_dir):
    """M7: ANOVA F of each feature against the level on the standardised train rows."""
    tr, _ = ml.scaled_splits(spark, sf_dir)
    return round_doubles(anova_f(tr, ml.MODEL_FEATURES))


@register("m8_select_k_best", oracle_ml.kbest_sql())
def m8_select_k_best(spark, sf_dir):
    """M8: the top-5 features by F."""
    tr, _ = ml.scaled_splits(spark, sf_dir)
    return round_doubles(select_k_best(anova_f(tr, ml.MODEL_FEATURES), ml.TOP_K)
                         .withColumn("rank", F.col("rank").cast("int")))


@register("m17_h1_predictions", oracle_ml.predictions_sql())
def m17_h1_predictions(spark, sf_dir):
    """M17 with helper H1: test-set predictions of the nearest-centroid model."""
    return ml.test_predictions(spark, sf_dir)[0]


@register("m24_accuracy", oracle_ml.accuracy_sql())
def m24_accuracy(spark, sf_dir):
    """Train and test accuracy."""
    te, tr = ml.test_predictions(spark, sf_dir)
    out = ev.accuracy(te).withColumn("split", F.lit("test")).unionByName(
        ev.accuracy(tr).withColumn("split", F.lit("train")))
    return round_doubles(out.select("split", "accuracy", "n"))


@register("m25_recall_by_type", oracle_ml.recall_by_type_sql())
def m25_recall_by_type(spark, sf_dir):
    """Accuracy per (level, text type) of the test split."""
    te = ml.test_predictions(spark, sf_dir)[0].withColumn("prof_level", F.col("label"))
    return round_doubles(ev.recall_by_type(te))


@register("m26_balanced_accuracy", oracle_ml.balanced_accuracy_sql())
def m26_balanced_accuracy(spark, sf_dir):
    """Balanced accuracy (mean class recall) on the test split."""
    return round_doubles(ev.balanced_accuracy(ml.test_predictions(spark, sf_dir)[0]))


@register("m27_confusion_matrix", oracle_ml.confusion_sql())
def m27_confusion_matrix(spark, sf_dir):
    """Confusion counts (true label x predicted label), long form."""
    return ev.confusion_matrix(ml.test_predictions(spark, sf_dir)[0])


@register("m23_classification_report", oracle_ml.report_sql())
def m23_classification_report(spark, sf_dir):
    """Per-class precision/recall/f1/support plus accuracy, macro and weighted rows."""
    return round_doubles(ev.classification_report(ml.test_predictions(spark, sf_dir)[0]))


@register("m22_oof_predictions", oracle_ml.oof_sql())
def m22_oof_predictions(spark, sf_dir):
    """Out-of-fold predictions of 10-fold CV (scaling, top-k and nearest centroid refitted per fold)."""
    return ml.oof_predictions(spark, sf_dir).select("doc_id", "label", "prediction", "fold")


@register("m20_cv_scores", oracle_ml.cv_scores_sql())
def m20_cv_scores(spark, sf_dir):
    """Mean and population sd of the per-fold accuracy."""
    return round_doubles(ev.cv_scores(ml.oof_predictions(spark, sf_dir)))


@register("m21_macro_prf", oracle_ml.macro_prf_sql())
def m21_macro_prf(spark, sf_dir):
    """Macro F1 / precision / recall per fold, mean and sd."""
    return round_doubles(ev.macro_prf_per_fold(ml.oof_predictions(spark, sf_dir)))


@register("m28_m29_permutation_importance", oracle_ml.importance_sql())
def m28_m29_permutation_importance(spark, sf_dir):
    """M28 + M29 + P6: permutation importance (10 repeats), ranked, with display names."""
    out = ml.importance(spark, sf_dir)
    return round_doubles(out.select("feature", "importance_mean", "importance_sd",
                                    F.col("rank").cast("int").alias("rank"), "display_name"))


@register("m28_balanced_second_set", oracle_ml.importance_sql(second=True))
def m28_balanced_second_set(spark, sf_dir):
    """M28 + M29 + P6 by balanced accuracy on a second validation set with levels of different size."""
    out = ml.importance(spark, sf_dir, second=True)
    return round_doubles(out.select("feature", "importance_mean", "importance_sd",
                                    F.col("rank").cast("int").alias("rank"), "display_name"))


def _model_query(name: str):
    def q(spark, sf_dir):
        return ml.test_predictions(spark, sf_dir, name)[0].select("doc_id", "label", "prediction")
    q.__doc__ = f"Test-set predictions of the {name} classifier (rows-only check)."
    return q


for _rid, _model in (("m10_logistic_regression", "logistic_regression"),
                     ("m11_logistic_regression_cv", "logistic_regression_cv"),
                     ("m12_svc_rbf", "svc_rbf"), ("m13_random_forest", "random_forest"),
                     ("m14_mlp", "mlp"), ("m15_lda", "lda"), ("m16_qda", "qda")):
    register(_rid)(_model_query(_model))


@register("m15_m16_one_feature", oracle_ml.discriminants_sql())
def m15_m16_one_feature(spark, sf_dir):
    """M15 + M16 with one feature, where both have a short closed form."""
    return ml.one_feature_discriminants(spark, sf_dir)


GRID_SIZES = list(range(5, len(ml.MODEL_FEATURES) + 1))


@register("m19_cv_grid")
def m19_cv_grid(spark, sf_dir):
    """M19 + M18: CV grid (scaling, top-k and model refitted per fold) for two models."""
    return round_doubles(ml.cv_grid(spark, sf_dir, ["nearest_centroid", "lda"], GRID_SIZES))


@register("m19_logistic_grid")
def m19_logistic_grid(spark, sf_dir):
    """M19 + M18 + M10: the same grid of logistic regressions, all fitted together to convergence."""
    return round_doubles(ml.cv_grid(spark, sf_dir, ["logistic_regression"], GRID_SIZES))


@register("m19_h1_grid", oracle_ml.grid_sql(GRID_SIZES))
def m19_h1_grid(spark, sf_dir):
    """M19 + M18 with H1 alone, whose scores SQL can give."""
    return round_doubles(ml.cv_grid(spark, sf_dir, ["nearest_centroid"], GRID_SIZES))


@register("m9_forward_selection")
def m9_forward_selection(spark, sf_dir):
    """M9: sequential forward selection of 3 features by 5-fold CV accuracy."""
    return round_doubles(ml.forward_selection(spark, sf_dir, 3))


# ---- lookups, scalar functions, predicates and segmentation ----------------------------------------

from ..operators import segmentation as seg  # noqa: E402
from ..operators.lookups import build_lexicon, build_stopwords, genre_lookup  # noqa: E402
from .corpus import documents  # noqa: E402


@register("j3_stopwords", oracle.stopwords_sql())
def j3_stopwords(spark, sf_dir):
    """The stopword table (100 most frequent cleaned lemmas)."""
    return build_stopwords(token_table(spark, sf_dir))


@register("j5_lexicon", oracle.lexicon_sql())
def j5_lexicon(spark, sf_dir):
    """The lexicon table (lemma key, abstractness, corpus frequency)."""
    return build_lexicon(token_table(spark, sf_dir))


@register("j7_genre_lookup", oracle.genre_sql())
def j7_genre_lookup(spark, sf_dir):
    """J7 (with P1-style metadata): level, exam session and text type of every document."""
    return genre_lookup(documents(spark, sf_dir).drop("text"))


@register("p4_p5_lemma_keys", oracle.lemma_functions_sql())
def p4_p5_lemma_keys(spark, sf_dir):
    """Stopword and lexicon keys of every distinct lemma."""
    t = token_table(spark, sf_dir)
    return t.select("lemma", fx.clean_lemma_stop("lemma").alias("stop_key"),
                    fx.clean_lemma_lexicon("lemma").alias("lexicon_key")).distinct()


@register("p7_p11_sentence_functions", oracle.sentence_functions_sql())
def p7_p11_sentence_functions(spark, sf_dir):
    """P7, P8, P9, P10, P11 applied to every sentence."""
    s = sentences(spark, sf_dir)
    return s.select("doc_id", "sent_id", F.size(fx.split_ws_tokens("sentence")).alias("ws_tokens"),
                    fx.capitalize_first("sentence").alias("capitalized"),
                    fx.detokenize_pieces("sentence").alias("detokenized"),
                    fx.length_gate("sentence").alias("accepted"),
                    fx.label_index(fx.level_from_id("doc_id")).alias("label_index"))


@register("f1_f6_predicates", oracle.predicates_sql())
def f1_f6_predicates(spark, sf_dir):
    """Per-document counts of tokens passing each predicate."""
    t = tokens(spark, sf_dir, with_meta=False)
    token = F.col("word").isNotNull()
    return t.groupBy("doc_id").agg(
        F.count_if(token & fx.not_punct()).alias("f1_not_punct"), F.count_if(token & fx.cleaned()).alias("f2_cleaned"),
        F.count_if(fx.by_pos("PROPN")).alias("f3_propn"), F.count_if(fx.by_pos("S")).alias("f3_s"),
        F.count_if(fx.nominal()).alias("f4_nominal"), F.count_if(token & fx.sentence_word()).alias("f5_sentence_words"),
        F.count_if(fx.has_feat("Case=Gen")).alias("f6_case_gen"))


@register("t3_chunks", oracle.chunks_sql(40))
def t3_chunks(spark, sf_dir):
    """Sentences cut into pieces of at most 40 characters."""
    return seg.chunk(sentences(spark, sf_dir), 40).select("doc_id", "sent_id", "piece_no", "sentence")


@register("t4_sentence_offsets", oracle.offsets_sql())
def t4_sentence_offsets(spark, sf_dir):
    """T4: character offset of every sentence in its document."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    return seg.sentence_offsets(d).select("doc_id", "sent_id", "sentence", F.col("start").cast("int"))


@register("t10_speller_suggestions", oracle.speller_sql())
def t10_speller_suggestions(spark, sf_dir):
    """T10 without context: for every word the most frequent of its candidates."""
    from ..operators.speller import candidates, suggestions, word_counts
    return suggestions(candidates(word_counts(counts=form_counts(spark, sf_dir)).checkpoint(eager=True)))


@register("t10_ngram_counts", oracle.ngrams_sql())
def t10_ngram_counts(spark, sf_dir):
    """Counts of the runs of one to three words within sentences."""
    from ..operators.speller import ngram_counts
    return ngram_counts(sentences(spark, sf_dir))


@register("t5_reassembled_text", oracle.reassembled_sql())
def t5_reassembled_text(spark, sf_dir):
    """T4 + T5: sentences and the white space before and behind them joined back into the
    document, which comes out as it was."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    return seg.reassemble(seg.delimiters(d), ["doc_id"], "sent_id", "sentence", "delim", "tail")


PIECE_CHARS = 40


@register("t4_chunk_delimiters", oracle.chunk_delimiters_sql(PIECE_CHARS))
def t4_chunk_delimiters(spark, sf_dir):
    """T2 + T3 + T4: pieces of at most 40 characters with the text between them, found by search."""
    from ..operators.requests import piece_array, piece_delimiters
    return piece_delimiters(documents(spark, sf_dir), piece_array(F.col("text"), PIECE_CHARS))


def _requests(spark, sf_dir):
    from ..operators.requests import process_requests
    return process_requests(documents(spark, sf_dir).select("doc_id", "text"),
                            correction_list=correction_dictionaries(spark, sf_dir)[0])


@register("t9_request_corrections", oracle.request_corrections_sql())
def t9_request_corrections(spark, sf_dir):
    """The corrections of every accepted request, at places of its full text."""
    return _requests(spark, sf_dir)[0].select("doc_id", F.inline("corrections"))


@register("t9_corrected_texts", oracle.request_texts_sql())
def t9_corrected_texts(spark, sf_dir):
    """T9 + T5: original and corrected text of every accepted request."""
    return _requests(spark, sf_dir)[0].select("doc_id", "original_text", "corrected_text", F.size("corrections").alias("n_corrections"))


@register("p8_rejected_requests", oracle.rejected_sql())
def p8_rejected_requests(spark, sf_dir):
    """The requests that are too long."""
    return _requests(spark, sf_dir)[1].select("doc_id", "chars", "status_code")


def _list_lines(spark, sf_dir):
    """Lines derived from the documents, each document a file: a word and the one behind it."""
    docs = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("words"))
    # the pairs are built once for a document, so that no line carries the whole array
    pairs = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get("words", i + 1).alias("following")))
    return docs.select("doc_id", F.posexplode_outer(pairs).alias("line", "pair")).select("doc_id", "line", "pair.*")


@register("s10_correction_list", oracle.correction_list_sql())
def s10_correction_list(spark, sf_dir):
    """Correction list of lines `word;next word`, a header in each document."""
    from ..sources.files import parse_correction_lines
    lines = _list_lines(spark, sf_dir)
    value = F.concat_ws(";", "word", "following")
    return parse_correction_lines(lines.select(F.col("doc_id").alias("file"), "line", value.alias("value")))


@register("s11_truecase_list", oracle.truecase_list_sql())
def s11_truecase_list(spark, sf_dir):
    """Truecase list of lines `word<TAB>place`, every third without a frequency."""
    from ..sources.files import parse_truecase_lines
    lines = _list_lines(spark, sf_dir).where("word <> ''")
    value = F.when(F.col("line") % 3 == 0, F.col("word")).otherwise(F.concat_ws("\t", "word", "line"))
    return parse_truecase_lines(lines.select(F.col("doc_id").alias("file"), "line", value.alias("value")))


@register("t9_s12_responses")
def t9_s12_responses(spark, sf_dir):
    """T9 + S12: the correction-list response of every sentence as JSON (rows-only)."""
    from ..operators.correction import add_response, dictionary_correct
    from ..sources.files import encode_response
    cl, _ = correction_dictionaries(spark, sf_dir)
    fixed = dictionary_correct(sentences(spark, sf_dir), ["doc_id", "sent_id"], "sentence", correction_list=cl)
    return encode_response(add_response(fixed, "sentence", "spell_target", "spell_pieces"), "response") \
        .select("doc_id", "sent_id", "json")


def _capitalise_batch(batch: list[str]) -> list[str]:
    return [s[:1].upper() + s[1:] for s in batch]


@register("t11_batch_infer", oracle.batch_infer_sql())
def t11_batch_infer(spark, sf_dir):
    """A per-batch sentence model (here: capitalise the first letter) run on Arrow
    batches of <= 10 sentences / <= 1,000 tokens, outputs in input order."""
    from ..operators.correction import batch_infer
    return batch_infer(sentences(spark, sf_dir), _capitalise_batch)


@register("j6_syllables", oracle.syllable_lookup_sql())
def j6_syllables(spark, sf_dir):
    """Syllables of every token from a table of hyphenated words, which holds half of the words of
    the documents (by md5); vowel groups for the rest."""
    from ..operators.lookups import syllable_lookup
    t = token_table(spark, sf_dir).select("doc_id", "sent_id", "idx", "word")
    known = t.select("word").where(F.col("word").rlike(r"^\p{L}+$") & (F.md5("word") < "8")).distinct()
    cut = F.regexp_replace(F.lower("word"), "([aeiouõäöüy]+[^aeiouõäöüy])", "$1-")
    return syllable_lookup(t, known.select("word", cut.alias("syllabified")))


@register("t8_chain", oracle.chain_sql())
def t8_chain(spark, sf_dir):
    """The correction list, then the speller (T10) in the context of each sentence."""
    from ..operators.correction import dictionary_correct
    counts = form_counts(spark, sf_dir)
    fixed = dictionary_correct(sentences(spark, sf_dir), ["doc_id", "sent_id"], "sentence", speller=speller_model(spark, sf_dir, counts),
                               correction_list=correction_dictionaries(spark, sf_dir, counts)[0])
    return fixed.select("doc_id", "sent_id", F.col("spell_target").alias("target"))


@register("p1_p2_metadata", oracle.metadata_sql())
def p1_p2_metadata(spark, sf_dir):
    """P1 + P2 on file and folder names built from level, session and id."""
    d = documents(spark, sf_dir).select("doc_id", "prof_level", "exam_time")
    name = F.concat_ws("_", "prof_level", "exam_time", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    suffix = F.when((F.col("prof_level") == "B2") & (F.col("doc_id") % 8 == 2), "_arg_writings") \
        .when(F.col("prof_level") == "B2", "_semiformal_letters").otherwise("")
    path = F.concat(F.lit("/texts/"), F.col("prof_level"), suffix, F.lit("/"), name)
    return d.select("doc_id", fx.level_from_name(name).alias("name_level"), fx.exam_from_name(name).alias("name_exam"),
                    fx.level_from_dir(path).alias("dir_level"), fx.type_from_dir(path).alias("dir_type"))


@register("f7_level_type", oracle.level_type_sql("A2", "personal letter"))
def f7_level_type(spark, sf_dir):
    """the documents of one level and text type."""
    return genre_lookup(documents(spark, sf_dir).drop("text")).where(fx.level_type("A2", "personal letter"))
