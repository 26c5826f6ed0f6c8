"""Fixed values.

Everything below must keep these exact values for the feature table to mean what the
learner-text method defines: level names, exam-session genres, morphological tag
strings, the lexicon frequency bounds and the readability formula constants.
"""

# ---- fixed values: proficiency levels (alphabetical = label index order) ----
LEVELS = ["A2", "B1", "B2", "C1"]

# ---- fixed values: text types ----
PERSONAL_LETTER = "personal letter"
DESCRIPTION_NARRATION = "description/narration"
SEMIFORMAL_LETTER = "semiformal letter"
ARGUMENTATIVE = "argumentative writing"

# ---- fixed values: genre of each (level, exam session); C1 is always argumentative ----
GENRE_BY_EXAM = [
    ("A2", "2018I", PERSONAL_LETTER),
    ("A2", "2018II", PERSONAL_LETTER),
    ("A2", "2018III", PERSONAL_LETTER),
    ("A2", "2020II", PERSONAL_LETTER),
    ("A2", "2018IV", DESCRIPTION_NARRATION),
    ("A2", "2020IV", DESCRIPTION_NARRATION),
    ("B1", "2018II", PERSONAL_LETTER),
    ("B1", "2020I", PERSONAL_LETTER),
    ("B1", "2020II", PERSONAL_LETTER),
    ("B1", "2018I", DESCRIPTION_NARRATION),
    ("B1", "2018III", DESCRIPTION_NARRATION),
    ("B1", "2018IV", DESCRIPTION_NARRATION),
    ("B2", "2018I", PERSONAL_LETTER),
    ("B2", "2018III", PERSONAL_LETTER),
    ("B2", "2018II", SEMIFORMAL_LETTER),
    ("B2", "2018IV", SEMIFORMAL_LETTER),
    ("B2", "2020II", ARGUMENTATIVE),
    ("B2", "2020IV", ARGUMENTATIVE),
]
ALWAYS_ARGUMENTATIVE_LEVEL = "C1"

# ---- fixed values: exam sessions present in the graded corpus ----
EXAM_SESSIONS = ["2017II", "2017IV", "2018I", "2018II", "2018III", "2018IV",
                 "2020I", "2020II", "2020IV"]

# ---- fixed values: part-of-speech tags (Xpos) with ratio and TTR columns ----
POS_TAGS = ["A", "D", "I", "J", "K", "N", "P", "S", "V"]
NOMINAL_XPOS = ["S", "A", "P", "N"]

# ---- fixed values: morphological feature strings ----
NOMINAL_TAGS = ["Case=Nom", "Case=Gen", "Case=Par", "Case=Add", "Case=Ill",
                "Case=Ine", "Case=Ela", "Case=All", "Case=Ade", "Case=Abl", "Case=Tra",
                "Case=Ter", "Case=Ess", "Case=Abe", "Case=Com", "Number=Sing", "Number=Plur"]
ADJ_DEGREE_TAGS = ["Degree=Pos", "Degree=Cmp", "Degree=Sup"]
VERB_TAGS = ["VerbForm=Fin", "Mood=Ind", "Mood=Cnd", "Mood=Imp", "Tense=Pres",
             "Tense=Past", "Number=Sing", "Number=Plur", "Polarity=Neg", "Voice=Pass",
             "VerbForm=Inf", "VerbForm=Part", "VerbForm=Conv", "Person=1", "Person=2",
             "Person=3"]

# ---- fixed values: lexicon frequency bounds (rank bound -> corpus frequency bound) ----
RARE_BOUNDS = [(5000, 220), (4000, 301), (3000, 447), (2000, 747), (1000, 1651)]

# ---- fixed values: readability and diversity constants ----
MTLD_THRESHOLD = 0.72
SMOG_SLOPE, SMOG_INTERCEPT = 1.0430, 3.1291
FK_WORDS, FK_SYLL, FK_INTERCEPT = 0.39, 11.8, 15.59
LONG_WORD_CHARS = 6
POLYSYLLABLE_MIN = 3

# ---- fixed values: characters removed from lemmas before lookups ----
STOP_LEMMA_STRIP = "_="
LEXICON_LEMMA_STRIP = "_=()\"&'"

# ---- fixed values: feature lists used by the classification studies ----
MIXED_51 = ['n_cases', 'n_Nom', 'n_Tra', 'n_Plur', 'S_cases', 'S_Nom', 'S_All',
            'S_Tra', 'S_Plur', 'A_cases', 'A_Gen', 'A_Par', 'A_Ine', 'A_Ela', 'A_Tra', 'A_Sing',
            'A_Plur', 'P_cases', 'P_Ine', 'P_Ela', 'P_Com', 'P_Prs', 'P_Dem', 'P_IntRel',
            'V_Fin', 'V_Sing', 'V_Neg', 'V_Conv', 'K_Post', 'D', 'J', 'S_Prop', 'lemma_count',
            'RTTR', 'CVV', 'D_TTR', 'S_abstr', 'rare_5000', 'MTLD', 'word_count', 'sent_count',
            'word_length', 'sent_length', 'SMOG', 'syll_count', 'spell_word_ratio',
            'avg_spell_word_ratio', 'error_word_ratio', 'errors_per_word', 'errors_per_sent',
            'avg_error_word_ratio']
SURFACE_6 = ['word_count', 'sent_count', 'word_length', 'sent_length', 'SMOG', 'syll_count']
VALIDATION_23 = ['n_cases', 'n_Tra', 'n_Plur', 'S_cases', 'S_Plur', 'A_cases', 'P_cases',
                 'P_Prs', 'P_Dem', 'P_IntRel', 'V_Fin', 'lemma_count', 'RTTR', 'CVV', 'S_abstr',
                 'MTLD', 'word_count', 'sent_count', 'word_length', 'sent_length', 'SMOG',
                 'syll_count', 'errors_per_word']
LEXICAL_5 = ['lemma_count', 'RTTR', 'CVV', 'MTLD', 'S_abstr']
MORPHOLOGICAL_25 = ['n_cases', 'n_Nom', 'n_Tra', 'n_Plur', 'S_cases',
                    'S_Nom', 'S_Tra', 'S_Plur', 'A_cases', 'A_Gen', 'A_Tra', 'A_Sing',
                    'A_Plur', 'P_cases', 'P_Ela', 'P_Prs', 'P_Dem', 'P_IntRel',
                    'V_Fin', 'V_Sing', 'V_Neg', 'K_Post', 'D', 'J', 'S_Prop']
SURFACE_3 = ['syll_count', 'word_length', 'word_count']
ERROR_2 = ['errors_per_word', 'errors_per_sent']

# ---- fixed values: display names for the importance report ----
DISPLAY_NAMES = {'lemma_count': 'lemma count', 'S_abstr': 'noun abstr.',
                 'n_cases': 'nominal cases', 'n_Tra': 'transl. case', 'n_Plur': 'plural nominals',
                 'S_cases': 'noun cases', 'S_Plur': 'plural nouns', 'A_cases': 'adjective cases',
                 'P_cases': 'pronoun cases', 'P_Prs': 'pers. pronouns', 'P_Dem': 'dem. pronouns',
                 'P_IntRel': 'int.-rel. pron.', 'V_Fin': 'finite verbs', 'word_count': 'word count',
                 'sent_count': 'sentence count', 'syll_count': 'syllable count',
                 'word_length': 'word length', 'sent_length': 'sentence length',
                 'errors_per_word': 'corr. per word'}

# ---- fixed values: request limits of the correction service ----
MAX_REQUEST_CHARS = 10000
BATCH_MAX_SENTENCES = 10
BATCH_MAX_TOKENS = 1000

# White space in the Unicode sense (`\s` of the JVM and of DuckDB is ASCII only): the inside of
# a character class that both engines read alike.
WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
