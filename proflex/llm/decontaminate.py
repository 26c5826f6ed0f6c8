"""Operator 1: benchmark decontamination with a BM25 index and block-max WAND.

Index.  Each benchmark item is cut into units of at most UNIT_WORDS words.  The index holds, for
each term, the units it stands in with their BM25 weight, divided by the unit's highest
attainable score, so a passage that holds a whole unit scores 1.  Units are put into blocks of
BLOCK; for each term the index keeps the largest weight of all and the largest of each block.

Search.  The queries are all training passages: windows of 2 * UNIT_WORDS words, one beginning
every UNIT_WORDS, so any run of UNIT_WORDS words lies whole in one of them.  A window is dropped
when the sum of its terms' largest weights stays under the threshold; a block is skipped when
the sum of its block maxima does; only the blocks left are scored exactly.  Both sums are upper
bounds, so every (passage, unit) with a score of at least the threshold is found.

Verification.  An item is question and answer: the answer is its last sentence, or the last
third of the words when there is one sentence only.  A candidate counts when the passage and the
item's length on either side hold at least OVERLAP of the question's and of the answer's word
trigrams (of the whole part, where it has fewer words).  One changed word spoils most trigrams of
a short answer, so a candidate also counts when they hold OVERLAP of the trigrams of the whole
item, or a run of words from which at most 1 - ORDERED of the item's words were edited.

Words are runs without white space, lower-cased, without other than letters and digits at both
ends; a run of none is no word.

The index is broadcast to the tasks: it is built in shards of at most SHARD_CHARS characters of
benchmark text, which is checked, and each shard is searched in one pass over the documents.
Corpus statistics of BM25 are those of the whole benchmark, whatever the shards.

Edge cases: null and empty documents match nothing; null and empty items, or items without
words, are not indexed; repeated rows give repeated results; equal items are all reported; other
columns are not read; empty tables give an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import id_and_text, map_batches, materialize

UNIT_WORDS = 64
BLOCK = 4
SHARD_CHARS = 1 << 20
THRESHOLD = 0.7         # share of a unit's highest BM25 score
OVERLAP = 0.6           # of the trigrams of the question, and of the answer
ORDERED = 0.8           # of an item's words, left in their order by edits
K1, B = 1.2, 0.75
GRAM = 3
MEMO_WORDS = 300_000    # entries of a task's word table; a full one is emptied
CHUNK = 1 << 15         # terms whose block maxima are summed at a time

SENTENCE = re.compile(r"[.!?]+\s+|\n+")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normal(run: str) -> str:
    return EDGE.sub("", run.lower())


def words_of(text: str) -> list[str]:
    return [w for w in map(normal, text.split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for part in parts[:-1] for w in part], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def grams(words: list) -> set[tuple]:
    n = min(GRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def unit_terms(items: DataFrame) -> DataFrame:
    """Unit terms of the items: (entry, shard, unit, term, tf, length, df, units, mean)."""

    def make():
        def row(entry, text, shard):
            words = words_of(text or "")
            out = []
            for n, start in enumerate(range(0, len(words), UNIT_WORDS)):
                unit = words[start:start + UNIT_WORDS]
                out += [(entry, shard, n, term, tf, len(unit)) for term, tf in Counter(unit).items()]
            return out
        return row

    terms = map_batches(items.select("entry", "text", "shard"), make,
                        "entry bigint, shard int, unit int, term string, tf int, length int")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    totals = (terms.groupBy().agg(F.sum("tf").alias("n_words")),
              terms.select("entry", "unit").distinct().groupBy().agg(F.count("*").alias("units")))
    n_words, units = (t.first()[0] for t in totals)
    return (terms.join(df, "term")
            .withColumn("units", F.lit(units or 0))
            .withColumn("mean", F.lit((n_words or 0) / (units or 1))))


def shards_of(items: DataFrame, limit: int) -> list[DataFrame]:
    """The items, packed into shards of at most `limit` characters of text: one that is longer than
    half of that has a shard of its own, the others follow each other."""
    lengths = items.select("entry", F.length("text").cast("long").alias("chars"))
    long = F.col("chars") * 2 > limit
    short_before = F.sum(F.when(long, 0).otherwise(F.col("chars"))).over(Window.orderBy("entry")) - F.when(long, 0).otherwise(F.col("chars"))
    own = F.sum(F.when(long, 1).otherwise(0)).over(Window.orderBy("entry"))
    # even numbers for the short ones, odd ones for the long
    dealt = lengths.select("entry", F.when(long, 2 * own - 1).otherwise(2 * F.floor(short_before * 2 / limit)).cast("int").alias("shard"))
    dealt = items.join(dealt, "entry")
    held = dealt.groupBy("shard").agg(F.sum(F.length("text")).alias("chars")).orderBy("shard").collect()
    if any(r.chars > limit for r in held):
        raise ValueError(f"a benchmark item is longer than a shard of {limit} characters")
    if not held:
        return [dealt]
    number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(held) for x in (r.shard, i)]), F.col("shard"))
    dealt = dealt.withColumn("shard", number)
    dealt = materialize(dealt)
    return [dealt.where(F.col("shard") == i) for i in range(len(held))]


class Index:
    """One shard: block maxima, postings by block, and the items' parts for verification."""

    def __init__(self, rows: list, items: list[tuple]):
        by_unit = defaultdict(list)
        for r in rows:
            idf = math.log(1 + (r.units - r.df + 0.5) / (r.df + 0.5))
            weight = idf * r.tf * (K1 + 1) / (r.tf + K1 * (1 - B + B * r.length / r.mean))
            by_unit[(r.entry, r.unit)].append((r.term, weight))
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for u in by_unit.values() for t, _ in u}))}
        keys = sorted(by_unit)
        self.unit_entries = [entry for entry, _ in keys]
        blocks = -(-len(keys) // BLOCK)
        self.block_max = np.zeros((len(self.vocabulary), blocks), np.float32)
        scores: list[dict[int, np.ndarray]] = [{} for _ in range(blocks)]
        for u, key in enumerate(keys):
            terms = by_unit[key]
            best = math.fsum(w for _, w in terms)
            for term, weight in terms:
                t, share = self.vocabulary[term], weight / best
                scores[u // BLOCK].setdefault(t, np.zeros(BLOCK))[u % BLOCK] = share
                self.block_max[t, u // BLOCK] = max(self.block_max[t, u // BLOCK], np.nextafter(np.float32(share), np.float32(2)))
        self.block_terms = [np.array(sorted(s), np.int64) for s in scores]
        self.block_scores = [np.array([s[t] for t in sorted(s)]) for s in scores]
        self.term_max = self.block_max.max(1) if blocks else np.zeros(0, np.float32)
        self.parts = {}     # entry -> item id, grams of question, of answer and of both, words
        ids = self.vocabulary
        for entry, item, text in items:
            question, answer = question_and_answer(text)
            self.parts[entry] = (item, *[grams([ids[w] for w in part]) for part in (question, answer, question + answer)],
                                 [ids[w] for w in question + answer])


class WordTable(dict):
    """Run of a text -> term number, -1 for other words, -2 for no word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, run: str) -> int:
        word = normal(run)
        number = self[run] = self.vocabulary.get(word, -1) if word else -2
        return number


class Searcher:
    """Searches one shard for the passages of many texts."""

    def __init__(self, index: Index, threshold: float, overlap: float):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.table = WordTable(index.vocabulary)

    def numbers(self, text: str) -> np.ndarray:
        if len(self.table) > MEMO_WORDS:
            self.table.clear()
        runs = text.split()
        ids = np.fromiter(map(self.table.__getitem__, runs), np.int64, len(runs))
        return ids[ids > -2]

    def candidates(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, float]]]:
        """For each text the (unit, first word of the passage, score) with enough score."""
        index, limit = self.index, self.threshold - 1e-6
        found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        if not index.unit_entries:
            return found
        sizes = np.array([len(t) // UNIT_WORDS + 2 for t in texts])     # one empty segment after each text
        bases = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        segments = [base + np.arange(len(t)) // UNIT_WORDS for base, t in zip(bases, texts)]
        terms, segment = np.concatenate(texts), np.concatenate(segments)
        known = terms >= 0
        width = len(index.vocabulary)
        keys = np.unique(segment[known] * width + terms[known])
        segment, terms = np.divmod(keys, width)
        n = int(sizes.sum())
        starts = np.searchsorted(segment, np.arange(n + 1))
        bound = np.bincount(segment, index.term_max[terms], n)
        passage = bound[:-1] + bound[1:] >= limit           # WAND: largest weights of all
        needed = np.zeros(n, bool)
        needed[:-1] |= passage
        needed[1:] |= passage
        sums = {}
        wanted = np.flatnonzero(needed & (starts[1:] > starts[:-1]))
        at = 0
        while at < len(wanted):
            upto = at + max(1, int(np.searchsorted(np.cumsum(starts[wanted[at:at + CHUNK] + 1] - starts[wanted[at:at + CHUNK]]), CHUNK)))
            group = wanted[at:upto]
            lengths = starts[group + 1] - starts[group]
            offsets = np.cumsum(lengths) - lengths
            rows = np.repeat(starts[group] - offsets, lengths) + np.arange(int(lengths.sum()))
            sums[at] = np.add.reduceat(index.block_max[terms[rows]], offsets, axis=0)
            at = upto
        if not sums:
            return found
        matrix = np.concatenate(list(sums.values()))
        place = np.full(n + 1, -1)
        place[wanted] = np.arange(len(wanted))
        first = np.flatnonzero(passage)
        zero = np.zeros((1, matrix.shape[1]), np.float32)
        matrix = np.concatenate([matrix, zero])             # place -1: an empty segment
        for part in range(0, len(first), 4096):             # WAND: largest weights of each block
            here = first[part:part + 4096]
            which, block = np.nonzero(matrix[place[here]] + matrix[place[here + 1]] >= limit)
            for seg, b in zip(here[which].tolist(), block.tolist()):
                held = np.unique(terms[starts[seg]:starts[seg + 2]])
                slots = np.searchsorted(index.block_terms[b], held)
                slots[slots == len(index.block_terms[b])] = 0
                scores = index.block_scores[b][slots[index.block_terms[b][slots] == held]].sum(0)
                for u in np.flatnonzero(scores >= limit).tolist():
                    text = int(owner[seg])
                    found[text].append((b * BLOCK + u, (seg - int(bases[text])) * UNIT_WORDS, float(scores[u])))
        return found

    def search(self, texts: list[str | None]) -> list[dict]:
        """For each text the verified items: item -> (score, question overlap, answer overlap)."""
        numbers = [self.numbers(t or "") for t in texts]
        results = []
        for words, units in zip(numbers, self.candidates(numbers)):
            best: dict = {}
            for unit, start, score in units:
                item, question, answer, whole, run = self.index.parts[self.index.unit_entries[unit]]
                around = words[max(0, start - len(run)):start + 2 * UNIT_WORDS + len(run)]
                held = grams_of(around.tolist(), question | answer | whole)
                *shares, both = [len(held & part) / len(part) if part else 1.0 for part in (question, answer, whole)]
                if max(min(shares), both) >= self.overlap or edits(run, around) <= (1 - ORDERED) * len(run) + 1e-9:
                    row = (min(1.0, round(score, 6)), *shares)
                    best[item] = max(best.get(item, row), row)
            results.append(best)
        return results


def grams_of(numbers: list[int], wanted: set[tuple]) -> set[tuple]:
    """The wanted grams that stand in these numbers."""
    out = set()
    for n in {len(g) for g in wanted}:
        out |= wanted.intersection(zip(*(numbers[i:] for i in range(n))))
    return out


def edits(item: list[int], words: np.ndarray) -> int:
    """The fewest words to replace, insert or remove that make the item a run of `words`."""
    places = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, word in enumerate(item, 1):
        step = np.concatenate([[i], np.minimum(row[:-1] + (words != word), row[1:] + 1)])
        row = np.minimum.accumulate(step - places) + places     # words inserted
    return int(row.min())


def build_shards(spark, items: DataFrame, item_id: str, item_text: str, shard_chars: int) -> list:
    """A broadcast index for each shard of the benchmark."""
    source = (id_and_text(items, item_id, item_text).where(F.length("text") > 0).distinct()
              .withColumn("entry", F.xxhash64("doc_id", "text")))
    out = []
    shards = shards_of(source, shard_chars)
    dealt = shards[0]
    for shard in shards[1:]:
        dealt = dealt.unionByName(shard)
    terms = materialize(unit_terms(dealt))
    for i, shard in enumerate(shards):
        rows = terms.where(F.col("shard") == i).collect()       # within shard_chars of text
        parts = [(r.entry, r.doc_id, r.text) for r in shard.collect()]
        out.append(spark.sparkContext.broadcast(Index(rows, parts)))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
               overlap: float = OVERLAP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: every document with a passage
    that holds a benchmark item.  One pass over the documents for each shard, without shuffle."""
    source = id_and_text(docs, id_col, text_col)
    id_type, item_type = source.schema["doc_id"].dataType, items.schema[item_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type),
                           *[T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]])
    arrow = to_arrow_schema(schema)
    result = None
    for shard in build_shards(docs.sparkSession, items, item_id, item_text, shard_chars):
        def run(batches, shard=shard):
            searcher = Searcher(shard.value, threshold, overlap)
            for batch in batches:
                found = searcher.search(batch.column(1).to_pylist())
                rows = [(doc_id.as_py(), item, *scores) for doc_id, items in zip(batch.column(0), found)
                        for item, scores in items.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
        part = source.mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return result


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP,
               shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The documents, with all their columns, in which no benchmark item was found."""
    at = docs.columns.index(text_col)
    for shard in build_shards(docs.sparkSession, items, item_id, item_text, shard_chars):
        def run(batches, shard=shard):
            searcher = Searcher(shard.value, threshold, overlap)
            for batch in batches:
                found = searcher.search(batch.column(at).to_pylist())
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
