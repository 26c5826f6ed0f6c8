"""Operator 6: secret scan by token efficiency.

Text that people write costs few tokens for its length, as the vocabulary was made from such
text; random strings cost many.  Every run of key characters is encoded with a public rank
file, and a run with few characters to a token is reported.  Known digests (hex of a digest's
length, UUIDs), plain numbers and identifiers (words joined by case, `_` or `-`) are left out;
a long string of one case is a word only if it costs as little as words do.  Readable words can
hide a key in the average of a run, so what stands between them is judged by itself too.
The three base patterns are reported whatever their cost.

Spans are code-point offsets, the end exclusive, written `kind:start:end` in order of start,
then of kind (assign, access, hex, token).  A `token` span never overlaps a base span.

Edge cases: null and empty texts have no spans; repeated rows give repeated results; other
columns are not read; an empty table gives an empty table.  Texts are scanned whole, whatever
their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import id_and_text, map_batches

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Shortest run that is judged by its cost, and the characters to a token under which a run
#: counts as random.  Prose lies above 3, random base64 or hex between 1 and 2.
MIN_RUN, MAX_RATIO = 20, 2.0
#: Letters and characters to a token from which a word within a run is readable.
MIN_WORD, WORD_RATIO = 5, 3.0
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Hex lengths of the usual digests (MD5, SHA-1, SHA-2 family).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
IDENTIFIER = re.compile(r"[-_=/+]*([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})([-_=/+]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})|[A-Z][a-z]+)*[0-9]{0,4}[-_=/+]*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A short word or number with its separators, at the ends of what stands between words.
LEAD = re.compile(r"[-_=/+]+|([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})[-_=/+]+")
LEAD_BACK = re.compile(r"[-_=/+]+|([a-z]+[A-Z]?|[A-Z]+|[0-9]{1,4})[-_=/+]+")      # of the run read backwards
NUMBER = re.compile(r"[-+=/_0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= MIN_ACCESS]
    return spans


def is_public(run: str) -> bool:
    """Digests, UUIDs and numbers: strings that look random but are public."""
    return bool(DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run) or NUMBER.fullmatch(run))


def is_costly(run: str, tokens_of: Callable[[str], int], max_ratio: float) -> bool:
    """Few characters to a token, and neither public nor words joined."""
    if is_public(run) or len(run) >= max_ratio * tokens_of(run):
        return False
    return not IDENTIFIER.fullmatch(run) or any(
        len(w) >= MIN_RUN and len(w) < max_ratio * tokens_of(w) for w in WORD.findall(run))


def between_words(run: str, tokens_of: Callable[[str], int]) -> list[tuple[int, int]]:
    """(start, end) of what stands between the readable words of a run, long enough for a key."""
    out, at, backwards = [], 0, run[::-1]
    words = [m.span() for m in WORD.finditer(run) if m.end() - m.start() >= MIN_WORD
             and m.end() - m.start() >= WORD_RATIO * tokens_of(m.group())]
    for start, end in [*words, (len(run), len(run))]:
        low, high = at, start
        while high - low >= MIN_RUN and (m := LEAD.match(run, low, high)):
            low = m.end()
        while high - low >= MIN_RUN and (m := LEAD_BACK.match(backwards, len(run) - high, len(run) - low)):
            high = len(run) - m.end()
        if high - low >= MIN_RUN:
            out.append((low, high))
        at = end
    return out


def costly_parts(run: str, tokens_of: Callable[[str], int], max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of a run that is costly, or of its costly parts."""
    if is_public(run):
        return []
    if not IDENTIFIER.fullmatch(run) and is_costly(run, tokens_of, max_ratio):
        return [(0, len(run))]
    return [(low, high) for low, high in between_words(run, tokens_of) if is_costly(run[low:high], tokens_of, max_ratio)]


def scan(text: str, tokens_of: Callable[[str], int], max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """All (start, kind, end) of one text, in order."""
    spans, costly = base_spans(text), []
    for m in RUN.finditer(text):
        run, at = m.group(), m.start()
        if len(run) >= MIN_HEX:     # a run of hex digits lies whole inside a run of key characters
            spans += [(at + h.start(), 2, at + h.end()) for h in HEX.finditer(run)
                      if h.end() - h.start() >= MIN_HEX]
        costly += [(at + low, 3, at + high) for low, high in costly_parts(run, tokens_of, max_ratio)]
    base = list(spans)
    spans += [s for s in costly if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def load_encoder(rank_path: str, pattern: str):
    import tiktoken
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def scan_documents(df: DataFrame, rank_path: Callable[[], str], pattern: str, id_col: str = "doc_id",
                   text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """Spans of every text: doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans.
    A projection of the rows; nothing is shuffled."""
    source = id_and_text(df, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def make():
        encoder = load_encoder(rank_path(), pattern)

        def tokens_of(run: str) -> int:
            return len(encoder.encode_ordinary(run))

        def row(doc_id, text):
            spans = scan(text or "", tokens_of, max_ratio)
            base = [s for s in spans if s[1] < 3]
            counts = [sum(s[1] == kind for s in spans) for kind in range(4)]
            return [(doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))]
        return row

    return map_batches(source, make, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, "
                                     "n_token bigint, base_sha256 string, spans string")
