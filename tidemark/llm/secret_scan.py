"""Secret scans: fixed patterns, and candidates whose zstandard novelty is high.

Base spans come from three patterns (``ASSIGN``, ``ACCESS``, ``HEX``). Beside them, every token of 12 or
more characters in a sensitive context (a word such as *password* or *key* shortly before or behind it)
is a candidate, unless a letter outside ASCII touches it: it is then a part of a word. Its novelty is the number of bytes by which it lengthens the zstandard frame of its
surrounding text, followed by ``TAIL`` in both frames (zstandard matches nothing at the very end of its input), where the compressor is primed with a dictionary: the words of two public tokenizers'
vocabularies, one of many languages (parameters, read by the driver and sent to the tasks) and ``CODE``. Words, identifiers and
repeated strings add few bytes; random strings add most of theirs. A candidate with at least ``limit`` added
bytes a character is reported as kind ``novel``. The limits are just below what nine in ten random strings of letters and digits add, measured
in fourteen contexts, code and prose, at 12 to 40 characters. Strings that are worded (``WORDED``: words in lower case, capitals or camel case, and numbers, dates and times, with
signs between) are held against higher limits: short words add as much as random letters, and no vocabulary has all words. So a random string of
letters in one case alone, or of digits alone, is as a rule not found.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Equal rows get equal
results; other columns than ``doc_id`` and ``text`` are not read. Without rows the result is empty.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textarrays import buffers

KINDS = ("assign", "access", "hex", "novel")
#: Patterns and least lengths of the base spans, as the contract of the query fixes them.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Words that make a string near them sensitive: whole words or parts of camelCase, snake_case and kebab-case
#: identifiers, in the plural too. ``key`` counts where it ends an identifier.
SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])(?i:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|(?:access|auth)[_-]?token|token|(?:api|access|private|client)[_-]?key|auth(?:orization)?|bearer|credential|signature|session[_-]?id)"
    r"|(?<=[a-z0-9])(?:Pass(?:[Ww]ord|[Ww]d|[Pp]hrase|[Cc]ode)?|Pwd|Secret|Token|Auth(?:orization)?|Bearer|Credential|Signature|SessionI[dD]))[sS]?(?![a-z]|(?<=[A-Z])[A-Z])"
    r"|(?:(?<![A-Za-z])(?i:key)|(?<=[a-z0-9])Key)[sS]?(?![A-Za-z0-9]|[_-][A-Za-z0-9])",
    re.A,
)
REACH, CONTEXT = 48, 256
MIN_CANDIDATE = 12
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-]|[^\x00-\x7F])[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}+(?![^\W\d_a-zA-Z])")
#: A word or a number; several of these with signs between, words then with a few digits too; humps of words are judged by ``worded``.
_ONE, _PART, _SIGNS = r"(?:\d+(?:T\d+Z?)?|[A-Za-z]+)", r"(?:\d+(?:T\d+Z?)?[a-z]?|(?:[A-Za-z]+\d{0,3}){1,2})", "[/_=-]"
WORDED = re.compile(rf"{_SIGNS}*(?:{_ONE}|{_PART}(?:{_SIGNS}+{_PART})+){_SIGNS}*", re.A)
HUMP, RUN, MIXED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), re.compile(r"[A-Za-z]+"), re.compile(r"[A-Za-z]\d|\d(?!T\d)[A-Za-z]")
#: Letters for each turn of case within a word, at least, for a string to count as worded.
TURN_LETTERS = 5
#: (characters, least added bytes a character), in between by lines; of worded strings.
LIMITS = ((12, 0.63), (16, 0.66), (20, 0.69), (32, 0.70), (40, 0.69))
WORD_LIMITS = ((12, 1.20), (24, 1.15), (32, 1.10), (40, 1.0))
#: Closes both frames.
TAIL = "\npassword = example\n"
#: Files of base64 tokens and ranks, and the least letters of a word taken from them.
VOCABULARY, MULTILINGUAL, MIN_WORD = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 4
#: zstandard looks for short matches everywhere in the dictionary.
FINE = {"window_log": 20, "chain_log": 18, "hash_log": 18, "search_log": 8, "min_match": 3, "target_length": 64, "strategy": zstandard.STRATEGY_BTULTRA}
#: Quick tests on bytes: texts without any of these have no span of that kind.
HAS_ASSIGN = re.compile(rb"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}")
HAS_HEX = re.compile(rb"[0-9a-f]{16}")
HAS_SENSITIVE = re.compile(rb"(?i)pass|pwd|secret|token|key|auth|bearer|credential|signature|session")

#: Code and identifier text that candidates are measured against, beside the vocabulary.
CODE = " ".join(
    f"{a}{b}{c}" for a in ("get", "set", "user", "client", "server", "request", "response", "default", "current", "config") for b in ("_", "") for c in ("name", "token", "password", "secret", "key", "value", "session", "handler", "provider", "configuration", "environment", "authorization")
) + (
    " import from return function const let var public private static final class def self this null None true false string bytes "
    "process.env. os.environ[ getenv( System.getProperty( application.properties example changeme placeholder your_token_here your-api-key-here "
    "https://www.example.com/ http://localhost:8080/ /usr/local/bin/ /etc/ssl/certs/ Content-Type: application/json Authorization: Bearer "
    "password = \"\" token = \"\" secret = \"\" api_key = \"\" abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx 0000000000000000"
)

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds."""
    spans = []
    if HAS_ASSIGN.search(raw):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if HAS_HEX.search(raw):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return spans


def dictionary(vocabulary: str = VOCABULARY, multilingual: str = MULTILINGUAL) -> bytes:
    """The words of both vocabularies by turns, the most frequent last, then ``CODE``."""

    def words(path: str) -> list[str]:
        with open(path, "rb") as file:
            tokens = [base64.b64decode(line.split()[0]).strip() for line in file]
        return [t.decode() for t in tokens if len(t) >= MIN_WORD and t.isalpha() and t.isascii()]

    turns = zip_longest(words(multilingual), words(vocabulary))
    return f"{' '.join(reversed(dict.fromkeys(w for pair in turns for w in pair if w)))} {CODE}".encode()


def worded(candidate: str) -> bool:
    """Whether a candidate is made of words, numbers, dates and times."""
    turns = len(HUMP.findall(candidate)) - len(RUN.findall(candidate))
    if MIXED.search(candidate) and turns:  # digits within words: these have one case
        return False
    return bool(WORDED.fullmatch(candidate)) and turns * TURN_LETTERS <= sum(map(str.isalpha, candidate))


def limit(candidate: str) -> float:
    return float(np.interp(len(candidate), *zip(*(WORD_LIMITS if worded(candidate) else LIMITS))))


class Novelty:
    """Marginal compressed bytes of a string after its context, given the dictionary."""

    def __init__(self, words: bytes | None = None):
        known = zstandard.ZstdCompressionDict(dictionary() if words is None else words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        fine = zstandard.ZstdCompressionParameters(**FINE, write_content_size=0, write_checksum=0, write_dict_id=0)
        known.precompute_compress(compression_params=fine)
        self.pack = zstandard.ZstdCompressor(dict_data=known, compression_params=fine)

    def of(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        around, candidate = f"{before}{after}\n", text[start:end]
        return (len(self.pack.compress(f"{around}{candidate}{TAIL}".encode())) - len(self.pack.compress(f"{around}{TAIL}".encode()))) / len(candidate)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        hints = [m.span() for m in SENSITIVE.finditer(text)]
        if not hints:
            return []
        starts, ends, found = [a for a, _ in hints], [b for _, b in hints], []
        for m in CANDIDATE.finditer(text):
            for a, b in pieces(m.start(), m.end(), hints[bisect_left(starts, m.start()) : bisect_left(starts, m.end())]):
                a = trimmed(text, a, b)
                k, j = bisect_right(ends, a) - 1, bisect_left(starts, b)  # the last hint before it and the first behind it
                near = (k >= 0 and a - ends[k] <= REACH) or (j < len(starts) and starts[j] - b <= REACH)
                if near and b - a >= MIN_CANDIDATE and self.of(text, a, b) >= limit(text[a:b]):
                    found.append((a, 3, b))
        return found


def pieces(start: int, end: int, inside: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A string cut at the sensitive words inside it; an identifier such as ``setClientSecret`` leaves no long piece."""
    cuts = [start, *(x for span in inside for x in span), end]
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if b - a >= MIN_CANDIDATE]


def trimmed(text: str, start: int, end: int) -> int:
    """Where a string starts without the signs that part it from a name before it."""
    return end - len(text[start:end].lstrip("=_-"))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(batches: Iterator[pa.RecordBatch], words: bytes) -> Iterator[pa.RecordBatch]:
    novelty = Novelty(words)
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", [])
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        view, offsets = memoryview(data), offsets.tolist()
        rows = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            raw = bytes(view[a:b])
            sensitive = HAS_SENSITIVE.search(raw)
            if not (sensitive or b"AKIA" in raw or HAS_HEX.search(raw)):
                rows.append(nothing)
                continue
            text = raw.decode()
            base = base_spans(text, raw)
            spans = sorted(base + (novelty.spans(text) if sensitive else []))
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), [{"kind": KINDS[k], "start": i, "end": j} for i, k, j in spans]))
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), found_type]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])


def secret_scan(docs: DataFrame, vocabulary: str = VOCABULARY, multilingual: str = MULTILINGUAL) -> DataFrame:
    """Counts of base spans, their digest and all spans: one row for each row of ``docs``."""
    words = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary, multilingual))
    return docs.select("doc_id", "text").mapInArrow(lambda batches: scan(batches, words.value), SCHEMA)


def redact(batches: Iterator[pa.RecordBatch], words: bytes) -> Iterator[pa.RecordBatch]:
    """The same rows with each found span of ``text`` replaced by ``<SECRET>`` and ``n_chars`` counted anew."""
    novelty = Novelty(words)
    for batch in batches:
        names = batch.schema.names
        texts = batch.column("text").to_pylist()
        for i, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode()
            sensitive = HAS_SENSITIVE.search(raw)
            if not (sensitive or b"AKIA" in raw or HAS_HEX.search(raw)):
                continue
            parts, at = [], 0
            for start, _, end in sorted(base_spans(text, raw) + (novelty.spans(text) if sensitive else [])):
                if start >= at:
                    parts += [text[at:start], "<SECRET>"]
                at = max(at, end)
            texts[i] = "".join([*parts, text[at:]])
        columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, batch.schema.field("text").type)}
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def redacted(docs: DataFrame, vocabulary: str = VOCABULARY, multilingual: str = MULTILINGUAL) -> DataFrame:
    """``docs`` with secrets replaced; every row stays."""
    words = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary, multilingual))
    return docs.select([F.col(f"`{c}`") for c in docs.columns]).mapInArrow(lambda batches: redact(batches, words.value), docs.schema)
