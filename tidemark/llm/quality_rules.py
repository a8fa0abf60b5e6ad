"""Quality rules by compression: a text that compresses far better or worse than prose is rejected.

Every text is compressed with zstandard as a whole and in chunks of fixed size. The ratio is compressed
bytes to bytes; short texts compress worse, so each length has limits of its own (``LOWS``, ``HIGHS``). A text
fails as ``repetitive`` below its band, as ``incompressible`` above it, and by its chunks when more than
``MAX_BAD_CHUNKS`` of their bytes are outside the chunk limits.

Null and empty texts have no words and fail the base rule (fewer than 50 words). Equal rows get equal
results; other columns than ``doc_id`` and ``text`` are not read. Without rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.textarrays import Words, chunks, mixed, span_hashes, window_hashes

LEVEL = 3
#: (bytes up to, lowest ratio) of a whole text.
LOWS = ((256, 0.30), (1024, 0.20), (4096, 0.14), (16384, 0.10), (1 << 62, 0.06))
#: (bytes, highest ratio); in between by the logarithm of the length. The highest ratios of English, German,
#: French and Spanish prose (license and message texts, documentation, and the tables) are 0.86, 0.82, 0.77,
#: 0.72, 0.65, 0.60, 0.56, 0.53, 0.49, 0.46 and 0.44 at 256, 350, 512, 768, 1024, 1536, 2048, 3072, 4096, 8192
#: and 16384 bytes. The limits are 0.03 above to 2 KB and 0.03 to 0.07 above beyond that. Words of random lower-case
#: letters have 0.61 at 1 KB and 0.58 to 0.60 from 2 KB: from there they fail; shorter ones overlap with prose.
HIGHS = ((128, 1.10), (256, 0.89), (350, 0.855), (512, 0.80), (768, 0.755), (1024, 0.685), (1536, 0.632), (2048, 0.589), (3072, 0.56), (4096, 0.54), (8192, 0.52), (16384, 0.51))
#: So, where more than ``OTHER_SCRIPT`` of the bytes are not ASCII: characters of three bytes compress worse.
OTHER_SCRIPT, OTHER_HIGHS = 1 / 3, ((256, 1.10), (1024, 0.92), (4096, 0.80), (16384, 0.72), (1 << 62, 0.68))
CHUNK_BYTES, CHUNK_LOW, OTHER_CHUNK_HIGH, MAX_BAD_CHUNKS = 4096, 0.12, 0.80, 0.5
ASCII = bytes(range(128))
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, bad_chunk_share double, verdict string"
)


def band(size: int, other: bool) -> tuple[float, float]:
    """Lowest and highest ratio at this length; ``other``: of a text in another script."""
    low = next(low for most, low in LOWS if size <= most)
    if other:
        return low, next(high for most, high in OTHER_HIGHS if size <= most)
    sizes, highs = zip(*HIGHS)
    return low, float(np.interp(np.log(size), np.log(sizes), highs))


def compression(text: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, float, str]:
    """(ratio of the whole text, share of its bytes in chunks beyond the limits, verdict)."""
    if not text:
        return 0.0, 0.0, "empty"
    ratio, bad = len(pack.compress(text)) / len(text), 0
    other = len(text.translate(None, ASCII)) > OTHER_SCRIPT * len(text)
    low, high = band(len(text), other)
    if len(text) > CHUNK_BYTES:
        whole = CHUNK_LOW, OTHER_CHUNK_HIGH if other else band(CHUNK_BYTES, other)[1]
        for at in range(0, len(text), CHUNK_BYTES):
            part = text[at : at + CHUNK_BYTES]
            a, b = whole if len(part) == CHUNK_BYTES else band(len(part), other)
            bad += len(part) * (not a <= len(pack.compress(part)) / len(part) <= b)
    share = bad / len(text)
    verdict = "repetitive" if ratio < low else "incompressible" if ratio > high else "chunks" if share > MAX_BAD_CHUNKS else "prose"
    return ratio, share, verdict


def per_text(counted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 array over each text."""
    return np.diff(np.concatenate([[0], np.cumsum(counted, dtype=np.int64)])[offsets])


def distinct_in(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by text and hash, where a new value begins in that order)."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return order, new


def repeated_words(words: Words, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """Of each text, its words in 3-word windows that the text has twice or more."""
    n = len(hashes)
    doc = np.repeat(np.arange(n_docs), np.diff(words.first))
    windows = window_hashes(hashes, 3)
    if not len(windows):
        return np.zeros(n_docs, np.int64)
    ok = np.flatnonzero(doc[2:] == doc[:-2])
    order, new = distinct_in(doc[ok], windows[ok])
    group = np.cumsum(new) - 1
    twice = ok[order[np.bincount(group)[group] > 1]] if len(ok) else ok
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(doc[hit], minlength=n_docs)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Of each text, its lines with a word that equal an earlier line."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(breaks + 1, offsets[:-1][np.diff(offsets) > 0])
    start = start[start < len(data)]
    stop = np.append(start[1:], len(data))
    end = np.where(data[stop - 1] == 10, stop - 1, stop) if len(start) else stop[:0]
    has_word = np.searchsorted(words.start, stop[: len(start)]) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    doc = np.searchsorted(offsets, start, "right") - 1
    _, new = distinct_in(doc, span_hashes(data, start, end))
    order_doc = np.sort(doc)
    return np.bincount(order_doc[~new], minlength=n_docs) if len(start) else np.zeros(n_docs, np.int64)


def assess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for rows, data, offsets in chunks(batch):
            words = Words(data, offsets)
            n_docs, n_words = rows.num_rows, np.diff(words.first)
            points = (data & 0xC0) != 0x80
            inner = np.zeros(len(data) + 1, np.int64)
            np.cumsum(points, out=inner[1:])
            in_word = np.concatenate([[0], np.cumsum(inner[words.end] - inner[words.start])])
            repeats = repeated_words(words, words.hashes(), n_docs)
            raw = data.tobytes()
            packed = [compression(raw[a:b], pack) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n_words)
            verdict = [v for _, _, v in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()), pa.array(n_words), pa.array(np.diff(in_word[words.first])), pa.array(per_text(SYMBOLS[data], offsets)),
                    pa.array(duplicate_lines(data, offsets, words)), pa.array(repeats), pa.array(failed), pa.array(~failed & np.array([v == "prose" for v in verdict], bool)),
                    pa.array([r for r, _, _ in packed], pa.float64()), pa.array([s for _, s, _ in packed], pa.float64()), pa.array(verdict, pa.string()),
                ],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, ``kept`` and why: one row for each row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(assess, SCHEMA)
