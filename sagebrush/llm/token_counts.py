"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, so that tokens are those a model would see; the tokens' character spans are
then joined with the spans of its sections. Both lists are sorted, so the interval join is a binary search within
the document's own row, and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import coder
from .common import map_texts


def line_sections(text: str) -> np.ndarray:
    """Starts of a text's lines; a line holds its line feed."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(text)]])


def told_sections(starts: list[int] | None, text: str) -> np.ndarray:
    return np.unique([0, *(s for s in starts or () if s is not None and 0 < s < len(text))])


def attribute(spans: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, tokens that cross a boundary, and characters of each section.

    The rule: a token belongs to the section that holds most of its characters, the earlier one on a tie. Each token
    is counted once, so the sections' counts add up to the document's.
    """
    k = len(starts)
    bounds = np.append(starts, length)
    first = np.searchsorted(starts, spans[:, 0], side="right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1
    owner, crossing = first.copy(), np.flatnonzero(first != last)
    for t in crossing:
        inside = range(first[t], last[t] + 1)
        owner[t] = max(inside, key=lambda s: (min(bounds[s + 1], spans[t, 1]) - max(bounds[s], spans[t, 0]), -s))
    return np.bincount(owner, minlength=k), np.bincount(owner[crossing], minlength=k), np.diff(bounds)


def section_token_counts(docs: DataFrame, path: str, pattern: str, sections: str | None = None) -> DataFrame:
    """Token counts of every section of every document: of its lines, or of what the column ``sections`` says.

    ``sections`` (array of int) has the characters at which a text's sections or fields begin, in order; 0 is one, also
    where it isn't told, and places beyond the text are none.

    Columns: doc_id, section (from 0), char_start, char_end (exclusive), n_tokens, n_crossing (tokens counted here
    that also cover characters of another section).

    A null or empty text is one section of no characters and no tokens. Null and repeated ids are kept, each row by
    itself. Other columns of ``docs`` are not read; no rows give no rows.
    """

    def rows(ids: list, *told_and_texts: list) -> list:
        bpe, texts = coder(path, pattern), told_and_texts[-1]
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        sizes = []
        for i, text in enumerate(texts):
            starts = line_sections(text) if sections is None else told_sections(told_and_texts[0][i], text)
            n, crossing, _ = attribute(bpe.spans(text, bpe.ids(text)), starts, len(text))
            for column, x in zip(out, (np.arange(len(starts)), starts, np.append(starts[1:], len(text)), n, crossing), strict=True):
                column.append(x)
            sizes.append(len(starts))
        owner = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
        return [owner, *(pa.array(np.concatenate(x).astype(np.int64)) for x in out)]

    return map_texts(docs, rows, "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long", ids=("doc_id", *([sections] if sections else [])))
