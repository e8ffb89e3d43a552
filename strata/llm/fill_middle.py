"""Fill-in-middle cuts: wavelet matrices over character classes locate both ends of the middle.

Texts stay flat UTF-8 bytes. Every byte has a class of three bits: it starts a
character, that character starts a word, that character starts a line. A wavelet
matrix over the classes answers "how many of class c before byte i" in three steps;
sums of such ranks count the boundaries of a unit, and bisection on them finds the
byte where the k-th unit starts, for all rows of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.text import SPACED, flat, slices

LEAD, WORD, LINE = 1, 2, 4
BITS = 3
#: classes that occur, by the unit whose boundary they are
UNITS = {"char": (LEAD, LEAD | WORD, LEAD | LINE, LEAD | WORD | LINE), "word": (LEAD | WORD, LEAD | WORD | LINE), "line": (LEAD | LINE, LEAD | WORD | LINE)}
#: marks of prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def classes(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of every byte; the first character of a row starts a line."""
    lead = (body & 0xC0) != 0x80
    solid = SPACED[body]
    first = offsets[:-1][np.diff(offsets) > 0]
    inside = np.zeros(len(body), bool)
    inside[1:] = solid[:-1]
    inside[first] = False
    line = np.zeros(len(body), bool)
    line[1:] = body[:-1] == 0x0A
    line[first] = True
    out = lead.astype(np.uint8)
    out |= (lead & solid & ~inside).astype(np.uint8) << 1
    out |= (lead & line).astype(np.uint8) << 2
    return out


class Bits:
    """Bits in words of 64 with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank of any symbol below 2**bits, one bit vector a level."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.levels, self.zeros, self.size = [], [], len(symbols)
        for level in reversed(range(bits)):
            ones = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(ones))
            self.zeros.append(self.size - int(np.count_nonzero(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first i places, for an array of i."""
        start = np.zeros(1, np.int64)
        for n, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            if symbol >> (len(self.levels) - 1 - n) & 1:
                i, start = zeros + bits.rank(i), zeros + bits.rank(start)
            else:
                i, start = i - bits.rank(i), start - bits.rank(start)
        return i - start

    def count(self, symbols: Sequence[int], i: np.ndarray) -> np.ndarray:
        """Occurrences of any of ``symbols`` among the first i places."""
        return sum((self.rank(s, i) for s in symbols), np.zeros_like(i))

    def locate(self, symbols: Sequence[int], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest place in low..high with k of ``symbols`` before and one at it; high if there is none."""
        low, high = low.copy(), high.copy()
        wanted = self.count(symbols, low) + k
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, np.minimum(middle + 1, self.size)) > wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def cuts(body: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Per row: units, byte where the prefix ends, byte where the middle ends, code points of both."""
    matrix = WaveletMatrix(classes(body, offsets))
    starts, ends = offsets[:-1], offsets[1:]
    n = matrix.count(UNITS[unit], ends) - matrix.count(UNITS[unit], starts)
    a, b = h1 % (n + 1), h2 % (n + 1)
    bounds = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        bounds.append(np.where(k == 0, starts, matrix.locate(UNITS[unit], k, starts, ends)))
    signs = [matrix.count(UNITS["char"], p) for p in (starts, *bounds)]
    return n, *bounds, signs[1] - signs[0], signs[2] - signs[1]


def _transform(batches: Iterator[pa.RecordBatch], unit: str, plain_from: int, spm_below: int) -> Iterator[pa.RecordBatch]:
    mark_p, mark_s, mark_m = (m.encode() for m in MARKS)
    for batch in batches:
        body, offsets = flat(batch.column("_text"))
        h1, h2, h3, h4 = (np.asarray(batch.column(f"_h{i}")) for i in range(1, 5))
        for first, last in slices(offsets):
            begin = int(offsets[first])
            part, places = body[begin : offsets[last]], offsets[first : last + 1] - begin
            rows = slice(first, last)
            n, left, right, before, within = cuts(part, places, h1[rows], h2[rows], unit)
            forms, texts = [], []
            for i, (p, q) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
                start, end = int(places[i]), int(places[i + 1])
                text = part[start:end].tobytes()
                if not text or h3[first + i] % 100 >= plain_from or any(m in text for m in (mark_p, mark_s, mark_m)):
                    forms.append(PLAIN)
                    texts.append(text)
                    continue
                prefix, middle, suffix = text[: p - start], text[p - start : q - start], text[q - start :]
                if h4[first + i] % 100 < spm_below:
                    forms.append(SPM)
                    texts.append(b"".join((mark_s, suffix, mark_p, prefix, mark_m, middle)))
                else:
                    forms.append(PSM)
                    texts.append(b"".join((mark_p, prefix, mark_s, suffix, mark_m, middle)))
            plain = np.array([f == PLAIN for f in forms])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").slice(first, last - first),
                    pa.array(n, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(before, pa.int64(), mask=plain),
                    pa.array(within, pa.int64(), mask=plain),
                    pa.array(texts, pa.binary()).view(pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(
    docs: DataFrame, unit: str = "char", seed: int = 1, plain_from: int = 90, spm_below: int = 20
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    ``n`` counts the units: ``char`` (code points), ``word`` (a word and the blanks after
    it) or ``line``. h1 to h4 are the first four groups of eight digits of the SHA-256 of
    ``seed:doc_id``; the prefix ends after the smaller of h1 and h2 modulo n + 1 units, the
    middle after the larger. What stands before the first word belongs to the first unit, and
    a text without a unit is all suffix. Texts that are empty, hold a mark, or whose h3 modulo
    100 is ``plain_from`` or more stay as they are (form plain, counts null); of the others,
    those whose h4 modulo 100 is below ``spm_below`` put the suffix first.

    A null text counts as empty, a null doc_id is hashed as an empty string. Equal rows
    give equal rows. Other columns are ignored. Texts are worked on whole, in slices of
    whole rows of about a megabyte; one stage, no shuffle.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"), digest.alias("_d"))
    groups = [F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    return rows.select("_id", "_text", *groups).mapInArrow(
        lambda batches: _transform(batches, unit, plain_from, spm_below),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from; marks occur in no cut text, so the first ones found are its own."""
    p, s, m = MARKS

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def after(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, -1)

    psm = F.concat(after(before(output, s), p), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), after(before(output, p), s))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), g AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM h
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
), p AS (
  SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
