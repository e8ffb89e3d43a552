"""Language of a text: its family first, then pairwise machines within it (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.text import flat, mix, slices

SIZE = 4096  # hashed features
PER_LANGUAGE = 400  # training rows of a language, about; twice that at most on the whole
#: most values of lang that are learned, and rows of them all
LANGUAGES, ROWS = 64, 6_400
UNDECIDED = "und"
# fixed values: language codes by family; a code that is absent is a family of its own
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def features(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, unit vectors, whether a text has a letter) for runs of whole texts.

    Hashed runs of one, two and three bytes of the lower-cased text; every run of
    bytes that are no letters counts as one blank, so marks and figures say nothing.
    """
    body, offsets = flat(pc.utf8_lower(column.cast(pa.string())))
    for first, last in slices(offsets, limit):
        part, local = body[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        rows = last - first
        owner = np.repeat(np.arange(rows), np.diff(local))
        letter = _LETTER[part]
        told = np.zeros(rows, bool)
        told[owner[letter]] = True
        # one blank for each run of other bytes
        edge = np.ones(len(part), bool)
        edge[1:] = letter[:-1] | (owner[1:] != owner[:-1])
        keep = letter | edge
        signs, whose = np.where(letter, part, 0x20)[keep].astype(np.uint64), owner[keep]
        counts = np.zeros(rows * SIZE, np.float32)
        for n in (1, 2, 3):
            if len(signs) < n:
                break
            value = np.full(len(signs) - n + 1, n, np.uint64)
            for j in range(n):
                value = value * np.uint64(256) + signs[j : len(signs) - n + 1 + j]
            same = whose[: len(value)] == whose[n - 1 :]
            place = (mix(value[same]) % np.uint64(SIZE)).astype(np.int64)
            counts += np.bincount(whose[: len(value)][same] * SIZE + place, minlength=rows * SIZE).astype(np.float32)
        vectors = np.sqrt(counts.reshape(rows, SIZE))
        norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        vectors /= np.where(norms > 0, norms, 1)
        for i in np.flatnonzero(told):
            if not (part[local[i] : local[i + 1]] < 0x80).any() or not letter[local[i] : local[i + 1]][part[local[i] : local[i + 1]] < 0x80].any():
                told[i] = any(c.isalpha() for c in part[local[i] : local[i + 1]].tobytes().decode("utf-8", "ignore"))
        yield first, vectors, told


def fit_machine(positive: np.ndarray, negative: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """A linear support vector machine (squared hinge); weights with the bias last."""
    rows = np.vstack([positive, negative])
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    sign = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))]).astype(np.float32)
    weight = np.where(sign > 0, 0.5 / len(positive), 0.5 / len(negative)).astype(np.float32)
    w = np.zeros(rows.shape[1], np.float32)
    ahead, pace = w.copy(), 1.0
    step = 1.0 / (4.0 + penalty)  # rows have a length of at most sqrt(2)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - sign * (rows @ ahead))
        gradient = penalty * ahead - 2 * rows.T @ (weight * sign * slack)
        new = ahead - step * gradient
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - w)
        w, pace = new.astype(np.float32), faster
        ahead = ahead.astype(np.float32)
    return w


@dataclass
class Choice:
    """One-versus-one machines between ``names``; decides by the sum of bounded margins."""

    names: list
    machines: np.ndarray
    pairs: list[tuple[int, int]]

    @classmethod
    def fit(cls, rows: np.ndarray, labels: list) -> Choice:
        names = sorted(set(labels))
        index = np.array([names.index(x) for x in labels])
        pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
        machines = [fit_machine(rows[index == a], rows[index == b]) for a, b in pairs]
        width = rows.shape[1] + 1
        return cls(names, np.array(machines, np.float32).reshape(-1, width), pairs)

    def decide(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner, and how sure its closest duel is (0.5 to 1)."""
        if not self.pairs:
            return np.zeros(len(rows), np.int64), np.ones(len(rows))
        margins = rows @ self.machines[:, :-1].T + self.machines[:, -1]
        sure = 1 / (1 + np.exp(-4.0 * margins.astype(np.float64)))
        votes = np.zeros((len(rows), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += sure[:, k]
            votes[:, b] += 1 - sure[:, k]
        best = votes.argmax(1)
        least = np.ones(len(rows))
        for k, (a, b) in enumerate(self.pairs):
            least = np.where(best == a, np.minimum(least, sure[:, k]), least)
            least = np.where(best == b, np.minimum(least, 1 - sure[:, k]), least)
        return best, least


@dataclass
class LanguageModel:
    """Family machines, and for each family the machines between its languages."""

    families: Choice | None
    languages: dict[str, Choice]

    @classmethod
    def fit(cls, rows: np.ndarray, labels: list[str]) -> LanguageModel:
        if not labels:
            return cls(None, {})
        kin = np.array([_FAMILY.get(x, f"={x}") for x in labels])
        tongues = np.array(labels)
        own = {k: Choice.fit(rows[kin == k], list(tongues[kin == k])) for k in sorted(set(kin))}
        return cls(Choice.fit(rows, list(kin)), own)

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        if self.families is None:
            return [UNDECIDED] * len(rows), np.zeros(len(rows))
        family, score = self.families.decide(rows)
        names = np.full(len(rows), UNDECIDED, object)
        for k, kin in enumerate(self.families.names):
            mine = np.flatnonzero(family == k)
            choice = self.languages[kin]
            best, sure = choice.decide(rows[mine])
            names[mine] = np.array(choice.names, object)[best]
            score[mine] *= sure
        return list(names), score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, vectors, told in features(batch.column("text")):
            kept = np.flatnonzero(told)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(pa.array(first + kept)), pa.array([vectors[i].tobytes() for i in kept], pa.binary())],
                ["lang", "vector"],
            )


def _predictions(batches: Iterator[pa.RecordBatch], model: LanguageModel, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names: list[str] = []
        scores: list[np.ndarray] = []
        for _, vectors, told in features(batch.column("text")):
            best, sure = model.predict(vectors)
            names += [n if t else UNDECIDED for n, t in zip(best, told, strict=True)]
            scores.append(np.where(told, sure, 0.0))
        found = [pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *found], [*kept, "lang_pred", "score"])


def held_out() -> F.Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of the rows with text and lang that aren't held out.

    Learned are the ``LANGUAGES`` values of lang with the most such rows (of equally many
    the first by name). Of each about ``per_language`` rows, those with the smallest hash
    of doc_id and text, and of all together about ``ROWS``, never more than twice that.
    The sample is filtered where it is scanned; texts are not moved.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return LanguageModel.fit(np.zeros((0, SIZE), np.float32), [])
    each = max(1, min(per_language, ROWS // len(counts)))
    n = F.try_element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], r["n"])]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    picked = usable.where(draw * n < F.lit(float(each * (1 << 40)))).select("lang", "text")
    got = picked.mapInArrow(_vectors, "lang string, vector binary").limit(2 * each * len(counts)).collect()
    rows = np.frombuffer(b"".join(bytes(r["vector"]) for r in got), np.float32).reshape(-1, SIZE)
    return LanguageModel.fit(rows, [r["lang"] for r in got])


def identify(docs: DataFrame, model: LanguageModel, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row, from its whole text alone.

    ``und`` with score 0 for null, empty and letterless texts, and for all texts if
    nothing could be learned. Repeated rows are kept; columns of the added names
    are replaced, those in ``drop`` (the text, say) are left out.
    """
    rows = docs.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    kept = [(n, t) for n, t in rows.dtypes if n not in drop]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # three weights a feature for four languages
    schema = ", ".join(f"`{n}` {t}" for n, t in kept)
    names = [n for n, _ in kept]
    return rows.mapInArrow(lambda it: _predictions(it, sent.value, names), f"{schema}, lang_pred string, score double")
