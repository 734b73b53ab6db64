"""Quality of documents by weak supervision.

Ten rules look at a document; each votes good or bad, or abstains.  Expectation-maximisation over the votes of the
whole corpus estimates how often each rule is right and how many documents are good; the posterior probability of
"good" then decides, so one odd measure doesn't reject a document, and several together do.

Only counts per vote pattern reach the driver: 3 ** 10 rows at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.texts import Words, mix, runs, windows

RULES = ("words", "word_length", "symbols", "letters", "capitals", "lines", "repeats", "variety", "sentences", "short_words")
ROUNDS = 50
# Outcomes (bad, abstain, good) expected of bad and of good documents, and the number of documents this counts for.
PRIOR_BAD, PRIOR_GOOD, STRENGTH = (0.4, 0.2, 0.4), (0.02, 0.28, 0.7), 20.0
MIN_WORDS = 50

_NONE = np.zeros(256, bool)


def _table(characters: bytes | range) -> np.ndarray:
    out = _NONE.copy()
    out[list(characters)] = True
    return out


SYMBOL = _table(b"#*$%&|<>")
CAPITAL = _table(range(65, 91))
LETTER = CAPITAL | _table(range(97, 123)) | _table(range(128, 256))
LEAD = ~_table(range(128, 192))
END = _table(b".!?")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _groups(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal values of one text: (how often each entry's value occurs in its text, text of each distinct value)."""
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(t), np.int64)
    out[order] = np.bincount(group)[group] if len(t) else 0
    return out, t[new]


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """Integer measures of every text; NULL is an empty text."""
    parts: dict[str, list[np.ndarray]] = {}
    for first, end, data, offsets in runs(column):
        n = end - first
        words = Words(data, offsets)
        n_words = np.diff(words.bounds)
        sums = words.prefix_sums()
        hashes = words.hashes(sums=sums)
        text = np.repeat(np.arange(n), n_words)
        size = words.end - words.start

        # Windows of three words that occur twice or more in their text cover words.
        window, bounds = windows(hashes, words.bounds, 3)
        of = np.repeat(np.arange(n), np.diff(bounds))
        at = (np.arange(len(window)) - bounds[of] + words.bounds[of])[_groups(of, window)[0] > 1]
        covered = np.zeros(len(hashes) + 2, bool)
        for j in range(3):
            covered[at + j] = True

        # Lines with a word, by the hash of their bytes.
        cuts = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
        worded = np.unique(np.searchsorted(cuts, words.start, "right") - 1)
        begin = cuts[worded]
        stop = np.append(cuts[1:], len(data))[worded]
        stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10)) if len(worded) else stop
        line = Words.__new__(Words)
        line.start, line.end, line.data = begin, stop, data
        line_text = np.searchsorted(offsets, begin, "right") - 1
        lines = np.bincount(line_text, minlength=n)
        _, distinct = _groups(line_text, line.hashes(sums=sums))
        _, variety = _groups(text, hashes)
        lettered = np.concatenate(([0], np.cumsum(LETTER[data], dtype=np.int64)))
        lettered = lettered[words.end] > lettered[words.start]
        spaces = _per_text((data == 32) | ((data >= 9) & (data <= 13)), offsets)
        found = {
            "n_words": n_words,
            "word_chars": _per_text(LEAD[data], offsets) - spaces,
            "n_symbols": _per_text(SYMBOL[data], offsets),
            "n_lines": lines,
            "n_dup_lines": lines - np.bincount(distinct, minlength=n),
            "n_repeat_words": np.bincount(text[covered[:len(text)]], minlength=n),
            "n_distinct": np.bincount(variety, minlength=n),
            "n_bytes": np.diff(offsets) - spaces,
            "n_letters": _per_text(LETTER[data], offsets),
            "n_capitals": _per_text(CAPITAL[data], offsets),
            "n_lettered": np.bincount(text[lettered], minlength=n),
            "n_ends": np.bincount(text[END[data[words.end - 1]]] if len(text) else text, minlength=n),
            "n_short": np.bincount(text[size <= 3], minlength=n),
        }
        for name, value in found.items():
            parts.setdefault(name, []).append(value.astype(np.int64))
    return {name: np.concatenate(value) for name, value in parts.items()}


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One column per rule: 1 good, -1 bad, 0 abstains."""
    words = np.maximum(m["n_words"], 1)

    def vote(good, bad):
        return np.where(bad, -1, np.where(good, 1, 0))

    long_enough = m["n_words"] >= MIN_WORDS
    chars = m["word_chars"] / words
    symbols = m["n_symbols"] / words
    letters = m["n_letters"] / np.maximum(m["n_bytes"], 1)
    capitals = m["n_capitals"] / np.maximum(m["n_letters"], 1)
    repeats = m["n_repeat_words"] / words
    variety = m["n_distinct"] / np.sqrt(words)
    ends = m["n_ends"] / words
    short = m["n_short"] / words
    return np.stack([
        vote(m["n_lettered"] / words >= 0.85, m["n_lettered"] / words < 0.8),
        vote((chars >= 3.5) & (chars <= 8), (chars < 2.5) | (chars > 12)),
        vote(symbols <= 0.02, symbols > 0.2),
        vote(letters >= 0.85, letters < 0.75),
        vote(capitals <= 0.1, capitals > 0.4),
        vote(m["n_dup_lines"] == 0, 10 * m["n_dup_lines"] > 3 * np.maximum(m["n_lines"], 1)),
        vote(repeats <= 0.1, repeats > 0.3),
        vote(variety >= 4, long_enough & (variety < 2)),
        vote((ends >= 0.005) & (ends <= 0.3), (ends > 0.6) | (long_enough & (ends == 0))),
        vote((short >= 0.1) & (short <= 0.6), long_enough & (short < 0.02)),
    ], axis=1)


def _codes(vote: np.ndarray) -> np.ndarray:
    return (vote + 1) @ (3 ** np.arange(vote.shape[1]))


def fit(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probability of each outcome, [class, rule, outcome], and of each class in [class, 0, 3], by EM from the number
    of documents per vote pattern.

    How often a rule is right is estimated for good and for bad documents apart: one that looks for capitals says "good"
    of most bad documents too, and then counts for little, while its "bad" counts for much.
    """
    outcome = codes[:, None] // (3 ** np.arange(len(RULES))) % 3
    bad_votes, good_votes = (outcome == 0).sum(1), (outcome == 2).sum(1)
    good = 1 / (1 + np.exp(4.0 * bad_votes - 0.5 * good_votes - 1.5))
    model = np.zeros((2, len(RULES), 4))
    for step in range(ROUNDS):
        for y, weight in enumerate((counts * (1 - good), counts * good)):
            for o in range(3):
                # A few made-up documents keep every rule better than chance: "bad" likelier among the bad.
                prior = (PRIOR_BAD if y == 0 else PRIOR_GOOD)[o]
                model[y, :, o] = np.log(((outcome == o) * weight[:, None]).sum(0) + prior * STRENGTH)
            model[y, :, :3] -= np.log(weight.sum() + STRENGTH)
            model[y, 0, 3] = np.log((weight.sum() + STRENGTH) / (counts.sum() + 2 * STRENGTH))
        now = posterior(outcome, model)
        if step and np.abs(now - good).max(initial=0) < 1e-9:
            break
        good = now
    return model


def posterior(outcome: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Probability that a document with these outcomes (0 bad, 1 abstains, 2 good) is good."""
    at = np.arange(len(RULES))
    bad, good = (model[y, at, outcome].sum(axis=1) + model[y, 0, 3] for y in (0, 1))
    return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def learn(documents: DataFrame) -> np.ndarray:
    """The fitted model from the votes on all documents; an empty table leaves the prior."""
    @F.arrow_udf("bigint")
    def pattern(texts: pa.Array) -> pa.Array:
        return pa.array(_codes(votes(measures(texts)))) if len(texts) else pa.array([], pa.int64())

    found = documents.groupBy(pattern(F.col("text").cast("string")).alias("p")).count().collect()
    return fit(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = "struct<" + ",".join(f"{c}:bigint" for c in BASE) + ",base_failed:boolean,kept:boolean,quality:double>"


def verdict(model: np.ndarray):
    """Arrow UDF: measures, base rule, posterior quality and decision of a text."""
    @F.arrow_udf(VERDICT)
    def judge(texts: pa.Array) -> pa.Array:
        m = measures(texts)
        if not m:
            m = {name: np.zeros(0, np.int64) for name in (*BASE, "n_lines", "n_distinct", "n_bytes", "n_letters", "n_capitals",
                                                          "n_lettered", "n_ends", "n_short")}
        good = posterior(votes(m) + 1, model)
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        columns = [pa.array(m[c]) for c in BASE] + [pa.array(failed), pa.array(~failed & (good >= 0.5)), pa.array(good)]
        return pa.StructArray.from_arrays(columns, names=[*BASE, "base_failed", "kept", "quality"])

    return judge


def document_quality(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality) per row.

    Words are runs of other characters than white space.  ``base_failed``: fewer than 50 words, or more than half of the words lie
    in three-word windows that the text repeats.  ``kept``: not failed, and good with a probability of 0.5 or more.
    NULL and empty texts have no words and fail.  Rows are judged one by one, repeated ones alike; a NULL doc_id stays NULL.
    """
    judge = verdict(learn(documents))
    return documents.select("doc_id", judge(F.col("text").cast("string")).alias("v")).select("doc_id", "v.*")


def good_documents(documents: DataFrame) -> DataFrame:
    """The rows that ``document_quality`` keeps, with all their columns."""
    judge = verdict(learn(documents))
    return documents.where(judge(F.col("text").cast("string"))["kept"])
