"""Language identification by compression: the dictionary that makes a text smallest names its language.

Each language has a zstandard dictionary of raw text. A text's size is the sum over its windows, so all of it
counts. Where the two smallest sizes are close, the text is compressed again behind samples of each language,
whose letters then shape the entropy coder; what stays narrow after that is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

#: What a language is learned from: documents, bytes of dictionary, samples and their bytes. The fit is on a bounded sample by design.
SAMPLE_DOCS, DICTIONARY, SAMPLES, SAMPLE = 160, 1 << 17, 8, 1500
#: Characters that one sampled document gives at most, and the languages that are told apart at most (the most frequent).
SAMPLE_CHARS, LANGUAGES = 8000, 64
LEVEL, WINDOW = 6, 4000
#: Relative margins: below NARROW a text is compressed again, below REJECTED it has no language.
NARROW, REJECTED = 0.03, 0.002
UNDETERMINED = "und"
_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str) -> bytes:
    """Lower-cased words of letters with single blanks; empty if there is no letter."""
    words = _LETTERS.findall(text.lower())
    return f" {' '.join(words)} ".encode("utf-8", "replace") if words else b""


@dataclass(frozen=True)
class Model:
    """Languages, most frequent first, with their dictionaries and samples."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    samples: tuple[tuple[bytes, ...], ...]


def fit(docs: DataFrame, learn_from: Column, label: str = "lang", text_column: str = "text") -> Model:
    """Learns from rows for which ``learn_from`` holds and text and label aren't null.

    Rows of each language are counted over the whole table. Then ``SAMPLE_DOCS`` texts of each at most, by hash of the
    text, come to the driver: a bounded sample, whatever the table's size. Texts of middling length are preferred; a
    text that repeats counts once, so neither ids nor copies can swell the sample.
    """
    rows = docs.where(learn_from & F.col(text_column).isNotNull() & F.col(label).isNotNull()).select(
        F.col(text_column).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    counted = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()
    if not counted:
        return Model((), (), ())
    share = F.create_map(*[x for r in counted for x in (F.lit(r.label), F.lit(4.0 * SAMPLE_DOCS / r["count"]))])
    order, n = F.xxhash64("text"), F.length("text")
    found = rows.where(F.pmod(order, F.lit(1 << 30)) < share[F.col("label")] * (1 << 30)).select(
        "label", order.alias("o"), n.alias("n"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    once = found.groupBy("label", "o", "n").agg(F.min("text").alias("text"))
    best = Window.partitionBy("label").orderBy(F.when(F.col("n").between(200, SAMPLE_CHARS), 0).otherwise(1), "o", "text")
    chosen = once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SAMPLE_DOCS).collect()
    dictionaries, samples = [], []
    for language in (r.label for r in counted):
        own = sorted((r for r in chosen if r.label == language), key=lambda r: r["rank"])
        texts = list(dict.fromkeys(letters(r.text) for r in own))
        content = b"".join(texts)
        dictionaries.append(content[:DICTIONARY])
        rest = content[DICTIONARY:] + content  # text beyond the dictionary first
        samples.append(tuple(rest[i * SAMPLE:(i + 1) * SAMPLE] for i in range(SAMPLES)))
    return Model(tuple(r.label for r in counted), tuple(dictionaries), tuple(samples))


class Classifier:
    """Sizes of a text under each language."""

    def __init__(self, model: Model):
        self.model = model
        self.by_dictionary, self.plain = [], zstandard.ZstdCompressor(level=LEVEL)
        for content in model.dictionaries:
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=WINDOW, dict_size=max(len(content), 8), write_content_size=False, write_checksum=False, write_dict_id=False)
            stored = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            stored.precompute_compress(compression_params=settings)
            self.by_dictionary.append(zstandard.ZstdCompressor(dict_data=stored, compression_params=settings))
        self.alone = [[len(self.plain.compress(s)) for s in own] for own in model.samples]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, relative margin (0 to 1), and whether it holds; ties go to the more frequent language."""
        content = letters(text) if text else b""
        if not content or not self.by_dictionary:
            return UNDETERMINED, 0.0, False
        windows = [content[i:i + WINDOW] for i in range(0, len(content), WINDOW)]
        best, margin = _smallest([sum(len(c.compress(w)) for w in windows) for c in self.by_dictionary])
        if margin < NARROW:
            best, margin = _smallest([
                sum(len(self.plain.compress(s + w)) - n for s, n in zip(own, alone) for w in windows)
                for own, alone in zip(self.model.samples, self.alone)])
        return self.model.languages[best], margin, margin >= REJECTED


def _smallest(sizes: list[int]) -> tuple[int, float]:
    best = min(range(len(sizes)), key=sizes.__getitem__)
    if len(sizes) == 1:
        return best, 1.0
    second = min(s for i, s in enumerate(sizes) if i != best)
    return best, min(1.0, max(0.0, (second - sizes[best]) / max(second, 1)))


@lru_cache(maxsize=2)
def _classifier(model: Model) -> Classifier:
    return Classifier(model)


RESULT = "struct<lang_pred: string, score: double, accepted: boolean>"


def predictor(docs: DataFrame, model: Model):
    """A function from a text column to struct<lang_pred, score, accepted>.

    ``lang_pred`` is a learned language, or ``und`` for null texts, texts without a letter, and all texts if nothing
    was learned; ``score`` is the relative margin; ``accepted`` is false for ``und`` and for margins below ``REJECTED``.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)  # LANGUAGES * (DICTIONARY + samples) bytes at most

    @F.arrow_udf(RESULT)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = _classifier(sent.value)
        for column in texts:
            found = [classifier.predict(t) for t in column.to_pylist()]
            yield pa.array([dict(zip(("lang_pred", "score", "accepted"), f)) for f in found],
                           pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())]))

    return lambda column: predict(column.cast("string"))


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def predictions(docs: DataFrame, label: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, accepted; learned from rows not held out.

    Null ids are never held out. Repeated rows each give a row; a very long text is read whole, window by window.
    Other columns aren't read; an empty table gives no rows.
    """
    model = fit(docs, ~held_out(), label)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       predictor(docs, model)(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")


def identified(docs: DataFrame, label: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language isn't rejected; ``label`` is what it learns from.

    Null texts and texts without a letter have no language and go; repeated rows go or stay together; a very long text
    is read whole. Columns of any name are kept. If no row is labelled, none stays; an empty table gives no rows.
    """
    model = fit(docs, ~held_out(), label)
    return docs.where(predictor(docs, model)(F.col("text"))["accepted"])
