"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sampled excerpts. A text is encoded, block by
block, with every dictionary; the language whose dictionary gives the fewest bytes is chosen, and the
choice is rejected when the second is hardly larger. Blocks keep a long text's own repeats from
hiding what the dictionary knows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, small_batches

#: The bounded training sample: about so many excerpts per language, each of so many characters at most.
SAMPLE_DOCS, EXCERPT_CHARS = 290, 400
#: Languages that get a dictionary: the most frequent ones.
MOST_LANGUAGES = 500
#: Bytes of one dictionary, and of one block of text.
DICTIONARY_BYTES, BLOCK = 112 << 10, 4 << 10
LEVEL = 3
#: Reject if the best is not this share smaller than the second, in bytes.
MARGIN = 0.002
#: How fast the score moves from one half to one with the bytes between best and second.
SCORE_SCALE = 0.12
UNDETERMINED = "und"


#: ASCII bytes other than letters become spaces, so that case, marks and digits say nothing.
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def folded(text: str) -> bytes:
    """Lower-case UTF-8 with one space between runs of letters."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split())


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary per language, from a sample of rows that are not held out and have a lang and a letter.

    The sample is drawn by a hash of the id at a rate that gives about SAMPLE_DOCS rows of each
    language, whatever the table's size; its excerpts (at most EXCERPT_CHARS characters from a
    hashed place) come to the driver: some 116 kB for each of MOST_LANGUAGES languages at most.
    """
    pick = F.xxhash64(F.lit("language"), F.col(doc_id), F.col(text))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~is_held_out(F.col(doc_id)))
    counts = dict(rows.groupBy(F.col(lang)).count().orderBy(F.desc("count"), F.col(lang)).limit(MOST_LANGUAGES).collect())
    if not counts:
        return {}
    rows = rows.where(F.col(lang).isin(list(counts)))
    rate = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_DOCS / n))))[F.col(lang)]
    place = F.pmod(F.shiftright(pick, 20), F.greatest(F.length(text) - EXCERPT_CHARS, F.lit(1))).cast("int") + 1
    drawn = rows.where(F.pmod(pick, F.lit(1 << 20)) < rate * (1 << 20))
    got = drawn.select(F.col(lang), pick, F.substring(F.col(text), place, F.lit(EXCERPT_CHARS))).collect()
    parts: dict[str, list[bytes]] = {}
    for own, _, excerpt in sorted(got):
        parts.setdefault(own, []).append(folded(excerpt))
    return {k: b" ".join(v)[-DICTIONARY_BYTES:] for k, v in parts.items()}


class Classifier:
    """Dictionaries, ready for one process."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.names = sorted(dictionaries)
        self.encode = []
        for k in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.encode.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False).compress)

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole text with each dictionary."""
        body = folded(text)
        cut = [body[k : k + BLOCK] for k in range(0, len(body), BLOCK)]
        return [sum(len(encode(b)) for b in cut) for encode in self.encode]

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, rejected."""
        if not self.names:
            return UNDETERMINED, 0.0, True
        found = self.sizes(text)
        order = sorted(range(len(found)), key=lambda k: (found[k], self.names[k]))
        best = found[order[0]]
        score = 1 / sum(math.exp(SCORE_SCALE * (best - n)) for n in found)
        margin = (found[order[1]] - best) / found[order[1]] if len(order) > 1 else 1.0
        return self.names[order[0]], score, margin < MARGIN


def _predict_task(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Classifier(model.value).predict
        for b in batches:
            found = [predict(t) if ok else (UNDETERMINED, 0.0, True) for t, ok in zip(b.column("text").to_pylist(), b.column("has_letter").to_pylist())]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*b.schema.names[:-2], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of docs (doc_id by default) with lang_pred, score and rejected, for every whole text.

    Texts that are null or have no letter are `und` with score 0, rejected. Repeated rows are
    predicted each for itself; a null doc_id never counts as held out; an empty table, or one
    without any lang, gives only `und`. Equal sizes go to the language that sorts first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs))
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), text.alias("text"), text.rlike(r"\p{L}").alias("has_letter"))
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"c{i} {types[c]}" for i, c in enumerate(keep)), "lang_pred string", "score double", "rejected boolean"])
    made = rows.mapInArrow(_predict_task(model), schema)
    return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "rejected")


def language_report(docs: DataFrame) -> DataFrame:
    """Predictions of all documents, with the mark of those that were held out of training."""
    return identify(docs).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    made = identify(docs, docs.columns)
    return made.where(~F.col("rejected")).select(*docs.columns)
