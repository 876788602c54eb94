"""Language by compression: the language whose dictionary makes a text smallest.

Per learned language a raw-content dictionary for zstandard holds pieces of a bounded sample of its labelled texts.
The words of every whole text are compressed with each dictionary, in blocks; the smallest sum names the language (ties: the smaller name),
and a narrow margin to the second marks the answer as rejected.  Texts without letters (numerals and signs are none), null texts, and all texts if no
language could be learned, are ``und`` with score 0.  Rows are judged one by one: repeated rows and extra columns don't
matter, and null or empty labels are never learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts per language that are learned from, at most, and the characters taken of each, from a place drawn by hash.
SAMPLE_ROWS = 96
SAMPLE_CHARS = 1200
DICTIONARY_BYTES = 110_000
#: Bytes compressed at once: in a longer run a text would be its own dictionary.
BLOCK_BYTES = 4096
#: An answer is rejected if the second language needs less than so much more, and less than so many bytes more.
NARROW_SHARE, NARROW_BYTES = 0.004, 4
#: How fast the score nears 1 with the bits that the second language needs more: repeats in a text count for less.
TRUST = 1 / 16


_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words of the whole text, without signs and digits."""
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language, from rows (doc_id, text, lang) chosen by a hash of the text.

    Each of the chosen texts gives a piece from anywhere in it, and all pieces of a language the same share of the bytes.
    """
    rows = labelled.where("text is not null and lang is not null and lang <> '' and text rlike '\\\\p{L}'")
    rows = rows.select("lang", "text", F.xxhash64("text").alias("key"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    # Copies are one before they are ranked, and a task passes on only its first keys of each language.
    chosen = rows.select("lang", "key").distinct().withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS).drop("place")
    start = F.pmod(F.xxhash64("key", F.lit("start")), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    pieces = rows.join(chosen, ["lang", "key"]).select("lang", "key", F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("piece"))
    found: dict[str, list[tuple[int, str]]] = {}
    for row in pieces.distinct().collect():  # SAMPLE_ROWS of each language
        found.setdefault(row.lang, []).append((row.key, row.piece))
    out = {}
    for lang, own in found.items():
        share = DICTIONARY_BYTES // len(own)
        out[lang] = b" ".join(letters(piece)[:share] for _, piece in sorted(own))
    return out


def languages(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1) and rejected."""
    names = sorted(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packers = []
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, window_log=18, chain_log=16, hash_log=17, search_log=4, min_match=4,
            target_length=0, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        for name in names:
            content = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            packers.append(zstandard.ZstdCompressor(compression_params=how, dict_data=content))
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                data = letters(text)
                if not data or not names or not any(c.isalpha() for c in text):
                    out.append(("und", 0.0, True))
                    continue
                blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
                sizes = np.array([sum(len(p.compress(b)) for b in blocks) for p in packers])
                best = int(sizes.argmin())
                more = sizes - sizes[best]
                second = int(np.delete(more, best).min()) if len(names) > 1 else int(sizes[best])
                score = 1.0 / float(np.exp2(-8.0 * TRUST * more).sum())
                narrow = second < max(NARROW_BYTES, NARROW_SHARE * sizes[best])
                out.append((names[best], score, bool(narrow)))
            langs, scores, rejected = zip(*out) if out else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
