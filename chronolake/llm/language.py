"""Language identification by compression with per-language zstandard raw-content dictionaries.

``learn`` takes a bounded sample of passages of each language as a raw-content dictionary.  ``identify`` cuts the
letters of the whole text into pieces, compresses each with every dictionary, adds up the sizes, and names the language
with the smallest sum.  The margin is what the second smallest lies above it, as a share; a document whose margin
is narrow is rejected, its best guess being returned all the same.

Bounds of the fit: of each language PASSAGES passages of PASSAGE characters, each of a different text, and of those whole
passages while the dictionary has at most DICTIONARY bytes.  Every language is learned: LANGUAGES at a time come to the driver and to the tasks, and each
block of them is a pass over the texts, whose two smallest sizes are then compared by text.

Nulls and edges: a null text, or one without a letter, is ``und``, score 0, and rejected; with equal sizes the first
language in order of name is taken and the margin is 0; rows that repeat an id are answered one by one; a null
doc_id is carried along; other columns are ignored, so names cannot clash; an empty table gives an empty
result; without any learned language every text is ``und``.  Rows without text or lang are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_of_id, stored, table

#: Bound of the fit: characters of a passage, passages and bytes of a dictionary, languages of a pass.
PASSAGE, PASSAGES, DICTIONARY, LANGUAGES = 2000, 80, 100_000, 256
#: Characters of a piece, compression level, and the margin from which on a document is accepted.
PIECE, LEVEL, MARGIN = 4000, 6, 0.01
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> str:
    """The text in lower case with a blank for whatever is no letter or mark on one: case, digits and symbols tell no language."""
    return _OTHER.sub(" ", text.lower())


def learn_blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", passage: int = PASSAGE, passages: int = PASSAGES, dictionary: int = DICTIONARY, languages: int = LANGUAGES) -> Iterator[dict[str, bytes]]:
    """Blocks of about ``languages`` languages with a raw-content dictionary each: passages at places that the text's hash decides, of the
    different texts with the smallest hashes; copies of a text count once.  Without any language, one empty block.

    At most about ``languages`` times ``dictionary`` bytes come to the driver at once, whatever the size of ``docs``."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and length(text) > 0")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    texts = stored(hashed.groupBy("lang", "h").agg(F.count("*").alias("n")), "texts")
    sizes = stored(texts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")), "sizes")
    blocks = max(1, -(-sizes.count() // languages))
    for k in range(blocks):
        block = sizes if blocks == 1 else sizes.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k)
        yield _dictionaries(hashed, texts, block, passage, passages, dictionary)


def learn(docs: DataFrame, **options) -> dict[str, bytes]:
    """The dictionaries of all languages at once, for as many as the driver can hold."""
    return {k: v for block in learn_blocks(docs, **options) for k, v in block.items()}


def _dictionaries(hashed: DataFrame, texts: DataFrame, sizes: DataFrame, passage: int, passages: int, dictionary: int) -> dict[str, bytes]:
    # about three times the texts wanted of each language, then the exact number of them
    share = stored(sizes.select("lang", (F.lit(3.0 * passages) / F.col("texts")).alias("share")), "shares")
    part = texts.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30))  # about `languages` rows
    ranked = part.select("lang", "h", F.row_number().over(Window.partitionBy("lang").orderBy("h")).alias("k"))
    chosen = stored(ranked.where(F.col("k") <= passages), "chosen")
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - F.lit(passage), F.lit(0)) + 1) + 1
    cut = hashed.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "k", F.substr("text", start.cast("int"), F.lit(passage)).alias("piece"))
    taken = cut.groupBy("lang", "k").agg(F.min("piece").alias("piece"))
    found: dict[str, list[bytes]] = {}
    for r in sorted(taken.select("lang", "k", "piece").collect()):
        found.setdefault(r.lang, []).append(letters(r.piece).encode())
    return {k: join(v, dictionary) for k, v in sorted(found.items())}


def join(passages: list[bytes], most: int) -> bytes:
    """The passages as long as they fit, a line each; one that alone is too long is cut between characters."""
    out = passages[0].decode()[: most // 4].encode() if len(passages[0]) > most else passages[0]
    for p in passages[1:]:
        if len(out) + 1 + len(p) <= most:
            out += b"\n" + p
    return out


def _coders(dictionaries: dict[str, bytes], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name, data in dictionaries.items():
        prepared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prepared.precompute_compress(level=level)
        out.append((name, zstandard.ZstdCompressor(level=level, dict_data=prepared, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def sizes_of(text: str, coders: list, piece: int = PIECE) -> list[int]:
    """Compressed bytes of the letters of the whole text with each dictionary."""
    text = letters(text)
    parts = [text[k : k + piece].encode() for k in range(0, len(text), piece)]
    return [sum(len(coder.compress(p)) for p in parts) for _, coder in coders]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _smallest(text: str | None, coders: list, piece: int) -> tuple[str | None, int, int]:
    """The language with the smallest size, that size, and the second smallest one, or twice the largest where there is one language; no language for texts without a letter."""
    if not text or not coders or not has_letter(text):
        return None, 0, 0
    sizes = sizes_of(text, coders, piece)
    first, second = (*sorted(sizes), 2 * max(sizes))[:2]
    return coders[sizes.index(first)][0], first, second


def _answer(name: str | None, first: int, second: int, margin: float) -> tuple[str, float, float, bool]:
    """Language, score, margin, and whether rejected.  score: 0.5 at margin 0, 0.75 at ``margin``, towards 1."""
    if name is None:
        return "und", 0.0, 0.0, True
    gap = (second - first) / first
    return name, 1 - 0.5 * margin / (margin + gap) if margin else 1.0, gap, gap < margin


ANSWER = "lang_pred string, score double, margin double, rejected boolean"
_ANSWER = [("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]


def _text_key(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def told(docs: DataFrame, blocks: dict[str, bytes] | Iterable[dict[str, bytes]], margin: float = MARGIN, text_col: str = "text", piece: int = PIECE, level: int = LEVEL) -> DataFrame:
    """docs with lang_pred, score, margin, rejected, which replace columns of these names.

    One block of languages is one pass that answers each row by itself.  Of several, each pass keeps the smallest two sizes of each different text; the answer
    is found among these, as the two smallest of all are, and joined to the rows by text."""
    docs = docs.drop(*[n for n, _ in _ANSWER])
    spark, at, found = docs.sparkSession, docs.columns.index(text_col), None
    every = iter([blocks] if isinstance(blocks, dict) else blocks)
    block, following = next(every), next(every, None)
    if following is None:
        learned = spark.sparkContext.broadcast(block)

        def answer(batches):
            coders = _coders(learned.value, level)
            for batch in batches:
                rows = [_answer(*_smallest(t, coders, piece), margin) for t in pa.compute.cast(batch.column(at), pa.string()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_ANSWER)]], [*batch.schema.names, *[n for n, _ in _ANSWER]])

        return docs.mapInArrow(answer, StructType([*docs.schema.fields, *StructType.fromDDL(ANSWER).fields]))
    texts = docs.select(_text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    while block is not None:
        learned = spark.sparkContext.broadcast(block)

        def smallest(batches, learned=learned):
            coders = _coders(learned.value, level)
            for batch in batches:
                rows = [_smallest(t, coders, piece) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], pa.array([len(coders) > 1] * len(rows))], ["key", "name", "first", "second", "several"])

        part = stored(texts.mapInArrow(smallest, "key string, name string, first long, second long, several boolean").where("name IS NOT NULL").dropDuplicates(["key"]), "sizes")
        learned.unpersist()
        found = part if found is None else found.unionByName(part)
        block, following = following, next(every, None)
    order = F.array_sort(F.collect_list(F.struct("first", "name")))
    seconds = F.min(F.when(F.col("several"), F.col("second")))
    best = found.groupBy("key").agg(order.alias("o"), seconds.alias("s")).select(F.col("key").alias("_key"), F.col("o")[0]["name"].alias("_name"), F.col("o")[0]["first"].alias("_first"), F.least(F.get("o", F.lit(1))["first"], "s").alias("_second"))
    rows = docs.withColumn("_by", _text_key(text_col)).join(best, F.col("_by") == F.col("_key"), "left")
    gap = F.coalesce((F.col("_second") - F.col("_first")) / F.col("_first"), F.lit(0.0))
    there = F.col("_name").isNotNull()
    score = F.when(there, 1 - F.lit(0.5 * margin) / (F.lit(margin) + gap) if margin else F.lit(1.0)).otherwise(0.0)
    return rows.select(*docs.columns, F.coalesce("_name", F.lit("und")).alias("lang_pred"), score.alias("score"), gap.alias("margin"), (~there | (gap < margin)).alias("rejected"))


def identify(docs: DataFrame, blocks: dict[str, bytes] | Iterable[dict[str, bytes]], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, level: int = LEVEL) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of every row, by the dictionaries of ``learn`` or the blocks of ``learn_blocks``."""
    return told(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), blocks, margin, "text", piece, level).drop("text")


def held_out(doc_id: Column) -> Column:
    """One id in five is not learned from."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(5)) == 0, F.lit(False))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told with a wide enough margin, learned from the others' lang.

    Each row is answered by its own text, whatever other rows share its id."""
    inner = {n: f"_answer{k}" for k, (n, _) in enumerate(_ANSWER) if n in docs.columns}  # columns that would clash wait under other names
    found = told(docs.withColumnsRenamed(inner), learn_blocks(docs.where(~held_out(F.col("doc_id")))))
    return found.where("NOT rejected").drop(*[n for n, _ in _ANSWER]).withColumnsRenamed({v: k for k, v in inner.items()}).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn_blocks(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
