"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw content: texts of a bounded sample of its labelled documents. A
text is cut into blocks, every block is encoded once with each dictionary, and the language whose
encodings are the smallest in all is chosen. The choice is rejected where the runner-up's size is
within a margin of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.llm.words import map_batches
from gaugewright.session import checkpointed

#: The bound of the labelled sample: documents of a language, characters of each, bytes of a dictionary, languages.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, MAX_LANGUAGES = 120, 4000, 64 << 10, 512

#: Bytes encoded at a time; short blocks keep the dictionary at work throughout a long text.
BLOCK_BYTES = 4000

#: A choice is rejected if its lead over the runner-up is below this share of its own size.
NARROW = 0.01

_LETTER = regex.compile(r"\p{L}")

# zstandard settings: match length from 4, tables no larger than the dictionary needs
_SEARCH = {"strategy": 5, "min_match": 4, "search_log": 6, "hash_log": 16, "chain_log": 17, "window_log": 18, "target_length": 16}

_FOLD = {c: " " for c in range(128) if not chr(c).isalpha()}


def learn_dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each non-null lang of ``labelled`` (text, lang; other columns are not looked at).

    The sample is each language's ``sample_docs`` distinct texts of the least hash, so it
    depends neither on ids nor on the order or the partitions of rows. Rows are chosen without their texts; a language's hot share never meets in one
    task, for each task passes on its own least ones only. Every chosen text gives an equal share of
    the dictionary, so that all of the sample is learned from; what short ones leave goes to the
    others. More than ``max_languages`` labels are an error: the sample is bounded.
    """
    row = (F.xxhash64("text"), F.hash("text"))
    usable = labelled.where("lang is not null and text is not null").select("lang", "text", row[0].alias("_h"), row[1].alias("_g"))
    order = Window.partitionBy("lang").orderBy("_h", "_g")
    chosen = checkpointed(usable.select("lang", "_h", "_g").distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample_docs).select("lang", "_h", "_g"))
    if (found := chosen.select("lang").distinct().count()) > max_languages:
        raise ValueError(f"{found} languages; max_languages is {max_languages}")
    texts = usable.join(F.broadcast(chosen), ["lang", "_h", "_g"], "left_semi").select("lang", "_h", "_g", F.substring("text", 1, sample_chars).alias("text")).distinct()
    content: dict[str, list[bytes]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["_h"], r["_g"])):  # at most sample_docs texts a language
        content.setdefault(r["lang"], []).append(_fold(r["text"]) + b" ")
    return {lang: _shared(own, dictionary_bytes) for lang, own in content.items()}


def _shared(texts: list[bytes], total: int) -> bytes:
    """The beginnings of texts, of equal length but for texts that are shorter, of ``total`` bytes in all at most."""
    left, out = total, []
    for k, text in enumerate(sorted(texts, key=len)):
        out.append(text[: left // (len(texts) - k)])
        left -= len(out[-1])
    return b"".join(out)


def _fold(text: str) -> bytes:
    """Lower-case words without ASCII digits and signs."""
    return " ".join(text.lower().translate(_FOLD).split()).encode("utf-8", "surrogatepass")


_compressors: dict[tuple, dict] = {}


def _tools(dictionaries: dict[str, bytes]) -> dict:
    """This process's compressors, one for each language; only the last set is remembered."""
    key = tuple(sorted((k, hash(v)) for k, v in dictionaries.items()))
    if key not in _compressors:
        import zstandard

        _compressors.clear()
        settings = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, write_checksum=False, **_SEARCH)
        tools = {}
        for lang in sorted(dictionaries):
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            tools[lang] = zstandard.ZstdCompressor(dict_data=content, compression_params=settings)
        _compressors[key] = tools
    return _compressors[key]


def classify(text: str, tools: dict) -> tuple[str, float, float]:
    """The language, a score from 0 to 1 and the lead over the runner-up as a share of the least size."""
    folded = _fold(text)
    blocks = [b" " + folded[a : a + BLOCK_BYTES] + b" " for a in range(0, max(1, len(folded)), BLOCK_BYTES)]
    sizes = sorted((sum(len(tool.compress(b)) for b in blocks), lang) for lang, tool in tools.items())
    least, lang = sizes[0]
    # each byte saved counts as two bits of evidence: words repeat, so that not all eight are news
    weights = sum(2.0 ** -min(1000.0, 2.0 * (size - least)) for size, _ in sizes)
    lead = (sizes[1][0] - least) / least if len(sizes) > 1 else 1.0
    return lang, 1.0 / weights, lead


def identify(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1) and rejected.

    ``docs`` has doc_id and text; no other column is looked at. lang_pred is one of the learned
    languages, or ``und`` with score 0 for a null text or one without letters, or if nothing was
    learned. Ties go to the language of the smaller name. ``rejected`` marks choices whose lead is
    narrow, and every ``und``. Repeated rows get a row each; an empty table gives none.
    """
    content = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(content.value)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py()
                if text is None or not content.value or not _LETTER.search(text):
                    out.append(("und", 0.0, True))
                else:
                    lang, score, lead = classify(text, tools)
                    out.append((lang, score, lead < narrow))
            columns = [pa.array([r[i] for r in out], type=t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def fold_of(doc_id: Column, folds: int = 3) -> Column:
    """The fold of a document: crc32 of its id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string")) % folds
