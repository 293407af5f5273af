"""Token ids in ORC files.

A row is a document: its id and the ids of its tokens. ORC stores the integers of a
stripe run-length encoded, keeps minima and maxima of the document ids per stripe and
per row group (the row index), and a Bloom filter on them. So whole stripes can be
read by many tasks, and a lookup by document id skips the stripes and row groups that
cannot hold it. Files hold ascending ranges of document ids, ascending inside too.

Texts are encoded word by word where that is exact: the vocabulary's rules drop white
space and never join what it separates, so the ids of a text are those of its words,
one after the other. Each Python worker keeps the ids of words it has met, in two
generations of bounded size.

Defined cases: a null text is an empty one and has only the end id; null doc_ids come
first; rows that repeat a doc_id follow each other, and a range holds them in the order
of a hash of their ids; an empty table gives an empty file set and an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import in_parts, released, split_at_blanks, stored, strung, text_sizes
from tablewright.session import new_path

END_ID = 2
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1_000
ROWS_IN_FILE = 100_000
CACHED_WORDS = 700_000
WORDS_AT_ONCE = 500
#: Words that are one run of letters whatever the tokenizer's rules do to them first.
LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+").fullmatch
#: Letters between signs, of which the tokenizer's rules make words of their own.
SIGNED = re.compile(r"([!-&(-/:-@\[-`{-~]*)([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
SPECIAL = "<|"
WORD_END = "</w>"
#: A word of its own in the joined texts; it has one id, which no other word has.
MARK = "\x00"


class WordCache:
    """Word -> ids (16-bit, little endian). The older generation is dropped when the newer is full."""

    def __init__(self, tokenizer, size: int = CACHED_WORDS):
        self.tokenizer, self.size = tokenizer, size
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.mark = self._ids(MARK)[0]
        # for runs of lower-case letters, which no rule but the division at blanks changes
        rules = json.loads(tokenizer.to_str())
        division = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        rules |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": division}}
        self.plain = type(tokenizer).from_str(json.dumps(rules))
        # the last id of a run of letters is one that ends a word
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        if tokenizer.get_vocab_size() > 1 << 16 or len(self._ids(MARK)) != 1:
            raise ValueError("the vocabulary does not fit this encoder")

    def _ids(self, text: str, tokenizer=None) -> list[int]:
        return (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> None:
        runs, plain = [], []
        for word in words:
            if LETTERS(word):
                runs.append(word)
            elif MARK not in word:
                plain.append(word)
        for i in range(0, len(runs), WORDS_AT_ONCE):
            part = runs[i : i + WORDS_AT_ONCE]
            ids = np.array(self._ids(" ".join(part).lower(), self.plain), np.uint16)
            data, last = ids.tobytes(), 0
            for word, end in zip(part, ((np.flatnonzero(self.ends[ids]) + 1) * 2).tolist(), strict=True):
                self.young[word] = data[last:end]
                last = end
        for i in range(0, len(plain), WORDS_AT_ONCE):
            part = plain[i : i + WORDS_AT_ONCE]
            ids = np.array(self._ids(f" {MARK} ".join(part)), np.uint16)
            cuts = np.flatnonzero(ids == self.mark)
            for word, own in zip(part, np.split(ids, cuts), strict=True):
                self.young[word] = own[own != self.mark].tobytes()
        for word in words:
            if MARK in word:
                self.young[word] = np.array(self._ids(word), np.uint16).tobytes()

    def _fetch(self, words: list[str]) -> None:
        unknown, signed, wanted = [], [], set()
        old, young = self.old, self.young
        for word in words:
            known = old.get(word)
            if known is not None:
                young[word] = known
                continue
            parts = SIGNED(word)
            if parts is None or SPECIAL in word or len(parts[2]) == len(word):
                unknown.append(word)
            else:
                signed.append(parts)
                wanted.update(parts.groups())
        wanted -= young.keys()
        for part in wanted & old.keys():
            young[part] = old[part]
        self._learn([*{*unknown, *(wanted - young.keys())}])
        for parts in signed:
            young[parts[0]] = young[parts[1]] + young[parts[2]] + young[parts[3]]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin and end."""
        if len(self.young) > self.size:
            self.young, self.old = {"": b""}, self.young
        ends, numbers, words = split_at_blanks([_folded(t).replace("\n", " ") for t in texts])
        # a word is looked up once, however often it stands in the texts
        own = list(map(self.young.get, words))
        missing = [w for w, ids in zip(words, own, strict=True) if ids is None]
        if missing:
            self._fetch(missing)
            own = [self.young[w] if ids is None else ids for w, ids in zip(words, own, strict=True)]
        return strung(own, numbers, ends, np.uint16)

    def encode(self, texts: list[str]) -> list[bytes]:
        flat, at = self.encode_all(texts)
        return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _folded(text: str) -> str:
    """Lower case where that surely is what the tokenizer does first: Latin-1 without composition."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """The worker's cache for one vocabulary file."""
    if path not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _CACHES[path] = WordCache(Tokenizer.from_file(path))
    return _CACHES[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(vocabulary_path: str, end_id: int = END_ID):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary_path)
        for batch in batches:
            for part in in_parts(batch, text_sizes(batch.column("text"))):
                texts = [t or "" for t in part.column("text").to_pylist()]
                flat, at = cache.encode_all(texts)
                ids = np.insert(flat.astype(np.int32), at[1:], end_id)
                ends = at + np.arange(len(at))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return encode


def encoded(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of every row."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(released(encoder(vocabulary_path, end_id)), "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write ORC files of ascending document ids to ``path``.

    Texts, which are shorter than their ids, go to their range before they are encoded.
    ``part`` names the range; it ascends with the ids. A row's number splits the rows of one
    doc_id; the ranges are found without reading a text.
    """
    rows = docs.count()
    parts = max(rows // ROWS_IN_FILE + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    numbered = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    ranged = numbered.repartitionByRange(parts, "doc_id", "row").drop("row")
    tokens = encoded(ranged, vocabulary_path, end_id).withColumn("part", F.spark_partition_id())
    (
        tokens.sortWithinPartitions("doc_id", F.xxhash64("ids"))
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, ids, part); a condition on doc_id reaches the stripes' metadata."""
    rows = spark.read.schema("doc_id long, ids array<int>, part int").orc(path)
    return rows if where is None else rows.where(where)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "part", "turn")), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "turn", "n_tokens", "ids_crc32"],
        )


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_tokens`` gives."""
    rows = stored(
        tokens.select("doc_id", "ids", "part", F.xxhash64("ids").alias("turn")).mapInArrow(
            _summed, "doc_id long, part int, turn long, n_tokens long, ids_crc32 long"
        ),
        "token-digests",
    )
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("part")
        .orderBy(F.col("doc_id").asc_nulls_first(), "turn")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, F.col("part") == F.col("p"))
        .select("doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
    )


def round_trip(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Write the tokens of ``docs``, read the files back and return their digests."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary_path or vocabulary())
    return token_digests(read_tokens(spark, path))
