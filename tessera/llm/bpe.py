"""BPE encoding and decoding through a table of distinct words.

Texts are cut into blocks of documents. A block becomes a list of its distinct words and, for each
document, the places of its words in that list. The lists of all blocks are dealt by word and
sorted, so equal words meet and each distinct word is encoded once; its ids go back to every block
that holds it, where they are put in each word's position. Decoding joins the distinct words'
ids with the vocabulary's pieces. No text is shuffled, and no table of words is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, TEXT, keyed, rows_of

#: A block ends at so many documents or characters, whichever comes first.
BLOCK_DOCS, BLOCK_CHARS = 8192, 24 << 20

# The split of the tokenizer kind that has a fast path, and the letters, digits and blanks below U+0180.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _DIGITS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")
_BEYOND = re.compile("[^\x00-ſ]|İ")


class Splitter:
    """Words of a text as the tokenizer's normaliser and pre-tokeniser give them, special tokens as words of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        plain = all(not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
        norms = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.fast = norms == ["NFC", "Replace", "Lowercase"] and cut.get("pattern") == {"Regex": _KNOWN_SPLIT} and cut.get("invert") is True
        if not plain or spec["decoder"] is not None:
            raise ValueError("this operator takes tokenizers with verbatim special tokens and pieces joined by a blank")
        if not self.fast:
            raise ValueError("this operator takes tokenizers that split words as described in its module")

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self._cut and "<|" in text:
            out = []
            for part in self._cut.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _BEYOND.search(text) is None:
            return _FAST.findall(text.lower())
        norm = self.tok.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]

    @lru_cache(maxsize=1)  # noqa: B019  one splitter for each task
    def _bytes(self):
        from tokenizers import pre_tokenizers

        return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for piece, _ in self._bytes().pre_tokenize_str(word) for t in self.tok.model.tokenize(piece)]

    def pieces(self) -> list[tuple[int, str]]:
        return sorted((i, p) for p, i in self.tok.get_vocab(with_added_tokens=True).items())


@lru_cache(maxsize=2)
def _splitter(path: str) -> Splitter:
    return Splitter(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list]]:
    """(name, keys, texts); the name tells the partition, the block's number in it and a digest of the content: the same whenever it is read again."""
    from pyspark import TaskContext

    partition, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        keys, start, size, part = batch.column(0), 0, 0, []
        for i, (x,) in enumerate(rows_of(batch, 1)):
            part.append(x)
            size += len(x or "")
            if i + 1 == batch.num_rows or len(part) >= BLOCK_DOCS or size >= BLOCK_CHARS:
                own = keys.slice(start, len(part))
                h = hashlib.sha256(repr(own.to_pylist()).encode())
                for t in part:
                    h.update(b"\0" if t is None else t.encode() + b"\1")
                yield f"{partition}.{number}.{h.hexdigest()[:12]}", own, part
                start, size, part, number = i + 1, 0, [], number + 1


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


def _pack(a: np.ndarray) -> bytes:
    return _compressor().compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def word_rows(documents: DataFrame, path: str) -> DataFrame:
    """``(block, place, word)``: the distinct words of each block, in order of their first place."""

    def run(batches):
        split = _splitter(path)
        for name, _, texts in _blocks(batches):
            words: dict[str, None] = {}
            for x in texts:
                words.update(dict.fromkeys(split.words(x)))
            words = list(words)
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int32()), pa.array(part, pa.string())], names=["block", "place", "word"])

    return documents.mapInArrow(run, "block string, place int, word string")


def document_rows(documents: DataFrame, path: str, key: str) -> DataFrame:
    """``(block, key, n, places)``: each document's words as places in its block's list, packed."""

    def run(batches):
        split = _splitter(path)
        for name, keys, texts in _blocks(batches):
            place: dict[str, int] = {}
            sizes, places = [], []
            for x in texts:
                ws = split.words(x)
                for w in dict.fromkeys(ws):
                    if w not in place:
                        place[w] = len(place)
                sizes.append(len(ws))
                # The four bytes of the numbers apart from each other: the high ones are mostly equal.
                places.append(_pack(np.fromiter(map(place.__getitem__, ws), np.uint32, len(ws)).view(np.uint8).reshape(-1, 4).T.copy()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), keys, pa.array(sizes, pa.int64()), pa.array(places, pa.binary())], names=["block", key, "n", "places"])

    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField(key, documents.schema[KEY].dataType), T.StructField("n", T.LongType()), T.StructField("places", T.BinaryType())])
    return documents.mapInArrow(run, schema)


def encode_words(words: DataFrame, path: str, buffer: int = 200_000) -> DataFrame:
    """``(block, places, lengths, ids)``: packed parts of each block's word list with the ids of its words.

    Rows are dealt by word and sorted, so each distinct word is encoded once, when its run begins.
    """

    def run(batches):
        split, last, ids = _splitter(path), None, []
        held: dict[str, tuple[list, list, list]] = {}
        n = 0

        def out():
            rows = [(b, _pack(np.array(p, np.uint32)), _pack(np.array(k, np.uint32)), _pack(np.array(v, np.uint32))) for b, (p, k, v) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "places", "lengths", "ids"])

        for batch in batches:
            for block, place, word in zip(*(batch.column(c).to_pylist() for c in ("block", "place", "word")), strict=True):
                if word != last:
                    last, ids = word, split.encode(word)
                p, k, v = held.setdefault(block, ([], [], []))
                p.append(place)
                k.append(len(ids))
                v.extend(ids)
                n += 1
                if n >= buffer:
                    yield out()
                    n = 0
        if held:
            yield out()

    dealt = words.repartition(F.col("word")).sortWithinPartitions("word")
    return dealt.mapInArrow(run, "block string, places binary, lengths binary, ids binary")


def encode_decode(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """For every row: ``key, n_tokens, ids array<int>, decoded`` plus digests ``ids_sha256`` and ``decoded_sha256``.

    Ids are those of the whole text without special tokens added; special tokens that the text holds
    count as such. ``decoded`` joins the pieces of the ids by blanks, as the tokenizer's decode does
    where it has no decoder. Null and empty texts have no tokens and decode to an empty string.
    Repeated rows each get a row. ``keep_ids=False`` leaves out the two long columns. The documents are read twice and
    must be the same both times (a table or a written stage is); where they are not, RuntimeError is raised, no wrong row made.
    """
    docs = keyed(documents, key, text).select(KEY, TEXT)
    lists = encode_words(word_rows(docs, path), path)
    spoken = _splitter(path).pieces()
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(spoken)  # the vocabulary: fixed, some ten thousand pieces
    dtype = documents.schema[key].dataType
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    long = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if keep_ids else []
    schema = T.StructType([T.StructField(key, dtype), *fields, *long])

    def join(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            raise RuntimeError("a block's words came without its documents: the input changed between two readings")
        table = _pieces(shared)
        place, begin, size, flat, at = [], [], [], [], 0
        for p, k, v in zip(parts["places"], parts["lengths"], parts["ids"], strict=True):
            p, k, v = _unpack(p, np.uint32), _unpack(k, np.uint32), _unpack(v, np.uint32)
            place.append(p)
            size.append(k)
            begin.append(at + np.cumsum(k) - k)
            flat.append(v)
            at += len(v)
        if place:
            order = np.argsort(np.concatenate(place))
            begin, size, flat = np.concatenate(begin)[order], np.concatenate(size)[order].astype(np.int64), np.concatenate(flat)
        else:
            begin = size = flat = np.zeros(0, np.int64)
        texts, spoken_words = [], []
        listed = flat.tolist()
        for b, k in zip(begin.tolist(), size.tolist(), strict=True):
            own = listed[b : b + k]
            texts.append(" ".join(map(str, own)))
            spoken_words.append(" ".join([table[i] for i in own]))
        out = []
        for doc, n, packed in zip(rows[key], rows["n"], rows["places"], strict=True):
            places = _unpack(packed, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() if n else np.zeros(0, np.uint32)
            if n and int(places.max()) >= len(texts):
                raise RuntimeError("a block's words are missing: the input changed between two readings")
            own = places.tolist()
            ids = " ".join([texts[i] for i in own])
            decoded = " ".join([spoken_words[i] for i in own])
            row = [doc, int(size[places].sum()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
            out.append(row + ([list(map(int, ids.split())), decoded] if keep_ids else []))
        return pd.DataFrame(out, columns=[f.name for f in schema.fields], dtype=object)

    blocks = document_rows(docs, path, key)
    return blocks.groupBy("block").cogroup(lists.groupBy("block")).applyInPandas(join, schema)


def _pieces(shared) -> list[str]:
    pairs = shared.value
    if not hasattr(shared, "_table"):
        table = [""] * (pairs[-1][0] + 1)
        for i, p in pairs:
            table[i] = p
        shared._table = table
    return shared._table
