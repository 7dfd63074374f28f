"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_uid

#: Words whose ids a worker remembers, and their longest in bytes. Beyond, it keeps the half that it met most; what it
#: forgets costs time and changes no result.
REMEMBERED, LONGEST = 200_000, 64
#: Characters of texts that are encoded at once; one longer text stays whole.
SLICE = 2_000_000
#: Letters before whose following sentence marks the tokenizer cuts, and words that it leaves whole.
LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
BEFORE_MARK, WHOLE = f"([{LETTERS}])([.,;:!?])", f"^(?:[{LETTERS}]+|[.,;:!?]+)$"
#: Pieces that are packed together.
GROUP = 4096
#: Times that partitions with gaps may exchange documents.
ROUNDS = 3


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space, with each word encoded once.

    Its pre-tokenizer never joins across white space, so a text's ids are those of its words, cut at ASCII
    white space; other white space stays inside a word and is left to the tokenizer. It also lowers letters and cuts
    between a letter and a sentence mark, so that is done before words are told apart. What is remembered are Arrow
    arrays: words and, for each, its ids' place in one array.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = pa.array([""])
        self.start, self.length, self.met = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts, and how many each has. Empty words, which have no ids, stand at some edges."""
        low = pc.ascii_lower(texts)
        for mark in self.special:  # these are found before letters are lowered
            if pc.any(pc.match_substring(low, mark.lower())).as_py():
                low = texts
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(low, pattern=BEFORE_MARK, replacement=r"\1 \2"))
        return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and the number of each."""
        ids, counts = [], np.zeros(len(words), np.int64)
        whole = pc.match_substring_regex(words, pattern=WHOLE).to_numpy(zero_copy_only=False)
        some = words.filter(pa.array(whole)).to_pylist()
        joined = [" ".join(some[i : i + 1000]) for i in range(0, len(some), 1000)]  # costs less than a text each
        flat = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *flat])
        last = np.flatnonzero(self.ends[flat])
        if len(last) != len(some):  # a tokenizer that does not mark the ends of words
            whole[:] = False
        else:
            counts[whole] = np.diff(last, prepend=-1)
            ids.append(flat)
        each = self.tokenizer.encode_batch_fast(words.filter(pa.array(~whole)).to_pylist(), add_special_tokens=False)
        counts[~whole] = [len(e.ids) for e in each]
        flat = np.concatenate([*ids, *(np.array(e.ids, np.uint32) for e in each), np.zeros(0, np.uint32)])
        first = np.zeros(len(words), np.int64)
        order = np.concatenate([np.flatnonzero(whole), np.flatnonzero(~whole)])
        first[order] = np.cumsum(counts[order]) - counts[order]
        return gather(flat, first, counts), counts

    def _learn(self, words: pa.Array) -> None:
        ids, length = self._encoded(words)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])
        self.ids = np.concatenate([self.ids, ids])
        self.known = pa.concat_arrays([self.known, words])

    def _forget(self) -> None:
        """Keep the words met most, at most half of REMEMBERED, and none over LONGEST."""
        rank = np.where(pc.binary_length(self.known).to_numpy() > LONGEST, 0, self.met)
        rank[0] = rank.max() + 1  # the empty word
        kept = np.sort(np.argsort(-rank, kind="stable")[: REMEMBERED // 2])
        kept = kept[rank[kept] > 0]
        self.ids = gather(self.ids, self.start[kept], self.length[kept])
        self.known, self.length, self.met = self.known.take(pa.array(kept)), self.length[kept], self.met[kept] // 2 + 1
        self.start = np.cumsum(self.length) - self.length

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, each text followed by the id `end`, and the number of ids of each text. No text is null."""
        words, counts = self._words(texts)
        coded = words.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        at, place = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if len(self.known) > REMEMBERED:
            self._forget()
        found = pc.index_in(place, value_set=self.known)
        if found.null_count:
            missing = pc.is_null(found)
            self._learn(place.filter(missing))
            spot = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            spot[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.known) - found.null_count, len(self.known))
        else:
            spot = found.to_numpy(zero_copy_only=False).astype(np.int64)
        self.met[spot] += np.bincount(at, minlength=len(place))
        at = spot[at]
        stops = np.cumsum(counts)
        length = np.insert(self.length[at], stops, 1)  # a place for the end of each text
        start = np.insert(self.start[at], stops, 0)
        is_end = np.cumsum(length)[stops + np.arange(len(texts))] - 1
        flat = gather(self.ids if len(self.ids) else np.zeros(1, np.uint32), start, length)
        flat[is_end] = end
        return flat, np.diff(is_end + 1, prepend=0)


def gather(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at start, one after the other."""
    first = np.cumsum(length) - length
    return ids[np.repeat(start - first, length) + np.arange(int(length.sum()))]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for a worker process, which keeps it for its next tasks."""
    return WordEncoder(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have about SLICE bytes together."""
    size = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(size) // SLICE, prepend=-1))
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(size)], strict=True):
        yield batch.slice(i, j - i)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null and empty texts are the end id alone."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for part in (p for b in batches if b.num_rows for p in _slices(b)):
            flat, sizes = encoder.encode(part["text"].fill_null(""), end_id)
            flat = flat.astype("<u4", copy=False)
            n = np.maximum(1, -(-sizes // capacity))
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            at = (np.cumsum(sizes) - sizes)[row] + start
            crc = [zlib.crc32(flat[a : a + k].tobytes()) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [part["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
            pa.default_memory_pool().release_unused()  # else a worker holds it, also in stages that follow

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int, depth: int = 24) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions, in integers.

    One family counts an item over capacity - e as a whole bin, drops items under e and keeps the others (e up
    to half the capacity; e = 0 is the total length over capacity). The other rounds item sizes to k-ths of a bin.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.cumsum(count), np.cumsum(count * x)
    e = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    best = int((large - (-middle // capacity)).max())
    for k in range(1, depth + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)  # times capacity * k
        best = max(best, -int(-(value * count).sum() // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, into the open bin with the least room that suffices.

    Room is at most `capacity`, so open bins are stacks by room, and a bit set finds the least room.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            stacks[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets


def _pack(rows: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Deal rows to groups of about GROUP, pack each, and certify it. Written, as the next steps read it often."""
    groups = max(1, -(-rows.count() // GROUP))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "uid"], ascending=[False, True])
        length = part["length"].to_numpy()
        bins, offset = best_fit_decreasing(length, capacity)
        fill = np.bincount(bins, weights=length).astype(np.int64)
        gap = len(fill) - lower_bound(length, capacity)
        # A partition with a gap gives up the documents of every bin that has room; one without, its emptiest bin.
        loose = (fill[bins] < capacity) if gap else (bins == int(fill.argmin())) & (fill[bins] < capacity)
        at = (np.int64(turn) << 56) + (part["deal"].to_numpy().astype(np.int64) << 24) + bins
        return part.drop(columns="deal").assign(sequence_id=at, offset=offset, loose=loose, gap=gap)

    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
    kind = "doc_id string, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, loose boolean, gap long"
    return materialise(dealt.groupBy("deal").applyInPandas(pack, kind).withColumn("doc_id", F.col("doc_id").cast("long")))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Every document's tokens and an end id 0 in sequences of at most `capacity` tokens.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Longer documents are cut into pieces
    of `capacity`; whole pieces fill a sequence each. The others are packed in groups by best-fit decreasing. A
    group whose bins reach its lower bound is settled but for its emptiest bin; other groups put the documents of
    bins with room into a pool that is dealt anew and packed again, and the result stands if it needs fewer bins.
    Null text: the end id alone. Null ids and repeated rows are packed like others; pieces of one length go by their
    row; a very long text is encoded whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    pieces = materialise(with_uid(token_pieces(docs, tokenizer_path, capacity)))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    packed = _pack(pieces.filter(F.col("length") < capacity), capacity, 1)
    settled = [whole.select(out)]
    for turn in range(2, ROUNDS + 2):
        loose = packed.filter("loose")
        before = loose.agg(F.countDistinct("sequence_id").alias("bins"), F.countDistinct(F.shiftright("sequence_id", 24)).alias("groups")).first()
        if before["groups"] < 2:
            break
        again = _pack(loose.select("doc_id", "piece", "start", "length", "ids_crc32", "uid"), capacity, turn)
        if again.agg(F.countDistinct("sequence_id").alias("bins")).first()["bins"] >= before["bins"]:
            break
        settled.append(packed.filter(~F.col("loose")).select(out))
        packed = again
    settled.append(packed.select(out))
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result
