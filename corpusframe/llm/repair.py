"""Token-ID / binary output: token ids in shards compressed by Re-Pair grammars.

Documents are dealt out by ranges of doc_id and encoded in that order. Each task cuts its ids into shards of about
``SHARD_TOKENS``; in a shard, frequent pairs of neighbouring symbols are replaced by new symbols, round after round,
until no pair occurs ``LEAST`` times. A shard stores its rules, the expansion length of each and the last sequence, so that any
document is decoded alone: lengths lead to its symbols, rules to its ids.

Shards are rows of a Parquet table in the shared folder, so they survive lost executors and can be read from anywhere.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import SLICE_BYTES, shared_dir, slices

END_ID = 2
SHARD_TOKENS = 1 << 21
PAIRS, LEAST = 16384, 24  # new symbols of a round, occurrences that a pair must have
MAGIC = b"RPG1"
JOINED = 1000  # distinct pieces encoded as one text
KNOWN = 300_000  # pieces that a task remembers (some 50 MB)
#: bytes at which a byte-level tokenizer starts a new word, and bytes that are white space in no character that they belong to
SEPARATORS, PLAIN = b"\n ", np.zeros(256, bool)
PLAIN[33:127] = PLAIN[128:] = True
#: marks before which it starts a new word behind an ASCII letter or digit
MARKS, SOLID = b".,;:!?", np.zeros(256, bool)
SOLID[48:58] = SOLID[65:91] = SOLID[97:123] = True


def visible(lead: np.ndarray, second: np.ndarray, last: np.ndarray, two: np.ndarray) -> np.ndarray:
    """No for any character of two or three bytes that may be white space, by its bytes; ``two``: it may have two bytes.

    White space beyond ASCII is C2 85, C2 A0 and some characters that begin E1 9A, E2 80, E2 81 or E3 80. Other characters
    with these beginnings are taken for it as well, which costs a little time only.
    """
    three = (lead >= 0xE1) & (lead <= 0xE3) & ((second == 0x80) | (second == 0x81) | (second == 0x9A))
    return ~(three | (two == 0xC2) & ((last == 0x85) | (last == 0xA0)))


def visible_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before byte ``at`` is surely no white space."""
    b = [data[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    return PLAIN[b[0]] & ((b[0] < 128) | visible(b[2], b[1], b[0], b[1]))


def visible_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at byte ``at`` is surely no white space."""
    b = [data[np.minimum(at + k, len(data) - 1)] for k in (0, 1)]
    return PLAIN[b[0]] & ((b[0] < 128) | visible(b[0], b[1], b[1], b[0]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts; a slice's distinct pieces are encoded once, and remembered. Beyond ``KNOWN``, only those that came
    again stay.

    A byte-level tokenizer starts a new word at a single space or line feed between two other characters and at a mark
    behind an ASCII letter or digit, and merges nothing across words. Texts are cut there into pieces (a separator or mark
    and what follows), a slice's pieces are dictionary encoded by Arrow, and ids are gathered by a vectorised take. This
    holds only for tokenizers without normalizer, put-in prefix space, dropout, and added tokens that touch white space or
    hold such a place: ``by_pieces`` says whether the file is of this kind; with any other, texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split, model = made["pre_tokenizer"] or {}, made["model"]
        added = made["added_tokens"]
        self.by_pieces = (
            made["normalizer"] is None
            and made["truncation"] is None
            and made["padding"] is None
            and split.get("type") == "ByteLevel"
            and split.get("add_prefix_space") is False
            and split.get("use_regex") is True
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or not t["content"] or re.search(r"\s|[^\x00-\x7f]|[0-9A-Za-z][.,;:!?]", t["content"]) for t in added)
        )
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # a token of a byte-level vocabulary is spelt with one character for each byte
        self.bytes = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        """``known``: pieces whose ids are ``count`` ones from ``begin`` on among ``ids``; ``again``: later slices they came in."""
        self.known = pa.array([], pa.large_binary())
        self.ids, self.begin, self.count, self.again = (np.empty(0, k) for k in (np.uint32, np.int64, np.int64, np.int64))

    def _keep(self, most: int) -> None:
        """Forgets all but the ``most`` pieces that came again the most often, and counts anew."""
        stay = np.sort(np.argsort(-self.again, kind="stable")[: min(most, np.count_nonzero(self.again))])
        self.known = self.known.take(pa.array(stay))
        self.ids, self.count = _gather(self.ids, self.begin[stay], self.count[stay]), self.count[stay]
        self.begin, self.again = np.cumsum(self.count) - self.count, np.zeros(len(stay), np.int64)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces in ``known``; new ones are learnt."""
        if len(self.known) > KNOWN:
            self._keep(KNOWN // 2)
        found = pc.index_in(pieces, value_set=self.known)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        self.again[found.drop_null().to_numpy(zero_copy_only=False)] += 1
        places = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            learnt = pieces.take(pa.array(new))
            ids, sizes = self._pieces(learnt)
            places[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, learnt])
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(sizes) - sizes))
            self.count = np.concatenate((self.count, sizes))
            self.again = np.concatenate((self.again, np.zeros(len(new), np.int64)))
            self.ids = np.concatenate((self.ids, ids))
        return places

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.concatenate(found) if found else np.empty(0, np.uint32), np.array([len(f) for f in found], np.int64)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``_each`` of distinct pieces. Those that begin and end as words do are encoded joined, and cut by their bytes."""
        data, at = _bytes(pieces)
        ends = at[1:]
        if not len(ends):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        begins = at[:-1]
        joins = _any(data[begins], SEPARATORS) & (at[1:] - begins >= 2)
        joins &= visible_at(data, begins + 1) & visible_before(data, at[1:])
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        sizes, parts = np.zeros(len(ends), np.int64), []
        for lo in range(0, int(joins.sum()), JOINED):
            pick = order[lo : min(lo + JOINED, int(joins.sum()))]
            raw, cut = _bytes(pieces.take(pa.array(pick)))
            ids, _ = self._each([raw[cut[0] : cut[-1]].tobytes().decode()])
            last = np.searchsorted(np.cumsum(self.bytes[ids]), cut[1:] - cut[0], "right")
            sizes[pick] = np.diff(np.concatenate(([0], last)))
            parts.append(ids)
        alone = order[int(joins.sum()) :]
        ids, sizes[alone] = self._each([x.decode() for x in pieces.take(pa.array(alone)).to_pylist()])
        parts.append(ids)
        begin = np.empty(len(order), np.int64)
        begin[order] = np.concatenate(([0], np.cumsum(sizes[order])[:-1]))
        return _gather(np.concatenate(parts), begin, sizes), sizes

    def encode(self, texts: pa.Array, limit: int = SLICE_BYTES):
        """``(first text, end text, ids, edges)`` by slices of ``texts``; ``ids[edges[k] : edges[k + 1]]`` are the ids of the
        slice's k-th text, the end id not among them. Null is empty text."""
        for lo, hi, data, offsets in slices(texts, limit):
            if not self.by_pieces:
                raw = data.tobytes()
                ids, sizes = self._each([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
                yield lo, hi, ids, np.concatenate(([0], np.cumsum(sizes)))
                continue
            starts, first = piece_starts(data, offsets)
            bounds = np.concatenate((starts, [len(data)]))
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
            coded = pieces.dictionary_encode()
            at = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            del bounds, pieces, coded
            sizes = self.count[at]
            ids = _gather(self.ids, self.begin[at], sizes)
            yield lo, hi, ids, np.concatenate(([0], np.cumsum(sizes)))[first]


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8) if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def _any(data: np.ndarray, values: bytes) -> np.ndarray:
    """Whether each byte is one of a few."""
    out = data == values[0]
    for v in values[1:]:
        out |= data == v
    return out


def _gather(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[begin[k] : begin[k] + sizes[k]]`` of all k, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(begin - ends + sizes, sizes)
    at += np.arange(total)
    return values[at]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin, and each text's first piece (one more at the end); empty texts have none.

    A piece begins with a text, at a space or line feed between two bytes that are surely no white space, and at a mark
    behind an ASCII letter or digit.
    """
    inner = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero(_any(data[1:-1], SEPARATORS)) + 1
    at = at[PLAIN[data[at - 1]] & PLAIN[data[at + 1]]]
    inner[at[visible_before(data, at) & visible_at(data, at + 1)]] = True
    edge = offsets[1:-1]
    inner[edge[edge > 0] - 1] = False  # a text's last byte has no text behind it; its next one is another text's
    at = np.flatnonzero(_any(data[1:], MARKS)) + 1
    inner[at[SOLID[data[at - 1]]]] = True
    inner[offsets[:-1]] = True
    inner[len(data)] = False
    starts = np.flatnonzero(inner)
    return starts, np.searchsorted(starts, offsets)


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """Kept by a Python worker from task to task."""
    return Encoder(path)


def compress(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, rules)``: rule k stands for symbol ``vocabulary + k`` and holds two earlier symbols.

    No rule spans the end id, so documents begin and end between symbols.
    """
    seq, rules, size = ids.astype(np.int64), [], vocabulary
    # places of pairs that may be frequent; a pair of earlier symbols that is rare stays so, as its places only get fewer
    likely = np.flatnonzero((seq[:-1] != END_ID) & (seq[1:] != END_ID))
    while len(likely):
        key = seq[likely]
        key <<= 32
        key |= seq[likely + 1]
        bucket = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)
        some = (np.bincount(bucket, minlength=1 << 20) >= LEAST)[bucket]  # a pair can't be more frequent than its bucket
        likely = likely[some]  # one by one: they are as large as the sequence
        key = key[some]
        bucket = bucket[some]
        ordered = np.sort(key)
        edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
        pairs, n = ordered[edge], np.diff(np.concatenate((edge, [len(ordered)])))
        chosen = np.flatnonzero(n >= LEAST)
        if not len(chosen):
            break
        pairs = pairs[chosen[np.lexsort((pairs[chosen], -n[chosen]))[:PAIRS]]]
        slot = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        pairs = np.sort(pairs[np.unique(slot, return_index=True)[1]])  # the most frequent of each slot; the rest waits a round
        slot = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        holds, number = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, np.int64)
        holds[slot], number[slot] = pairs, size + np.arange(len(pairs))
        hit = holds[bucket] == key
        at, symbol = likely[hit], number[bucket[hit]]
        # of places that overlap, every second one is replaced
        edge = np.concatenate(([True], np.diff(at) > 1))
        begin = at[np.maximum.accumulate(np.where(edge, np.arange(len(at)), 0))]
        even = (at - begin) % 2 == 0
        at, symbol = at[even], symbol[even]
        seq[at] = symbol
        keep, near = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        keep[at + 1] = False
        near[likely] = near[at] = near[at[at > 0] - 1] = True  # beside new symbols all pairs are new
        seq, near = seq[keep], near[keep]
        del key, bucket
        likely = np.flatnonzero(near[:-1])
        likely = likely[(seq[likely] != END_ID) & (seq[likely + 1] != END_ID)]
        rules.append(np.stack((pairs >> 32, pairs & 0xFFFFFFFF), 1))
        size += len(pairs)
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.int64)


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    lengths = [1] * vocabulary
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    return np.array(lengths[vocabulary:], np.int64)


def pack(ids: np.ndarray, doc_tokens, vocabulary: int) -> bytes:
    """A shard: magic, counts, rules, expansion lengths, tokens of each document, sequence; all little-endian."""
    seq, rules = compress(ids, vocabulary)
    wide = vocabulary + len(rules) > 1 << 16
    lengths = expansion_lengths(rules, vocabulary)
    head = MAGIC + struct.pack("<IIQIB", vocabulary, len(rules), len(seq), len(doc_tokens), wide)
    return head + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + np.array(doc_tokens, "<u4").tobytes() + seq.astype("<u4" if wide else "<u2").tobytes()


class Shard:
    """Reads a packed shard, whole or one document."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        vocabulary, n_rules, n_seq, n_docs, wide = struct.unpack_from("<IIQIB", blob, 4)
        at = 4 + struct.calcsize("<IIQIB")
        self.rules = np.frombuffer(blob, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.concatenate((np.ones(vocabulary, np.int64), np.frombuffer(blob, "<u4", n_rules, at)))
        at += 4 * n_rules
        self.doc_tokens = np.frombuffer(blob, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        self.seq = np.frombuffer(blob, "<u4" if wide else "<u2", n_seq, at).astype(np.int64)
        self.vocabulary = vocabulary
        self.doc_ends = np.cumsum(self.doc_tokens)
        self.flat = None

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        if self.flat is None:
            self.start = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
            self.flat = np.empty(int(self.lengths.sum()), np.uint32)
            self.flat[: self.vocabulary] = np.arange(self.vocabulary)
            start, length, flat = self.start.tolist(), self.lengths.tolist(), self.flat
            for k, (a, b) in enumerate(self.rules.tolist(), self.vocabulary):
                mid = start[k] + length[a]
                flat[start[k] : mid] = flat[start[a] : start[a] + length[a]]
                flat[mid : mid + length[b]] = flat[start[b] : start[b] + length[b]]
        n = self.lengths[seq]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[seq] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def document(self, k: int) -> np.ndarray:
        """Ids of one document: its symbols are found by expansion lengths, only they are expanded."""
        ends = np.cumsum(self.lengths[self.seq])
        stop = int(self.doc_ends[k])
        start = stop - int(self.doc_tokens[k])
        lo, hi = np.searchsorted(ends, (start, stop), "right")
        if hi < len(ends) and ends[hi] - self.lengths[self.seq[hi]] < stop:
            hi += 1
        return self._expand(self.seq[lo:hi])


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encodes ``doc_id, text`` in ascending doc_id order (nulls last, ties by text) and writes the shard table.

    Null text is empty and has the end id only. A document longer than a shard makes a shard of its own.
    """
    kind = docs.schema["doc_id"].dataType
    source = tokenizer or default_tokenizer()

    def run(batches):
        encoder = encoder_of(source)
        vocabulary, place, shard = max(encoder.size, END_ID + 1), TaskContext.get().partitionId(), 0
        owners, parts, sizes, total = [], [], [], 0

        def row():
            each = np.concatenate(sizes)
            blob = pack(np.concatenate(parts), each, vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([shard], pa.int32()), pa.array([total], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), pa.concat_arrays(owners)), pa.array([blob], pa.binary())], ["place", "shard", "n_tokens", "doc_ids", "blob"])

        for batch in batches:
            for lo, hi, ids, edges in encoder.encode(batch.column(1)):
                ends = edges[1:] + np.arange(1, hi - lo + 1)  # an end id behind each document
                closed = np.full(int(ends[-1]), END_ID, np.uint32)
                inner = np.ones(len(closed), bool)
                inner[ends - 1] = False
                closed[inner] = ids
                at = 0
                while at < hi - lo:  # a shard ends with the document that fills it
                    begin = int(ends[at - 1]) if at else 0
                    stop = min(hi - lo, int(np.searchsorted(ends, begin + SHARD_TOKENS - total, "left")) + 1)
                    owners.append(batch.column(0).slice(lo + at, stop - at))
                    parts.append(closed[begin : int(ends[stop - 1])])
                    sizes.append(np.diff(np.concatenate(([begin], ends[at:stop]))))
                    total += len(parts[-1])
                    at = stop
                    if total >= SHARD_TOKENS:
                        yield row()
                        shard += 1
                        owners, parts, sizes, total = [], [], [], 0
        if sizes:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    ordered.mapInArrow(run, f"place int, shard int, n_tokens long, doc_ids array<{kind.simpleString()}>, blob binary").write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the stored shards.

    Starts add up in two steps: tokens of the tasks that wrote before (as many numbers as partitions), and of the
    task's shards before.
    """
    shards = spark.read.parquet(path)
    sums = sorted((r[0], r[1]) for r in shards.groupBy("place").agg(F.sum("n_tokens")).collect())
    before, offsets = 0, []
    for place, n in sums:
        offsets.append((place, before))
        before += n
    places = F.broadcast(spark.createDataFrame(offsets, "place int, place_start long"))
    run_sum = F.sum("n_tokens").over(Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = shards.select("place", "shard", "n_tokens").withColumn("shard_start", run_sum - F.col("n_tokens")).drop("n_tokens")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column("blob")[k].as_py())
                ids = shard.ids().astype("<u4")
                ends = shard.doc_ends
                begin = ends - shard.doc_tokens
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                n = len(crc)
                same = lambda c: pa.array([batch.column(c)[k].as_py()] * n, pa.int32())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("place"), same("shard"), batch.column("doc_ids")[k].values, pa.array(begin), pa.array(shard.doc_tokens), pa.array(crc, pa.int64())], ["place", "shard", "doc_id", "begin", "n_tokens", "ids_crc32"])

    decoded = shards.select("place", "shard", "doc_ids", "blob").mapInArrow(run, f"place int, shard int, doc_id {kind}, begin long, n_tokens long, ids_crc32 long")
    out = decoded.join(starts, ["place", "shard"]).join(places, "place")
    return out.select("doc_id", (F.col("place_start") + F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, read back from the shards that ``write_shards`` makes of it.

    Null and empty texts have the end id alone. Rows that repeat, an id or a whole row, are documents of their own, one
    behind the other (ties by text); null ids come last. An empty table gives no rows; further columns aren't looked at.
    ``path`` stays for readers and is the caller's to delete; without one it is a new folder of the shared one.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer)
    return read_shards(spark, path)


def op4_repair(spark, sf_dir: str) -> DataFrame:
    """``token_files`` of all ``documents``."""
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
